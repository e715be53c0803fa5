"""The quality operator's sites and the archives of equal payloads, against plain Python."""

from __future__ import annotations

import base64
import hashlib
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quire.llm import quality, warc


def strength(sites):
    """Pseudo-documents of a prior for (n, good, outer) of sites, by moments."""
    some = [s for s in sites if s[0] > 1]
    found = sum(n * (g / n - o) ** 2 for n, g, o in some)
    chance = sum(o * (1 - o) for n, g, o in some)
    spread = sum(o * (1 - o) * (n - 1) for n, g, o in some)
    beyond = (found - chance) / spread if spread else 0
    return min(quality.MOST_STRENGTH, max(quality.LEAST_STRENGTH, 1 / beyond - 1)) if beyond > 0 else quality.MOST_STRENGTH


def test_scores_equal_plain_sums(spark):
    rng = random.Random(11)
    hosts = ["a.org"] * 6 + ["b.net", "b.net", "c.com", "d.de"]
    docs = [(i, " ".join(rng.choices(["word", "Other", "it.", "|", "7", "and"], k=rng.randrange(40))), f"{rng.choice(hosts)}/{rng.randrange(3)}") for i in range(400)]
    good = {"a.org": 0.8, "b.net": 0.3, "c.com": 0.5, "d.de": 0.9}
    labels = [(i, int(rng.random() < good[s.split("/")[0]])) for i, _, s in docs if rng.random() < 0.6]
    train = lambda i: i % 4 != 1
    out = quality.score(
        spark.createDataFrame(docs, "doc_id bigint, text string, source string"), spark.createDataFrame(labels, "doc_id bigint, quality int"), F.col("doc_id") % 4 != 1
    ).collect()
    p = {r["doc_id"]: r["doc_score"] for r in out}
    known = {i: q for i, q in labels if train(i)}
    own = {i: (1.0, float(known[i])) if i in known else (quality.SOFT, quality.SOFT * p[i]) for i, _, _ in docs}
    paths, at = defaultdict(lambda: [0.0, 0.0]), defaultdict(lambda: [0.0, 0.0])
    for i, _, s in docs:
        for k, d in ((s, paths), (s.split("/")[0], at)):
            d[k][0] += own[i][0]
            d[k][1] += own[i][1]
    n, g = sum(x[0] for x in at.values()), sum(x[1] for x in at.values())
    centre = (g + 0.5) / (n + 1)
    a = strength([(x[0], x[1], centre) for x in at.values()])
    outer = {h: (x[1] + a * centre) / (x[0] + a) for h, x in at.items()}
    b = strength([(x[0], x[1], outer[s.split("/")[0]]) for s, x in paths.items()])
    where = {i: s for i, _, s in docs}
    assert len(out) == len(docs)
    for r in out:
        i, s = r["doc_id"], where[r["doc_id"]]
        h, mine = at[s.split("/")[0]], own[i]
        host = (h[1] - mine[1] + a * centre) / (h[0] - mine[0] + a)
        path = (paths[s][1] - mine[1] + b * host) / (paths[s][0] - mine[0] + b)
        logit = math.log(p[i] / (1 - p[i])) + math.log(path / (1 - path)) - math.log(centre / (1 - centre))
        assert r["host_share"] == pytest.approx(host) and r["path_share"] == pytest.approx(path)
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-logit)))


def test_own_label_is_left_out(spark):
    """Two documents alike but for their labels, at one path each alone: their scores don't tell the labels."""
    docs = [(i, "some plain words", f"h.org/{i}") for i in (0, 1)] + [(i, "other words " * (i % 5), "z.org/") for i in range(2, 60)]
    labels = [(i, i % 2) for i in range(60)]
    out = {r["doc_id"]: r for r in quality.score(
        spark.createDataFrame(docs, "doc_id bigint, text string, source string"), spark.createDataFrame(labels, "doc_id bigint, quality int"), F.lit(True)
    ).collect()}
    assert out[0]["path_share"] >= out[1]["path_share"]  # the good one's label serves the other alone


@pytest.mark.parametrize("least", [0, 40])
def test_archives_of_repeated_payloads(spark, least):
    rng = random.Random(3)
    texts = ["", "short", "é" * 30, "<p>a long one</p>" * 20, None]
    pages = [(i, f"http://h/{i}", rng.choice(texts) if i % 3 else f"<p>{i}</p>" * (i % 9)) for i in rng.sample(range(1000), 500)]
    out = warc.read(warc.write(spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(5), least_bytes=least)).collect()
    body = {i: (t or "").encode() for i, _, t in pages}
    first: dict[bytes, int] = {}
    for i in sorted(body):
        first.setdefault(body[i], i)
    want = {}
    for i, x in body.items():
        again = len(x) >= least and first[x] != i
        digest = base64.b32encode(hashlib.sha1(x).digest()).decode()
        want[i] = (len(x), digest, "revisit" if again else "response", first[x] if again else None, b"" if again else x)
    assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], bytes(r["payload"] or b"")) for r in out} == want
    assert len(out) == len(pages) and sum(w[2] == "revisit" for w in want.values()) > 100

"""URL filters against a look at every rule, with random rules, hosts and paths."""

from __future__ import annotations

import random
import re

import pytest

from quire.llm import urlrules


def lowered(t: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def judged(url: str | None, rules: list[tuple]) -> tuple:
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (lowered(m[1]), m[2]) if m else ("", "")
    best = None
    for h, p, verdict in rules:
        if h is None or verdict is None:
            continue
        h, p = lowered(h), p or ""
        if f".{host}".endswith(f".{h}") and path.startswith(p):
            rank = (len(h) + len(p), len(h), f"{h}{p}", [-ord(c) for c in verdict])
            if best is None or rank > best[0]:
                best = rank, f"{h}{p}", verdict
    return host, path, best and best[1], best[2] if best else "allow"


@pytest.mark.parametrize("seed", range(2))
def test_random_rules(spark, seed):
    r = random.Random(seed)
    labels = ["net", "org", "a", "É", "é", "A", "b", "a-b", "\U0010ffff", "", "a0"]
    steps = ["/", "/a", "/a/", "a", "É", "\U0010ffff", "x", " ", ""]
    host = lambda: ".".join(r.choices(labels, k=r.randint(1, 4)))
    path = lambda: "".join(r.choices(steps, k=r.randint(0, 5)))
    rules = [(host(), path(), r.choice(["allow", "block"])) for _ in range(60)]
    rules = list({(lowered(h), p): (h, p, v) for h, p, v in rules}.values()) + [(None, "/", "block"), ("org", None, "block") if (("org", "") not in {(lowered(h), p) for h, p, _ in rules}) else (None, None, None)]
    urls = [f"http://{host()}{'/' + path() if r.random() < 0.9 else ''}{r.choice(['', '?q=/a', '#/a'])}" for _ in range(400)]
    urls += ["http://a.net/" + "\U0010ffff" * 2 + "x", "HTTP://É.net/", "none", "", None, "http://", "http:///a", urls[0], "http://hot.net/a"] + ["http://hot.net/a/x"] * 200
    pages = spark.createDataFrame(list(enumerate(urls)) + [(0, urls[0])], "page_id bigint, url string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    for parts in (4, 256):
        got = sorted(tuple(x) for x in urlrules.judge(pages, table, parts=parts).collect())
        want = sorted([(i, *judged(u, rules)) for i, u in enumerate(urls)] + [(0, *judged(urls[0], rules))])
        assert [x[:4] for x in got if x[3]] == [x[:4] for x in want if x[3]]
        assert [(x[0], x[1], x[2], x[4]) for x in got] == [(x[0], x[1], x[2], x[4]) for x in want]


def test_nothing_beyond_a_prefix(spark):
    pages = spark.createDataFrame([(1, "http://a.net/\U0010ffff\U0010ffffx"), (2, "http://É.net/"), (3, "http://X.É.net/q")], "page_id bigint, url string")
    rules = spark.createDataFrame([("net", "/", "block"), ("É.net", "", "allow")], "host string, path string, verdict string")
    out = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlrules.judge(pages, rules).collect()}
    assert out == {1: ("net/", "block"), 2: ("É.net", "allow"), 3: ("É.net", "allow")}

"""one_of_each against all pairs, and its choice of rows."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from quire.llm import minhash, simhash


def similarity(a: str, b: str) -> float:
    s, t = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.lower().split(), b.lower().split()))
    return len(s & t) / len(s | t)


def kept_by_pairs(texts: list[str]) -> set[int]:
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if similarity(texts[i], texts[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return set(root)


def near_copies(seed: int) -> list[str]:
    """Texts with copies of which one to four words are others: similarities on both sides of 0.8."""
    r = random.Random(seed)
    out = []
    for _ in range(25):
        words = [f"w{r.randrange(5000)}" for _ in range(r.randrange(60, 120))]
        out.append(" ".join(words))
        for changes in (1, 2, 3, 4):
            other = list(words)
            for k in r.sample(range(len(other)), changes):
                other[k] = f"x{r.randrange(5000)}"
            out.append(" ".join(other))
    r.shuffle(out)
    return out


def test_every_pair_from_the_bound_on(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_TEXTS", 2)
    texts = near_copies(1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r["doc_id"] for r in simhash.one_of_each(docs).collect()} == kept_by_pairs(texts)


def test_search_finds_the_components():
    texts = near_copies(2)
    root = list(range(len(texts)))
    for i, j in minhash.search([minhash.shingles(t, 5) for t in texts]):
        a, b = root[i], root[j]
        root = [min(a, b) if r in (a, b) else r for r in root]
    assert set(root) == kept_by_pairs(texts)
    assert minhash.search([]) == [] and minhash.search([np.zeros(0, np.uint64)] * 2) == []


def test_rows_are_chosen_by_class_not_by_id(spark):
    words = [f"w{i}" for i in range(100)]
    near = [*words[:-1], "other"]
    rows = [(1, "an id with two texts of its own here"), (1, "and this is quite another text of it"), (1, "and this is quite another text of it")]
    rows += [(None, " ".join(words)), (None, " ".join(near)), (None, "without an id and a text like no other"), (9, "w8 w9 and so on to the end of it"), (None, "w8 w9 and so on to the end of it")]
    kept = [tuple(r) for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert len(kept) == 5 and {rows[0], rows[1], rows[5], rows[6]} < set(kept)
    assert sum(t in (" ".join(words), " ".join(near)) for _, t in kept) == 1


def test_fingerprints_find_candidates(spark, monkeypatch):
    """The stage's candidates come from fingerprints too: without any MinHash key it still finds copies whose fingerprints are linked."""
    whole = simhash.sketches

    def without_keys(words):
        return lambda text: F.struct(whole(words)(text)["node"].alias("node"), F.array().cast("array<bigint>").alias("keys"), whole(words)(text)["print"].alias("print"))

    monkeypatch.setattr(simhash, "sketches", without_keys)
    words = [f"w{i}" for i in range(2000)]
    copy = " ".join([*words[:-1], "other"])
    rows = [(1, " ".join(words)), (2, copy), (3, "a text that has nothing in common with the others")]
    a, b = (simhash.fingerprint(t, 5) for _, t in rows[:2])
    assert (a ^ b).bit_count() <= simhash.RADIUS
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"] for r in kept} == {1, 3}


def test_components_end_with_stars(spark, monkeypatch):
    """Edges that already join every node to the smallest of its component take no round, others only those that they need."""
    names = []
    monkeypatch.setattr(simhash, "written", lambda df, name, f=simhash.written: names.append(name) or f(df, name))
    table = lambda edges: spark.createDataFrame(edges, "a bigint, b bigint")
    roots = lambda edges: {r["node"]: r["root"] for r in simhash.components(table(edges)).collect()}
    assert roots([(1, 2), (1, 3), (5, 9), (-4, -3), (3, 1), (7, 7)]) == {2: 1, 3: 1, 9: 5, -3: -4} and names == ["edges"]
    assert roots([]) == {} and names == ["edges"] * 2
    assert roots([(1, 3), (2, 3), (4, 5)]) == {2: 1, 3: 1, 5: 4} and "star" in names
    for edges in ([(1, 2), (2, 3)], [(1, 3), (2, 3)]):
        assert not simhash._stars(table(edges))


def test_learning_gives_the_drivers_memory_back(spark, monkeypatch):
    from quire.llm import toxicity

    given = []
    monkeypatch.setattr(toxicity, "trim", lambda: given.append(1), raising=False)
    docs = spark.createDataFrame([(i, f"text number {i} of some words " * 3) for i in range(40)], "doc_id bigint, text string")
    assert toxicity.fit_from_labels(docs, docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic"))) is not None and given

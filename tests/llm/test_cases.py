"""The odd cases that every operator and stage must bear: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

from __future__ import annotations

import hashlib
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import langid, packing, quality, simhash, suffixtree, toxicity, urlrules, warc, webp, winnow

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
LONG = "word " * 40_000
ROWS = [
    (1, "the cat sat on the mat and the dog ran off", "en"),
    (1, "the cat sat on the mat and the dog ran off", "en"),
    (2, None, "en"),
    (3, "", None),
    (4, "die katze sass auf der matte und der hund lief", "de"),
    (5, " \t\n ", "de"),
    (6, LONG, "en"),
    (None, "no id here at all my friend so what", None),
    (7, "12345 67890 ...", "en"),
    (8, "é", "fr"),
]
SCHEMA = "doc_id bigint, text string, lang string"
PAGES = [
    (3, "http://a.example.net/en/x?q#f", "<p>one</p>"),
    (1, "HTTPS://B.Example.NET/en/", "<p>one</p>"),
    (1, "HTTPS://B.Example.NET/en/", "<p>one</p>"),
    (2, None, None),
    (4, "no scheme", ""),
    (None, "http://x.org/fr/1\n2", "<p>one</p>"),
    (5, "http://net/", "y" * 100_000),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Rows with extra columns whose names others use."""
    rows = spark.createDataFrame(ROWS, SCHEMA)
    return rows.select("doc_id", "text", "lang", F.lit("src").alias("source"), F.lit(1).alias("score"), F.lit(2).alias("print"), F.lit(3).alias("node"), F.lit(4).alias("n"))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 1), (4, 1, 1), (None, 1, 1), (99, 1, 0)], "doc_id bigint, quality int, toxic int")


def test_toxicity(spark, docs, labels):
    model = toxicity.fit_from_labels(docs, labels)
    assert model is None  # too few texts: the score is 0
    out = toxicity.score_documents(docs, model).collect()
    assert len(out) == len(ROWS) and all(r["toxicity"] == 0 and r["score"] == 1 for r in out)
    texts = [f"{w} thing number {i} here".encode() for i in range(40) for w in ("fine", "good")]
    bad = [f"you moron scum number {i} there".encode() for i in range(80)]
    model = toxicity.fit(bad, texts, 0.5)
    out = {r["doc_id"]: r["toxicity"] for r in toxicity.score_documents(docs, model).collect()}
    assert all(0 <= s <= 1 for s in out.values()) and out[2] == out[3]
    assert toxicity.score_documents(docs.limit(0), model).count() == 0


def test_language(spark, docs):
    model = langid.fit({"en": ["the cat and the dog"] * 5, "de": ["die katze und der hund"] * 5}, "en")
    out = {(r["doc_id"], r["f"]["lang"]) for r in docs.select("doc_id", langid.identifier(spark, model)(F.col("text")).alias("f")).collect()}
    assert {(2, "und"), (3, "und"), (5, "und"), (7, "und"), (1, "en"), (4, "de"), (8, "en")} <= out
    assert langid.fit_from_rows(docs.limit(0)) is None and langid.identify(["a"], None)[0] == ["und"]
    assert langid.fit_from_rows(docs) is not None


def test_media(spark, docs):
    out = webp.store(docs).select("doc_id", "text", "image.n_bytes", webp.described(F.col("image.media")).alias("r"), webp.pixels(F.col("image.media")).alias("p")).collect()
    assert len(out) == len(ROWS)
    for r in out:
        raw = (r["text"] or "").encode()
        whole = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert (r["n_bytes"], r["r"]["payload_bytes"]) == (len(raw), len(whole)) and r["p"]["samples"] == whole
        assert r["r"]["payload_sha256"] == hashlib.sha256(whole).hexdigest() and r["r"]["tail_crc32"] == zlib.crc32(whole[-16:])
    assert webp.store(docs.limit(0)).count() == 0


def test_packing(spark, docs):
    out = packing.pack(docs, TOKENIZER).collect()
    by: dict = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 2048
    assert sum(r["doc_id"] == 1 for r in out) == 2 and [r["length"] for r in out if r["doc_id"] == 2] == [1]
    assert sum(r["length"] for r in out if r["doc_id"] == 6) == 40_001
    assert packing.pack(docs.limit(0), TOKENIZER).count() == 0


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(1, "The CAT sat on the mat and the dog ran off!"), (2, "katze sass"), (3, None), (4, "..."), (None, "word")], "item_id bigint, text string")
    found = winnow.find(docs.drop("n"), items, into="leak").select("doc_id", "leak.*")
    out = {(r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in found.collect()}
    assert {(1, 11, 11, ("1",)), (2, 0, 0, ()), (3, 0, 0, ()), (4, 10, 2, ("2",)), (6, 40_000, 0, ())} <= out and found.count() == len(ROWS)
    assert winnow.find(docs, items.limit(0)).where("leak.n_hit > 0").count() == 0
    assert winnow.find(docs.limit(0), items).count() == 0


def test_urls(spark):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").withColumn("rule", F.lit("x")).withColumn("id", F.lit(0))
    rules = spark.createDataFrame([("net", "/", "block"), ("net", "/", "allow2"), ("example.net", "/en/", "allow"), ("org", "/fr/", "allow"), (None, "/", "block"), ("x.org", None, "block")], "host string, path string, verdict string")
    out = [tuple(r) for r in urlrules.judge(pages, rules.where("verdict <> 'allow2'")).collect()]
    assert out.count((1, "b.example.net", "/en/", "example.net/en/", "allow")) == 2
    assert (3, "a.example.net", "/en/x", "example.net/en/", "allow") in out and (2, "", "", None, "allow") in out and (4, "", "", None, "allow") in out
    assert (5, "net", "/", "net/", "block") in out and (None, "x.org", "/fr/1\n2", "org/fr/", "allow") in out and len(out) == len(PAGES)
    assert {r["verdict"] for r in urlrules.judge(pages, rules.limit(0)).collect()} == {"allow"}
    assert urlrules.judge(pages.limit(0), rules).count() == 0


def test_suffix_tree(spark, docs):
    out = suffixtree.score(docs, F.col("doc_id") != 4).collect()
    got = {(r["doc_id"], r["n_tokens"], r["n_known"]) for r in out}
    assert len(out) == len(ROWS) and {(2, 1, 1), (3, 1, 1), (5, 1, 1), (6, 40_001, 40_001)} <= got and (4, 11, 1) in got
    assert suffixtree.score(docs.limit(0), F.lit(True)).count() == 0
    empty = suffixtree.score(docs, F.lit(False)).collect()  # nothing to learn from
    assert {r["train_tokens"] for r in empty} == {0} and {r["n_known"] for r in empty} == {0}


def test_simhash(spark, docs):
    out = [tuple(r) for r in simhash.classes(docs).collect()]
    zero = "0" * 16
    assert len(out) == len(ROWS) and sum(r[0] == 1 for r in out) == 2
    assert {(2, zero, 2), (3, zero, 2), (5, zero, 2)} <= set(out)
    assert simhash.classes(docs.limit(0)).count() == 0
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 2, 4, 6, 7, 8, None]


def test_warc(spark):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").withColumn("first", F.lit(0)).withColumn("sha", F.lit("x"))
    out = warc.read(warc.write(pages)).collect()
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in out), key=str)
    assert got == sorted(
        [(3, 10, "revisit", 1), (1, 10, "response", None), (1, 10, "response", None), (2, 0, "response", None), (4, 0, "revisit", 2), (None, 10, "revisit", 1), (5, 100_000, "response", None)], key=str
    )
    assert [bytes(r["payload"]) for r in out if r["page_id"] == 5] == [b"y" * 100_000]
    assert warc.write(pages.limit(0)).count() == 0


def test_quality(spark, docs, labels):
    out = quality.score(docs, labels, F.col("doc_id") > 0).collect()
    assert len(out) == len(ROWS) and all(0 < r["score"] < 1 for r in out)
    assert quality.score(docs, labels.limit(0), F.lit(True)).count() == len(ROWS)
    assert quality.score(docs.limit(0), labels, F.lit(True)).count() == 0
    sites = docs.withColumn("source", F.when(F.col("doc_id") == 1, None).otherwise(F.concat(F.lit("a.org/"), F.col("doc_id"))))
    assert quality.score(sites, labels, F.lit(True)).count() == len(ROWS)


def test_pipeline_stages(spark, docs, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "die katze sass auf der matte und der hund lief weg")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, str(tmp_path))
            if name != "packing":
                assert out.columns == docs.columns
            n = out.count()
            assert name == "packing" or n <= rows.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_duplicates", "decontamination", "packing"]

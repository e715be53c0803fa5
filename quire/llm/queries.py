"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import langid, packing, quality, simhash, suffixtree, toxicity, urlrules, warc, webp, winnow
from quire.llm.common import id_fold


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (_table(spark, sf_dir, t) for t in ("documents", "labels"))
    fold = id_fold("doc_id", 5)
    model = toxicity.fit_from_labels(docs, labels, fold != 0)
    return toxicity.score_documents(docs.select("doc_id", "text"), model).select(
        "doc_id",
        (fold == 0).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = id_fold("doc_id", 4)
    found = langid.identifier(spark, langid.fit_from_rows(docs, fold != 2))(F.col("text"))
    return docs.select("doc_id", (fold == 2).alias("held_out"), found.alias("found")).select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score")


def op3_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    read = webp.store(docs).select("doc_id", "image.n_bytes", webp.described(F.col("image.media")).alias("r"))
    return read.select("doc_id", "n_bytes", "r.*")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = winnow.find(docs, _table(spark, sf_dir, "benchmark")).select("doc_id", "leak.n_words", "leak.n_hit", "leak.items")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


#: The rules of the url query.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlrules.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), rules)


OP6_SQL = """
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages)
SELECT page_id, host, path,
       CASE WHEN net AND en THEN 'example.net/en/' WHEN net THEN 'net/' WHEN com THEN 'example.com/de/' WHEN org THEN 'org/fr/' END AS rule,
       CASE WHEN net AND en THEN 'allow' WHEN net OR com THEN 'block' ELSE 'allow' END AS verdict
FROM (
  SELECT *,
         ('.' || host) LIKE '%.net' AND starts_with(path, '/') AS net,
         ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') AS en,
         ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') AS com,
         ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') AS org
  FROM parts)
"""


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc.read(archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = suffixtree.score(docs, id_fold("doc_id", 7) != 2)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (_table(spark, sf_dir, t) for t in ("documents", "labels"))
    scored = quality.score(docs.select("doc_id", "text", "source"), labels.select("doc_id", "quality"), id_fold("doc_id", 5) != 0)
    good = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "score", good, "doc_score", "host_share", "path_share")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_language_id": op2_language_id,
    "op3_webp": op3_webp,
    "op4_packing": op4_packing,
    "op5_decontamination": op5_decontamination,
    "op6_url_filters": op6_url_filters,
    "op7_suffix_tree": op7_suffix_tree,
    "op8_simhash": op8_simhash,
    "op9_warc": op9_warc,
    "op10_quality": op10_quality,
}
ORACLE_SQL: dict[str, str] = {"op6_url_filters": OP6_SQL}

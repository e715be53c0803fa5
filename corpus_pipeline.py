"""A corpus pipeline: toxicity, language, near duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last
return the columns of documents. run() applies them to the table documents, each stage's result
written as Parquet in the shared folder and read again by the next.

Cases that the operators leave open: a null or letterless text has no language and goes with the
language stage; an empty table passes through every stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import langid, packing, simhash, toxicity, winnow
from quire.llm.common import unused, written

#: A text is rejected as toxic from this score on.
TOXIC = 0.5
#: A text has a language if its best one knows at least about this share of its n-grams, alone.
CERTAIN = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity bound, by dictionaries trained on those of them that have labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    score = toxicity.scorer(spark, toxicity.fit_from_labels(docs.select("doc_id", "text"), labels))
    return docs.where(score(F.col("text")) < TOXIC)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the filters know."""
    find = langid.identifier(spark, langid.fit_from_rows(docs.select("doc_id", "text", "lang")))
    return docs.where(find(F.col("text"))["score"] >= CERTAIN)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    into = unused("leak", docs.columns)
    found = winnow.find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), into=into)
    return found.where(F.col(f"`{into}`.n_hit") == 0).drop(into)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of 2048."""
    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("language", keep_known_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL expresses none of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed corpus."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

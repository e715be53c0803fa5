"""Stored pages and results: tables of transcriptions and layouts, files of HTML, and the model as an operator."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import markup as M

PAGES = "doc_id bigint, page_number int, text string"
REGIONS = "doc_id bigint, page_index int, region_no int, json string, width double, height double"


def pages(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Stored page texts, as parquet, json or csv; columns and types are fixed."""
    reader = spark.read.schema(PAGES)
    return reader.option("header", True).csv(path) if kind == "csv" else reader.format(kind).load(path)


def texts(spark: SparkSession, path: str) -> DataFrame:
    """Text files as one-page documents: path and text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def layouts(spark: SparkSession, path: str) -> DataFrame:
    """A layout model's records, one JSON a region."""
    return spark.read.schema(REGIONS).json(path)


def write_html(documents: DataFrame, path: str, buckets: int | None = None) -> None:
    """Documents (doc_id, html) as text files, one folder each, committed by Spark's writer.

    That is for as many documents as a folder may hold; with buckets they are rows of Parquet files in so many folders, by the hash of doc_id, from which read_html() takes one.
    """
    if buckets is None:
        documents.select("doc_id", F.col("html").alias("value")).write.partitionBy("doc_id").mode("overwrite").text(path)
        return
    _bucketed(documents.select("doc_id", "html"), buckets).write.partitionBy("bucket").mode("overwrite").parquet(path)


def write_pages(pages: DataFrame, path: str, buckets: int | None = None) -> None:
    """Page artefacts (doc_id, page_number, html) likewise."""
    if buckets is None:
        pages.select("doc_id", "page_number", F.col("html").alias("value")).write.partitionBy("doc_id", "page_number").mode("overwrite").text(path)
        return
    _bucketed(pages.select("doc_id", "page_number", "html"), buckets).write.partitionBy("bucket").mode("overwrite").parquet(path)


def _bucket(doc_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(doc_id.cast("bigint")), F.lit(buckets)).cast("int")


def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    """rows with their bucket, each bucket in one task and sorted, so that a look-up skips most of its file."""
    return rows.withColumn("bucket", _bucket(F.col("doc_id"), buckets)).repartition(buckets, "bucket").sortWithinPartitions("bucket", "doc_id")


def read_html(spark: SparkSession, path: str, buckets: int, doc_id: int) -> DataFrame:
    """A document's rows out of what was written with buckets; only its bucket is looked at."""
    rows = spark.read.parquet(path)
    return rows.where((F.col("bucket") == _bucket(F.lit(doc_id), buckets)) & (F.col("doc_id") == doc_id)).drop("bucket")


PROMPT = "Transcribe the page as markdown. Keep tables."


def request_body(image_base64: str, model: str, max_tokens: int) -> bytes:
    image = {"type": "image_url", "image_url": {"url": f"data:image/png;base64,{image_base64}"}}
    message = {"role": "user", "content": [{"type": "text", "text": PROMPT}, image]}
    return json.dumps({"model": model, "temperature": 0, "max_tokens": max_tokens, "messages": [message]}).encode()


def http_client(base_url: str, model: str, timeout: int) -> Callable[[str, int], str]:
    """A client that posts a page image and gives the response's body; an error with its first 300 characters unless it is 200."""

    def call(image_base64: str, max_tokens: int) -> str:
        request = urllib.request.Request(f"{base_url.rstrip('/')}/v1/chat/completions", request_body(image_base64, model, max_tokens), {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as response:
                return response.read().decode()
        except urllib.error.HTTPError as e:
            raise RuntimeError(f"the model answered {e.code}: {e.read()[:300].decode(errors='replace')}") from e

    return call


def transcribe(images: DataFrame, make_client: Callable[[], Callable[[str, int], str]], permissive: bool = False) -> DataFrame:
    """images (doc_id, page_number, image_base64, max_tokens) as ocr_text and error; one client a task.

    A failed page fails the job, or with permissive is kept with its error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = make_client()
        for batch in batches:
            bodies, errors = [], []
            for image, most in zip(batch["image_base64"].to_pylist(), batch["max_tokens"].to_pylist(), strict=True):
                try:
                    bodies.append(call(image, most))
                    errors.append(None)
                except Exception as e:
                    if not permissive:
                        raise
                    bodies.append(None)
                    errors.append(str(e)[:300])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["page_number"], pa.array(bodies, pa.string()), pa.array(errors, pa.string())], ["doc_id", "page_number", "body", "error"])

    rows = images.select("doc_id", "page_number", M.strict_base64(F.col("image_base64")).alias("image_base64"), F.col("max_tokens").cast("int").alias("max_tokens"))
    answered = rows.mapInArrow(run, "doc_id bigint, page_number int, body string, error string")
    return answered.select("doc_id", "page_number", F.when(F.col("body").isNotNull(), M.response_text(F.col("body"))).alias("ocr_text"), "error")

"""From pages with transcriptions and text layers to HTML, as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.config import EngineConfig
from quire.functions import markup as M
from quire.functions import text as T
from quire.operators import pages as P
from quire.operators import transcripts as X
from quire.operators.udf import dealt


def read_pass(pages: DataFrame, config: EngineConfig) -> DataFrame:
    """A pass over pages (doc_id, page_number, ocr_text, second_text, layer_text, words): repaired, merged and rated.

    Adds open_table, merged_text and merged_quality. A second transcription only goes into pages whose tables don't end.
    """
    second = F.col("second_text") if config.secondary_table_repair else F.lit(None).cast("string")
    rows = pages.withColumn("open_table", M.has_open_table(F.col("ocr_text"))).withColumn("ocr_text", X.repaired(F.col("ocr_text"), second))
    rows = X.merge_with_fallback(rows, config.merge_policy)
    rows = rows.withColumn("merged_text", X.table_corrected(F.col("merged_text"), F.col("words")))
    return rows.withColumn("merged_quality", T.quality(F.col("merged_text"))["score"])


def convert_pages(pages: DataFrame, words: DataFrame, config: EngineConfig, retry: DataFrame | None = None) -> DataFrame:
    """doc_id, page_number, blocks and html of pages (doc_id, page_number, ocr_text, second_text, layer_text).

    words: doc_id, page_number, x0..y1, text. retry: a second pass's pages, of which only those are used whose first pass needs it.
    """
    page = ["doc_id", "page_number"]
    likely = P.table_likelihood(words).select(*page, "n_words", "likelihood")
    # dealt by a hash of the keys: dealing by the keys themselves is dropped as soon as a join has dealt by them, and that one is merged to few tasks by bytes
    own = dealt(pages.join(P.page_words(words), page, "left").join(likely, page, "left"), F.xxhash64(*page))
    own = own.withColumn("words", F.coalesce("words", F.array().cast(own.schema["words"].dataType))).withColumn("likelihood", F.coalesce("likelihood", F.lit(0.0)))
    first = read_pass(own, config)
    if retry is not None:
        layer_quality = T.quality(F.col("layer_text"))["score"]
        wanted = first.where(X.needs_retry(config, F.col("open_table"), F.col("merged_quality"), layer_quality, F.col("layer_text"))).select(*page, "layer_text", "words", "n_words", "likelihood")
        second = read_pass(retry.select(*page, "ocr_text", "second_text").join(wanted, page), config)
        first = X.best_pass(first, second)
    chosen = X.prefer_layer(first, config.layer_fallback_mode)
    clean = chosen.withColumn("markdown", X.closed(X.sanitized(F.col("merged_text"))))
    made = X.postprocess(clean.withColumn("blocks", X.blocks(F.col("markdown"))), config)
    return made.select(*page, "blocks", X.page_html(F.col("page_number"), F.col("blocks")).alias("html"))


def convert(pages: DataFrame, words: DataFrame, config: EngineConfig | None = None, retry: DataFrame | None = None, title: str | None = "Document") -> DataFrame:
    """doc_id and html: whole documents (fragments with title=None)."""
    return X.documents_html(convert_pages(pages, words, config or EngineConfig(), retry).select("doc_id", "page_number", "html"), title)

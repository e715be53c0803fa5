"""Streams: pages in order, and versioned job states."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "doc_id bigint, page_number int, position int, html string"
STATE = "next int, numbers array<int>, pages array<string>"


def _in_order(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Pages are held back until all before them have come; a page that comes again is ignored."""
    following, numbers, pages = state.get if state.exists else (1, [], [])
    held = dict(zip(numbers, pages, strict=True))
    for frame in batches:
        for number, html in zip(frame["page_number"].tolist(), frame["html"].tolist(), strict=True):
            if number >= following:
                held.setdefault(int(number), html)
    out = []
    while following in held:
        out.append((key[0], following, following - 1, held.pop(following)))
        following += 1
    left = sorted(held)
    state.update((following, left, [held[n] for n in left]))
    if out:
        yield pd.DataFrame(out, columns=["doc_id", "page_number", "position", "html"])


def in_order(pages: DataFrame) -> DataFrame:
    """A stream of pages (doc_id, page_number, html) in any order as one in page order: page n comes only after 1 to n - 1.

    The state of a document is its next page's number and the pages that wait for it.
    """
    rows = pages.select("doc_id", "page_number", "html")
    return rows.groupBy("doc_id").applyInPandasWithState(_in_order, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def in_order_batch(pages: DataFrame) -> DataFrame:
    """What in_order() has emitted once all pages have come: those up to the first that is missing."""
    from pyspark.sql import Window

    once = pages.groupBy("doc_id", "page_number").agg(F.min("html").alias("html"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_number"))
    rows = once.where("page_number >= 1").withColumn("place", place)
    return rows.where("place = page_number").select("doc_id", "page_number", (F.col("place") - 1).alias("position"), "html")


def latest_jobs(changes: DataFrame) -> DataFrame:
    """The newest state of each job in a changelog (job_id, version, status, ...): one row a job, versions only grow."""
    rest = [c for c in changes.columns if c != "job_id"]
    return changes.groupBy("job_id").agg(F.max_by(F.struct(*rest), "version").alias("s")).select("job_id", "s.*")


def unless_seen(jobs: DataFrame, known_version: Column) -> DataFrame:
    """Jobs whose version isn't the one that a reader knows: the others need no answer."""
    return jobs.where(~F.col("version").eqNullSafe(known_version))


def job_html(final: Column, partial: Column) -> Column:
    """A job's result, else what it has so far, else the empty text."""
    return F.coalesce(F.nullif(final, F.lit("")), partial, F.lit(""))


def progress(changes: DataFrame) -> DataFrame:
    """job_id, version, processed_pages and partial_html after each finished page of a changelog (job_id, version, page_number, html).

    Finished pages are kept in page order, whatever the order in which they came.
    """
    from pyspark.sql import Window

    upto = Window.partitionBy("job_id").orderBy("version").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.sort_array(F.collect_list(F.when(F.col("html").isNotNull(), F.struct("page_number", "html"))).over(upto))
    return changes.select(
        "job_id", "version", F.size(own).alias("processed_pages"), F.array_join(F.transform(own, lambda p: p["html"]), "\n<!-- page -->\n").alias("partial_html")
    )


def poll_interval(busy: Column) -> Column:
    """Milliseconds until a reader should ask again."""
    return F.when(busy, 1000).otherwise(10_000)


def sessions(events: DataFrame, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Events (ts, user_id) in sessions that end after a gap: user_id, start, end and count; works on streams and tables."""
    own = events.withWatermark("ts", late) if events.isStreaming else events
    return own.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")

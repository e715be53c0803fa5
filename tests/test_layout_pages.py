"""Blocks of pages, made page by page, against spans assigned by the range join and joined by the plain kernel; and what moves for them."""

from __future__ import annotations

import random

import __spark_entry__ as entry
from pyspark.sql import functions as F

from quire.kernels import order
from quire.operators import layout, pages

PAGE = "doc_id int, page_number int, "
SPANS = PAGE + "span_no int, x0 double, y0 double, x1 double, y1 double, text string, size double"
REGIONS = PAGE + "region_no int, bbox struct<x0:double,y0:double,x1:double,y1:double>, label string, reading_order int"


def test_blocks_of_random_pages(spark):
    r = random.Random(4)
    spans, regions = [], []
    for doc in range(12):
        for i in range(r.choice([0, 3, 40])):
            x, y = r.randrange(0, 95, 5) * 1.0, r.randrange(0, 95, 3) * 1.0
            spans.append((doc, 1, i, x, y, x + r.choice([0.0, 4.0, 9.0]), y + r.choice([0.0, 2.0, 3.0]), r.choice(["a", "b-", "", "Ünd", " ", None, "c d"]), r.choice([None, 0.0, 8.0, 9.0, 14.0])))
        for i in range(r.choice([0, 1, 5])):
            x, y = r.random() * 0.6, r.random() * 0.6
            regions.append((doc, 1, i, (x, y, x + 0.4, y + 0.4), r.choice(["text", "title", "figure", "odd", None]), r.choice([None, i])))
    sizes = spark.createDataFrame([(d, 1, 100.0, 100.0) for d in range(11)], PAGE + "width double, height double")
    s, g = spark.createDataFrame(spans, SPANS), spark.createDataFrame(regions, REGIONS)
    own: dict = {}
    for row in layout.assign(s, g, sizes).collect():
        own.setdefault((row["doc_id"], row["region_no"]), []).append((row["x0"], row["y0"], row["x1"], row["y1"], row["text"] or ""))
    place = {(x["doc_id"], x["region_no"]): x["position"] for x in layout.reading_order(g).collect()}
    want: dict = {}
    for (doc, region), rows in sorted(own.items(), key=lambda x: (x[0][0], place.get(x[0], 99))):
        if text := order.region_text(rows):
            want.setdefault(doc, []).append(text)
    got: dict = {}
    for row in layout.page_blocks(s, g, sizes).orderBy("doc_id", "block_no").collect():
        assert row["block_no"] == len(got.setdefault(row["doc_id"], []))
        got[row["doc_id"]].append(row["text"])
    assert got == want and len(got) > 5


def test_blocks_of_a_table_region(spark):
    spans = [(1, 1, i, 40.0 + 160 * (i % 3), 12.0 * (i // 3), 70.0 + 160 * (i % 3), 12.0 * (i // 3) + 10, str(100 + i), 9.0) for i in range(30)]
    regions = spark.createDataFrame([(1, 1, 0, (0.0, 0.0, 1.0, 1.0), " Table ", None)], REGIONS)
    sizes = spark.createDataFrame([(1, 1, 600.0, 200.0)], PAGE + "width double, height double")
    (row,) = layout.page_blocks(spark.createDataFrame(spans, SPANS), regions, sizes).collect()
    assert row["kind"] == "table" and row["grid"][0] == ["100", "101", "102"] and len(row["grid"]) == 10


def test_lines_make_the_words_of_pages(spark):
    docs = spark.createDataFrame([(1, "one  two\r\n thrée \n\nx"), (2, ""), (3, "\n".join(f"l{i} w" for i in range(90)))], "doc_id bigint, text string")
    words = pages.words(pages.lines(docs)).withColumn("size", 8.0 + F.col("line_no") % 7).withColumn("span_no", F.lit(0))
    box = F.struct(*(F.lit(x).alias(n) for n, x in zip(("x0", "y0", "x1", "y1"), (0.0, 0.0, 0.2, 0.5), strict=True)))
    keys = words.select("doc_id", "page_number").distinct()
    regions = keys.select("*", F.lit(0).alias("region_no"), box.alias("bbox"), F.lit("text").alias("label"), F.lit(None).cast("int").alias("reading_order"))
    want = layout.page_blocks(words, regions, keys.select("*", F.lit(160.0).alias("width"), F.lit(480.0).alias("height")))
    own = pages.page_lines(docs).withColumn("sizes", F.transform("lines", lambda _, i: 8.0 + ((F.col("page_number") - 1) * pages.LINES_A_PAGE + i) % 7))
    region = F.array(F.struct("box.*", F.lit("text").alias("label"), F.lit(None).cast("int").alias("reading_order"), F.lit(0).alias("region_no")))
    rows = own.withColumn("box", box).withColumns({"regions": region, "width": F.lit(160.0), "height": F.lit(480.0)})
    assert sorted(layout.text_blocks(rows).collect()) == sorted(want.collect()) and want.count() > 4


def test_no_word_moves_for_layout_blocks(spark):
    plan = entry.queries()["layout_blocks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1  # documents of a small file are dealt as text

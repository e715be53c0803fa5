"""Page tables: lines, positioned words, table likelihood, gap groups and page analysis. Everything here is native.

Tables are keyed by (doc_id, page_number); a word has x0, y0, x1, y1 in points and its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators.udf import dealt

LINES_A_PAGE, CHAR_WIDTH, LINE_PITCH, LINE_HEIGHT = 40, 6, 12, 10
BLOCK = 32  # words of a line that are placed together


def lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, page_number, line_no and line for docs (doc_id, text): pages of LINES_A_PAGE lines."""
    rows = docs.select("doc_id", F.posexplode(F.split(T.newlines(F.col(text)), "\n")).alias("line_no", "line"))
    return rows.select("doc_id", (F.expr(f"line_no div {LINES_A_PAGE}") + 1).cast("int").alias("page_number"), "line_no", "line")


def page_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, page_number and the array of a page's lines, where the document's text lies."""
    own = docs.select("doc_id", F.split(T.newlines(F.col(text)), "\n").alias("own"))
    paged = F.transform(F.sequence(F.lit(1), F.size("own"), F.lit(LINES_A_PAGE)), lambda i: F.slice("own", i, LINES_A_PAGE))
    return own.select("doc_id", F.posexplode(paged).alias("n", "lines")).select("doc_id", (F.col("n") + 1).alias("page_number"), "lines")


def _starts(sizes: Column) -> Column:
    """The sums of an array's sizes before each."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("places"))
    return F.aggregate(sizes, begin, lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["places"], F.array(s["at"])).alias("places")))["places"]


def words(lines: DataFrame) -> DataFrame:
    """Words of lines set in a fixed pitch: doc_id, page_number, line_no, word_no, x0, y0, x1, y1, text.

    Words are placed where their line lies, without a shuffle: a line is cut into runs of BLOCK words, whose places are sums, and a word's
    place in its run is the length of what stands before it.
    """
    parts = lines.select("doc_id", "page_number", "line_no", F.split("line", " ").alias("parts"))
    run = lambda i: F.array_join(F.slice("parts", i, BLOCK), " ")
    runs = parts.select("doc_id", "page_number", "line_no", F.transform(F.sequence(F.lit(1), F.size("parts"), F.lit(BLOCK)), run).alias("runs"))
    starts = _starts(F.transform("runs", lambda r: F.char_length(r) + 1))
    one = runs.select("doc_id", "page_number", "line_no", F.posexplode(F.arrays_zip(F.col("runs").alias("run"), starts.alias("at"))).alias("run_no", "r"))
    each = one.select("doc_id", "page_number", "line_no", "run_no", "r.run", "r.at", F.posexplode(F.split("r.run", " ")).alias("no", "text")).where("text <> ''")
    before = F.when(F.col("no") == 0, 0).otherwise(F.char_length(F.expr("substring_index(run, ' ', no)")) + 1)
    x0, y0 = CHAR_WIDTH * (F.col("at") + before).cast("double"), LINE_PITCH * (F.col("line_no") % LINES_A_PAGE).cast("double")
    return each.select(
        "doc_id", "page_number", "line_no", (F.col("run_no") * BLOCK + F.col("no")).alias("word_no"), x0.alias("x0"), y0.alias("y0"),
        (x0 + CHAR_WIDTH * F.char_length("text")).alias("x1"), (y0 + LINE_HEIGHT).alias("y1"), "text",
    )


def _bin(value: Column, size: float | Column) -> Column:
    """The number of a bin, rounded half to even."""
    return F.bround(value / size).cast("int")


def table_likelihood(words: DataFrame) -> DataFrame:
    """doc_id, page_number, n_words, n_rows and likelihood: how much a page's words look like a table.

    Two aggregations: words by (row, x bin), then by x bin and by page; the first shrinks the words before they move.
    """
    page = ["doc_id", "page_number"]
    binned = words.select(*page, _bin(F.col("y0"), 5.0).alias("row"), _bin(F.col("x0"), 20.0).alias("bin"), F.col("text").rlike("[0-9]").cast("int").alias("digit"))
    cells = binned.groupBy(*page, "row", "bin").agg(F.count("*").alias("n"), F.sum("digit").alias("digits"))
    rows = cells.groupBy(*page, "row").agg(F.sum("n").alias("n"), F.sum("digits").alias("digits"))
    total = rows.groupBy(*page).agg(
        F.sum("n").alias("n_words"), F.count("*").alias("n_rows"), F.sum((F.col("n") >= 3).cast("int")).alias("several"), F.sum("digits").alias("digits")
    )
    bins = cells.groupBy(*page, "bin").agg(F.count("*").alias("rows"))
    needed = F.greatest(F.lit(3), F.bround(F.col("n_rows") * 0.35))
    aligned = bins.join(total.select(*page, "n_rows"), page).groupBy(*page).agg(F.sum((F.col("rows") >= needed).cast("int")).alias("repeated"))
    score = (
        F.least(F.lit(1.0), F.col("repeated") / 3.0) * 0.55
        + F.col("several") / F.col("n_rows").cast("double") * 0.30
        + F.col("digits") / F.col("n_words").cast("double") * 0.15
    )
    few = (F.col("n_words") < 12) | (F.col("n_rows") < 6)
    likelihood = F.when(few, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
    return total.join(aligned, page).select(*page, "n_words", "n_rows", likelihood.alias("likelihood"))


def gap_groups(words: DataFrame) -> DataFrame:
    """The groups of words in a row: doc_id, page_number, row, group_no, x0, x1, n_words and text.

    A row is a bin of vertical centres, max(4, 3/4 of the page's median height) high; a group ends where the next word
    is more than max(12, 1.2 median heights) away; a blank stands where words are max(2, 0.2 median heights) apart.
    """
    page = ["doc_id", "page_number"]
    height = F.greatest(F.lit(0.0), F.col("y1") - F.col("y0"))
    sizes = words.groupBy(*page).agg(F.coalesce(F.median(height), F.lit(10.0)).alias("height"))
    row = _bin((F.col("y0") + F.col("y1")) / 2, F.greatest(F.lit(4.0), F.col("height") * 0.75))
    placed = words.join(sizes, page).withColumn("row", row)
    order = Window.partitionBy(*page, "row").orderBy("x0", "x1", "text")
    gap = F.col("x0") - F.lag("x1").over(order)
    broken = placed.withColumn("gap", gap)
    number = F.sum((F.coalesce(F.col("gap"), F.lit(0.0)) > F.greatest(F.lit(12.0), F.col("height") * 1.2)).cast("int")).over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    space = F.when(F.col("gap") >= F.greatest(F.lit(2.0), F.col("height") * 0.2), " ").otherwise("")
    numbered = broken.withColumn("group_no", number).withColumn("piece", F.concat(space, F.col("text")))
    grouped = numbered.groupBy(*page, "row", "group_no").agg(
        F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.count("*").alias("n_words"), F.sort_array(F.collect_list(F.struct("x0", "x1", "piece"))).alias("own")
    )
    return grouped.select(*page, "row", "group_no", "x0", "x1", "n_words", T.strip(F.array_join(F.transform("own", lambda w: w["piece"]), "")).alias("text"))


def analysis(pages: DataFrame, likelihoods: DataFrame | None = None) -> DataFrame:
    """One row a page: normalised text, tokens, quality, table likelihood and kind.

    pages: doc_id, page_number, text, and if they are known image_ratio and found_tables; the likelihood is at least the latter.
    """
    page = ["doc_id", "page_number"]
    ratio, found = (F.coalesce(c, F.lit(0.0)) if c in pages.columns else F.lit(0.0) for c in ("image_ratio", "found_tables"))
    rows = pages.select(*page, F.coalesce("text", F.lit("")).alias("raw_text"), ratio.alias("image_area_ratio"), found.cast("double").alias("found_tables"))
    if likelihoods is not None:
        rows = rows.join(likelihoods.select(*page, "likelihood"), page, "left")
    likelihood = F.greatest(F.coalesce("likelihood", F.lit(0.0)), "found_tables") if likelihoods is not None else F.col("found_tables")
    normal = T.normalize(F.col("raw_text"))
    has_text = T.strip(normal) != ""
    return rows.select(
        *page,
        "raw_text",
        normal.alias("normalized_text"),
        T.tokens(normal).alias("tokens"),
        has_text.alias("has_text_layer"),
        T.quality(F.col("raw_text")).alias("quality"),
        "image_area_ratio",
        likelihood.alias("table_likelihood"),
        T.page_kind(has_text, F.col("image_area_ratio"), likelihood).alias("page_kind"),
    )


def image_signals(pages: DataFrame, blocks: str = "blocks") -> DataFrame:
    """pages with image_count and image_ratio: the images among a page's raw blocks (type 1) and the share of its area they take."""
    images = F.filter(blocks, lambda b: b["type"] == 1)
    area = F.aggregate(images, F.lit(0.0), lambda s, b: s + F.greatest(F.lit(0.0), b["x1"] - b["x0"]) * F.greatest(F.lit(0.0), b["y1"] - b["y0"]))
    whole = F.col("width") * F.col("height")
    ratio = F.when(whole > 0, F.least(F.lit(1.0), area / whole)).otherwise(0.0)
    return pages.withColumn("image_count", F.size(images)).withColumn("image_ratio", ratio)


def page_words(words: DataFrame) -> DataFrame:
    """doc_id, page_number and the array of a page's words, as the row functions take it."""
    return dealt(words, "doc_id", "page_number").groupBy("doc_id", "page_number").agg(F.sort_array(F.collect_list(F.struct("y0", "x0", "y1", "x1", "text"))).alias("own")).select(
        "doc_id", "page_number", F.transform("own", lambda w: F.struct(w["x0"].alias("x0"), w["y0"].alias("y0"), w["x1"].alias("x1"), w["y1"].alias("y1"), w["text"].alias("text"))).alias("words")
    )


def line_windows(pages: DataFrame, most: int = 8, separator: str = " ", text: str = "text") -> DataFrame:
    """doc_id, page_number, ordinal, window: every run of 1 to most neighbouring lines, each text once, in first-seen order."""
    own = T.filled_lines(F.col(text))
    runs = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.size("own")),
            lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.size("own") - i + 1)), lambda n: T.strip(F.array_join(F.slice("own", i, n), separator))),
        )
    )
    rows = pages.select("doc_id", "page_number", own.alias("own")).where(F.size("own") > 0)
    once = F.array_distinct(F.filter(runs, lambda w: w != ""))
    return rows.select("doc_id", "page_number", F.posexplode(once).alias("ordinal", "window"))


def cell_candidates(pages: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, page_number, ordinal, candidate: windows of 1 to 3 lines that may be a table's cell, each visible text once."""
    rows = line_windows(pages.withColumn(text, T.normalize(F.col(text))), 3, " ", text)
    own = T.compact(F.col("window"))
    digits = F.char_length(own) - F.char_length(F.regexp_replace(own, r"\p{Nd}", ""))
    fits = F.char_length("own").between(2, 48) & ~F.lower("window").rlike("https?://") & T.has_letter(F.col("own")) & (F.col("digits") <= 0.55 * F.char_length("own"))
    kept = rows.select("*", own.alias("own"), digits.alias("digits")).where(fits)
    first = kept.groupBy("doc_id", "page_number", "own").agg(F.min_by("window", "ordinal").alias("candidate"), F.min("ordinal").alias("ordinal"))
    return first.select("doc_id", "page_number", "ordinal", "candidate")


def preface(pages: DataFrame, text: str = "text", most: int = 40) -> DataFrame:
    """doc_id, page_number, preface: the lines before the first that looks like a table's row, most at most."""
    own = T.filled_lines(F.col(text))
    stop = F.array_position(F.transform("own", T.is_data_line), True)
    n = F.least(F.lit(most), F.when(stop > 0, stop - 1).otherwise(F.size("own"))).cast("int")
    return pages.select("doc_id", "page_number", own.alias("own")).select("doc_id", "page_number", F.array_join(F.slice("own", F.lit(1), n), "\n").alias("preface"))

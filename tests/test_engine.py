"""Queries against SQL, streams against batches, sources, configuration and the command line."""

from __future__ import annotations

import datetime
import difflib
import html
import json
import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quire import cli
from quire.config import EngineConfig
from quire.functions import markup as K
from quire.functions import text as T
from quire.kernels import words as kernel_words
from quire.operators import layout, pages, transcripts
from quire.plans import convert
from quire.sources import pdf, stored
from quire.streaming import emission

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x.replace(tzinfo=None) if isinstance(x, datetime.datetime) else x


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.sql(entry.oracle_sql()[name])
    columns = sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    rows = sorted(repr(tuple(plain(r[i]) for i in at)) for r in want.fetchall())
    df = entry.queries()[name](spark, SF)
    assert sorted(df.columns) == columns
    assert sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect()) == rows


@pytest.fixture(scope="module")
def turns(spark):
    """The text of each turn, and as the queries' transcriptions have it."""
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    return {(r["conv_id"], r["turn"]): (r["text"].strip(), r["text"].strip().translate(str.maketrans("lO", "10"))) for r in rows}


def test_merges_keep_every_other_character(spark, turns):
    out = entry.queries()["merged_texts"](spark, SF).collect()
    assert len(out) == len(turns)
    for r in out:
        layer, own = turns[r["doc_id"], r["page_number"]]
        assert len(r["text"]) == len(own) and all(c in pair for c, pair in zip(r["text"], zip(layer, own, strict=True), strict=True))
        assert r["changed_chars"] == sum(a != b for a, b in zip(own, r["text"], strict=True))
    assert sum(r["text"] == turns[r["doc_id"], r["page_number"]][0] for r in out) > 0.9 * len(out)


def test_converted_pages_hold_their_turns(spark, turns):
    plain_text = lambda t: re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", t))).strip().translate(str.maketrans("lO", "10"))
    read, by_layer = 0, 0
    for r in entry.queries()["converted_documents"](spark, SF).collect():
        for number, body in re.findall(r'<section data-page="(\d+)">(.*?)</section>', r["html"], re.S):
            layer, own = turns[r["doc_id"], int(number)]
            tail = {0: f"{layer[:12]} 1", 1: "end end"}.get(int(number) % 5, "")
            want = plain_text(own if "<h1>Turn</h1>" not in body else f"Turn {own} {tail}")
            assert plain_text(body) == want
            read, by_layer = read + 1, by_layer + ("<h1>Turn</h1>" not in body)
    assert read == len(turns) and 0 < by_layer < read / 2


def test_best_passages_by_brute_force(spark):
    lines: dict[str, tuple] = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").where("text IS NOT NULL").orderBy("doc_id").collect():
        for i, line in enumerate(r["text"].replace("\r\n", "\n").replace("\r", "\n").split("\n")):
            if line:
                lines.setdefault(line, (r["doc_id"], i))
    words = lambda t: {t[a:b] for a, b in kernel_words.tokens(t)}
    known = [(words(line.lower()), place, line) for line, place in lines.items()]
    out = {r["item_id"]: r for r in entry.queries()["best_passages"](spark, SF).collect()}
    items = spark.read.parquet(f"{SF}/benchmark.parquet").where("text IS NOT NULL").collect()
    assert len(out) == len(items)
    for r in items:
        own = words(r["text"].lower())
        less, place, line = min((-len(own & w), place, line) for w, place, line in known)
        got = out[r["item_id"]]
        if less:
            assert (got["n"], got["doc_id"], got["line_no"]) == (-less, *place)
            assert got["similarity"] == pytest.approx(difflib.SequenceMatcher(None, r["text"], line, autojunk=False).ratio())
        else:
            assert got["n"] is None


def test_grids_run(spark):
    """Of page_grids the grids themselves are compared in test_kernels."""
    assert entry.queries()["page_grids"](spark, SF).count() == 2 * 204


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 64, 100, 1500])
def test_words_of_long_lines_stand_in_place(spark, n):
    line = " ".join("" if i % 7 == 3 else "é" * (i % 5) + "x" for i in range(n))
    want, at = [], 0
    for i, w in enumerate(line.split(" ")):
        if w:
            want.append((i, 6.0 * at, 6.0 * (at + len(w)), w))
        at += len(w) + 1
    rows = pages.words(spark.createDataFrame([(1, 1, 0, line)], "doc_id bigint, page_number int, line_no int, line string"))
    assert [(r["word_no"], r["x0"], r["x1"], r["text"]) for r in rows.orderBy("word_no").collect()] == want


def test_entry(spark):
    assert entry.entry(spark).count() == 204


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_text_functions(spark):
    s = F.lit
    assert one(spark, T.normalize(s("a\r\nb\r\x00c\x07d 　"))) == "a\nb\ncd"
    assert one(spark, T.tokens(s("東京都ABC123ひらがなカタカナ!!"))) == ["東京都", "ABC", "123", "ひらがな", "カタカナ", "!!"]
    assert one(spark, T.promoted_heading(s("事業概要｜BPaaS事業 これは、本文です"), s(3))) == ("事業概要｜BPaaS事業", "これは、本文です")
    assert one(spark, T.promoted_heading(s("01 | Company Overview"), s(1))) == ("01 | Company Overview", None)
    assert one(spark, T.close_japanese(s("連結 業績 の 概況"))) == "連結業績の概況"
    assert one(spark, T.split_contents_line(s("(1) 経営 ........ 2 (2) 財政 ........ 3"))).count("\n") == 1
    assert one(spark, T.change_budget(s(10), 0.08)) == 1 and one(spark, T.safe_cell_change(s("a"), s("a|b"))) is False
    assert one(spark, T.quality(s("")))["score"] == 0.0 and one(spark, T.quality(s("日本語の本文です。" * 20)))["score"] > 0.5
    assert one(spark, T.repeat_coverage(s("a\na\nb"))) == pytest.approx(2 / 3) and one(spark, T.repeat_coverage(s(""))) == 0.0
    kinds = [("t", True, 0.7, 0.0), ("t", True, 0.0, 0.7), ("t", True, 0.2, 0.0), ("t", True, 0.0, 0.0), ("t", False, 0.2, 0.0), ("t", False, 0.0, 0.0)]
    rows = spark.createDataFrame(kinds, "k string, a boolean, b double, c double").select(T.page_kind(F.col("a"), F.col("b"), F.col("c")).alias("x")).collect()
    assert [r["x"] for r in rows] == ["image", "table", "mixed", "text", "image", "empty"]


def test_markup_functions(spark):
    s = F.lit
    assert one(spark, K.disposition(s("/a/b/報告.pdf"), "html")) == "attachment; filename=\"download.html\"; filename*=UTF-8''%E5%A0%B1%E5%91%8A.html"
    assert one(spark, K.disposition(s("x y.pdf"), "html")) == 'attachment; filename="x y.html"'
    assert one(spark, K.response_text(s('{"choices":[{"message":{"content":"a\\r\\nb"}}]}'))) == "a\nb"
    assert one(spark, K.response_text(s('{"choices":[{"message":{"content":[{"text":"a"},{"text":"b"}]}}]}'))) == "ab"
    assert one(spark, K.tolerant_base64(s("data:image/png;base64,YQ=="))) == b"a" and one(spark, K.tolerant_base64(s("!!"))) == b""
    assert one(spark, K.is_note(s("*Note: this image contains a chart*"))) is True and one(spark, K.is_broken_tag(s("<div class"))) is True
    assert one(spark, K.lone_table_tags(s("<table>\n<tr>"))) is True and one(spark, K.compact_blank_lines(s("a  \n\n\n\nb\n"))) == "a\n\nb"
    upload = lambda c, busy=False: one(spark, K.upload_reason(s("n"), s(c), 10, s(busy)))
    assert (upload(b" %PDF-1"), upload(b""), upload(b"hello"), upload(b"%PDF" + b"x" * 20), upload(b"%PDF", True)) == (None, 400, 400, 413, 409)
    with pytest.raises(Exception, match="base64"):
        one(spark, K.strict_base64(s("???")))


def test_stream_equals_batch(spark, tmp_path):
    rows = [(d, n, f"p{n}") for d, order in ((1, [2, 3, 1, 3]), (2, [1, 4, 2]), (3, [2])) for n in order]
    schema = "doc_id bigint, page_number int, html string"
    for i, r in enumerate(rows):
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i:03}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{tmp_path}/in/*")
    query = emission.in_order(stream).writeStream.format("memory").queryName("ordered").option("checkpointLocation", f"{tmp_path}/c").start()
    query.processAllAvailable()
    query.stop()
    got = sorted(map(tuple, spark.table("ordered").collect()))
    want = sorted(map(tuple, emission.in_order_batch(spark.createDataFrame(rows, schema)).collect()))
    assert got == want == [(1, 1, 0, "p1"), (1, 2, 1, "p2"), (1, 3, 2, "p3"), (2, 1, 0, "p1"), (2, 2, 1, "p2")]


def test_jobs(spark):
    changes = spark.createDataFrame([(1, 1, "queued"), (1, 3, "done"), (1, 2, "running"), (2, 1, "queued")], "job_id int, version int, status string")
    latest = emission.latest_jobs(changes)
    assert {(r["job_id"], r["status"]) for r in latest.collect()} == {(1, "done"), (2, "queued")}
    assert emission.unless_seen(latest, F.lit(3)).count() == 1
    assert one(spark, emission.job_html(F.lit(""), F.lit("part"))) == "part" and one(spark, emission.poll_interval(F.lit(True))) == 1000


def test_regions(spark):
    raw = [(1, 0, 0, '{"bbox":[0,0,50,100],"label":" title ","order":1.0}', 100.0, 100.0), (1, 0, 1, '{"bbox":[0,0,50],"label":"x"}', 100.0, 100.0), (1, 0, 2, '{"bbox":[0,0,5,5],"label":""}', 100.0, 100.0), (1, 0, 3, '{"bbox":[0,0,5,5],"label":"a","order":-1}', 100.0, 0.0)]
    got = {r["region_no"]: r for r in layout.raw_regions(spark.createDataFrame(raw, stored.REGIONS)).collect()}
    assert got[0]["problem"] is None and got[0]["reading_order"] == 1 and got[0]["label"] == "title" and got[0]["bbox"]["x1"] == 0.5
    assert [got[i]["problem"] for i in (1, 2, 3)] == ["bbox", "label", "order"]


def test_layout_blocks(spark):
    spans = [(1, 1, 0, 50.0, 20.0, 300.0, 40.0, "Hello World", 20.0), (1, 1, 1, 50.0, 120.0, 300.0, 130.0, "Body", 10.0), (1, 1, 2, 50.0, 134.0, 300.0, 144.0, "more", 10.0), (1, 1, 3, 900.0, 900.0, 950.0, 910.0, "far", 10.0)]
    spans = spark.createDataFrame(spans, "doc_id int, page_number int, span_no int, x0 double, y0 double, x1 double, y1 double, text string, size double")
    regions = spark.createDataFrame([(1, 1, 0, (0.0, 0.0, 0.5, 0.08), "title", None), (1, 1, 1, (0.0, 0.1, 0.5, 0.3), "text", None)], "doc_id int, page_number int, region_no int, bbox struct<x0:double,y0:double,x1:double,y1:double>, label string, reading_order int")
    pages = spark.createDataFrame([(1, 1, 1000.0, 1000.0)], "doc_id int, page_number int, width double, height double")
    got = [(r["kind"], r["level"], r["text"]) for r in layout.page_blocks(spans, regions, pages).orderBy("block_no").collect()]
    assert got == [("heading", 1, "Hello World"), ("paragraph", None, "Body more"), ("paragraph", None, "far")]


def test_conversion(spark):
    pages = spark.createDataFrame([(1, 2, "second", None, "second"), (1, 1, "# T\n<table><tr><td>a", "x\n<table><tr><td>a</td></tr></table>", "T a")], "doc_id bigint, page_number int, ocr_text string, second_text string, layer_text string")
    words = spark.createDataFrame([(1, 1, 0.0, 0.0, 9.0, 9.0, "T")], "doc_id bigint, page_number int, x0 double, y0 double, x1 double, y1 double, text string")
    html = convert.convert(pages, words, title=None).first()["html"]
    assert html.index('data-page="1"') < html.index('data-page="2"') and "<h1>T</h1>" in html and "<th>a</th>" in html
    again = convert.convert(pages, words, EngineConfig(postprocess_mode="full", fast_pass=False), retry=pages).first()["html"]
    assert again.startswith("<!doctype html>")


def test_preferences(spark):
    layer = "the layer of this page has a long and readable text that says what it says and goes on for more than eighty characters"
    rows = [(1, "loop\n" * 9, "loop\n" * 9, 0.1, layer, 30, 0.0), (2, layer, layer, 0.9, layer, 30, 0.0), (3, "x", "", 0.0, layer, 30, 0.0), (4, "x", "x", 0.0, "short", 1, 0.0)]
    pages = spark.createDataFrame(rows, "doc_id int, ocr_text string, merged_text string, merged_quality double, layer_text string, n_words int, likelihood double")
    got = {r["doc_id"]: r["used_layer"] for r in transcripts.prefer_layer(pages).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False}
    assert not any(r["used_layer"] for r in transcripts.prefer_layer(pages, "off").collect())


def test_model_operator(spark):
    images = spark.createDataFrame([(1, 1, "YQ==", 10), (1, 2, "Yg==", 10)], "doc_id bigint, page_number int, image_base64 string, max_tokens int")

    def client():
        def call(image, most):
            if image == "Yg==":
                raise RuntimeError("no answer")
            return json.dumps({"choices": [{"message": {"content": f"{image} {most}"}}]})

        return call

    got = {r["page_number"]: (r["ocr_text"], r["error"]) for r in stored.transcribe(images, client, permissive=True).collect()}
    assert got == {1: ("YQ== 10", None), 2: (None, "no answer")}
    with pytest.raises(Exception, match="no answer"):
        stored.transcribe(images, client).collect()


class _Page:
    """A page as the PDF library shows it."""

    rect = type("Rect", (), {"width": 600, "height": 800})

    def __init__(self, text):
        self.text = text

    def get_text(self, kind):
        span = {"bbox": (1, 2, 9, 4), "text": self.text, "size": 9.0, "flags": 0, "font": "f"}
        return {"text": self.text, "words": [(1, 2, 9, 4, self.text, 0, 0, 0)], "dict": {"blocks": [{"type": 0, "bbox": (1, 2, 9, 4), "lines": [{"spans": [span]}]}, {"type": 1, "bbox": (0, 0, 300, 400)}]}}[kind]

    def find_tables(self):
        if self.text == "p2":
            raise RuntimeError("odd drawing")
        return type("Found", (), {"tables": [1] if self.text == "p1" else []})


class _Pdf(list):
    def __enter__(self):
        return self

    def __exit__(self, *_):
        return None


def test_pdf_pages_are_read_once_each(monkeypatch, tmp_path):
    opened = lambda stream, filetype: _Pdf(_Page(f"p{i}") for i in range(int(stream[5:8])))
    monkeypatch.setattr(pdf, "library", lambda: type("Library", (), {"open": staticmethod(opened)}))
    for name, n, size in (("a", 3, 10), ("b", 7, 950), ("c", 0, 10), ("d", 1, 85)):
        (tmp_path / f"{name}.pdf").write_bytes(b"%PDF-" + b"%03d" % n + b" " * size)
    reader = pdf._Reader({"path": str(tmp_path), "bytes_per_partition": "100", "find_tables": "true"})
    parts = reader.partitions()
    assert len(parts) == 10 + 2 and len(parts[-2].files) == 2
    rows = sorted(r for p in parts for r in reader.read(p))
    assert [(os.path.basename(r[0]), r[1]) for r in rows] == [("a.pdf", i) for i in (1, 2, 3)] + [("b.pdf", i) for i in range(1, 8)] + [("d.pdf", 1)]
    assert [r[8] for r in rows[:3]] == [0.0, 1.0, 0.0]
    assert rows[1][2:8] == (600.0, 800.0, "p1", [(1.0, 2.0, 9.0, 4.0, "p1", 0, 0, 0)], [(1.0, 2.0, 9.0, 4.0, "p1", 9.0, 0, "f")], [(0, 1.0, 2.0, 9.0, 4.0), (1, 0.0, 0.0, 300.0, 400.0)])
    with pytest.raises(ValueError, match="at most 2"):
        list(pdf._Reader({"path": str(tmp_path), "max_pages": "2"}).read(parts[-2]))


def test_found_tables_raise_the_likelihood(spark):
    rows = spark.createDataFrame([(1, 1, "a word", 0.0, 1.0), (1, 2, "a word", 0.0, None)], "doc_id int, page_number int, text string, image_ratio double, found_tables double")
    assert {r["page_number"]: (r["table_likelihood"], r["page_kind"]) for r in pages.analysis(rows).collect()} == {1: (1.0, "table"), 2: (0.0, "text")}


def test_html_in_buckets(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"<p>{i}</p>\n") for i in range(50)], "doc_id bigint, html string")
    stored.write_html(docs, f"{tmp_path}/h", buckets=4)
    assert len([f for f in os.listdir(f"{tmp_path}/h") if f.startswith("bucket=")]) == 4
    assert [tuple(r) for r in stored.read_html(spark, f"{tmp_path}/h", 4, 17).collect()] == [(17, "<p>17</p>\n")]
    stored.write_pages(docs.withColumn("page_number", F.lit(1)), f"{tmp_path}/p", buckets=4)
    assert stored.read_html(spark, f"{tmp_path}/p", 4, 3).collect()[0]["page_number"] == 1


def test_pdf_limits():
    pdf.check(b"  %PDF-1.7", 100)
    for bad in (b"", b"hello", b"%PDF" + b"x" * 200):
        with pytest.raises(ValueError):
            pdf.check(bad, 100)
    assert pdf.fitted_size(2000, 1000, 1000) == (1000, 500) and pdf.fitted_size(10, 10, 1000) == (10, 10)
    assert pdf.words_of([(2, 1, 3, 2, "b", 0, 0, 0), (1, 1, 2, 2, "a", 0, 0, 0), (1, 1, 2, 2, " ", 0, 0, 0), (1,)])[0]["text"] == "a"
    assert pdf.spans_of([{"lines": [{"spans": [{"bbox": (0, 0, 1, 1), "text": "x", "size": 9}, {"bbox": (0, 0, 0, 1), "text": "y"}]}]}])[0]["size"] == 9


def test_config():
    assert EngineConfig.read({}) == EngineConfig()
    own = EngineConfig.read({"QUIRE_FAST_PASS": "off", "QUIRE_MAX_PAGES": "7", "QUIRE_MERGE_POLICY": "Aggressive", "QUIRE_TABLE_THRESHOLD": "0.5"})
    assert (own.fast_pass, own.max_pages, own.merge_policy, own.table_threshold) == (False, 7, "aggressive", 0.5)
    for bad in ({"QUIRE_MAX_PAGES": "0"}, {"QUIRE_FAST_PASS": "maybe"}, {"QUIRE_POSTPROCESS_MODE": "x"}, {"QUIRE_MAX_TOKENS": "a"}):
        with pytest.raises(ValueError):
            EngineConfig.read(bad)


def test_command_line(spark, tmp_path, capsys):
    pages = f"{tmp_path}/pages"
    spark.createDataFrame([(1, 1, "hello there")], stored.PAGES).write.parquet(pages)
    out = f"{tmp_path}/o.html"
    assert cli.main(["--pages", pages, "--out", out]) == 0 and "hello there" in open(out).read()
    assert cli.main(["--pages", pages, "--out", out]) == 2 and cli.main(["--pages", f"{pages}x", "--stdout"]) == 2 and cli.main([]) == 2
    assert cli.main(["--pages", pages]) == 2 and cli.main(["--pages", pages, "--stdout", "--fragment"]) == 0
    assert '<article class="document">' in capsys.readouterr().out


def test_sinks(spark, tmp_path):
    stored.write_html(spark.createDataFrame([(1, "<p>a</p>"), (2, "<p>b</p>")], "doc_id bigint, html string"), f"{tmp_path}/h")
    assert {p for p in os.listdir(f"{tmp_path}/h") if p.startswith("doc_id")} == {"doc_id=1", "doc_id=2"}
    spark.createDataFrame([(1, 1, "t")], stored.PAGES).write.parquet(f"{tmp_path}/p")
    assert stored.pages(spark, f"{tmp_path}/p").count() == 1


def test_file_names(spark):
    s = F.lit
    assert one(spark, K.disposition_name(s("attachment; filename=\"x.html\"; filename*=UTF-8''%E5%A0%B1%20a.html"))) == "報 a.html"
    assert one(spark, K.disposition_name(s('attachment; filename="a/b.html"'))) == "b.html" and one(spark, K.disposition_name(s("inline"))) is None
    assert one(spark, K.saved_name(s(" a/b.txt "), "f", "html")) == "b.html" and one(spark, K.saved_name(s(""), "f.html")) == "f.html"
    rows = spark.createDataFrame([("d", "a.html"), ("d", "a.html"), ("e", "a.html"), ("d", "b")], "folder string, name string")
    assert sorted(r["unique_name"] for r in K.numbered_names(rows).collect()) == ["a (1).html", "a.html", "a.html", "b"]


def test_images_without_a_library(spark):
    from quire.sources import images

    assert images.below("bm90IGFuIGltYWdl") is None and images.smaller(None, 10) is None
    assert one(spark, images.downscaled(F.lit("YQ=="), 10)) == "YQ=="

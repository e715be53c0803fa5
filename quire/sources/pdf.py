"""A data source for PDF files, read with an optional library; without it, reading fails with a clear message.

`register(spark)` makes `spark.read.format("quire_pdf")` available. Each row is a page: path, page_number, width,
height, text, words, spans, blocks (raw image and text blocks) and found_tables, 1 where the library sees tables, which is
only asked with the option find_tables. Other options: max_bytes, max_pages, bytes_per_partition.

The driver only lists files and their sizes: small files are read together, a large one by several tasks, each of which takes its share of the pages.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

WORDS = "array<struct<x0:double,y0:double,x1:double,y1:double,text:string,block_no:int,line_no:int,word_no:int>>"
SPANS = "array<struct<x0:double,y0:double,x1:double,y1:double,text:string,size:double,flags:int,font:string>>"
SCHEMA = (
    f"path string, page_number int, width double, height double, text string, words {WORDS}, spans {SPANS}, "
    "blocks array<struct<type:int,x0:double,y0:double,x1:double,y1:double>>, found_tables double"
)


def library():
    """The PDF library, imported when it is needed."""
    try:
        import fitz
    except ImportError as e:
        raise ImportError("reading PDF files needs the package pymupdf") from e
    return fitz


def check(data: bytes, max_bytes: int) -> None:
    """An error unless data may be a PDF of a fair size."""
    if not data:
        raise ValueError("the file is empty")
    if len(data) > max_bytes:
        raise ValueError(f"the file has {len(data)} bytes, at most {max_bytes} are read")
    if not data[:1024].lstrip().startswith(b"%PDF"):
        raise ValueError("the file isn't a PDF")


def words_of(raw) -> list[dict]:
    """Words from 8-tuples, sorted from the top left; malformed and empty ones are left out."""
    names = ("x0", "y0", "x1", "y1", "text", "block_no", "line_no", "word_no")
    out = [dict(zip(names, (*map(float, w[:4]), str(w[4]), *map(int, w[5:8])), strict=True)) for w in raw if len(w) >= 8 and str(w[4]).strip()]
    return sorted(out, key=lambda w: (w["y0"], w["x0"], w["y1"], w["x1"], w["text"]))


def spans_of(blocks) -> list[dict]:
    """Spans of text blocks, sorted likewise; empty texts and boxes without extent are left out."""
    out = []
    for block in blocks:
        for line in block.get("lines", ()):
            for s in line.get("spans", ()):
                x0, y0, x1, y1 = map(float, s["bbox"])
                if s.get("text", "").strip() and x1 > x0 and y1 > y0:
                    out.append({"x0": x0, "y0": y0, "x1": x1, "y1": y1, "text": s["text"], "size": s.get("size"), "flags": s.get("flags"), "font": s.get("font")})
    return sorted(out, key=lambda s: (s["y0"], s["x0"], s["y1"], s["x1"], s["text"]))


def tables_found(page) -> float:
    """1.0 where the library sees a table on its page; 0.0 also if it can't look."""
    try:
        return float(bool(list(page.find_tables().tables)))
    except Exception:  # older libraries lack it, and it fails on odd drawings; it is a hint only
        return 0.0


@dataclass
class _Pages(InputPartition):
    """Files, each with the share of its pages that is read: part of parts."""

    files: tuple[tuple[str, int, int], ...]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.max_bytes = int(options.get("max_bytes", 100 * 1024 * 1024))
        self.max_pages = int(options.get("max_pages", 200))
        self.step = max(1, int(options.get("bytes_per_partition", 4 * 1024 * 1024)))
        self.find_tables = str(options.get("find_tables", "false")).lower() == "true"

    def partitions(self) -> list[_Pages]:
        path = self.options["path"].removeprefix("file://")
        files = sorted(glob.glob(os.path.join(path, "*.pdf"))) if os.path.isdir(path) else sorted(glob.glob(path))
        out: list[_Pages] = []
        small: list[tuple[str, int, int]] = []
        size = 0
        for f in files:
            n = os.path.getsize(f)
            parts = -(-n // self.step)
            if parts > 1:
                out += [_Pages(((f, k, parts),)) for k in range(parts)]
                continue
            if small and size + n > self.step:
                out.append(_Pages(tuple(small)))
                small, size = [], 0
            small.append((f, 0, 1))
            size += n
        return [*out, _Pages(tuple(small))] if small else out

    def read(self, partition: _Pages) -> Iterator[tuple]:
        for path, part, parts in partition.files:
            with open(path, "rb") as handle:
                data = handle.read(self.max_bytes + 1)
            check(data, self.max_bytes)
            with library().open(stream=data, filetype="pdf") as pdf:
                n = len(pdf)
                if n > self.max_pages:
                    raise ValueError(f"{path} has {n} pages, at most {self.max_pages} are read")
                for i in range(n * part // parts, n * (part + 1) // parts):
                    yield self.row(path, i, pdf[i])

    def row(self, path: str, i: int, page) -> tuple:
        raw = page.get_text("dict") or {}
        blocks = [(int(b.get("type", -1)), *map(float, b["bbox"])) for b in raw.get("blocks", ()) if len(b.get("bbox", ())) == 4]
        own = [tuple(w.values()) for w in words_of(page.get_text("words") or ())]
        spans = [tuple(s.values()) for s in spans_of(b for b in raw.get("blocks", ()) if b.get("type") == 0)]
        found = tables_found(page) if self.find_tables else 0.0
        return path, i + 1, float(page.rect.width), float(page.rect.height), page.get_text("text") or "", own, spans, blocks, found


class PdfSource(DataSource):
    """Pages of PDF files in a folder that every machine mounts."""

    @classmethod
    def name(cls) -> str:
        return "quire_pdf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PdfSource)


def fitted_size(width: int, height: int, max_edge: int) -> tuple[int, int]:
    """A page image's size with its longer edge at most max_edge; it never grows."""
    longest = max(width, height)
    if longest <= max_edge or max_edge <= 0:
        return width, height
    return max(1, round(width * max_edge / longest)), max(1, round(height * max_edge / longest))


def page_images(path: str, dpi: int, max_edge: int, max_pages: int = 200, max_bytes: int = 100 * 1024 * 1024) -> Iterator[tuple[int, bytes]]:
    """(page number, PNG) of a PDF's pages, one at a time."""
    with open(path, "rb") as handle:
        data = handle.read()
    check(data, max_bytes)
    with library().open(stream=data, filetype="pdf") as pdf:
        if len(pdf) > max_pages:
            raise ValueError(f"{path} has {len(pdf)} pages, at most {max_pages} are read")
        for i, page in enumerate(pdf):
            width, height = (round(v * dpi / 72) for v in (page.rect.width, page.rect.height))
            to = fitted_size(width, height, max_edge)
            matrix = library().Matrix(to[0] / page.rect.width, to[1] / page.rect.height)
            yield i + 1, page.get_pixmap(matrix=matrix, alpha=False).tobytes("png")

"""`python -m quire.cli --pdf IN --out OUT`: a PDF (or stored pages) to HTML.

Exit codes: 0 done, 1 the conversion failed, 2 wrong usage, a missing input or an output that exists.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quire.config import EngineConfig
from quire.plans.convert import convert
from quire.sources import pdf


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quire", description="Convert a document to HTML.")
    own = p.add_mutually_exclusive_group(required=True)
    own.add_argument("--pdf", help="a PDF file")
    own.add_argument("--pages", help="stored pages: parquet with doc_id, page_number, text and ocr_text")
    p.add_argument("--out", help="the HTML file to write")
    p.add_argument("--overwrite", action="store_true", help="replace an existing output")
    p.add_argument("--stdout", action="store_true", help="write to standard output")
    p.add_argument("--fragment", action="store_true", help="no document around the article")
    return p


def _inputs(spark: SparkSession, args: argparse.Namespace):
    """Pages (doc_id, page_number, ocr_text, second_text, layer_text) and words."""
    none = F.lit(None).cast("string")
    if args.pages:
        from quire.operators import pages as P

        rows = spark.read.parquet(args.pages)
        ocr = F.col("ocr_text") if "ocr_text" in rows.columns else F.col("text")
        pages = rows.select("doc_id", "page_number", ocr.alias("ocr_text"), none.alias("second_text"), F.col("text").alias("layer_text"))
        lines = rows.select("doc_id", "page_number", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
        return pages, P.words(lines)
    pdf.register(spark)
    rows = spark.read.format("quire_pdf").load(args.pdf).withColumn("doc_id", F.lit(0).cast("bigint"))
    pages = rows.select("doc_id", "page_number", F.col("text").alias("ocr_text"), none.alias("second_text"), F.col("text").alias("layer_text"))
    words = rows.select("doc_id", "page_number", F.explode("words").alias("w")).select("doc_id", "page_number", "w.x0", "w.y0", "w.x1", "w.y1", "w.text")
    return pages, words


def main(argv: list[str] | None = None) -> int:
    try:
        args = _parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    source = args.pdf or args.pages
    problem = (
        "give --out or --stdout" if not args.out and not args.stdout
        else f"{source} doesn't exist" if not os.path.exists(source)
        else f"{args.out} exists" if args.out and os.path.exists(args.out) and not args.overwrite
        else None
    )
    if problem:
        print(problem, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("quire").getOrCreate()
    try:
        rows = convert(*_inputs(spark, args), EngineConfig.read(), title=None if args.fragment else "Document").orderBy("doc_id").toLocalIterator()
        html = "\n".join(r["html"] for r in rows) + "\n"
        if args.stdout:
            sys.stdout.write(html)
        if args.out:
            with open(args.out, "w", encoding="utf-8") as f:
                f.write(html)
    except Exception as e:
        print(f"the conversion failed: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())

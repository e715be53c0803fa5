"""Row functions as Arrow UDFs, and the types that operators share."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

WORD = "struct<x0:double,y0:double,x1:double,y1:double,text:string>"
CELL = "struct<row:int,col:int,text:string,colspan:int,rowspan:int>"
BLOCK = f"struct<kind:string,text:string,level:int,grid:array<array<string>>,cells:array<{CELL}>>"
GRID = (
    "struct<reason:string,confidence:double,columns:int,centers:array<double>,cutoffs:array<double>,row_bin:double,"
    f"row_keys:array<int>,rows:array<array<string>>,cells:array<{CELL}>,collisions:int,groups:int>"
)


def rowwise(fn: Callable, ddl: str) -> Callable[..., Column]:
    """fn of one row's values as a column function; batches travel as Arrow. Needs a session when it is called."""

    def call(*columns: Column) -> Column:
        kind = to_arrow_type(_parse_datatype_string(ddl))

        @F.arrow_udf(ddl)
        def run(*arrays: pa.Array) -> pa.Array:
            return pa.array([fn(*row) for row in zip(*(a.to_pylist() for a in arrays), strict=True)], kind)

        return run(*columns)

    return call


def dealt(rows: DataFrame, *keys: str | Column) -> DataFrame:
    """rows dealt by keys over as many partitions as shuffles have: row functions take far longer than their bytes tell."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def word_rows(words) -> list[tuple]:
    """An array of words as tuples in reading order, without empty ones."""
    rows = sorted((w["y0"], w["x0"], w["y1"], w["x1"], w["text"]) for w in words or () if w["text"])
    return [(x0, y0, x1, y1, text) for y0, x0, y1, x1, text in rows]

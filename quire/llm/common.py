"""What several operators share: tables in the shared folder, unused column names, and splits by id."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The tables of this driver: by the identity of a DataFrame, its session, path and name in the catalog.
_own: dict[str, tuple[SparkSession, str | None]] = {}
_PATH = "quire_path"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LIBC = ctypes.CDLL(None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Only a local session gets one of its own where that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quire-")
        atexit.register(shutil.rmtree, path[7:], True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _note(df: DataFrame, path: str, table: str | None) -> DataFrame:
    if not _own:
        atexit.register(_forget)
    _own[path] = (df.sparkSession, table)
    setattr(df, _PATH, path)
    return df


@contextmanager
def _own_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile removes its shuffle files at its end, which else stay until the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once as a table in the shared folder and read back: later uses and lost executors don't compute it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _own_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    return _note(spark.read.schema(df.schema).parquet(path), path, None)


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """written(), but dealt into buckets by key, so that grouping by key doesn't move the rows again."""
    spark = df.sparkSession
    number = uuid.uuid4().hex
    path, table = f"{shared_dir(spark)}/{name}-{number}", f"quire_{name}_{number}"
    with _own_shuffles(spark):
        df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(table)
    return _note(spark.table(table), path, table)


def release(df: DataFrame) -> None:
    """Remove the table behind a result of written() or bucketed(), which nothing reads any more."""
    path = getattr(df, _PATH)
    spark, table = _own.pop(path)
    if table:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _forget() -> None:
    """Remove this session's tables as the driver ends."""
    for path in list(_own):
        spark, _ = _own.pop(path)
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session is gone; the folder's owner clears it
            return


def trim() -> None:
    """Give freed memory back, which an idle process would keep while others grow."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def unused(wanted: str, taken: list[str]) -> str:
    """wanted, or it with underscores until no column has that name; Spark compares names without case."""
    names = {c.lower() for c in taken}
    while wanted.lower() in names:
        wanted += "_"
    return wanted


def id_fold(column: str, of: int) -> Column:
    """crc32 of an id's text modulo of; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(of))


def chunks(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Runs of neighbours whose sizes add up to at most that; a larger one stands alone."""
    out, begin, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > most:
            out.append((begin, i))
            begin, total = i, 0
        total += n
    if len(sizes) > begin:
        out.append((begin, len(sizes)))
    return out

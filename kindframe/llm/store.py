"""Shared storage for intermediate tables, and small helpers that several operators use."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space, as a trim set.
WHITE = " \t\n\x0b\x0c\r"
#: Words are maximal runs of anything else.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only where that is unset, as in tests, one is made."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="kindframe-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: its lineage ends there, and no lost executor can take it along."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])).parquet(path)
    out.stored_at = path
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Delete tables that stored() wrote and that nothing reads any more."""
    for t in tables:
        if t is not None:
            spark = t.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(t.stored_at)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def each(column: pa.Array) -> Iterator:
    """A column's values one by one, so that a batch of long texts is not held twice."""
    return (x.as_py() for x in column)


def records(batch: pa.RecordBatch) -> Iterator[dict]:
    """A batch's rows one by one, as dicts."""
    return (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows))


def slim(f: Callable) -> Callable:
    """f, a function over a task's batches, that gives memory back when it ends, as workers live on for other stages."""

    @functools.wraps(f)
    def run(*args, **kw):
        yield from f(*args, **kw)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # no such call in this C library
            return

    return run


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, nothing else. lower() does the same on ASCII text, much faster than translate()."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def row_key(*cols: Column) -> Column:
    """A 64-bit key of a row's content, to meet it again after a shuffle. Nulls count by their position."""
    return F.xxhash64(*[F.coalesce(x, F.lit("")) for c in cols for x in (c.isNull().cast("string"), c.cast("string"))])


def dealt_anew(c: str) -> Column:
    """A join key for a column of longs that an aggregate was dealt by. Under the column itself a join takes the aggregate's rows
    as they lie, and Spark can't split a key of very many rows; under this key it deals both sides, with no table written."""
    return F.bitwise_not(F.col(c))


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

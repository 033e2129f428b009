"""Statistics, quotas, permissions, ids, call profiles: small tables beside the kinds."""

from __future__ import annotations

import time
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindframe.errors import KindError
from kindframe.functions import values

OPERATIONS = ("create", "read", "update", "delete", "extend")


def row_size(df: DataFrame):
    return F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))


def kind_stats(df: DataFrame, name: str, indexes: dict[str, list[str]] | None = None) -> DataFrame:
    """One row: count and size of live rows, of tombstones, and of each index's entries, in one pass."""
    gone = F.coalesce(F.col("_del"), F.lit(False)) if "_del" in df.columns else F.lit(False)
    size = row_size(df)
    out = [F.count(F.when(~gone, 1)).alias("count"), F.coalesce(F.sum(F.when(~gone, size)), F.lit(0)).alias("size"), F.count(F.when(gone, 1)).alias("del_count"), F.coalesce(F.sum(F.when(gone, size)), F.lit(0)).alias("del_size")]
    for index, props in (indexes or {}).items():
        full = ~gone
        for p in props:
            full = full & F.col(p).isNotNull()
        out.append(F.count(F.when(full, 1)).alias(f"index_{index}_count"))
    return df.agg(*out).select(F.lit(name).alias("kind"), "*")


def usage(kinds: Iterable[tuple[str, DataFrame]]) -> DataFrame:
    """(owner, size) over the kinds of each owner."""
    parts = [df.agg(F.coalesce(F.sum(row_size(df)), F.lit(0)).cast("long").alias("size")).select(F.lit(owner).alias("owner"), "size") for owner, df in kinds]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.groupBy("owner").agg(F.sum("size").alias("size"))


def over_quota(used: DataFrame, quotas: DataFrame) -> DataFrame:
    """Owners whose use is above their quota (owner, quota)."""
    return used.join(quotas, "owner").where(F.col("size") > F.col("quota"))


def check_quota(used: DataFrame, quotas: DataFrame) -> None:
    if (row := over_quota(used, quotas).first()) is not None:
        raise KindError("QuotaExceeded", row["owner"])


def permits(pattern: str, name: str) -> bool:
    return name.startswith(pattern[:-1]) if pattern.endswith("*") else name == pattern


def allowed(permissions: list[dict], caller: str, operation: str, kinds: list[str], owner: str = "", admins: tuple[str, ...] = ()) -> bool:
    """Whether a caller may do something to a kind: owners and admins may; else the most exact rule that names the caller
    decides, of the kind itself or else of its supers in order; nothing said is a no."""
    if operation not in OPERATIONS:
        raise KindError("InvalidOperation", operation)
    if caller == owner or caller in admins:
        return True
    for kind in kinds:
        hits = [p for p in permissions if p["object"] == kind and permits(p["caller"], caller) and operation in p["operations"]]
        if hits:
            return max(hits, key=lambda p: (not p["caller"].endswith("*"), len(p["caller"])))["operations"][operation] == "allow"
    return False


def reserve_ids(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    if not 0 <= n <= 1000:
        raise KindError("MaxCountExceeded", str(n))
    return spark.range(n).select(values.new_id(F.concat_ws("-", F.lit(seed), "id"), F.unix_micros(F.current_timestamp()) + F.col("id")).alias("_id"))


PROFILE = T.StructType([T.StructField("application", T.StringType()), T.StructField("operation", T.StringType()), T.StructField("seconds", T.DoubleType()), T.StructField("at", T.LongType())])


class Profile:
    """Calls and their times, as a table for the usual queries."""

    def __init__(self):
        self.calls: list[tuple] = []

    def run(self, application: str, operation: str, call):
        began = time.time()
        try:
            return call()
        finally:
            self.calls.append((application, operation, time.time() - began, int(began * 1e6)))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.calls, PROFILE)

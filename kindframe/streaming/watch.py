"""Watches: a query's first match in a change stream fires once.

Changes come as rows of a stream, each with the row after the change, and before it as a struct where it existed. A
change touches a query if either image meets its conditions. A limited find watches only up to its last returned row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from kindframe.operators import predicates
from kindframe.plans.spec import QuerySpec, parse


def touches(schema: T.StructType, q: QuerySpec, bound: Column | None = None) -> Column:
    """Whether a row is in a query's range; bound narrows it to what a limited result has shown."""
    out = F.lit(True) if bound is None else bound
    for c in q.where:
        out = out & F.coalesce(predicates.where(schema, c), F.lit(False))
    return out


def fired(changes: DataFrame, query: dict, bound: Column | None = None, before: str | None = None) -> DataFrame:
    """The changes that touch a query, of a stream or a table. before names the column of the image before."""
    q = parse(query)
    now = touches(changes.schema, q, bound)
    if before is None:
        return changes.where(now)
    names = changes.schema[before].dataType.names
    was = changes.select("*", *[F.col(f"{before}.{n}").alias(f"_b_{n}") for n in names])
    old = T.StructType([T.StructField(f"_b_{f.name}", f.dataType) for f in changes.schema[before].dataType])
    renamed = parse(query | {"where": [c | {"prop": f"_b_{c['prop']}"} for c in query.get("where", [])]})
    return was.where(now | touches(old, renamed)).select(*changes.columns)


def watch(changes: DataFrame, query: dict, on_fire: Callable[[DataFrame], None], checkpoint: str, bound: Column | None = None, before: str | None = None) -> StreamingQuery:
    """Start a watch on a streaming DataFrame. on_fire gets the first micro-batch that touches the query; then it ends.

    Cancel it with stop(). After a restart from its checkpoint a watch that has fired fires no more than once a start.
    """
    done: list[bool] = []
    query_: list[StreamingQuery] = []

    def each(batch: DataFrame, _: int) -> None:
        if not done and not batch.isEmpty():
            on_fire(batch)
            done.append(True)

    started = fired(changes, query, bound, before).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime="1 second").start()
    query_.append(started)
    started.fired = lambda: bool(done)
    return started


def run_until_fired(stream: StreamingQuery, seconds: float) -> bool:
    """Wait for a watch to fire, and stop it. Whether it fired in time."""
    import time

    end = time.time() + seconds
    while time.time() < end and stream.isActive and not stream.fired():
        time.sleep(0.1)
    stream.stop()
    return stream.fired()


def changes_between(old: DataFrame, new: DataFrame) -> DataFrame:
    """The change feed between two snapshots: rows after, with the row before as _before; deleted rows as tombstones."""
    o = old.select("_id", F.struct(*old.columns).alias("_before"))
    met = new.withColumn("_new", F.lit(True)).join(o, "_id", "full")
    cols = [F.when(F.col("_new"), F.col(c)).otherwise(F.lit(True) if c == "_del" else F.col(f"_before.{c}")).alias(c) if c != "_id" else F.col("_id") for c in new.columns]
    moved = F.col("_new").isNull() | F.col("_before").isNull() | (F.col("_rev") != F.col("_before._rev"))
    return met.where(moved).select(*cols, "_before")


def latest_state(changes: DataFrame, key: str = "_id", rev: str = "_rev") -> DataFrame:
    """The last row of each id in a change stream or table, as a running aggregate."""
    row = F.struct(*[F.col(c) for c in changes.columns])
    return changes.groupBy(key).agg(F.max_by(row, F.col(rev)).alias("row")).select("row.*")


def activated(before: DataFrame, after: DataFrame) -> DataFrame:
    """The shards (_shard) that are active now and were not before: each brings rows that no change feed shows, so any of
    them fires all watches."""
    return after.select("_shard").join(before.select("_shard"), "_shard", "left_anti").distinct()

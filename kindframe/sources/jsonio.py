"""Dump and load: one JSON object a line, live rows and on request tombstones; incremental backups by revision."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindframe.functions import values
from kindframe.operators import mutate


def dump(df: DataFrame, path: str, kind: str, deleted: bool = False) -> None:
    """Write a snapshot's rows without _rev; the lines say their kind."""
    rows = df if deleted or "_del" not in df.columns else df.where(~F.coalesce(F.col("_del"), F.lit(False)))
    rows.drop("_rev", "_kind").withColumn("_kind", F.lit(kind)).write.mode("overwrite").json(path)


def dump_documents(df: DataFrame, path: str, kind: str, deleted: bool = False) -> None:
    """dump() of a schemaless snapshot: each line is the object itself, with its _id, its kind, and _del if it is one."""
    rows = df if deleted or "_del" not in df.columns else df.where(~F.coalesce(F.col("_del"), F.lit(False)))
    system = {"_id": F.to_variant_object(F.struct(F.col("_id").cast("string").alias("v"))), "_kind": F.to_variant_object(F.struct(F.lit(kind).alias("v")))}
    own = F.map_from_entries(F.array(*[F.struct(F.lit(k), F.try_variant_get(v, "$.v", "variant")) for k, v in system.items()]))
    gone = F.when(F.col("_del"), F.map_from_entries(F.array(F.struct(F.lit("_del"), F.parse_json(F.lit("true")))))) if "_del" in df.columns else F.lit(None)
    kept = F.map_filter(F.coalesce(F.col("_doc").cast(values.OBJECT_MAP), F.expr("map()").cast(values.OBJECT_MAP)), lambda k, v: ~k.isin("_id", "_kind", "_rev", "_del"))
    whole = F.map_concat(kept, own, F.coalesce(gone.cast(values.OBJECT_MAP), F.expr("map()").cast(values.OBJECT_MAP)))
    rows.select(values.json_text(F.to_variant_object(whole)).alias("value")).write.mode("overwrite").text(path)


def load_lines(spark: SparkSession, path: str) -> DataFrame:
    """(_kind, _id, _del, _doc) of each object in a dump; _doc is a variant, so that 5 and 5.0 stay apart. Lines that are
    no JSON object are left out."""
    return objects(spark.read.text(path))


def objects(values: DataFrame) -> DataFrame:
    """load_lines() of a column value of JSON texts."""
    rows = values.select(F.try_parse_json(F.col("value")).alias("_doc")).where(F.schema_of_variant("_doc").startswith("OBJECT"))
    get = lambda p, t: F.try_variant_get("_doc", f"$.{p}", t)
    return rows.select(get("_kind", "string").alias("_kind"), get("_id", "string").alias("_id"), F.coalesce(get("_del", "boolean"), F.lit(False)).alias("_del"), "_doc")


def load(old: DataFrame, path: str, kind: str) -> DataFrame:
    """A snapshot after a dump is loaded into it: objects are put whatever their revision, tombstones delete."""
    fields = [f for f in old.schema if f.name not in ("_rev", "_kind")]
    rows = old.sparkSession.read.schema(T.StructType([*fields, T.StructField("_kind", T.StringType())])).json(path).where(F.col("_kind") == kind).drop("_kind")
    live = rows.where(~F.coalesce(F.col("_del"), F.lit(False))) if "_del" in rows.columns else rows
    out = mutate.put(old, live.drop("_del"), check=False)
    return mutate.delete_ids(out, rows.where("_del"), purge=True) if "_del" in rows.columns else out


def incremental(df: DataFrame, since: int, limit_bytes: int | None = None) -> tuple[DataFrame, int, bool]:
    """Rows after a revision, the revision to go on from, and whether there are more.

    With a limit the backup ends before the first revision with which it would be larger; all rows of a revision go
    together, and at least one revision goes. Sizes are summed by revision, and only single numbers reach the driver.
    """
    new = df.where(F.col("_rev") > since)
    if "_sync" in df.columns:
        new = new.where(F.coalesce(F.col("_sync"), F.lit(False)))
    if limit_bytes is None:
        last = new.agg(F.max("_rev")).first()[0]
        return new, since if last is None else last, False
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    per = new.groupBy("_rev").agg(F.sum(size).alias("_n")).persist()
    low, first, high = since, per.agg(F.min("_rev")).first()[0], per.agg(F.max("_rev")).first()[0]
    if first is None:
        return new, since, False
    end = high
    low = first
    while low < end:  # the largest revision up to which the sum is within the limit
        mid = (low + end + 1) // 2
        total = per.where(F.col("_rev") <= mid).agg(F.sum("_n")).first()[0]
        low, end = (mid, end) if total <= limit_bytes else (low, mid - 1)
    per.unpersist()
    return new.where(F.col("_rev") <= low), low, low < high

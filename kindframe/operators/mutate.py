"""Writes as new snapshots: put, merge, merge by query, delete, purge, batch. A snapshot has _id, _rev and _del.

Each operation takes the table as it is and returns the table as it will be. Objects meet by id in one join; conflicts
come back as rows of their own, so that a caller can refuse the write. The rows that one write changes share one new
revision, the table's last plus 1.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindframe.errors import KindError
from kindframe.functions import values

SYSTEM = ("_id", "_rev", "_del", "_kind", "_sync")


def with_system(df: DataFrame, id_col: str, rev: int = 0) -> DataFrame:
    """A plain table as a snapshot of one revision without tombstones."""
    return df.withColumn("_id", F.col(id_col)).withColumn("_rev", F.lit(rev).cast("long")).withColumn("_del", F.lit(False))


def last_rev(df: DataFrame) -> Column:
    """A snapshot's last revision, as a subquery of whatever uses it."""
    return df.agg(F.coalesce(F.max("_rev"), F.lit(0)).cast("long")).scalar()


def conflicts(old: DataFrame, new: DataFrame) -> DataFrame:
    """(_id, error) of new objects that exist already and name no revision, or another one."""
    n = new if "_rev" in new.columns else new.withColumn("_rev", F.lit(None).cast("long"))
    met = old.where("NOT _del").select("_id", F.col("_rev").alias("_old")).join(n.select("_id", F.col("_rev").alias("_new")), "_id")
    error = F.when(F.col("_new").isNull(), "RevNotSpecified").when(F.col("_new") != F.col("_old"), "RevisionMismatch")
    return met.select("_id", error.alias("error")).where("error IS NOT NULL")


def _folded(new: DataFrame, lay: Callable[[Column, Column, str], Column] | None) -> DataFrame:
    """(_id, _n): one object an id. Of objects that repeat an id the last one stays, or with lay each is laid over those before."""
    cols = [c for c in new.columns if c not in ("_rev", "_del")]
    row = F.struct(F.monotonically_increasing_id().alias("_at"), F.struct(*cols).alias("_row"))
    if lay is None:
        return new.select("_id", row.alias("_r")).groupBy("_id").agg(F.max_by("_r._row", "_r._at").alias("_n"))
    # The objects of one write that name one id are few, as a client sends them.
    all_of = new.select("_id", row.alias("_r")).groupBy("_id").agg(F.array_sort(F.collect_list("_r"), lambda a, b: F.when(a["_at"] < b["_at"], -1).otherwise(1)).alias("_all"))
    rows = F.transform("_all", lambda x: x["_row"])
    over = lambda a, b: F.struct("_id", *[lay(a[c], b[c], c).alias(c) for c in cols if c != "_id"])
    one = F.aggregate(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), F.struct("_id", *[rows[0][c].alias(c) for c in cols if c != "_id"]), over)
    return all_of.select("_id", F.when(F.size("_all") == 1, F.struct("_id", *[rows[0][c].alias(c) for c in cols if c != "_id"])).otherwise(one).alias("_n"))


def _combined(old: DataFrame, new: DataFrame, lay: Callable[[Column, Column, str], Column] | None, keep_new: bool) -> DataFrame:
    """Old and new rows in one, lay(old, new, column) where both have it (or else the new one); rows without a change keep
    their revision."""
    kinds = {f.name: f.dataType for f in old.schema}
    data = [c for c in old.columns if c not in ("_id", "_rev", "_del")]
    have = set(new.columns)
    met = old.select("_id", F.struct(*old.columns).alias("_o")).join(_folded(new, lay), "_id", "full" if keep_new else "left")

    def pick(c: str) -> Column:
        was, now = F.col("_o").getField(c), F.col("_n").getField(c) if c in have else None
        if now is None:
            return was if lay else F.when(F.col("_n").isNull(), was)
        return F.when(F.col("_n").isNull(), was).when(F.col("_o").isNull() | F.col("_o._del") | F.lit(lay is None), now).otherwise(lay(was, now, c) if lay else now)

    out = met.select("_id", "_o", "_n", *[pick(c).alias(c) for c in data])
    same = F.col("_n").isNull() | (F.col("_o").isNotNull() & ~F.col("_o._del"))
    for c in data:
        same = same & (F.col("_n").isNull() | values.same(F.col(f"`{c}`"), F.col("_o").getField(c), kinds[c]))
    out = out.withColumn("_same", same)
    rev = F.when(F.col("_same"), F.col("_o._rev")).otherwise(last_rev(old) + 1)
    gone = F.when(F.col("_same"), F.col("_o._del")).otherwise(F.lit(False))
    return out.select("_id", *data, rev.alias("_rev"), gone.alias("_del")).select(*old.columns)


def put(old: DataFrame, new: DataFrame, check: bool = True) -> DataFrame:
    """Insert, or replace by id. With check, an object that exists must name its revision. The last object of an id counts."""
    if check and (bad := conflicts(old, new).first()):
        raise KindError(bad["error"], str(bad["_id"]))
    return _combined(old, new, None, True)


def merge(old: DataFrame, new: DataFrame, ignore_missing: bool = False) -> DataFrame:
    """Lay new objects over old ones: objects merge property by property, scalars and arrays replace. Objects of one id
    are laid over each other in their order."""
    kinds = {f.name: f.dataType for f in old.schema}
    return _combined(old, new, lambda a, b, c: merged(a, b, kinds.get(c)), not ignore_missing)


def merged(old: Column, new: Column, kind: T.DataType) -> Column:
    """The deep merge of two values; null stands for absent."""
    if isinstance(kind, T.StructType):
        both = F.struct(*[merged(old.getField(f.name), new.getField(f.name), f.dataType).alias(f.name) for f in kind])
        return F.when(new.isNull(), old).when(old.isNull(), new).otherwise(both)
    if isinstance(kind, T.VariantType):
        return values.laid_over(old, new)
    return F.coalesce(new, old)


def merge_where(old: DataFrame, match: Column, props: dict[str, Column], rev: int | None = None) -> DataFrame:
    """Set properties on every live row that a query matches; rows that change get a revision."""
    hit = F.coalesce(match & ~F.col("_del"), F.lit(False))
    change = hit & ~reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(v) for c, v in props.items()])
    new = {c: F.when(hit, v).otherwise(F.col(c)) for c, v in props.items()}
    return old.withColumns(new | {"_rev": F.when(change, (last_rev(old) if rev is None else F.lit(rev).cast("long")) + 1).otherwise(F.col("_rev"))})


def merge_put(old: DataFrame, match: Column, props: dict[str, Column], new: DataFrame) -> DataFrame:
    """Merge by query; where nothing matches, put."""
    return put(old, new) if old.where(match & ~F.col("_del")).isEmpty() else merge_where(old, match, props)


def delete(old: DataFrame, match: Column, purge: bool = True) -> DataFrame:
    """Drop matching rows, or leave tombstones."""
    hit = F.coalesce(match, F.lit(False))
    if purge:
        return old.where(~hit)
    live = hit & ~F.col("_del")
    return old.withColumns({"_rev": F.when(live, last_rev(old) + 1).otherwise(F.col("_rev")), "_del": F.col("_del") | hit})


def delete_ids(old: DataFrame, ids: DataFrame, purge: bool = True) -> DataFrame:
    if purge:
        return old.join(ids.select("_id"), "_id", "left_anti").select(*old.columns)
    gone = ids.select("_id").distinct().withColumn("_gone", F.lit(True))
    rev = last_rev(old) + 1
    live = F.coalesce("_gone", F.lit(False)) & ~F.col("_del")
    met = old.join(gone, "_id", "left")
    return met.withColumn("_rev", F.when(live, rev).otherwise(F.col("_rev"))).withColumn("_del", F.col("_del") | live).select(*old.columns)


def purge(old: DataFrame, rev_times: DataFrame, before: Column) -> DataFrame:
    """Drop tombstones up to the last revision whose time in rev_times (rev, ts) is at or before a time."""
    upto = rev_times.where(F.col("ts") <= before).agg(F.max("rev").alias("_upto"))
    last = upto.first()[0]
    return old if last is None else old.where(~F.col("_del") | (F.col("_rev") > last))


def revision_sets(old: DataFrame, new: DataFrame, sets: dict[str, list[str]]) -> DataFrame:
    """new with each set's column at the row's revision where one of the set's properties changed, else as it was."""
    was = old.select("_id", F.struct(*old.columns).alias("_o"))
    met = new.join(was, "_id", "left")
    kinds = {f.name: f.dataType for f in new.schema}
    for name, props in sets.items():
        now, before = F.struct(*[F.col(p) for p in props]), F.struct(*[F.col(f"_o.{p}") for p in props])
        kept = F.col(f"_o.{name}") if name in old.columns else F.lit(None).cast("long")
        kind = T.StructType([T.StructField(p, kinds[p]) for p in props])
        met = met.withColumn(name, F.when(F.col("_o").isNull() | ~values.same(now, before, kind), F.col("_rev")).otherwise(kept))
    return met.drop("_o")


def own_revisions(new: DataFrame, changed: DataFrame) -> DataFrame:
    """new with a revision of its own for each changed row, from the one that they share on, in order of _id.

    changed is what changed_ids() gave, written and read again, as a row's place must not depend on who asks.
    """
    part, place = F.shiftright("_place", 33), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    counts = changed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # one row a partition
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    numbers = changed.withColumn("_part", part).join(before, "_part").select("_id", (F.col("_before") + place).alias("_more"))
    return new.join(numbers, "_id", "left").withColumn("_rev", F.col("_rev") + F.coalesce("_more", F.lit(0))).select(*new.columns)


def changed_ids(old: DataFrame, new: DataFrame) -> DataFrame:
    """(_id, _place) of the rows of new that have a revision after old's last, dealt by ranges of _id; places sort as ids do."""
    ids = new.where(F.col("_rev") > last_rev(old)).select("_id")
    return ids.repartitionByRange("_id").sortWithinPartitions("_id").withColumn("_place", F.monotonically_increasing_id())


def latest(df: DataFrame) -> DataFrame:
    """The newest revision of each id."""
    order = Window.partitionBy("_id").orderBy(F.desc("_rev"))
    return df.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def batch(df: DataFrame, steps: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Steps one after another on one staged snapshot; an error in one leaves df as it was."""
    for step in steps:
        df = step(df)
    return df


def with_sub_ids(c: Column, kind: T.ArrayType) -> Column:
    """Objects in an array get an _id of their own where they have none: hex of their content and place."""
    names = kind.elementType.names
    make = lambda x, i: F.struct(*[x.getField(n).alias(n) for n in names if n != "_id"], F.coalesce(*([x.getField("_id")] if "_id" in names else []), F.lower(F.hex(F.xxhash64(F.to_json(x), i)))).alias("_id"))
    return F.transform(c, make)

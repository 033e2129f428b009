"""aggregate: one grouping property, several functions over several properties, in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindframe.errors import KindError
from kindframe.functions import values
from kindframe.functions.paths import Values, resolve
from kindframe.functions.text import collated, collation
from kindframe.plans.spec import Aggregate

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
NUMBERS = (*WHOLE, T.DecimalType, T.DoubleType, T.FloatType)


def column_name(function: str, prop: str) -> str:
    return f"{function}_{prop.replace('.', '_')}"


def _plain(schema: T.StructType, prop: str) -> Values:
    """Aggregates do not go into arrays: an array is one value."""
    if prop in schema.names:
        return Values(F.col(f"`{prop}`"), schema[prop].dataType)
    v = resolve(schema, prop)
    return Values(F.get(v.column, 0), v.type) if v.many and v.variant else v


def _key(v: Values, collate: str | None) -> Column:
    if v.variant:
        return values.order_key(v.column)
    return collated(v.column, collation(collate)) if isinstance(v.type, T.StringType) else v.column


def _number(v: Values) -> Column:
    """The value as a number: whole numbers stay whole, others get six digits. A variant that is no number is an error."""
    if not v.variant:
        if not isinstance(v.type, NUMBERS):
            raise KindError("InvalidAggregateType", v.type.simpleString())
        return v.column if isinstance(v.type, WHOLE) else F.round(v.column.cast("decimal(38,12)"), 6).cast("decimal(25,6)")
    key = values.order_key(v.column)
    bad = F.raise_error(F.lit("InvalidAggregateType")).cast("decimal(25,6)")
    return F.when(key.isNull(), None).when(key["rank"] == values.INT, key["i"].cast("decimal(25,6)")).when(key["rank"] == values.DECIMAL, key["d"]).otherwise(bad)


def _descending(c: Column, kind: str | None) -> Column:
    """A column that sorts the other way: numbers negated, texts as hex digits turned round, with an end above them all."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return -c.cast("decimal(20,0)")
    return F.concat(F.translate(F.hex(F.encode(c.cast("string"), "utf-8")), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))


def aggregate(df: DataFrame, spec: Aggregate, tie: Column, desc: bool = False, collate: dict[str, str] | None = None, ordered: bool = True) -> DataFrame:
    """A row for each group in order of its key, with <function>_<property> columns; no rows give no row.

    Where very many groups need no order, ordered=False saves the global sort.

    An array as the grouping property puts a row into each element's group. Absent values are skipped property by property.
    first and last are the whole rows with the least and the greatest value, the earliest in order of tie among equals.
    sum and avg need numbers; avg has six digits.
    """
    schema, collate = df.schema, collate or {}
    if spec.group_by:
        g = resolve(schema, spec.group_by)
        name = spec.group_by.split(".")[-1]
        df = df.withColumn("_group", F.explode_outer(g.column) if g.many else g.column)
        keys = [F.to_json(F.col("_group")).alias(name) if g.variant else F.col("_group").alias(name)]
        order = [values.order_key(F.col("_group")).alias("_order")] if g.variant else []
    else:
        name, keys, order = None, [F.lit(1).alias("_all")], []
    out: list[Column] = []
    for function, props in spec.props.items():
        for prop in props:
            v, as_ = _plain(schema, prop), column_name(function, prop)
            key = _key(v, collate.get(prop))
            if function == "cnt":
                out.append(F.count(v.column).alias(as_))
            elif function in ("min", "max"):
                # By key and value, so that a collated or variant value comes back as it is.
                if v.variant:
                    at = (F.min if function == "min" else F.max)(key)
                    text = F.when(at["rank"] == values.BOOL, F.when(at["i"] == 1, "true").otherwise("false"))
                    out.append(F.coalesce(text, at["s"], at["i"].cast("string"), values.decimal_text(at["d"])).alias(as_))
                elif isinstance(v.type, T.StringType) and prop in collate:
                    out.append((F.min_by if function == "min" else F.max_by)(v.column, key).alias(as_))
                else:
                    out.append(getattr(F, function)(v.column).alias(as_))
            elif function in ("first", "last"):
                row = F.struct(*[F.col(f"`{c}`") for c in schema.names if c not in ("_id", "_rev")])
                if function == "first":
                    out.append(F.min_by(row, F.when(key.isNotNull(), F.struct(key.alias("k"), tie.alias("t")))).alias(as_))
                else:
                    out.append(F.max_by(row, F.when(key.isNotNull(), F.struct(key.alias("k"), _descending(tie, dict(df.dtypes).get("_id")).alias("t")))).alias(as_))
            elif function == "sum":
                out.append(F.sum(_number(v)).alias(as_))
            else:
                out.append(F.round(F.avg(_number(v).cast("decimal(25,6)")), 6).cast("decimal(25,6)").alias(as_))
    done = df.groupBy(*keys, *order).agg(*out)
    if name is None:
        return done.drop("_all")
    if not ordered:
        return done.drop("_order")
    by = F.col("_order") if order else F.col(f"`{name}`")
    return done.orderBy(by.desc() if desc else by.asc()).drop("_order")

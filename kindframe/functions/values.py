"""Dynamic values: one order over all types, decimals of six digits, ids, time in microseconds.

Values of schemaless kinds are variants, which Spark neither compares nor groups. order_key() maps them to structs that
compare as the values do: null < object < array < string < false < true < decimal < integer. 5 and 5.0 are of two types.
"""

from __future__ import annotations

import json
import string
from collections.abc import Callable
from decimal import ROUND_HALF_EVEN, Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed ranks of the types.
NULL, OBJECT, ARRAY, STRING, BOOL, DECIMAL, INT = range(1, 8)
KEY_FIELDS = (("rank", "int"), ("d", "decimal(25,6)"), ("i", "bigint"), ("s", "string"))
KEY = "struct<rank:int,d:decimal(25,6),i:bigint,s:string>"
#: The 64 digits of ids: ASCII letters, digits and two marks, sorted, so that later ids sort later.
ID_DIGITS = "".join(sorted(string.ascii_letters + string.digits + "+_"))
#: Objects nest no deeper.
DEPTH = 32
#: json_text() goes so deep, as Spark resolves no more nested functions.
TEXT_DEPTH = 16
OBJECT_MAP = "map<string,variant>"


def _key(rank: Column, d: Column | None = None, i: Column | None = None, s: Column | None = None) -> Column:
    none = F.lit(None)
    parts = ((none if d is None else d).cast("decimal(25,6)").alias("d"), (none if i is None else i).cast("long").alias("i"), (none if s is None else s).cast("string").alias("s"))
    return F.struct(rank.cast("int").alias("rank"), *parts)


def holds(c: Column, test: Callable[[Column], Column]) -> Column:
    """The condition test(c) with c computed once a row. Where a filter names c several times, Spark puts all of its
    expression, such as the parsing of a text, in each place."""
    return F.exists(F.array(c), test)


def order_key(v: Column, kind: Column | None = None) -> Column:
    """The order key of a variant, whose schema_of_variant may be known; null where the property is absent."""
    kind = F.schema_of_variant(v) if kind is None else kind
    number = (
        F.when(F.is_variant_null(v), _key(F.lit(NULL)))
        .when(kind.startswith("OBJECT"), _key(F.lit(OBJECT), s=F.to_json(v)))
        .when(kind.startswith("ARRAY"), _key(F.lit(ARRAY), s=F.to_json(v)))
        .when(kind.startswith("STRING"), _key(F.lit(STRING), s=F.try_variant_get(v, "$", "string")))
        .when(kind == "BOOLEAN", _key(F.lit(BOOL), i=F.try_variant_get(v, "$", "boolean").cast("int")))
        .when(kind == "BIGINT", _key(F.lit(INT), i=F.try_variant_get(v, "$", "bigint")))
        .when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), _key(F.lit(DECIMAL), d=F.try_variant_get(v, "$", "decimal(25,6)")))
    )
    return F.when(v.isNotNull(), number)


def order_literal(value: Any) -> Column:
    """The order key of a query's operand."""
    if value is None:
        return _key(F.lit(NULL))
    if isinstance(value, bool):
        return _key(F.lit(BOOL), i=F.lit(int(value)))
    if isinstance(value, int):
        return _key(F.lit(INT), i=F.lit(value))
    if isinstance(value, (float, Decimal)):
        return _key(F.lit(DECIMAL), d=F.lit(rounded(value)))
    if isinstance(value, str):
        return _key(F.lit(STRING), s=F.lit(value))
    return _key(F.lit(OBJECT if isinstance(value, dict) else ARRAY), s=F.to_json(F.parse_json(F.lit(json.dumps(value)))))


def rounded(value: float | Decimal) -> Decimal:
    return Decimal(repr(value) if isinstance(value, float) else value).quantize(Decimal("0.000001"), ROUND_HALF_EVEN)


def decimal_text(c: Column) -> Column:
    """A decimal as JSON has it: at least one digit of fraction, no more zeros than that."""
    return F.regexp_replace(c.cast("decimal(19,6)").cast("string"), r"(\.\d+?)0+$", "$1")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def new_id(seed: Column, at: Column) -> Column:
    """An id of 11 digits of six bits: 50 bits of microseconds, 14 of a hash of seed."""
    bits = F.shiftleft(at.bitwiseAND(F.lit((1 << 50) - 1)), 14).bitwiseOR(F.xxhash64(seed).bitwiseAND(F.lit((1 << 14) - 1)))
    digits = [F.substring(F.lit(ID_DIGITS), (F.shiftrightunsigned(bits, max(0, 58 - 6 * k)) if k < 10 else F.shiftleft(bits, 2)).bitwiseAND(F.lit(63)).cast("int") + 1, F.lit(1)) for k in range(11)]
    return F.concat(*digits)


# --- schemaless values as a whole


def has_variant(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(has_variant(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return has_variant(kind.elementType)
    return isinstance(kind, T.VariantType) or isinstance(kind, T.MapType) and has_variant(kind.valueType)


def same(a: Column, b: Column, kind: T.DataType) -> Column:
    """Whether two values are equal, absent ones too. Variants of other types, such as 5 and 5.0, are not."""
    if isinstance(kind, T.VariantType):
        return F.to_json(a).eqNullSafe(F.to_json(b)) & F.schema_of_variant(a).eqNullSafe(F.schema_of_variant(b))
    return F.to_json(F.struct(a.alias("v"))).eqNullSafe(F.to_json(F.struct(b.alias("v")))) if has_variant(kind) else a.eqNullSafe(b)


def is_object(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("OBJECT")


def laid_over(old: Column, new: Column, depth: int = DEPTH) -> Column:
    """The deep merge of two variants: objects merge property by property, anything else is replaced; null is absent."""
    if not depth:
        return F.coalesce(new, old)
    both = F.to_variant_object(F.map_zip_with(old.cast(OBJECT_MAP), new.cast(OBJECT_MAP), lambda k, a, b: laid_over(a, b, depth - 1)))
    return F.when(new.isNull(), old).when(old.isNull() | ~(is_object(old) & is_object(new)), new).otherwise(both)


def json_text(v: Column, depth: int = TEXT_DEPTH) -> Column:
    """A variant as JSON text in which decimals keep a fraction, as 5.0 and 5 are of two types; further down than depth whole
    decimals lose theirs."""
    kind = F.schema_of_variant(v)
    number = decimal_text(F.try_variant_get(v, "$", "decimal(25,6)"))
    plain = F.when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), number).otherwise(F.to_json(v))
    if not depth:
        return plain
    # Objects and arrays as one list of what stands before each value, and the value.
    props = F.transform(F.array_sort(F.map_keys(v.cast(OBJECT_MAP))), lambda k: F.struct(F.to_json(F.struct(k.alias("k"))).alias("p"), v.cast(OBJECT_MAP)[k].alias("v")))
    # to_json of {"k": name} is the name quoted between a fixed head and tail.
    props = F.transform(props, lambda x: F.struct(F.concat(F.substring(x["p"], F.lit(6), F.length(x["p"]) - 6), F.lit(":")).alias("p"), x["v"].alias("v")))
    items = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.struct(F.lit("").alias("p"), x.alias("v")))
    inside = F.array_join(F.transform(F.when(is_object(v), props).otherwise(items), lambda x: F.concat(x["p"], json_text(x["v"], depth - 1))), ",")
    # inside stands here once, as each level would double it otherwise.
    whole = F.concat(F.when(is_object(v), "{").otherwise("["), inside, F.when(is_object(v), "}").otherwise("]"))
    return F.when(is_object(v) | kind.startswith("ARRAY"), whole).otherwise(plain)


def object_hash(v: Column) -> Column:
    """A 64-bit hash of a variant's whole content; the order of an object's properties does not count."""
    return F.xxhash64(F.to_json(v), F.schema_of_variant(v))


# --- scalar helpers


def to_base64(c: Column, ids: bool = False) -> Column:
    """Bytes as base64 text: the MIME alphabet, or that of ids, without padding."""
    text = F.replace(F.base64(c), F.lit("\r\n"), F.lit(""))
    return F.translate(text, MIME + "=", ID_DIGITS) if ids else text


def from_base64(c: Column, ids: bool = False) -> Column:
    """The bytes of base64 text; null for text that is none."""
    text = F.translate(c, ID_DIGITS, MIME) if ids else c
    return F.try_to_binary(F.rpad(text, (F.length(text) + F.pmod(-F.length(text), F.lit(4))).cast("int"), F.lit("=")), F.lit("base64"))


#: The MIME alphabet in its order, which is fixed.
MIME = string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/"


def as_int(v: Column) -> Column:
    """A variant as a whole number: decimals lose their fraction, booleans are 0 and 1, texts are read, all else is 0."""
    key = order_key(v)
    text = F.coalesce(F.regexp_extract(key["s"], r"^\s*([+-]?\d+)", 1).try_cast("bigint"), F.lit(0))
    return F.when(v.isNull(), None).when(key["rank"].isin(INT, BOOL), key["i"]).when(key["rank"] == DECIMAL, key["d"].cast("bigint")).when(key["rank"] == STRING, text).otherwise(F.lit(0).cast("bigint"))


def as_decimal(v: Column) -> Column:
    key = order_key(v)
    number = F.coalesce(F.regexp_extract(key["s"], r"^\s*([+-]?\d+(?:\.\d*)?)", 1).try_cast("decimal(25,6)"), F.lit(0))
    return F.when(v.isNull(), None).when(key["rank"].isin(INT, BOOL), key["i"].cast("decimal(25,6)")).when(key["rank"] == DECIMAL, key["d"]).when(key["rank"] == STRING, number).otherwise(F.lit(0)).cast("decimal(25,6)")


def as_bool(v: Column) -> Column:
    """false, 0, 0.0, null and the text false are false; any other value is true."""
    key = order_key(v)
    return F.when(v.isNull(), None).when(key["rank"].isin(INT, BOOL), key["i"] != 0).when(key["rank"] == DECIMAL, key["d"] != 0).when(key["rank"] == STRING, F.lower(key["s"]) != "false").otherwise(key["rank"] != NULL)


def as_text(v: Column) -> Column:
    """A scalar's text, and an object's or array's JSON."""
    key = order_key(v)
    return F.when(v.isNull(), None).when(key["rank"].isin(STRING, OBJECT, ARRAY), key["s"]).when(key["rank"] == BOOL, F.when(key["i"] == 1, "true").otherwise("false")).when(key["rank"] == INT, key["i"].cast("string")).when(key["rank"] == DECIMAL, decimal_text(key["d"])).otherwise("null")

"""JSON schemas as Column expressions: each rule is one condition, and a row is valid if none fails."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindframe.functions import values

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
REAL = (T.FloatType, T.DoubleType, T.DecimalType)


def _is(kind: T.DataType, name) -> bool:
    if isinstance(name, dict) or isinstance(kind, T.VariantType):
        return True
    return {"any": True, "string": isinstance(kind, T.StringType), "integer": isinstance(kind, WHOLE), "number": isinstance(kind, (*WHOLE, *REAL)), "boolean": isinstance(kind, T.BooleanType), "object": isinstance(kind, (T.StructType, T.MapType)), "array": isinstance(kind, T.ArrayType), "null": False}.get(name, False)


#: What schema_of_variant says of each type, as a pattern.
VARIANT = {"string": "^STRING", "integer": "^BIGINT", "number": "^(BIGINT|DECIMAL|DOUBLE|FLOAT)", "boolean": "^BOOLEAN", "object": "^OBJECT", "array": "^ARRAY", "null": "^VOID"}


def _property(kind: T.DataType, schema: dict, absent: Column, c: Column) -> Column:
    """A property against its schema; absent says whether it may be so."""
    return F.when(c.isNull(), absent).otherwise(valid(c, kind, schema))


def _variant_rules(c: Column, kind: Column, schema: dict) -> list[tuple[str, Column]]:
    """rules() of a variant and what schema_of_variant says of it: each rule holds for values that are not of its type."""
    when = lambda name, test: F.when(F.regexp_like(kind, F.lit(VARIANT[name])), test).otherwise(True)
    number, text = F.try_variant_get(c, "$", "decimal(25,6)"), F.try_variant_get(c, "$", "string")
    out: list[tuple[str, Column]] = []

    def typed(wanted) -> Column:
        options = wanted if isinstance(wanted, list) else [wanted]
        one = [valid(c, T.VariantType(), o) if isinstance(o, dict) else F.lit(True) if o == "any" else F.regexp_like(kind, F.lit(VARIANT[o])) for o in options]
        return reduce(lambda a, b: a | b, one, F.lit(False))

    if "type" in schema:
        out.append(("type", typed(schema["type"])))
    if "disallow" in schema:
        out.append(("disallow", ~typed(schema["disallow"])))
    if "enum" in schema:
        among = lambda key: reduce(lambda a, b: a | b, [key == values.order_literal(v) for v in schema["enum"]], F.lit(False))
        out.append(("enum", values.holds(values.order_key(c, kind), among)))
    for name, test in (("minimum", lambda v, eq: number >= v if eq else number > v), ("maximum", lambda v, eq: number <= v if eq else number < v)):
        if name in schema:
            out.append((name, when("number", test(schema[name], schema.get(f"{name}CanEqual", True)))))
    if "divisibleBy" in schema:
        out.append(("divisibleBy", when("number", number % schema["divisibleBy"] == 0)))
    for name, test in (("minLength", lambda v: F.length(text) >= v), ("maxLength", lambda v: F.length(text) <= v), ("pattern", lambda v: F.regexp_like(text, F.lit(v)))):
        if name in schema:
            out.append((name, when("string", test(schema[name]))))
    items = F.try_variant_get(c, "$", "array<variant>")
    for name, test in (("minItems", lambda v: F.size(items) >= v), ("maxItems", lambda v: F.size(items) <= v)):
        if name in schema:
            out.append((name, when("array", test(schema[name]))))
    if schema.get("uniqueItems"):
        keys = F.transform(items, lambda x: values.order_key(x))
        out.append(("uniqueItems", when("array", F.size(F.array_distinct(keys)) == F.size(items))))
    if isinstance(schema.get("items"), dict):
        out.append(("items", when("array", F.forall(items, lambda x: valid(x, T.VariantType(), schema["items"])))))
    elif isinstance(schema.get("items"), list):
        out += [(f"items[{i}]", when("array", (F.size(items) <= i) | valid(F.get(items, i), T.VariantType(), s))) for i, s in enumerate(schema["items"])]
        if schema.get("additionalProperties") is False:
            out.append(("items", when("array", F.size(items) <= len(schema["items"]))))
    known = schema.get("properties", {})
    get = lambda n: F.try_variant_get(c, f"$['{n}']", "variant")
    for name, sub in known.items():
        must = sub.get("required", not sub.get("optional", False))
        out.append((name, when("object", values.holds(get(name), partial(_property, T.VariantType(), sub, F.lit(not must))))))
        if "requires" in sub:
            out.append((f"{name}.requires", when("object", get(name).isNull() | get(sub["requires"]).isNotNull())))
    more = schema.get("additionalProperties", True)
    if more is not True and not isinstance(schema.get("items"), list):
        extra = F.map_filter(c.cast(values.OBJECT_MAP), lambda k, v: ~k.isin(list(known)) & ~k.startswith("_"))
        test = F.size(extra) == 0 if more is False else F.forall(F.map_values(extra), lambda v: valid(v, T.VariantType(), more))
        out.append(("additionalProperties", when("object", test)))
    return out


def _type(c: Column, kind: T.DataType, wanted) -> Column:
    """A value against a type, or a union of types and schemas."""
    options = wanted if isinstance(wanted, list) else [wanted]
    out = []
    for o in options:
        if isinstance(o, dict):
            out.append(valid(c, kind, o))
        elif o == "null":
            out.append(c.isNull())
        elif o == "integer" and isinstance(kind, REAL):
            out.append(c.isNotNull() & (c == F.floor(c)))
        else:
            out.append(c.isNotNull() if o != "any" and _is(kind, o) else F.lit(_is(kind, o)))
    return reduce(lambda a, b: a | b, out, F.lit(False))


def rules(c: Column, kind: T.DataType, schema: dict) -> list[tuple[str, Column]]:
    """(rule, condition) for a present value."""
    if isinstance(kind, T.VariantType):
        return _variant_rules(c, F.schema_of_variant(c), schema)
    out: list[tuple[str, Column]] = []
    if "type" in schema:
        out.append(("type", _type(c, kind, schema["type"])))
    if "disallow" in schema:
        out.append(("disallow", ~_type(c, kind, schema["disallow"])))
    if "enum" in schema:
        out.append(("enum", F.coalesce(c.isin([v for v in schema["enum"] if v is not None]), F.lit(None in schema["enum"]))))
    if isinstance(kind, (*WHOLE, *REAL)):
        if "minimum" in schema:
            out.append(("minimum", c >= schema["minimum"] if schema.get("minimumCanEqual", True) else c > schema["minimum"]))
        if "maximum" in schema:
            out.append(("maximum", c <= schema["maximum"] if schema.get("maximumCanEqual", True) else c < schema["maximum"]))
        if "divisibleBy" in schema:
            out.append(("divisibleBy", c % schema["divisibleBy"] == 0))
    if isinstance(kind, T.StringType):
        if "minLength" in schema:
            out.append(("minLength", F.length(c) >= schema["minLength"]))
        if "maxLength" in schema:
            out.append(("maxLength", F.length(c) <= schema["maxLength"]))
        if "pattern" in schema:
            out.append(("pattern", F.regexp_like(c, F.lit(schema["pattern"]))))
    if isinstance(kind, T.ArrayType):
        if "minItems" in schema:
            out.append(("minItems", F.size(c) >= schema["minItems"]))
        if "maxItems" in schema:
            out.append(("maxItems", F.size(c) <= schema["maxItems"]))
        if schema.get("uniqueItems"):
            out.append(("uniqueItems", F.size(F.array_distinct(c)) == F.size(c)))
        if isinstance(schema.get("items"), dict):
            out.append(("items", F.forall(c, lambda x: valid(x, kind.elementType, schema["items"]))))
        elif isinstance(schema.get("items"), list):
            out += [(f"items[{i}]", (F.size(c) <= i) | valid(F.get(c, i), kind.elementType, s)) for i, s in enumerate(schema["items"])]
            if schema.get("additionalProperties") is False:
                out.append(("items", F.size(c) <= len(schema["items"])))
    if isinstance(kind, T.StructType):
        get = lambda n: c.getField(n) if n in kind.names else F.lit(None)
        for name, sub in schema.get("properties", {}).items():
            must = sub.get("required", not sub.get("optional", False))
            if name not in kind.names:
                out.append((name, F.lit(not must)))
                continue
            there = partial(_property, kind[name].dataType, sub, _null_ok(sub, must))
            out.append((name, values.holds(get(name), there) if isinstance(kind[name].dataType, T.VariantType) else there(get(name))))
            if "requires" in sub:
                out.append((f"{name}.requires", get(name).isNull() | get(sub["requires"]).isNotNull()))
        extra = [n for n in kind.names if n not in schema.get("properties", {}) and not n.startswith("_")]
        more = schema.get("additionalProperties", True)
        if more is False:
            out += [(n, get(n).isNull()) for n in extra]
        elif isinstance(more, dict):
            out += [(n, get(n).isNull() | valid(get(n), kind[n].dataType, more)) for n in extra]
    return out


def _null_ok(sub: dict, must: bool) -> Column:
    kinds = sub.get("type", "any")
    return F.lit(not must or "null" in (kinds if isinstance(kinds, list) else [kinds]))


def valid(c: Column, kind: T.DataType, schema: dict) -> Column:
    """Whether a value meets every rule of a schema."""
    met = lambda found: F.coalesce(reduce(lambda a, b: a & b, [r for _, r in found], F.lit(True)), F.lit(False))
    if isinstance(kind, T.VariantType):
        # Each rule names the value and its type.
        return values.holds(c, lambda v: values.holds(F.schema_of_variant(v), lambda k: met(_variant_rules(v, k, schema))))
    return met(rules(c, kind, schema))


def validate(df: DataFrame, schema: dict) -> DataFrame:
    """df plus _failed: the names of the rules that a row breaks, in order; empty for a valid row."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    failed = [F.when(~F.coalesce(r, F.lit(False)), F.lit(n)) for n, r in rules(row, df.schema, schema)]
    none = F.array().cast("array<string>")
    return df.withColumn("_failed", F.filter(F.array(*failed), lambda x: x.isNotNull()) if failed else none)

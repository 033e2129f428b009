"""Clauses as Column predicates, in a shape that reaches the scan where the property is a plain column."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindframe.functions import text, values
from kindframe.functions.paths import Values, resolve
from kindframe.plans.spec import Bound, Clause


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def _operand(val: Any, kind: T.DataType) -> Column:
    if isinstance(val, dict) and isinstance(kind, T.StructType):
        return F.struct(*[_operand(val.get(f.name), f.dataType).cast(f.dataType).alias(f.name) for f in kind])
    return F.lit(val)


def _compare(c: Column, kind: T.DataType, b: Bound, collate: str | None) -> Column:
    """One element against one operator. Nulls inside variants are values; a null column is absent."""
    if isinstance(kind, T.VariantType):
        if b.op in ("%", "%%", "?") and all(isinstance(v, str) for v in (b.val if isinstance(b.val, list) else [b.val])):
            return _compare(F.try_variant_get(c, "$", "string"), T.StringType(), b, collate)
        key, lit = values.order_key(c), values.order_literal
    else:
        own = collate if isinstance(kind, T.StringType) else None
        key, lit = text.collated(c, own), lambda v: text.collated(_operand(v, kind), own)
    if b.op in ("=", "%") and isinstance(b.val, (list, tuple)):
        one = [v for i, v in enumerate(b.val) if v not in b.val[:i]]
        if b.op == "=" and not isinstance(kind, (T.VariantType, T.StructType)) and not collate and None not in one:
            return key.isin(one) if one else F.lit(False)
        return _any([_compare(c, kind, Bound(b.op, v), collate) for v in one])
    if b.op == "%" and isinstance(b.val, str) and isinstance(kind, T.StringType):
        return text.begins_with(c, F.lit(b.val), collate)
    if b.op == "?":
        return text.matches(text.tokens(c), b.val, collate)
    if b.val is None and not isinstance(kind, T.VariantType):
        return {"=": c.isNull(), "!=": c.isNotNull(), "<=": c.isNull(), ">=": F.lit(True), ">": c.isNotNull()}.get(b.op, F.lit(False))
    v = lit(b.val)
    return {"=": lambda: key == v, "%": lambda: key == v, "!=": lambda: key != v, "<": lambda: key < v, "<=": lambda: key <= v, ">": lambda: key > v, ">=": lambda: key >= v}[b.op]()


def _all_of(c: Column, kind: T.DataType, bounds: list[Bound], test) -> Column:
    return reduce(lambda a, b: a & b, [test(c, kind, b) for b in bounds])


def element_test(clause: Clause, kind: T.DataType, collate: str | None):
    return lambda c: _all_of(c, kind, clause.bounds, lambda x, k, b: _compare(x, k, b, collate))


def where(schema: T.StructType, clause: Clause, found: Values | None = None) -> Column:
    """A where clause: any element of a many-valued property may meet it. Full-text words may be in several elements."""
    v = found or resolve(schema, clause.prop)
    collate = text.collation(clause.collate)
    if clause.bounds[0].op == "?":
        words = F.flatten(F.transform(v.array(), lambda x: text.tokens(F.try_variant_get(x, "$", "string") if v.variant else x)))
        return F.coalesce(text.matches(words, clause.bounds[0].val, collate), F.lit(False))
    test = element_test(clause, v.type, collate)
    return F.exists(v.column, test) if v.many else test(v.column)


def _filtered(c: Column, kind: T.DataType, b: Bound) -> Column:
    """One element against one filter operator: prefixes and substrings are case-blind, collations do not count."""
    if b.op in ("%", "%%"):
        if isinstance(kind, T.VariantType):
            c = F.try_variant_get(c, "$", "string")
        part = text.starts_ci if b.op == "%" else text.contains_ci
        return _any([part(c, str(v)) for v in (b.val if isinstance(b.val, (list, tuple)) else [b.val])])
    return _compare(c, kind, b, None)


def post_filter(schema: T.StructType, clause: Clause) -> Column:
    """A filter clause: both bounds must hold for one element; absent properties fail."""
    v = resolve(schema, clause.prop)
    test = lambda c: _all_of(c, v.type, clause.bounds, _filtered)
    return F.coalesce(F.exists(v.column, test) if v.many else test(v.column), F.lit(False))

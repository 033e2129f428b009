"""select: dotted paths that keep the nested shape, inside arrays too."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindframe.errors import KindError


def _tree(paths: list[str]) -> dict:
    """Paths as nested keys; a path takes in those below it."""
    root: dict = {}
    for p in sorted(paths):
        at, parts = root, p.split(".")
        for i, name in enumerate(parts):
            if at.get(name, 0) is None:
                break
            if i == len(parts) - 1:
                at[name] = None
            else:
                at = at.setdefault(name, {})
    return root


def _cut(c: Column, kind: T.DataType, tree: dict | None) -> Column:
    if tree is None:
        return c
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _cut(x, kind.elementType, tree))
    if isinstance(kind, T.StructType):
        kept = [_cut(c.getField(n), kind[n].dataType, t).alias(n) for n, t in tree.items() if n in kind.names]
        return F.when(c.isNotNull(), F.struct(*kept)) if kept else F.lit(None)
    if isinstance(kind, T.VariantType):
        return F.struct(*[_cut(F.try_variant_get(c, f"$.{n}", "variant"), kind, t).alias(n) for n, t in tree.items()])
    raise KindError("InvalidQuery", "select goes into objects and arrays")


def select(schema: T.StructType, paths: list[str]) -> list[Column]:
    """Columns for the paths; properties that no row can have are left out."""
    whole = [p for p in paths if p in schema.names and "." in p]
    tree = _tree([p for p in paths if p not in whole])
    out = [F.col(f"`{p}`") for p in whole]
    for name, sub in tree.items():
        if name in schema.names:
            out.append(_cut(F.col(f"`{name}`"), schema[name].dataType, sub).alias(name))
        elif "_doc" in schema.names:
            out.append(_cut(F.try_variant_get(F.col("_doc"), f"$.{name}", "variant"), T.VariantType(), sub).alias(name))
    return out

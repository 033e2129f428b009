"""Property paths: dots go into objects, arrays fan out at every level, * stands for all of an object's values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindframe.errors import KindError


@dataclass(frozen=True)
class Values:
    """What a path leads to: one value of a type, or an array of them."""

    column: Column
    type: T.DataType
    many: bool = False

    @property
    def variant(self) -> bool:
        return isinstance(self.type, T.VariantType)

    def array(self) -> Column:
        return self.column if self.many else F.when(self.column.isNotNull(), F.array(self.column))

    def default(self, value) -> Values:
        """The value where the property is absent."""
        if self.variant:
            raise KindError("InvalidIndex", "defaults need typed properties")
        lit = F.array(*map(F.lit, value)) if isinstance(value, list) else F.array(F.lit(value)) if self.many else F.lit(value)
        if isinstance(value, list) and not self.many:
            return Values(F.coalesce(F.array(self.column), lit), self.type, True)
        return Values(F.coalesce(self.column, lit), self.type, self.many)


def _fan(v: Values) -> Values:
    """Arrays as many values; a variant may hold an array."""
    while isinstance(v.type, T.ArrayType):
        v = Values(F.flatten(v.column) if v.many else v.column, v.type.elementType, True)
    return v


def _step(v: Values, name: str) -> Values:
    t = v.type
    if isinstance(t, T.VariantType):
        get = lambda c: F.try_variant_get(c, f"$.{name}" if name.isidentifier() else f"$['{name}']", "variant")
        return Values(F.filter(F.transform(v.column, get), lambda x: x.isNotNull()) if v.many else get(v.column), t, v.many)
    if name == "*":
        if isinstance(t, T.MapType):
            all_of, inner = F.map_values, t.valueType
        elif isinstance(t, T.StructType) and len({f.dataType for f in t}) == 1:
            all_of, inner = (lambda c: F.array(*[c.getField(f.name) for f in t])), t[0].dataType
        else:
            raise KindError("InvalidQuery", "* needs an object whose values have one type")
        got = F.flatten(F.transform(v.column, all_of)) if v.many else all_of(v.column)
        return _fan(Values(got, inner, True))
    if isinstance(t, T.StructType) and name in t.names:
        get, inner = (lambda c: c.getField(name)), t[name].dataType
    elif isinstance(t, T.MapType):
        get, inner = (lambda c: c.getItem(name)), t.valueType
    else:
        raise KindError("InvalidQuery", f"no property {name}")
    return _fan(Values(F.transform(v.column, get) if v.many else get(v.column), inner, v.many))


def resolve(schema: T.StructType, path: str) -> Values:
    """The values of a dotted path in rows of a schema. A column whose name has the dots wins."""
    if path in schema.names:
        return _fan(Values(F.col(f"`{path}`"), schema[path].dataType))
    first, *rest = path.split(".")
    if first not in schema.names:
        if "_doc" in schema.names and isinstance(schema["_doc"].dataType, T.VariantType):
            first, rest = "_doc", [first, *rest]
        else:
            raise KindError("InvalidQuery", f"no property {path}")
    v = _fan(Values(F.col(f"`{first}`"), schema[first].dataType))
    for name in rest:
        v = _step(v, name)
    if v.variant and not v.many:
        # A variant array fans out like any other.
        is_array = F.schema_of_variant(v.column).startswith("ARRAY")
        return Values(F.when(is_array, F.try_variant_get(v.column, "$", "array<variant>")).when(v.column.isNotNull(), F.array(v.column)), v.type, True)
    return v


def exists(schema: T.StructType, path: str) -> bool:
    try:
        resolve(schema, path)
    except KindError:
        return False
    return True

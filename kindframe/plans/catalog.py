"""Kinds and the queries over them.

A kind is a DataFrame with a name, an id column, indexes and supers. find() and search() turn a checked query into filters,
an order, a limit and a projection; Catalyst does the rest. In strict mode a query needs an index that can answer it,
and rows that lack a property of that index are not in the result, as in an indexed store; otherwise any property may be
asked for, and rows are left out by the conditions alone.
"""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindframe.errors import KindError
from kindframe.functions import values
from kindframe.functions.paths import Values, resolve
from kindframe.functions.text import collated, collation
from kindframe.operators import predicates, projection
from kindframe.operators.aggregate import aggregate
from kindframe.plans.spec import QuerySpec, check_find, parse


@dataclass
class Index:
    """Named properties in order. default stands in for an absent property; include feeds one property from several."""

    props: list[str]
    name: str = ""
    inc_del: bool = False
    collate: dict[str, str] = field(default_factory=dict)
    default: dict[str, Any] = field(default_factory=dict)
    include: dict[str, list[str]] = field(default_factory=dict)

    def answers(self, q: QuerySpec) -> bool:
        """Whether the query's rows lie together in the index: its properties lead, the compared one last, the order next."""
        asked = {c.prop: c for c in q.where}
        props = self.props[1:] if self.inc_del and "_del" not in asked else self.props
        if not asked:
            return props[:1] == [q.order_by] if q.order_by else self.props == ["_id"]
        lead, rest = props[: len(asked)], props[len(asked) :]
        if set(lead) != set(asked) or any(not asked[p].equal for p in lead[:-1]):
            return False
        if any(asked[p].collate != self.collate.get(p) for p in lead):
            return False
        return not q.order_by or q.order_by in asked or rest[:1] == [q.order_by]


@dataclass
class Kind:
    name: str
    df: DataFrame
    id_col: str = "_id"
    indexes: list[Index] = field(default_factory=list)
    extends: list[str] = field(default_factory=list)
    owner: str = ""
    schema: dict | None = None
    rev_sets: dict[str, list[str]] = field(default_factory=dict)


class Catalog:
    def __init__(self, spark: SparkSession, strict: bool = False, locale: str | None = None):
        self.spark, self.strict, self.locale = spark, strict, locale
        self.kinds: dict[str, Kind] = {}
        self._cache: dict[str, tuple[int, DataFrame]] = {}
        self._version: dict[str, int] = {}

    def set_locale(self, locale: str | None) -> None:
        """Collate by another locale from now on; kept results are of the old one and go."""
        self.locale = locale
        for name in self._version:
            self._version[name] += 1

    # --- kinds

    def put_kind(self, name: str, df: DataFrame, id_col: str = "_id", **more) -> Kind:
        base, _, version = name.rpartition(":")
        if not base or not version.isdigit() or len(name) > 256:
            raise KindError("KindNotSpecified", name)
        for p in more.get("extends", ()):
            if p not in self.kinds and p != "Object:1":
                raise KindError("KindNotRegistered", p)
        self.kinds[name] = kind = Kind(name, df, id_col, **more)
        self._version[name] = self._version.get(name, 0) + 1
        return kind

    def del_kind(self, name: str, recursive: bool = False) -> None:
        subs = [k.name for k in self.kinds.values() if name in k.extends]
        if subs and not recursive:
            raise KindError("KindHasSubKinds", name)
        for s in subs:
            self.del_kind(s, True)
        self.kind(name)
        del self.kinds[name]

    def kind(self, name: str) -> Kind:
        if name not in self.kinds:
            raise KindError("KindNotRegistered", name)
        return self.kinds[name]

    def closure(self, name: str) -> list[Kind]:
        """A kind and all that extend it; Object:1 is everybody's super."""
        if name == "Object:1":
            return list(self.kinds.values())
        out = [self.kind(name)]
        for k in self.kinds.values():
            if name in k.extends:
                out += [s for s in self.closure(k.name) if s not in out]
        return out

    def rows(self, name: str, exclude: tuple[str, ...] = (), active_shards: DataFrame | None = None) -> DataFrame:
        """The rows of a kind and its sub-kinds, with _id; of kinds not excluded, and of active shards if these are given."""
        parts = [k for k in self.closure(name) if k.name not in exclude]
        if not parts:
            raise KindError("KindNotRegistered", name)
        dfs = [k.df if k.id_col == "_id" else k.df.withColumn("_id", F.col(k.id_col)) for k in parts]
        if len(dfs) > 1:
            dfs = [d if "_kind" in d.columns else d.withColumn("_kind", F.lit(k.name)) for k, d in zip(parts, dfs, strict=True)]
        out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
        if active_shards is not None and "_shard" in out.columns:
            out = out.join(active_shards.select("_shard"), "_shard", "left_semi")
        return out

    # --- queries

    def _index(self, q: QuerySpec, search: bool) -> Index | None:
        order, q.order_by = q.order_by, None if search else q.order_by
        try:
            found = [i for i in (Index(["_id"]), *(x for k in self.closure(q.kind) for x in k.indexes)) if i.answers(q)]
        finally:
            q.order_by = order
        if not found and self.strict:
            raise KindError("NoIndexForQuery", q.kind)
        return min(found, key=lambda i: len(i.props)) if found else None

    def _values(self, df: DataFrame, prop: str, index: Index | None) -> Values:
        if index and prop in index.include:
            parts = [resolve(df.schema, p) for p in index.include[prop]]
            none = F.array().cast(f"array<{parts[0].type.simpleString()}>")
            return Values(F.concat(*[F.coalesce(p.array(), none) for p in parts]), parts[0].type, True)
        v = resolve(df.schema, prop)
        return v.default(index.default[prop]) if index and prop in index.default else v

    def _narrowed(self, q: QuerySpec, search: bool) -> tuple[DataFrame, Index | None]:
        df = self.rows(q.kind)
        index = self._index(q, search)
        if "_del" in df.columns and not q.inc_del and not any(c.prop == "_del" for c in q.where):
            df = df.where(~F.coalesce(F.col("_del"), F.lit(False)))
        for c in q.where:
            df = df.where(predicates.where(df.schema, c, self._values(df, c.prop, index)))
        if self.strict and index:
            for p in index.props:
                if p not in ("_id", "_del"):
                    v = self._values(df, p, index)
                    df = df.where(F.size(v.column) > 0 if v.many else v.column.isNotNull())
        for c in q.filter:
            df = df.where(predicates.post_filter(df.schema, c))
        return df, index

    def _sort_key(self, df: DataFrame, q: QuerySpec, index: Index | None, search: bool) -> Column | None:
        if not q.order_by:
            return None
        v = self._values(df, q.order_by, index)
        clause = next((c for c in q.where if c.prop == q.order_by), None)
        strength = (clause.collate if clause else None) or next((i.collate[q.order_by] for k in self.closure(q.kind) for i in k.indexes if q.order_by in i.collate), None)
        name = collation(strength, self.locale)
        one = (lambda c: values.order_key(c)) if v.variant else (lambda c: collated(c, name)) if name else (lambda c: c)
        if not v.many:
            return one(v.column)
        # A row stands where its first matching element does.
        found = v.column
        if clause and not search:
            found = F.filter(found, predicates.element_test(clause, v.type, name))
        keys = F.transform(found, one)
        return F.array_max(keys) if q.desc else F.array_min(keys)

    def _further(self, df: DataFrame, q: QuerySpec, index: Index | None, search: bool) -> list[Column]:
        """In find, rows of one value stand in order of the index's properties after that one."""
        if search or not index or q.order_by and q.order_by not in index.props:
            return []
        # Without an order, compared properties are equal, and those after them give the order.
        start = index.props.index(q.order_by) + 1 if q.order_by else len(q.where)
        rest = [self._values(df, p, index) for p in index.props[start:] if p not in ("_id", "_del")]
        return [values.order_key(v.column) if v.variant else v.column for v in rest if not v.many]

    def _ordered(self, df: DataFrame, q: QuerySpec, key: Column | None, further: list[Column] = ()) -> DataFrame:
        cols = [c for c in (key, *further, F.col("_id")) if c is not None]
        return df.orderBy(*[c.desc() if q.desc else c.asc() for c in cols])

    def _finished(self, df: DataFrame, q: QuerySpec, key: Column | None, further: list[Column] = ()) -> DataFrame:
        if q.distinct:
            v = resolve(df.schema, q.distinct)
            name = q.distinct.split(".")[-1]
            # Not in order of _id any more: a value is all that is left of its rows.
            out = df.where(v.column.isNotNull()).select((F.explode(v.column) if v.many else v.column).alias(name)).distinct()
            out = out.orderBy(F.col(f"`{name}`").desc() if q.desc else F.col(f"`{name}`").asc())
            return out if q.limit is None else out.limit(q.limit)
        if not q.immediate and (key is not None or further or q.limit is not None or q.desc):
            df = self._ordered(df, q, key, further)
        if q.limit is not None:
            df = df.limit(q.limit)
        return df.select(*projection.select(df.schema, q.select)) if q.select else df

    def _aggregated(self, df: DataFrame, q: QuerySpec, ordered: bool = True) -> DataFrame:
        if q.limit is not None:  # a limit counts rows that go in
            df = self._ordered(df, q, None).limit(q.limit)
        strengths = {p: s for k in self.closure(q.kind) for i in k.indexes for p, s in i.collate.items()}
        return aggregate(df, q.aggregate, F.col("_id"), q.desc, strengths, ordered)

    def find(self, query: dict, service: bool = False, ordered: bool = True) -> DataFrame:
        """Rows in order of the compared or ordering property, the index's further properties, then _id. ordered=False
        leaves an aggregate's groups in any order."""
        q = parse(query, service)
        check_find(q)
        if not q.order_by and not q.aggregate:
            q.order_by = next((c.prop for c in q.where if not c.equal), None)
        df, index = self._narrowed(q, False)
        if q.aggregate:
            return self._aggregated(df, q, ordered)
        key = self._sort_key(df, q, index, False)
        if key is not None and not q.distinct:
            df = df.where(key.isNotNull())
        further = self._further(df, q, index, False)
        if q.page:
            df = df.where(self._after(q, [c for c in (key, *further) if c is not None]))
        return self._finished(df, q, key, further)

    def search(self, query: dict, service: bool = False) -> DataFrame:
        """Rows that full-text conditions and post-filters leave, sorted; rows that lack the ordering property come first."""
        q = parse(query, service)
        df, index = self._narrowed(q, True)
        if q.aggregate:
            return self._aggregated(df, q)
        key = self._sort_key(df, q, index, True)
        if q.page:
            at = df.where(F.col("_id") == _unpack(q.page)[-1])
            seek = at.select(*([key.alias("_k")] if key is not None else []), F.col("_id").alias("_i"))
            row = seek.first()
            if row is None:
                raise KindError("InvalidQueryPage", q.page)
            df = df.where(self._beyond(q, [] if key is None else [key], [*row], True))
        return self._finished(df, q, key)

    def count(self, query: dict, search: bool = False) -> int:
        """Rows that a query has from its page on, whatever its limit. Groups, for an aggregate in find."""
        query = {k: v for k, v in query.items() if k not in ("limit", "select")}
        return (self.search if search else self.find)(query).count()

    def get(self, name: str, ids: list) -> DataFrame:
        """Rows by id in the order asked for, tombstones too; unknown ids are left out."""
        rows = self.rows(name)
        place = F.array_position(F.array(*[F.lit(i) for i in ids]), F.col("_id"))
        return rows.where(F.col("_id").isin(list(ids))).orderBy(place) if ids else rows.limit(0)

    # --- paging

    def _after(self, q: QuerySpec, keys: list[Column]) -> Column:
        at = _unpack(q.page)
        # A token made by hand may name fewer keys than the index has properties.
        return self._beyond(q, keys[: len(at) - 1], at, False)

    def _beyond(self, q: QuerySpec, keys: list[Column], at: list, inclusive: bool) -> Column:
        """Rows after a place in the order: by the keys, and by _id among equal ones. Absent values come first."""
        ids, last = F.col("_id"), at[-1]
        out = (ids <= last if inclusive else ids < last) if q.desc else (ids >= last if inclusive else ids > last)
        for key, raw in reversed(list(zip(keys, at[:-1], strict=True))):
            if raw is None:
                out = out & key.isNull() if q.desc else key.isNotNull() | out
                continue
            if isinstance(raw, (list, tuple)) and len(raw) == 2:  # a text of identical strength
                v = collated(F.lit(raw[1]), collation("identical", self.locale))
            elif isinstance(raw, (list, tuple)):
                v = F.struct(*[F.lit(x).cast(t).alias(n) for x, (n, t) in zip(raw, values.KEY_FIELDS, strict=True)])
            else:
                v = F.lit(raw)
            out = (key < v if q.desc else key > v) | key.isNull() & F.lit(q.desc) | (key == v) & out
        return out

    def find_page(self, query: dict) -> tuple[list, str | None]:
        """A page's rows and the token of the next: there is one whenever the page is full. At most limit rows come here."""
        q = parse(query)
        if q.limit is None or q.aggregate or q.distinct:
            raise KindError("InvalidQueryPage", "a page needs a limit, and rows")
        q.order_by = q.order_by or next((c.prop for c in q.where if not c.equal), None)
        df, index = self.find({k: v for k, v in query.items() if k != "select"}), self._index(q, False)
        key = self._sort_key(df, q, index, False)
        keys = [c for c in (key, *self._further(df, q, index, False)) if c is not None]
        rows = df.select("*", F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], F.col("_id").alias("i")).alias("_at")).collect()
        token = _pack([*rows[-1]["_at"]]) if rows and len(rows) == q.limit else None
        keep = [c for c in (q.select or df.columns) if c in df.columns]
        return [tuple(r[c] for c in keep) for r in rows], token

    def shown(self, query: dict) -> Column | None:
        """For a limited find that is full, the condition of rows not after its last one: what a watch of it looks at."""
        q = parse(query)
        if q.limit is None or q.aggregate or q.distinct:
            return None
        _, token = self.find_page(query)
        if token is None:
            return None
        q.order_by = q.order_by or next((c.prop for c in q.where if not c.equal), None)
        df, index = self._narrowed(q, False)
        keys = [c for c in (self._sort_key(df, q, index, False), *self._further(df, q, index, False)) if c is not None]
        return ~F.coalesce(self._beyond(q, keys, _unpack(token), False), F.lit(False))

    # --- results kept

    def cached(self, query: dict, search: bool = True) -> DataFrame:
        """A query's persisted result, until one of its kinds is put again."""
        key = json.dumps([search, query], sort_keys=True, default=str)
        now = sum(self._version[k.name] for k in self.closure(query["from"]))
        hit = self._cache.get(key)
        if hit and hit[0] == now:
            return hit[1]
        if hit:
            hit[1].unpersist()
        df = (self.search if search else self.find)(query).persist()
        self._cache[key] = (now, df)
        return df


def _pack(at: list) -> str:
    return base64.urlsafe_b64encode(json.dumps(at, default=str).encode()).decode()


def _unpack(page: str) -> list:
    try:
        return json.loads(base64.urlsafe_b64decode(page.encode()))
    except ValueError:
        raise KindError("InvalidQueryPage", page) from None


def page_of(*at) -> str:
    """The token of the place (key, id) after which a page begins."""
    return _pack(list(at))


def redundant_indexes(indexes: list[Index]) -> list[Index]:
    """Indexes whose properties begin another's: these can go."""
    return [i for i in indexes if any(o is not i and o.props[: len(i.props)] == i.props and len(o.props) > len(i.props) for o in indexes)]

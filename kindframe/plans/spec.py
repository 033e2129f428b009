"""Queries as checked data: the closed set of keys, the operators, and which of them go together."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from kindframe.errors import KindError
from kindframe.functions.text import collation

#: Fixed names of the grammar.
KEYS = ("select", "from", "where", "filter", "aggregate", "orderBy", "distinct", "desc", "incDel", "limit", "immediateReturn", "page")
WHERE_OPS = ("<", "<=", "=", ">=", ">", "!=", "%", "?")
FILTER_OPS = ("<", "<=", "=", ">=", ">", "!=", "%%", "%")
AGGREGATES = ("cnt", "min", "max", "sum", "avg", "first", "last")
LOWER, UPPER = (">", ">="), ("<", "<=")


@dataclass(frozen=True)
class Bound:
    op: str
    val: Any


@dataclass
class Clause:
    """The conditions on one property: one operator, or a lower and an upper bound."""

    prop: str
    bounds: list[Bound]
    collate: str | None = None

    @property
    def equal(self) -> bool:
        return self.bounds[0].op == "="

    @property
    def listed(self) -> bool:
        return isinstance(self.bounds[0].val, (list, tuple))


@dataclass
class Aggregate:
    group_by: str | None
    props: dict[str, list[str]]  # function -> properties


@dataclass
class QuerySpec:
    kind: str
    select: list[str] | None = None
    where: list[Clause] = field(default_factory=list)
    filter: list[Clause] = field(default_factory=list)
    aggregate: Aggregate | None = None
    order_by: str | None = None
    distinct: str | None = None
    desc: bool = False
    inc_del: bool = False
    limit: int | None = None
    immediate: bool = False
    page: str | None = None


def _clauses(raw: Any, ops: tuple[str, ...], bad: str) -> list[Clause]:
    out: dict[str, Clause] = {}
    for x in raw:
        if not isinstance(x, dict) or not {"prop", "op", "val"} <= x.keys() or x.keys() - {"prop", "op", "val", "collate"}:
            raise KindError("InvalidQuery", "a clause has prop, op and val")
        prop, op, val, strength = x["prop"], x["op"], x["val"], x.get("collate")
        if op not in ops:
            raise KindError(bad, str(op))
        collation(strength)
        if isinstance(val, (list, tuple)) and op not in ("=", "%", "%%"):
            raise KindError("InvalidQuery", f"{op} takes no list")
        if prop not in out:
            out[prop] = Clause(prop, [Bound(op, val)], strength)
            continue
        c = out[prop]
        pair = {"l" if b in LOWER else "u" if b in UPPER else "?" for b in (op, *(b.op for b in c.bounds))}
        if len(c.bounds) != 1 or pair != {"l", "u"}:
            raise KindError("InvalidQueryOpCombo", prop)
        if c.collate != strength:
            raise KindError("InvalidQueryCollationMismatch", prop)
        c.bounds.append(Bound(op, val))
    return list(out.values())


def parse(raw: dict, service: bool = False) -> QuerySpec:
    """A checked query. service applies the limit of 500 rows that requests over the bus have."""
    if unknown := raw.keys() - set(KEYS):
        raise KindError("InvalidQuery", f"unknown keys {sorted(unknown)}")
    if not isinstance(raw.get("from"), str):
        raise KindError("KindNotSpecified")
    q = QuerySpec(raw["from"], order_by=raw.get("orderBy"), distinct=raw.get("distinct"), desc=bool(raw.get("desc", False)), inc_del=bool(raw.get("incDel", False)), page=raw.get("page"))
    if "select" in raw:
        if not raw["select"]:
            raise KindError("InvalidQuery", "empty select")
        q.select = list(raw["select"])
    q.where = _clauses(raw.get("where", ()), WHERE_OPS, "InvalidQueryOp")
    q.filter = _clauses(raw.get("filter", ()), FILTER_OPS, "InvalidFilterOp")
    if "limit" in raw:
        if not isinstance(raw["limit"], int) or raw["limit"] < 0:
            raise KindError("InvalidQuery", "limit")
        q.limit = raw["limit"]
    if service:
        q.limit = 500 if q.limit is None else q.limit
        if q.limit > 500:
            raise KindError("InvalidQuery", "limit is at most 500")
    if "aggregate" in raw:
        a = dict(raw["aggregate"])
        groups = a.pop("groupBy", [])
        if a.keys() - set(AGGREGATES):
            raise KindError("InvalidQuery", "unknown aggregate")
        q.aggregate = Aggregate(groups[0] if groups else None, {k: list(v) for k, v in a.items()})
        # An aggregate leaves nothing of these.
        q.select = q.distinct = q.order_by = None
    if q.distinct is not None:
        q.select, q.order_by = [q.distinct], q.distinct
    if "immediateReturn" in raw:
        if q.order_by or q.distinct or q.aggregate or q.limit is None:
            raise KindError("InvalidQuery", "immediateReturn needs a limit and no order")
        q.immediate = bool(raw["immediateReturn"])
    _check(q)
    return q


def _check(q: QuerySpec) -> None:
    plain = [c for c in q.where if c.prop != "_del"]
    if sum(not c.equal for c in plain) > 1:
        raise KindError("InvalidQuery", "one property at most may be compared by order")
    if sum(c.listed for c in plain) > 1:
        raise KindError("InvalidQuery", "one property at most may have a list")


def check_find(q: QuerySpec) -> None:
    """What find does not take but search does."""
    if q.filter:
        raise KindError("InvalidQuery", "find has no filter")
    for c in q.where:
        if c.bounds[0].op == "?":
            raise KindError("InvalidQuery", "find has no full-text match")
        if not c.equal and q.order_by and q.order_by != c.prop:
            raise KindError("InvalidQuery", "the order must be that of the compared property")

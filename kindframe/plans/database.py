"""A catalog that is written to: each call checks what it may do, and replaces a kind's snapshot.

A Database puts the parts together that stand alone elsewhere: writes (operators/mutate.py), schemas, revision sets,
permissions and quotas act on every call; a batch of calls takes effect as a whole or not at all and answers each; a find may
leave a watch behind. Snapshots are DataFrames; with a folder each new one is written there, so that lineage ends with a write.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindframe.errors import KindError
from kindframe.operators import admin, mutate, validate
from kindframe.plans.catalog import Catalog, Kind
from kindframe.plans.spec import parse
from kindframe.sources import jsonio
from kindframe.streaming import watch

#: Calls that a batch takes, by the names of the grammar.
BATCHED = ("put", "merge", "del", "find", "search", "get")


@dataclass
class Watch:
    """What a find with a watch leaves: the query, and the condition that narrows it to what was shown."""

    query: dict
    bound: Column | None

    def fired(self, changes: DataFrame, before: str | None = None) -> DataFrame:
        return watch.fired(changes, self.query, self.bound, before)

    def start(self, changes: DataFrame, on_fire: Callable[[DataFrame], None], checkpoint: str, before: str | None = None):
        return watch.watch(changes, self.query, on_fire, checkpoint, self.bound, before)


class Database:
    """caller is who calls; without one nothing is refused. Kinds are snapshots with _id, _rev and _del.

    With own_revisions, which needs a folder, the rows that one write changes have a revision each and not one together.
    """

    def __init__(self, catalog: Catalog, caller: str | None = None, admins: tuple[str, ...] = (), folder: str | None = None, own_revisions: bool = False):
        if own_revisions and not folder:
            raise KindError("InvalidOperation", "own_revisions needs a folder")
        self.catalog, self.caller, self.admins, self.folder, self.own_revisions = catalog, caller, admins, folder, own_revisions
        self.permissions: list[dict] = []
        self.quotas: dict[str, int] = {}
        self.purged_rev = 0
        self.profile: admin.Profile | None = None

    # --- who may do what

    def put_permissions(self, rules: Iterable[dict]) -> None:
        """Rules (object, caller, operations); one of the same object and caller takes the old one's place."""
        for r in rules:
            if bad := set(r["operations"]) - set(admin.OPERATIONS):
                raise KindError("InvalidOperation", ", ".join(sorted(bad)))
            self.permissions = [p for p in self.permissions if (p["object"], p["caller"]) != (r["object"], r["caller"])] + [r]

    def may(self, operation: str, kind: str) -> bool:
        k = self.catalog.kind(kind)
        return self.caller is None or admin.allowed(self.permissions, self.caller, operation, [kind, *k.extends], k.owner, self.admins)

    def _check(self, operation: str, *kinds: str) -> None:
        for k in kinds:
            if not self.may(operation, k):
                raise KindError("PermissionDenied", f"{self.caller} may not {operation} {k}")

    def put_quotas(self, quotas: dict[str, int]) -> None:
        if self.caller is not None and self.caller not in self.admins:
            raise KindError("AccessDenied", self.caller)
        self.quotas |= quotas

    def quota_stats(self) -> DataFrame:
        """(owner, size) of the kinds of each owner."""
        return admin.usage([(k.owner, k.df) for k in self.catalog.kinds.values()])

    def start_profile(self, on: bool = True) -> None:
        self.profile = admin.Profile() if on else None

    def _timed(self, name: str, call: Callable[[], Any]) -> Any:
        return self.profile.run(self.caller or "", name, call) if self.profile else call()

    def get_profile(self, query: dict) -> DataFrame:
        """A find over the calls so far, whatever the query's kind is named."""
        if not self.profile:
            raise KindError("InvalidOperation", "no profile")
        calls = self.profile.table(self.catalog.spark).withColumn("_id", F.monotonically_increasing_id())
        own = Catalog(self.catalog.spark)
        own.put_kind(query["from"], calls)
        return own.find(query)

    # --- kinds and writes

    def put_kind(self, name: str, df: DataFrame, **more) -> Kind:
        for p in more.get("extends", ()):
            if p != "Object:1":
                self._check("extend", p)
        if name in self.catalog.kinds and self.caller is not None and self.catalog.kind(name).owner != self.caller and self.caller not in self.admins:
            raise KindError("PermissionDenied", f"{self.caller} does not own {name}")
        return self.catalog.put_kind(name, df, **({"owner": self.caller or ""} | more))

    def _replace(self, kind: Kind, new: DataFrame, grew: bool = True) -> None:
        if self.own_revisions:
            new = self._written(new, kind.name)
            new = mutate.own_revisions(new, self._written(mutate.changed_ids(kind.df, new), "changed"))
        if kind.rev_sets:
            new = mutate.revision_sets(kind.df, new, kind.rev_sets)
        if kind.schema:
            # Only rows of this write are checked, as a schema may be younger than old rows.
            changed = new.join(kind.df.select("_id", F.col("_rev").alias("_was")), "_id", "left").where("NOT _del AND (_was IS NULL OR _was <> _rev)").drop("_was")
            row = validate.validate(changed, kind.schema).where(F.size("_failed") > 0).select("_id", "_failed").first()
            if row is not None:
                raise KindError("SchemaValidation", f"{row['_id']}: {', '.join(row['_failed'])}")
        if grew and kind.owner in self.quotas:
            own = [(k.owner, new if k is kind else k.df) for k in self.catalog.kinds.values() if k.owner == kind.owner]
            if admin.usage(own).first()["size"] > self.quotas[kind.owner]:
                raise KindError("QuotaExceeded", kind.owner)
        kind.df = self._written(new, kind.name) if self.folder else new
        self.catalog._version[kind.name] += 1

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name.replace(':', '-')}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.catalog.spark.read.schema(df.schema).parquet(path)

    def put(self, name: str, new: DataFrame, check: bool = True) -> None:
        self._check("create", name)
        kind = self.catalog.kind(name)
        self._timed("put", lambda: self._replace(kind, mutate.put(kind.df, new, check)))

    def merge(self, name: str, new: DataFrame, ignore_missing: bool = False) -> None:
        self._check("update", name)
        kind = self.catalog.kind(name)
        self._timed("merge", lambda: self._replace(kind, mutate.merge(kind.df, new, ignore_missing)))

    def merge_query(self, query: dict, props: dict[str, Column]) -> None:
        self._check("update", query["from"])
        kind = self.catalog.kind(query["from"])
        self._timed("merge", lambda: self._replace(kind, mutate.merge_where(kind.df, watch.touches(kind.df.schema, parse(query)), props)))

    def delete(self, name: str, ids: DataFrame, purge: bool = True) -> None:
        self._check("delete", name)
        kind = self.catalog.kind(name)
        self._timed("del", lambda: self._replace(kind, mutate.delete_ids(kind.df, ids, purge), grew=False))

    def delete_query(self, query: dict, purge: bool = True) -> None:
        self._check("delete", query["from"])
        kind = self.catalog.kind(query["from"])
        self._timed("del", lambda: self._replace(kind, mutate.delete(kind.df, watch.touches(kind.df.schema, parse(query)), purge), grew=False))

    # --- reads

    def find(self, query: dict) -> DataFrame:
        self._check("read", query["from"])
        return self._timed("find", lambda: self.catalog.find(query))

    def search(self, query: dict) -> DataFrame:
        self._check("read", query["from"])
        return self._timed("search", lambda: self.catalog.search(query))

    def get(self, name: str, ids: list) -> DataFrame:
        self._check("read", name)
        return self._timed("get", lambda: self.catalog.get(name, ids))

    def find_watched(self, query: dict) -> tuple[DataFrame, Watch]:
        """A find's rows, and a watch of them. Of a limited find that is full, changes after its last row do not fire it."""
        found = self.find(query)
        return found, Watch({k: v for k, v in query.items() if k in ("from", "where")}, self.catalog.shown(query))

    def batch(self, calls: list[dict]) -> list[Any]:
        """The answers of {"method", "params"} calls, one after another, each seeing the writes before it. An error in one
        leaves all kinds as they were. A write's answer is its number of calls' objects; a read's is its DataFrame."""
        before = {n: k.df for n, k in self.catalog.kinds.items()}
        out: list[Any] = []
        try:
            for c in calls:
                if c["method"] not in BATCHED:
                    raise KindError("InvalidOperation", c["method"])
                p = c["params"]
                if c["method"] in ("find", "search"):
                    out.append(getattr(self, c["method"])(p["query"]))
                elif c["method"] == "get":
                    out.append(self.get(p["kind"], p["ids"]))
                elif "query" in p:
                    self.merge_query(p["query"], p["props"]) if c["method"] == "merge" else self.delete_query(p["query"], p.get("purge", True))
                    out.append(True)
                elif c["method"] == "del":
                    self.delete(p["kind"], p["ids"], p.get("purge", True))
                    out.append(True)
                else:
                    getattr(self, c["method"])(p["kind"], p["objects"])
                    out.append(True)
        except Exception:
            for n, df in before.items():
                self.catalog.kinds[n].df = df
            raise
        return out

    # --- upkeep

    def purge(self, rev_times: DataFrame, before: Column) -> None:
        """Drop old tombstones of every kind; purge_status() then has the last revision that went."""
        upto = rev_times.where(F.col("ts") <= before).agg(F.max("rev")).first()[0]
        for kind in self.catalog.kinds.values():
            if "_del" in kind.df.columns:
                kind.df = mutate.purge(kind.df, rev_times, before)
        self.purged_rev = max(self.purged_rev, upto or 0)

    def purge_status(self) -> int:
        return self.purged_rev

    def compact(self, name: str, rows_a_file: int = 1_000_000) -> None:
        """Write a kind's snapshot anew in files of about so many rows, in order of _id, so that reads skip by it."""
        if not self.folder:
            raise KindError("InvalidOperation", "compact needs a folder")
        kind = self.catalog.kind(name)
        parts = max(1, -(-kind.df.count() // rows_a_file))
        self._replace(kind, kind.df.repartitionByRange(parts, "_id").sortWithinPartitions("_id"), grew=False)

    def remove_app_data(self, owner: str) -> list[str]:
        """Delete the kinds that an owner has, with those that extend them, and its permissions and quota."""
        gone = [k.name for k in self.catalog.kinds.values() if k.owner == owner]
        for name in gone:
            if name in self.catalog.kinds:
                self.catalog.del_kind(name, recursive=True)
        self.permissions = [p for p in self.permissions if p["object"] not in gone]
        self.quotas.pop(owner, None)
        return gone

    def load(self, path: str) -> dict[str, int]:
        """Load a dump of concatenated objects: kinds first, then permissions, then each known kind's objects, tombstones as
        deletions. Objects of unknown kinds are left out. How many rows of each kind came."""
        rows = concatenated(self.catalog.spark, path)
        field = lambda p, t="string": F.try_variant_get("_doc", f"$.{p}", t)
        for r in rows.where(F.col("_kind") == "Kind:1").select(field("id").alias("id"), field("owner").alias("owner"), field("extends", "array<string>").alias("extends")).collect():
            if r["id"] not in self.catalog.kinds:
                none = self.catalog.spark.createDataFrame([], "_id string, _doc variant, _rev long, _del boolean")
                self.catalog.put_kind(r["id"], none, owner=r["owner"] or "", extends=[e for e in r["extends"] or [] if e in self.catalog.kinds])
        rules = rows.where(F.col("_kind") == "Permission:1").select(field("object").alias("object"), field("caller").alias("caller"), field("operations", "map<string,string>").alias("operations")).collect()
        self.put_permissions({"object": r["object"], "caller": r["caller"], "operations": dict(r["operations"] or {})} for r in rules)
        counts = {r["_kind"]: r["count"] for r in rows.where(F.col("_kind").isin(list(self.catalog.kinds))).groupBy("_kind").count().collect()}
        for name in counts:
            kind = self.catalog.kind(name)
            mine = rows.where(F.col("_kind") == name)
            if "_doc" in kind.df.columns:
                new = mutate.put(kind.df, mine.where("NOT _del").select("_id", "_doc"), check=False)
            else:
                fields = [f for f in kind.df.schema if f.name not in ("_rev", "_del", "_id")]
                typed = mine.where("NOT _del").select(F.col("_id").cast(kind.df.schema["_id"].dataType).alias("_id"), *[F.try_variant_get("_doc", f"$['{f.name}']", f.dataType.simpleString()).alias(f.name) for f in fields])
                new = mutate.put(kind.df, typed, check=False)
            gone = mine.where("_del").select(F.col("_id").cast(kind.df.schema["_id"].dataType).alias("_id"))
            self._replace(kind, mutate.delete_ids(new, gone, purge=True))
        return counts

    def dump(self, path: str, deleted: bool = False) -> None:
        """Write kinds, permissions and all objects, one a line, in folders of their own below path; load() takes them back
        from path + "/*"."""
        spark = self.catalog.spark
        rules = [json.dumps(r | {"_kind": "Permission:1"}) for r in self.permissions]
        kinds = [json.dumps({"_kind": "Kind:1", "id": k.name, "owner": k.owner, "extends": k.extends}) for k in self.catalog.kinds.values()]
        spark.createDataFrame([(x,) for x in kinds + rules], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/kinds")
        for kind in self.catalog.kinds.values():
            folder = f"{path}/objects-{kind.name.replace(':', '-')}"
            jsonio.dump_documents(kind.df, folder, kind.name, deleted) if "_doc" in kind.df.columns else jsonio.dump(kind.df, folder, kind.name, deleted)

    def restore(self, paths: list[str]) -> dict[str, int]:
        """Load the files of a full backup and of the incremental ones after it, in their order."""
        total: dict[str, int] = {}
        for p in paths:
            for k, n in self.load(p).items():
                total[k] = total.get(k, 0) + n
        return total


def _objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of concatenated JSON values -> one row a value, as it is written. What is no JSON ends its text."""
    read = json.JSONDecoder().raw_decode
    for b in batches:
        for text in b.column(0):
            s, at, out = text.as_py() or "", 0, []
            while True:
                while at < len(s) and s[at] in " \t\r\n,":
                    at += 1
                if at >= len(s):
                    break
                try:
                    _, end = read(s, at)
                except ValueError:
                    break
                out.append(s[at:end])
                at = end
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.string())})
                    out = []
            yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.string())})


def concatenated(spark, path: str) -> DataFrame:
    """load_lines() of files whose objects follow each other with or without line ends between and inside them. A file is
    one task's; dumps of one object a line are better read by load_lines()."""
    return jsonio.objects(spark.read.text(path, wholetext=True).mapInArrow(_objects, "value string"))

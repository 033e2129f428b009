"""Calls on a Database: permissions, quotas, schemas and revision sets act; batches, watches, loads and upkeep."""

import pytest
from pyspark.sql import functions as F

from kindframe.errors import KindError
from kindframe.plans.catalog import Catalog, Index
from kindframe.plans.database import Database

SNAP = "_id long, a string, n long, _rev long, _del boolean"


@pytest.fixture
def base(spark):
    db = Database(Catalog(spark), admins=("root",))
    db.put_kind("K:1", spark.createDataFrame([(1, "a", 10, 1, False), (2, "b", 20, 2, False), (3, "c", 30, 3, True)], SNAP), owner="me", indexes=[Index(["n"])])
    return db


def rows(db, kind="K:1"):
    return {r._id: r for r in db.catalog.kind(kind).df.collect()}


def new(spark, *r):
    return spark.createDataFrame(r, "_id long, a string, n long, _rev long")


def test_permissions_act(spark, base):
    base.caller = "com.app"
    with pytest.raises(KindError, match="PermissionDenied"):
        base.find({"from": "K:1"})
    base.put_permissions([{"object": "K:1", "caller": "com.*", "operations": {"read": "allow", "create": "deny"}}])
    assert base.find({"from": "K:1"}).count() == 2
    with pytest.raises(KindError, match="PermissionDenied"):
        base.put("K:1", new(spark, (4, "d", 1, None)))
    with pytest.raises(KindError, match="AccessDenied"):
        base.put_quotas({"me": 1})
    base.caller = "me"
    base.put("K:1", new(spark, (4, "d", 1, None)))
    assert rows(base)[4]._rev == 4


def test_quota_schema_and_revision_sets_act(spark, base):
    kind = base.catalog.kind("K:1")
    kind.schema = {"properties": {"n": {"type": "integer", "maximum": 50}}}
    kind.rev_sets = {"a_rev": ["a"]}
    base.put("K:1", new(spark, (1, "a", 40, 1)))
    base.put("K:1", new(spark, (2, "x", 20, 2)))
    assert (rows(base)[1].a_rev, rows(base)[2].a_rev) == (None, 5)
    with pytest.raises(KindError, match="SchemaValidation: 9: n"):
        base.put("K:1", new(spark, (9, "z", 51, None)))
    size = base.quota_stats().first()["size"]
    base.put_quotas({"me": size + 10})
    with pytest.raises(KindError, match="QuotaExceeded"):
        base.put("K:1", new(spark, (9, "z" * 50, 5, None)))
    assert 9 not in rows(base)


def test_batches_are_whole(spark, base):
    ids = spark.createDataFrame([(1,)], "_id long")
    out = base.batch([{"method": "put", "params": {"kind": "K:1", "objects": new(spark, (7, "g", 70, None))}}, {"method": "del", "params": {"kind": "K:1", "ids": ids}}, {"method": "find", "params": {"query": {"from": "K:1"}}}, {"method": "merge", "params": {"query": {"from": "K:1", "where": [{"prop": "n", "op": ">", "val": 60}]}, "props": {"a": F.lit("m")}}}])
    assert out[:2] == [True, True] and sorted(r._id for r in out[2].collect()) == [2, 7] and rows(base)[7].a == "m"
    with pytest.raises(KindError, match="RevNotSpecified"):
        base.batch([{"method": "del", "params": {"kind": "K:1", "ids": spark.createDataFrame([(7,)], "_id long")}}, {"method": "put", "params": {"kind": "K:1", "objects": new(spark, (2, "q", 1, None))}}])
    assert 7 in rows(base)


def test_repeated_ids_of_a_write(spark, base):
    base.put("K:1", new(spark, (5, "x", 1, None), (5, "y", 2, None)).coalesce(1))
    assert (rows(base)[5].a, len(rows(base))) == ("y", 4)
    base.merge("K:1", spark.createDataFrame([(5, None, 3), (5, "z", None)], "_id long, a string, n long").coalesce(1))
    assert (rows(base)[5].a, rows(base)[5].n) == ("z", 3)


def test_watched_find_looks_at_what_was_shown(spark, base):
    found, watch = base.find_watched({"from": "K:1", "where": [{"prop": "n", "op": ">", "val": 5}], "limit": 1})
    assert [r._id for r in found.collect()] == [1]
    changes = spark.createDataFrame([(8, "h", 7, 9, False), (9, "i", 15, 9, False), (10, "j", 1, 9, False)], SNAP)
    assert [r._id for r in watch.fired(changes).collect()] == [8]
    _, open_ = base.find_watched({"from": "K:1", "where": [{"prop": "n", "op": ">", "val": 5}], "limit": 9})
    assert sorted(r._id for r in open_.fired(changes).collect()) == [8, 9]


def test_loads_kinds_permissions_and_objects(spark, tmp_path):
    one = '{"_kind":"Kind:1","id":"New:1","owner":"o"}{"_kind":"Permission:1","object":"New:1","caller":"*","operations":{"read":"allow"}}'
    (tmp_path / "a.json").write_text(one + '{"_kind":"New:1","_id":"x",\n"v":5.0}{"_kind":"New:1","_id":"y","t":"}{"} {"_kind":"None:1","_id":"z"}')
    (tmp_path / "b.json").write_text('{"_kind":"New:1","_id":"x","_del":true}\n{"_kind":"New:1","_id":"w","v":1} nonsense {"_kind":"New:1","_id":"u"}')
    db = Database(Catalog(spark), caller="anyone", folder=str(tmp_path / "snapshots"))
    assert db.restore([str(tmp_path / "a.json"), str(tmp_path / "b.json")]) == {"New:1": 4}
    assert sorted(r._id for r in db.find({"from": "New:1"}).collect()) == ["w", "y"]
    db.compact("New:1")
    assert sorted(r._id for r in db.catalog.kind("New:1").df.collect()) == ["w", "y"]
    assert db.remove_app_data("o") == ["New:1"] and not db.catalog.kinds


def test_purge_status_and_profile(spark, base):
    base.start_profile()
    base.find({"from": "K:1"})
    assert [r.operation for r in base.profile.table(spark).collect()] == ["find"]
    times = spark.createDataFrame([(1, 10), (3, 20), (9, 99)], "rev long, ts long")
    base.purge(times, F.lit(50))
    assert base.purge_status() == 3 and sorted(rows(base)) == [1, 2]


def test_dump_and_load_again(spark, base, tmp_path):
    doc = spark.createDataFrame([("p", '{"v":5.0,"_id":"old"}', 1, False), ("q", '{"t":"x"}', 2, True)], "_id string, j string, _rev long, _del boolean")
    base.put_kind("D:1", doc.select("_id", F.parse_json("j").alias("_doc"), "_rev", "_del"), owner="me")
    base.put_permissions([{"object": "D:1", "caller": "*", "operations": {"read": "allow"}}])
    base.dump(str(tmp_path / "d"), deleted=True)
    again = Database(Catalog(spark))
    assert again.load(f"{tmp_path}/d/*") == {"K:1": 3, "D:1": 2}
    assert again.permissions == base.permissions and set(again.catalog.kinds) == {"K:1", "D:1"}
    got = again.catalog.kind("D:1").df.select("_id", F.to_json("_doc").alias("j"), F.schema_of_variant("_doc").alias("s")).collect()
    assert [r._id for r in got] == ["p"] and '"_id":"p"' in got[0].j and "v: DECIMAL" in got[0].s
    assert sorted(r._id for r in again.catalog.kind("K:1").df.collect()) == ["1", "2"]


def test_locale_and_shards(spark, base):
    from kindframe.streaming import watch

    first = base.catalog.cached({"from": "K:1"})
    base.catalog.set_locale("de")
    assert base.catalog.cached({"from": "K:1"}) is not first
    one = spark.createDataFrame([(1,), (2,)], "_shard long")
    assert [r._shard for r in watch.activated(one.where("_shard = 1"), one).collect()] == [2]


def test_a_revision_for_each_row(spark, base, tmp_path):
    db = Database(base.catalog, folder=str(tmp_path / "s"), own_revisions=True)
    db.put("K:1", spark.createDataFrame([(i, "n", i, None) for i in range(40, 10, -1)], "_id long, a string, n long, _rev long").repartition(5))
    assert {i: r._rev for i, r in rows(db).items()} == {1: 1, 2: 2, 3: 3} | {i: i - 7 for i in range(11, 41)}
    db.merge("K:1", spark.createDataFrame([(2, "m"), (11, "n"), (40, "m")], "_id long, a string"))
    assert [rows(db)[i]._rev for i in (2, 11, 40)] == [34, 4, 35]
    with pytest.raises(KindError, match="InvalidOperation"):
        Database(base.catalog, own_revisions=True)

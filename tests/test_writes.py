"""Writes, validation, administration, dumps and watches."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindframe.errors import KindError
from kindframe.functions import values
from kindframe.operators import admin, mutate, validate
from kindframe.sources import jsonio
from kindframe.streaming import watch

SNAP = "_id long, a string, n struct<x: long, y: long>, _rev long, _del boolean"


@pytest.fixture
def snap(spark):
    return spark.createDataFrame([(1, "a", (1, 2), 1, False), (2, "b", None, 2, False), (3, "c", (5, 6), 3, True)], SNAP)


def by_id(df):
    return {r["_id"]: r for r in df.collect()}


def test_put_and_conflicts(spark, snap):
    new = spark.createDataFrame([(1, "z", (9, 9), 1), (4, "d", None, None)], "_id long, a string, n struct<x: long, y: long>, _rev long")
    out = by_id(mutate.put(snap, new))
    assert (out[1].a, out[1]._rev, out[4].a, out[2]._rev, len(out)) == ("z", 4, "d", 2, 4)
    with pytest.raises(KindError, match="RevNotSpecified"):
        mutate.put(snap, new.withColumn("_rev", F.lit(None).cast("long")))
    with pytest.raises(KindError, match="RevisionMismatch"):
        mutate.put(snap, new.withColumn("_rev", F.lit(7).cast("long")))
    same = by_id(mutate.put(snap, snap.where("_id = 1")))
    assert same[1]._rev == 1  # nothing changed, no revision


def test_merge_is_deep(spark, snap):
    new = spark.createDataFrame([(1, (7, None)), (2, (3, 3)), (9, (1, 1))], "_id long, n struct<x: long, y: long>")
    out = by_id(mutate.merge(snap, new))
    assert (tuple(out[1].n), out[1].a, tuple(out[2].n), 9 in out) == ((7, 2), "a", (3, 3), True)
    assert 9 not in by_id(mutate.merge(snap, new, ignore_missing=True))
    docs = spark.createDataFrame([('{"a":{"b":1,"c":[1]}}', '{"a":{"c":[2],"d":5.0}}'), (None, "{}"), ("{}", None)], "o string, n string")
    assert [r[0] and json.loads(r[0]) for r in docs.select(F.to_json(values.laid_over(F.try_parse_json("o"), F.try_parse_json("n")))).collect()] == [{"a": {"b": 1, "c": [2], "d": 5.0}}, {}, {}]


def test_delete_purge_batch(spark, snap):
    out = by_id(mutate.batch(snap, [lambda d: mutate.delete(d, F.col("a") == "a", purge=False), lambda d: mutate.delete(d, F.col("a") == "b")]))
    assert (out[1]._del, out[1]._rev, 2 in out, out[3]._rev) == (True, 4, False, 3)
    times = spark.createDataFrame([(2, 10), (3, 20)], "rev long, ts long")
    assert set(by_id(mutate.purge(snap, times, F.lit(20)))) == {1, 2}
    assert set(by_id(mutate.purge(snap, times, F.lit(15)))) == {1, 2, 3}


def test_revision_sets(snap):
    new = snap.withColumns({"a": F.when(F.col("_id") == 1, "new").otherwise(F.col("a")), "_rev": F.lit(50).cast("long")})
    out = by_id(mutate.revision_sets(snap, new, {"revA": ["a"], "revN": ["n"]}))
    assert (out[1].revA, out[1].revN, out[2].revA) == (50, None, None)


def test_sub_ids(spark):
    kind = T.ArrayType(T.StructType([T.StructField("b", T.LongType())]))
    row = spark.createDataFrame([([(1,), (1,)],)], T.StructType([T.StructField("arr", kind)])).select(mutate.with_sub_ids(F.col("arr"), kind).alias("x")).first()
    assert len({e["_id"] for e in row.x}) == 2


@pytest.mark.parametrize(
    ("rule", "good", "bad"),
    [
        ({"type": "integer"}, 5, None), ({"minimum": 5, "minimumCanEqual": False}, 6, 5), ({"maximum": 5}, 5, 6), ({"divisibleBy": 3}, 9, 10), ({"enum": [1, 2]}, 2, 3), ({"type": ["string", "integer"]}, 1, None), ({"disallow": "string"}, 1, None),
    ],
)
def test_schema_rules(spark, rule, good, bad):
    df = spark.createDataFrame([(1, good), (2, bad)] if bad is not None else [(1, good)], "_id long, v long")
    out = by_id(validate.validate(df, {"properties": {"v": rule}}))
    assert out[1]._failed == [] and (bad is None or out[2]._failed == ["v"])


def test_schema_structure(spark):
    df = spark.createDataFrame([(1, "ab", [1, 2], ("x",)), (2, "abcd", [1, 1, 1], (None,)), (3, None, None, None)], "_id long, s string, l array<long>, o struct<k: string>")
    schema = {"properties": {"s": {"type": "string", "maxLength": 3, "pattern": "^a"}, "l": {"type": "array", "uniqueItems": True, "maxItems": 2, "items": {"type": "integer", "minimum": 1}, "optional": True}, "o": {"type": "object", "properties": {"k": {"type": "string"}}, "optional": True, "requires": "s"}}, "additionalProperties": False}
    out = by_id(validate.validate(df, schema))
    assert (out[1]._failed, out[2]._failed, out[3]._failed) == ([], ["s", "l", "o"], ["s"])


def test_schema_of_parsed_variants(spark):
    rows = [(1, '{"t":"a","n":5,"o":{"k":12}}'), (2, '{"t":"c","n":5,"o":{"k":12}}'), (3, '{"t":"a","n":7,"o":{"k":12}}'), (4, '{"t":"a","n":5,"o":{"k":13}}'), (5, '{"t":"a","n":5,"o":{"k":12,"z":1}}'), (6, '{"t":"a","n":null,"o":{"k":12}}'), (7, '{"t":"a","n":5}'), (8, "[]"), (9, None)]
    docs = spark.createDataFrame(rows, "_id long, j string").select("_id", F.parse_json("j").alias("_doc"))
    schema = {"type": "object", "properties": {"t": {"type": "string", "enum": ["a", "b"]}, "n": {"type": "number", "maximum": 6}, "o": {"type": "object", "properties": {"k": {"minimum": 10, "divisibleBy": 2}}, "additionalProperties": False}}}
    bad = docs.where(~validate.valid(F.col("_doc"), T.VariantType(), schema)).select("_id")
    assert sorted(r._id for r in bad.collect()) == [2, 3, 4, 5, 6, 7, 8, 9]
    failed = validate.validate(docs, {"properties": {"_id": {}, "_doc": schema}}).where(F.size("_failed") > 0).select("_id")
    assert sorted(r._id for r in failed.collect()) == [2, 3, 4, 5, 6, 7, 8, 9]
    # The filters take the place before the parsing, and parse a text once, not once for each rule.
    assert [d._jdf.queryExecution().optimizedPlan().toString().count("parseJson") for d in (bad, failed)] == [1, 1]


def test_admin(spark, snap):
    s = admin.kind_stats(snap, "K:1", {"n": ["n"]}).first()
    assert (s["count"], s.del_count, s.index_n_count) == (2, 1, 1)
    used = admin.usage([("a", snap), ("a", snap), ("b", snap.limit(0))])
    assert {r.owner: r.size > 0 for r in used.collect()} == {"a": True, "b": False}
    with pytest.raises(KindError, match="QuotaExceeded"):
        admin.check_quota(used, spark.createDataFrame([("a", 5)], "owner string, quota long"))
    rules = [{"object": "K:1", "caller": "com.x.*", "operations": {"read": "allow", "delete": "deny"}}, {"object": "Super:1", "caller": "*", "operations": {"update": "allow"}}]
    can = lambda caller, op: admin.allowed(rules, caller, op, ["K:1", "Super:1"], owner="me", admins=("root",))
    assert [can("com.x.y", "read"), can("com.x.y", "delete"), can("other", "update"), can("other", "read"), can("me", "delete"), can("root", "delete")] == [True, False, True, False, True, True]
    ids = [r._id for r in admin.reserve_ids(spark, 50).collect()]
    assert len(set(ids)) == 50 and all(len(i) == 11 for i in ids)
    with pytest.raises(KindError):
        admin.reserve_ids(spark, 1001)
    p = admin.Profile()
    assert p.run("app", "find", lambda: 7) == 7 and p.table(spark).count() == 1


def test_dump_load_incremental(spark, snap, tmp_path):
    jsonio.dump(snap, str(tmp_path / "d"), "K:1", deleted=True)
    lines = jsonio.load_lines(spark, str(tmp_path / "d"))
    assert sorted((r._id, r._del) for r in lines.collect()) == [("1", False), ("2", False), ("3", True)]
    base = snap.where("_id <> 2").withColumn("_del", F.lit(False))
    assert sorted(by_id(jsonio.load(base, str(tmp_path / "d"), "K:1"))) == [1, 2]
    (tmp_path / "bad.json").write_text('{"_id":"x","_kind":"K:1","v":5.0}\nnot json\n[1]\n')
    assert [r._id for r in jsonio.load_lines(spark, str(tmp_path / "bad.json")).collect()] == ["x"]
    rows, last, more = jsonio.incremental(snap, 1)
    assert (rows.count(), last, more) == (2, 3, False)
    rows, last, more = jsonio.incremental(snap, 0, limit_bytes=1)
    assert (rows.count(), last, more) == (1, 1, True)


def test_values(spark):
    row = spark.range(1).select(values.decimal_text(F.lit("5.500000").cast("decimal(19,6)")).alias("a"), values.decimal_text(F.lit("5").cast("decimal(19,6)")).alias("b"), values.new_id(F.lit("x"), F.lit(5)).alias("c"), values.new_id(F.lit("x"), F.lit(6000)).alias("d")).first()
    assert (row.a, row.b) == ("5.5", "5.0") and row.c < row.d


def test_watch_fires_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "_id long, v long"
    spark.createDataFrame([(1, 1)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    changes, got = spark.readStream.schema(schema).parquet(str(tmp_path / "in")), []
    s = watch.watch(changes, {"from": "K:1", "where": [{"prop": "v", "op": ">", "val": 5}]}, lambda b: got.append(sorted(r._id for r in b.collect())), str(tmp_path / "cp"))
    s.processAllAvailable()
    assert got == []
    spark.createDataFrame([(2, 9), (3, 2)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    assert watch.run_until_fired(s, 60)
    assert got == [[2]] and not s.isActive


def test_watch_sees_images_before(snap):
    new = mutate.delete_ids(snap, snap.where("_id = 1").select("_id"), purge=True)
    feed = watch.changes_between(snap, new)
    assert [r._id for r in watch.fired(feed, {"from": "K:1", "where": [{"prop": "a", "op": "=", "val": "a"}]}, before="_before").collect()] == [1]
    assert by_id(watch.latest_state(snap.select("_id", "a", "_rev")))[2].a == "b"

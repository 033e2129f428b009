"""Finds, searches, filters and aggregates over small kinds with known results."""

import json
import random
import unicodedata
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from kindframe.errors import KindError
from kindframe.functions import text, values
from kindframe.plans.catalog import Catalog, Index, redundant_indexes
from kindframe.plans.spec import check_find, parse


def q(kind, *clauses, **more):
    return {"from": kind, "where": [dict(zip(("prop", "op", "val", "collate"), c, strict=False)) for c in clauses]} | more


COUNT = 700
#: (id, text, group) of a kind, and of one that extends it.
SHELF = [(1, "maple", 1), (2, "maple syrup", 1), (3, "", 1)]
DRAWER = [(4, "maple syrup, dark", 2), (5, "map", 2), (6, "oak", 3), (7, "oats", 3), (8, "rye", 4)]


@pytest.fixture(scope="module")
def numbers(spark):
    c = Catalog(spark)
    rows = spark.range(COUNT).select(F.col("id").alias("_id"), F.col("id").alias("n"), (F.col("id") - F.col("id") % 4).alias("quad"))
    c.put_kind("Number:1", rows, indexes=[Index(["n"]), Index(["quad", "n"])])
    c.put_kind("Shelf:1", spark.createDataFrame(SHELF, "_id long, label string, row long"))
    c.put_kind("Drawer:1", spark.createDataFrame(DRAWER, "_id long, label string, row long"), extends=["Shelf:1"])
    return c


TESTS = {"=": lambda a, b: a in b if isinstance(b, list) else a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "%": lambda a, b: a.startswith(tuple(b) if isinstance(b, list) else b)}


@pytest.mark.parametrize(
    "clauses",
    [
        [("n", "=", 17)], [("n", "=", -4)], [("n", ">", 17)], [("n", ">=", 17)], [("n", ">", 17), ("n", "<", 19)], [("n", ">=", 17), ("n", "<=", 21)], [("n", "=", [90, 91, 90])],
        [("n", "=", [])], [("quad", "=", 16), ("n", ">", 17)], [("n", "!=", 650)],
    ],
)
def test_whole_numbers(numbers, clauses):
    want = [i for i in range(COUNT) if all(TESTS[op]({"n": i, "quad": i - i % 4}[p], v) for p, op, v in clauses)]
    assert sorted(r._id for r in numbers.find(q("Number:1", *clauses)).collect()) == want


@pytest.mark.parametrize(("op", "val"), [("=", "maple"), ("%", "maple"), (">", "maple"), (">=", "maple"), ("<", "oak"), ("<=", "oak"), ("%", ["map", "oa"]), ("%", ["maple s", "oak", "map", "m"])])
def test_strings_and_sub_kinds(numbers, op, val):
    want = [i for i, label, _ in SHELF + DRAWER if TESTS[op](label, val)]
    assert sorted(r._id for r in numbers.find(q("Shelf:1", ("label", op, val))).collect()) == want


def test_inheritance(numbers):
    assert [numbers.find({"from": k}).count() for k in ("Shelf:1", "Drawer:1", "Object:1")] == [8, 5, COUNT + 8]
    with pytest.raises(KindError, match="KindHasSubKinds"):
        numbers.del_kind("Shelf:1")
    with pytest.raises(KindError, match="KindNotRegistered"):
        numbers.find({"from": "None:1"})


A, B = {"prop": "a", "op": "=", "val": 1}, {"prop": "b", "op": "<", "val": 3}


@pytest.mark.parametrize(
    ("where", "error"),
    [
        ([A, {"prop": "a", "op": "=", "val": 2}], "InvalidQueryOpCombo"), ([A, {"prop": "a", "op": "<", "val": 2}], "InvalidQueryOpCombo"), ([B, B], "InvalidQueryOpCombo"),
        ([B, {"prop": "b", "op": ">", "val": 2}, B], "InvalidQueryOpCombo"), ([B | {"collate": "primary"}, {"prop": "b", "op": ">", "val": 2}], "InvalidQueryCollationMismatch"),
        ([B | {"collate": "backwards"}], "InvalidCollation"), ([B | {"collate": "default"}], "InvalidCollation"), ([{"prop": "a", "op": "<", "val": 3}, {"prop": "b", "op": "!=", "val": 2}], "InvalidQuery"),
        ([{"prop": "a", "op": "=", "val": [3]}, {"prop": "b", "op": "%", "val": [5]}], "InvalidQuery"), ([{"prop": "a", "op": "<", "val": [3]}], "InvalidQuery"), ([{"prop": "a", "op": "~", "val": 3}], "InvalidQueryOp"),
    ],
)
def test_invalid_clauses(where, error):
    with pytest.raises(KindError) as e:
        parse({"from": "Foo:1", "where": where})
    assert e.value.name == error


@pytest.mark.parametrize("more", [{"limit": -1}, {"select": []}, {"join": 1}, {"immediateReturn": False}, {"immediateReturn": True, "limit": 1, "orderBy": "a"}, {"aggregate": {"median": ["a"]}}])
def test_invalid_queries(more):
    with pytest.raises(KindError):
        parse({"from": "Foo:1"} | more)


def test_find_takes_less_than_search():
    for more in ({"filter": [A]}, {"where": [{"prop": "a", "op": "?", "val": "x"}]}, {"where": [B], "orderBy": "a"}):
        with pytest.raises(KindError):
            check_find(parse({"from": "Foo:1"} | more))
    assert parse({"from": "Foo:1"}, service=True).limit == 500


@pytest.mark.parametrize(
    ("props", "clauses", "order", "can"),
    [
        (["foo"], [("foo", "<", 5)], None, True), (["foo"], [("bar", "<", 5)], None, False), (["foo"], [("foo", "=", 5), ("bar", "=", 5)], None, False),
        (["foo", "bar"], [("foo", "=", 5), ("bar", ">", 5)], None, True), (["foo", "bar"], [("foo", ">", 5), ("bar", "=", 5)], None, False), (["foo", "bar"], [("foo", "=", 5)], "bar", True),
        (["foo", "bar"], [], "foo", True), (["foo", "bar"], [], "bar", False), (["foo"], [], None, False), (["_id"], [], None, True),
    ],
)
def test_index_answers(props, clauses, order, can):
    assert Index(props).answers(parse(q("Foo:1", *clauses) | ({"orderBy": order} if order else {}))) is can


def test_strict_mode_needs_an_index(spark):
    c = Catalog(spark, strict=True)
    df = spark.createDataFrame([(1, 5, 1), (2, 5, None), (3, None, 7)], "_id long, foo long, bar long")
    c.put_kind("K:1", df, indexes=[Index(["foo", "bar"])])
    assert [r._id for r in c.find(q("K:1", ("foo", "=", 5))).collect()] == [1]
    with pytest.raises(KindError, match="NoIndexForQuery"):
        c.find(q("K:1", ("bar", "=", 1)))
    c.kinds["K:1"].indexes.append(Index(["bar"], default={"bar": 9}))
    assert [r._id for r in c.find(q("K:1", ("bar", "=", 9))).collect()] == [2]
    assert [i.props for i in redundant_indexes([Index(["a"]), Index(["a", "b"]), Index(["b"])])] == [["a"]]


def _plants():
    """Rows of plants: whole numbers, some of them absent, and heights of both number types."""
    r = random.Random(12)
    for i in range(14):
        yield {"plot": r.choice("xyz"), "weeks": 3 + i, "bed": r.randint(1, 4), "seeds": r.randint(10, 99), "lost": r.choice([None, 0, 5, 9]), "height": r.choice([r.randint(20, 90), r.randint(20, 90) + 0.25])}


PLANTS = list(_plants())
TAGS = [(31, "p", ["red"]), (7, "q", ["red", "blue"]), (4, "r", ["blue", "tall"]), (16, "s", ["tall"]), (2, "t", [])]


@pytest.fixture(scope="module")
def garden(spark):
    c = Catalog(spark)
    lines = [(i, json.dumps({k: v for k, v in p.items() if v is not None})) for i, p in enumerate(PLANTS)]
    doc = spark.createDataFrame(lines, "_id long, j string").select("_id", F.parse_json("j").alias("_doc"))
    typed = [F.try_variant_get("_doc", f"$.{n}", "long").alias(n) for n in ("weeks", "bed", "seeds", "lost")]
    c.put_kind("Plant:1", doc.select("_id", "_doc", F.try_variant_get("_doc", "$.plot", "string").alias("plot"), F.try_variant_get("_doc", "$.height", "variant").alias("height"), *typed))
    rows = [(n, name, (tags,)) for n, name, tags in TAGS]
    c.put_kind("Tag:1", spark.createDataFrame(rows, "n long, name string, marks struct<all: array<string>>"), "n")
    return c


def test_aggregates(garden):
    spec = {"cnt": ["weeks", "lost", "height"], "min": ["weeks", "height"], "max": ["weeks", "height"], "sum": ["seeds", "lost"], "avg": ["seeds", "height"]}
    r = garden.find({"from": "Plant:1", "aggregate": spec}).first()
    of = lambda n: [p[n] for p in PLANTS if p[n] is not None]
    assert (r.cnt_weeks, r.cnt_lost, r.cnt_height) == tuple(len(of(n)) for n in ("weeks", "lost", "height"))
    assert (r.min_weeks, r.max_weeks, r.sum_seeds, r.sum_lost) == (min(of("weeks")), max(of("weeks")), sum(of("seeds")), sum(of("lost")))
    # Whole numbers are above all decimals.
    whole, parts = [v for v in of("height") if isinstance(v, int)], [v for v in of("height") if isinstance(v, float)]
    assert whole and parts and (r.min_height, r.max_height) == (str(min(parts)), str(max(whole)))
    mean = lambda v: round(Decimal(str(sum(v))) / len(v), 6)
    assert (r.avg_seeds, r.avg_height) == (mean(of("seeds")), mean(of("height")))


def test_groups(garden):
    rows = garden.find({"from": "Plant:1", "aggregate": {"groupBy": ["bed"], "avg": ["seeds"], "cnt": ["lost"], "first": ["weeks"], "last": ["weeks"]}}).collect()
    beds = sorted({p["bed"] for p in PLANTS})
    assert [r.bed for r in rows] == beds
    for r in rows:
        own = [p for p in PLANTS if p["bed"] == r.bed]
        assert float(r.avg_seeds) == round(sum(p["seeds"] for p in own) / len(own), 6) and r.cnt_lost == sum(p["lost"] is not None for p in own)
        assert (r.first_weeks.weeks, r.last_weeks.weeks) == (min(p["weeks"] for p in own), max(p["weeks"] for p in own))
    assert [r.bed for r in garden.find({"from": "Plant:1", "aggregate": {"groupBy": ["bed"], "cnt": ["weeks"]}, "desc": True}).collect()] == beds[::-1]
    with pytest.raises(KindError, match="InvalidAggregateType"):
        garden.find({"from": "Plant:1", "aggregate": {"sum": ["plot"]}})


def test_array_groups(garden):
    agg = {"groupBy": ["marks.all"], "sum": ["n"]}

    def want(rows):
        names = sorted({t for *_, tags in rows for t in tags})
        return [(t, sum(n for n, _, tags in rows if t in tags)) for t in names]

    found = [tuple(r) for r in garden.find({"from": "Tag:1", "aggregate": agg}).collect()]
    assert [r for r in found if r[0] is not None] == want(TAGS)
    rows = garden.find(q("Tag:1", ("marks.all", "=", ["red"]), aggregate=agg)).collect()
    assert [tuple(r) for r in rows] == want([x for x in TAGS if "red" in x[2]])
    assert garden.find(q("Tag:1", ("n", "<", 0), aggregate={"cnt": ["n"]})).collect() == []


def test_last_of_string_ids_and_booleans(spark):
    c = Catalog(spark)
    rows = [("b", 5, "true"), ("a", 5, "false"), ("ab", 5, "true"), ("é", 1, "false")]
    c.put_kind("S:1", spark.createDataFrame(rows, "_id string, n long, j string").select("_id", "n", F.col("_id").alias("name"), F.parse_json("j").alias("flag")))
    r = c.find({"from": "S:1", "aggregate": {"last": ["n"], "first": ["n"], "min": ["flag"], "max": ["flag"]}}).first()
    assert (r.last_n.name, r.first_n.name, r.min_flag, r.max_flag) == ("a", "é", "false", "true")


def test_pages_over_variants_and_further_properties(spark):
    c = Catalog(spark)
    vals = ['"b"', "3", "2.5", "null", "true", '"a"', "3", "-1", '{"x":1}']
    df = spark.createDataFrame([(i, v, i % 3) for i, v in enumerate(vals)], "_id long, j string, k long").select("_id", F.parse_json("j").alias("v"), "k")
    c.put_kind("V:1", df, indexes=[Index(["v", "k"])])
    for desc in (False, True):
        query = {"from": "V:1", "orderBy": "v", "limit": 2, "desc": desc, "select": ["_id"]}
        seen, (rows, token) = [], c.find_page(query)
        while rows:
            seen += [r[0] for r in rows]
            rows, token = c.find_page(query | {"page": token}) if token else ([], None)
        assert seen == [r._id for r in c.find({k: v for k, v in query.items() if k != "limit"} | {"limit": 100}).collect()] and sorted(seen) == list(range(9))
    t = spark.createDataFrame([(1, 1, 9), (2, 1, 3), (3, 0, 5)], "_id long, a long, b long")
    c.put_kind("T:1", t, indexes=[Index(["a", "b"])])
    assert [r._id for r in c.find({"from": "T:1", "orderBy": "a", "limit": 9}).collect()] == [3, 2, 1]
    assert [r._id for r in c.find(q("T:1", ("a", "=", 1))).collect()] == [2, 1]
    assert [r._id for r in c.find(q("T:1", ("a", "=", 1), limit=1, page=c.find_page(q("T:1", ("a", "=", 1), limit=1))[1])).collect()] == [1]


def test_order_across_types(spark):
    docs = ["null", '{"b":1}', "[1]", '"a"', "false", "true", "5.5", "-3", "5"]
    c = Catalog(spark)
    c.put_kind("Mixed:1", spark.createDataFrame([(i, d) for i, d in enumerate(reversed(docs))], "_id long, j string").select("_id", F.parse_json("j").alias("v")))
    one = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i long, j string").select("i", F.parse_json("j").alias("v")).orderBy(values.order_key(F.col("v")))
    assert [r.i for r in one.select("i").collect()] == list(range(9))
    # An upper bound lets all lower types in; 5.5 and 5 are of two types.
    assert c.find(q("Mixed:1", ("v", "<", "b"))).count() == 4  # the array's element 1 is above strings
    assert [r._id for r in c.find(q("Mixed:1", ("v", "=", 5))).collect()] == [0]
    assert c.find(q("Mixed:1", ("v", "=", 5.5))).count() == 1


SENTENCES = ["small rivers run to large seas", "large boats need seas and rivers", "no river is small", "sm", "resume", "Resume", "résumé", "résume", "resumé", "q", None, "c", "b", None, None]


@pytest.fixture(scope="module")
def words(spark):
    c = Catalog(spark)
    rows = [(i + 1, t, i % 3) for i, t in enumerate(SENTENCES)]
    c.put_kind("Sentence:1", spark.createDataFrame(rows, "_id long, line string, bar long"), indexes=[Index(["line"], collate={"line": "primary"})])
    return c


@pytest.mark.parametrize("query", ["s", "river", "small rivers", "small ships", "seas large", "rivers ri r riv", "RESUME"])
def test_full_text(words, query):
    plain = lambda t: unicodedata.normalize("NFD", t).encode("ascii", "ignore").decode().lower()
    want = [i + 1 for i, t in enumerate(SENTENCES) if t and all(any(plain(w).startswith(plain(part)) for w in t.split()) for part in query.split())]
    assert sorted(r._id for r in words.search(q("Sentence:1", ("line", "?", query, "primary"))).collect()) == want


def test_search_order_keeps_rows_that_lack_the_property(words):
    absent = [i + 1 for i, t in enumerate(SENTENCES) if t is None]
    assert [r._id for r in words.search({"from": "Sentence:1", "orderBy": "line", "limit": 4}).collect()] == [*absent, SENTENCES.index("b") + 1]
    assert text.query_tokens("rivers ri r riv") == ["rivers"]


@pytest.mark.parametrize(("value", "part"), [("north-east_12.ogg", "h-ea"), ("Good Evening, all!", "NING, A"), ("", ""), ("x y z", ""), ("", "NING")])
def test_substring_filter(spark, value, part):
    c = Catalog(spark)
    c.put_kind("F:1", spark.createDataFrame([(1, value)], "_id long, s string"))
    hit = value == "" if part == "" else part.lower() in value.lower()
    assert c.search({"from": "F:1", "filter": [{"prop": "s", "op": "%%", "val": part}]}).count() == hit


def test_filters_fan_out(spark):
    c = Catalog(spark)
    c.put_kind("F:1", spark.createDataFrame([(1, ("a", [(1,), (9,)])), (2, ("b", [(5,)])), (3, None)], "_id long, file struct<name: string, ext: array<struct<n: long>>>"))
    flt = [{"prop": "file.ext.n", "op": ">", "val": 3}, {"prop": "file.ext.n", "op": "<", "val": 7}]
    assert [r._id for r in c.search({"from": "F:1", "filter": flt}).collect()] == [2]
    out = c.find({"from": "F:1", "select": ["file.ext.n", "_id"]})
    assert out.schema.simpleString() == "struct<_id:bigint,file:struct<ext:array<struct<n:bigint>>>>"


def test_distinct_pages_count_cache(numbers):
    assert [r.row for r in numbers.find({"from": "Shelf:1", "distinct": "row"}).collect()] == sorted({g for *_, g in SHELF + DRAWER})
    seen, query = [], {"from": "Number:1", "orderBy": "quad", "limit": 300, "desc": True, "select": ["_id"]}
    rows, token = numbers.find_page(query)
    while rows:
        seen += [r[0] for r in rows]
        rows, token = numbers.find_page(query | {"page": token}) if token else ([], None)
    assert seen == list(range(COUNT))[::-1]
    assert numbers.count(q("Number:1", ("n", ">", 17), limit=3)) == COUNT - 18
    first = numbers.cached({"from": "Number:1", "limit": 3})
    assert first is numbers.cached({"from": "Number:1", "limit": 3})
    with pytest.raises(KindError, match="InvalidQueryPage"):
        numbers.find({"from": "Number:1", "page": "!"})


def test_filter_reaches_the_scan(spark):
    c = Catalog(spark)
    c.put_kind("orders:1", spark.read.parquet("/root/testdata/sf0.001/orders.parquet"), "o_orderkey")
    found = c.find(q("orders:1", ("o_orderstatus", "=", "O"), ("o_totalprice", ">", 1000.0), select=["o_orderkey"]))
    plan = found._sc._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    pushed = next(x for x in plan.splitlines() if x.startswith("PushedFilters"))
    assert "EqualTo(o_orderstatus,O)" in pushed and "GreaterThan(o_totalprice,1000.0)" in pushed
    assert "o_custkey" not in next(x for x in plan.splitlines() if x.startswith("ReadSchema"))

"""The registered queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindframe.functions import text, values
from kindframe.operators import admin, mutate, validate
from kindframe.plans.catalog import Catalog, Index, page_of
from kindframe.plans.database import Database
from kindframe.streaming import watch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
IDS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": "l_orderkey", "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id"}


def catalog(spark: SparkSession, sf_dir: str, *tables: str, **kw) -> Catalog:
    """The tables as kinds <table>:1."""
    c = Catalog(spark, **kw)
    for t in tables:
        df = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        if t == "lineitem":
            df = df.withColumn("_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
        c.put_kind(f"{t}:1", df, "_id" if t == "lineitem" else IDS[t])
    return c


def add(name: str, sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def simple(name: str, table: str, query: dict, sql: str, search: bool = False) -> None:
    """A query of one kind; its select decides the columns."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = catalog(spark, sf_dir, table)
        return (c.search if search else c.find)({"from": f"{table}:1"} | query)

    add(name, sql)(run)


def where(*clauses: tuple) -> list[dict]:
    return [{"prop": p, "op": o, "val": v} for p, o, v in clauses]


CUST, LINE, PART, ORD = ["c_custkey", "c_mktsegment"], ["_id", "l_quantity"], ["p_partkey", "p_name"], ["o_orderkey", "o_totalprice"]
LINE_SQL = "SELECT l_orderkey * 10 + l_linenumber AS _id, l_quantity FROM lineitem WHERE "

simple("find_eq", "customer", {"select": CUST, "where": where(("c_mktsegment", "=", "BUILDING"))}, "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'")
simple("find_in", "customer", {"select": CUST, "where": where(("c_mktsegment", "=", ["BUILDING", "MACHINERY", "BUILDING"]))}, "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
simple("find_in_empty", "customer", {"select": CUST, "where": where(("c_mktsegment", "=", []))}, "SELECT c_custkey, c_mktsegment FROM customer WHERE false")
simple("find_neq", "customer", {"select": CUST, "where": where(("c_mktsegment", "!=", "BUILDING"))}, "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING'")
simple("find_lt", "lineitem", {"select": LINE, "where": where(("l_quantity", "<", 5.0))}, LINE_SQL + "l_quantity < 5")
simple("find_lte", "lineitem", {"select": LINE, "where": where(("l_quantity", "<=", 5.0))}, LINE_SQL + "l_quantity <= 5")
simple("find_gt", "lineitem", {"select": LINE, "where": where(("l_quantity", ">", 45.0))}, LINE_SQL + "l_quantity > 45")
simple("find_gte", "lineitem", {"select": LINE, "where": where(("l_quantity", ">=", 45.0))}, LINE_SQL + "l_quantity >= 45")
simple("find_range", "lineitem", {"select": LINE, "where": where(("l_quantity", ">", 10.0), ("l_quantity", "<=", 12.0))}, LINE_SQL + "l_quantity > 10 AND l_quantity <= 12")
simple("find_prefix", "part", {"select": PART, "where": where(("p_name", "%", "bl"))}, "SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'bl')")
simple("find_prefix_list", "part", {"select": PART, "where": where(("p_name", "%", ["b", "bl", "c"]))}, "SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'b') OR starts_with(p_name, 'c')")
simple(
    "find_compound_eq_range", "lineitem", {"select": [*LINE, "l_returnflag"], "where": where(("l_returnflag", "=", "R"), ("l_quantity", ">=", 30.0), ("l_quantity", "<", 32.0))},
    "SELECT l_orderkey * 10 + l_linenumber AS _id, l_quantity, l_returnflag FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 30 AND l_quantity < 32",
)
simple(
    "find_order_limit_desc", "orders", {"select": ORD, "where": where(("o_orderstatus", "=", "O")), "orderBy": "o_totalprice", "desc": True, "limit": 100},
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 100",
)
simple("find_order_limit_asc", "part", {"select": ["p_partkey", "p_size"], "orderBy": "p_size", "limit": 50}, "SELECT p_partkey, p_size FROM part ORDER BY p_size, p_partkey LIMIT 50")
simple("find_select_projection", "supplier", {"select": ["s_name", "s_acctbal"]}, "SELECT s_name, s_acctbal FROM supplier")
simple("find_distinct", "events", {"distinct": "event_type"}, "SELECT DISTINCT event_type FROM events")
simple("find_distinct_limit_desc", "part", {"distinct": "p_brand", "desc": True, "limit": 5}, "SELECT DISTINCT p_brand FROM part ORDER BY p_brand DESC LIMIT 5")


@add("search_immediate_return", "SELECT CAST(least(count(*), 20) AS BIGINT) AS n, CAST(least(count(*), 20) AS BIGINT) AS matching FROM part WHERE starts_with(p_name, 'b')")
def search_immediate_return(spark, sf_dir):
    """The first 20 matches that come, whichever they are: how many there are, and how many of them match."""
    found = catalog(spark, sf_dir, "part").search({"from": "part:1", "select": PART, "where": where(("p_name", "%", "b")), "limit": 20, "immediateReturn": True})
    return found.agg(F.count("*").alias("n"), F.count(F.when(F.col("p_name").startswith("b"), 1)).alias("matching"))



@add("find_page_next", "SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey DESC) AS n FROM orders) WHERE n BETWEEN 11 AND 20")
def find_page_next(spark, sf_dir):
    c = catalog(spark, sf_dir, "orders")
    q = {"from": "orders:1", "orderBy": "o_totalprice", "desc": True, "limit": 10, "select": ORD}
    _, token = c.find_page(q)
    return c.find(q | {"page": token})


@add("search_page_by_id", "SELECT p_partkey, p_size FROM part WHERE (p_size, p_partkey) >= (SELECT (p_size, p_partkey) FROM part WHERE p_partkey = 77) ORDER BY p_size, p_partkey LIMIT 25")
def search_page_by_id(spark, sf_dir):
    return catalog(spark, sf_dir, "part").search({"from": "part:1", "orderBy": "p_size", "limit": 25, "page": page_of(77), "select": ["p_partkey", "p_size"]})


@add("find_count", "SELECT count(*) AS n FROM lineitem WHERE l_quantity > 45")
def find_count(spark, sf_dir):
    n = catalog(spark, sf_dir, "lineitem").count({"from": "lineitem:1", "where": where(("l_quantity", ">", 45.0)), "limit": 10})
    return spark.createDataFrame([(n,)], "n long")


@add("get_ids", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (7, 1, 32, 4)")
def get_ids(spark, sf_dir):
    return catalog(spark, sf_dir, "orders").get("orders:1", [7, 1, 32, 4, -5]).select(*ORD)


# --- aggregates


def aggregated(name: str, table: str, spec: dict, sql: str, **query) -> None:
    simple(name, table, {"aggregate": spec} | query, sql)


aggregated("agg_cnt_global", "events", {"cnt": ["user_id", "value"]}, "SELECT count(user_id) AS cnt_user_id, count(value) AS cnt_value FROM events")
aggregated("agg_min_max_grouped", "orders", {"groupBy": ["o_orderpriority"], "min": ["o_totalprice"], "max": ["o_totalprice", "o_custkey"]}, "SELECT o_orderpriority, min(o_totalprice) AS min_o_totalprice, max(o_totalprice) AS max_o_totalprice, max(o_custkey) AS max_o_custkey FROM orders GROUP BY 1")
aggregated("agg_sum_whole", "part", {"groupBy": ["p_brand"], "sum": ["p_size"], "cnt": ["p_size"]}, "SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS sum_p_size, count(p_size) AS cnt_p_size FROM part GROUP BY 1")
aggregated("agg_sum_decimal", "lineitem", {"groupBy": ["l_returnflag"], "sum": ["l_extendedprice"]}, "SELECT l_returnflag, sum(CAST(l_extendedprice AS DECIMAL(25, 6))) AS sum_l_extendedprice FROM lineitem GROUP BY 1")
aggregated("agg_avg", "part", {"groupBy": ["p_brand"], "avg": ["p_size"]}, "SELECT p_brand, CAST(round(CAST(sum(p_size) AS DECIMAL(30, 10)) / count(p_size), 6) AS DECIMAL(25, 6)) AS avg_p_size FROM part GROUP BY 1")
aggregated("agg_where", "orders", {"groupBy": ["o_orderstatus"], "cnt": ["o_custkey"]}, "SELECT o_orderstatus, count(o_custkey) AS cnt_o_custkey FROM orders WHERE o_totalprice > 100000 GROUP BY 1", where=where(("o_totalprice", ">", 100000.0)))
aggregated("agg_empty", "orders", {"cnt": ["o_custkey"]}, "SELECT count(o_custkey) AS cnt_o_custkey FROM orders WHERE o_orderstatus = 'none' GROUP BY o_orderstatus", where=where(("o_orderstatus", "=", "none")))
aggregated("agg_limit_counts_input", "orders", {"cnt": ["o_custkey"], "max": ["o_orderkey"]}, "SELECT count(o_custkey) AS cnt_o_custkey, max(o_orderkey) AS max_o_orderkey FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 100)", limit=100)


def _ends(name: str, function: str, by: str) -> None:
    @add(name, f"SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice {by}, o_orderkey) AS n FROM orders) WHERE n = 1")
    def run(spark, sf_dir):
        out = catalog(spark, sf_dir, "orders").find({"from": "orders:1", "aggregate": {"groupBy": ["o_orderpriority"], function: ["o_totalprice"]}})
        return out.select("o_orderpriority", F.col(f"{function}_o_totalprice.o_orderkey").alias("o_orderkey"))


_ends("agg_first", "first", "ASC")
_ends("agg_last", "last", "DESC")


@add("agg_explode_group", "SELECT token AS tokens, count(doc_id) AS cnt_doc_id, max(doc_id) AS max_doc_id FROM (SELECT doc_id, unnest(list_distinct(string_split(lower(text), ' '))) AS token FROM documents) GROUP BY 1")
def agg_explode_group(spark, sf_dir):
    c = Catalog(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.array_distinct(F.split(F.lower("text"), " ")).alias("tokens"))
    c.put_kind("tokens:1", docs, "doc_id")
    return c.find({"from": "tokens:1", "aggregate": {"groupBy": ["tokens"], "cnt": ["doc_id"], "max": ["doc_id"]}}, ordered=False)


@add("search_filter_aggregate", "SELECT p_brand, count(p_size) AS cnt_p_size FROM part WHERE p_size > 10 AND contains(upper(p_type), 'ECON') GROUP BY 1")
def search_filter_aggregate(spark, sf_dir):
    q = {"from": "part:1", "where": where(("p_size", ">", 10)), "filter": where(("p_type", "%%", "econ")), "aggregate": {"groupBy": ["p_brand"], "cnt": ["p_size"]}}
    return catalog(spark, sf_dir, "part").search(q)


# --- search

TOKENS = "regexp_extract_all({}, '[\\p{{L}}\\p{{N}}]+')"
simple("search_tokens_and", "documents", {"select": ["doc_id"], "where": where(("text", "?", "The and"))}, f"SELECT doc_id FROM documents WHERE len(list_filter({TOKENS.format('text')}, lambda t: starts_with(t, 'The'))) > 0 AND len(list_filter({TOKENS.format('text')}, lambda t: starts_with(t, 'and'))) > 0", search=True)
simple("search_token_prefix", "part", {"select": PART, "where": where(("p_name", "?", "b bl"))}, f"SELECT p_partkey, p_name FROM part WHERE len(list_filter({TOKENS.format('p_name')}, lambda t: starts_with(t, 'bl'))) > 0", search=True)
simple("search_filter_substring", "part", {"select": PART, "filter": where(("p_name", "%%", ["RE", "lu"]))}, "SELECT p_partkey, p_name FROM part WHERE contains(upper(p_name), 'RE') OR contains(upper(p_name), 'LU')", search=True)
simple("search_filter_prefix_ci", "pages", {"select": ["page_id", "url"], "filter": where(("url", "%", "HTTPS://"))}, "SELECT page_id, url FROM pages WHERE starts_with(upper(url), 'HTTPS://')", search=True)
simple("search_filter_range", "part", {"select": ["p_partkey"], "where": where(("p_brand", "!=", "Brand#2")), "filter": where(("p_size", ">=", 10), ("p_size", "<", 20))}, "SELECT p_partkey FROM part WHERE p_brand <> 'Brand#2' AND p_size >= 10 AND p_size < 20", search=True)
simple("search_sorted", "part", {"select": ["p_partkey", "p_retailprice"], "filter": where(("p_type", "%%", "small")), "orderBy": "p_retailprice", "desc": True, "limit": 40}, "SELECT p_partkey, p_retailprice FROM part WHERE contains(upper(p_type), 'SMALL') ORDER BY p_retailprice DESC, p_partkey DESC LIMIT 40", search=True)


@add("search_multi_prop", f"SELECT p_partkey FROM part WHERE len(list_filter(list_concat({TOKENS.format('p_name')}, {TOKENS.format('p_type')}), lambda t: starts_with(t, 'S'))) > 0 AND len(list_filter(list_concat({TOKENS.format('p_name')}, {TOKENS.format('p_type')}), lambda t: starts_with(t, 'b'))) > 0")
def search_multi_prop(spark, sf_dir):
    """Words of one query in either of two properties, through an index that includes both."""
    c = catalog(spark, sf_dir, "part")
    c.kinds["part:1"].indexes.append(Index(["words"], include={"words": ["p_name", "p_type"]}))
    return c.search({"from": "part:1", "where": where(("words", "?", "S b")), "select": ["p_partkey"]})


@add("search_nested_json", "SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50")
def search_nested_json(spark, sf_dir):
    """Conditions on a schemaless property: events' props, parsed to variants."""
    c = Catalog(spark)
    c.put_kind("events:1", spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("props", F.try_parse_json("props")), "event_id")
    return c.search({"from": "events:1", "filter": where(("props.k", ">=", 50)), "select": ["event_id"]})


@add("search_collated", "SELECT c_custkey, c_name FROM customer WHERE starts_with(upper(c_name), 'CUSTOMER')")
def search_collated(spark, sf_dir):
    """Accents and case do not count in the order or in the prefix."""
    c = catalog(spark, sf_dir, "customer")
    c.kinds["customer:1"].indexes.append(Index(["c_name"], collate={"c_name": "primary"}))
    return c.search({"from": "customer:1", "where": [{"prop": "c_name", "op": "%", "val": "CUSTOMER", "collate": "primary"}], "orderBy": "c_name", "select": ["c_custkey", "c_name"]})


# --- kinds


@add("super_kind_union", "SELECT c_custkey AS _id, c_acctbal AS bal, 'customer:1' AS _kind FROM customer WHERE c_acctbal < 0 UNION ALL SELECT s_suppkey, s_acctbal, 'supplier:1' FROM supplier WHERE s_acctbal < 0")
def super_kind_union(spark, sf_dir):
    c = Catalog(spark)
    c.put_kind("party:1", spark.createDataFrame([], "_id long, bal double"))
    for t, k, b in (("customer", "c_custkey", "c_acctbal"), ("supplier", "s_suppkey", "s_acctbal")):
        c.put_kind(f"{t}:1", spark.read.parquet(f"{sf_dir}/{t}.parquet").select(F.col(k).alias("_id"), F.col(b).alias("bal")), extends=["party:1"])
    return c.find({"from": "party:1", "where": where(("bal", "<", 0.0)), "select": ["_id", "bal", "_kind"]})


@add("find_exclude_kinds", "SELECT s_suppkey AS _id FROM supplier")
def find_exclude_kinds(spark, sf_dir):
    c = catalog(spark, sf_dir, "customer", "supplier")
    return c.rows("Object:1", exclude=("customer:1",)).select("_id")


@add("find_active_shards", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def find_active_shards(spark, sf_dir):
    c = Catalog(spark)
    c.put_kind("customer:1", spark.read.parquet(f"{sf_dir}/customer.parquet").withColumn("_shard", F.col("c_nationkey")), "c_custkey")
    active = spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_regionkey = 1").select(F.col("n_nationkey").alias("_shard"))
    return c.rows("customer:1", active_shards=active).select("c_custkey")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as a snapshot: revision by key, every seventh a tombstone."""
    df = mutate.with_system(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_orderkey")
    return df.withColumn("_rev", F.col("o_orderkey") % 100).withColumn("_del", F.col("o_orderkey") % 7 == 0)


SNAP = "(SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderkey AS _id, o_orderkey % 100 AS _rev, o_orderkey % 7 = 0 AS _del FROM orders)"


@add("find_live_only", f"SELECT _id FROM {SNAP} WHERE NOT _del AND o_orderstatus = 'F'")
def find_live_only(spark, sf_dir):
    c = Catalog(spark)
    c.put_kind("orders:1", orders(spark, sf_dir))
    return c.find({"from": "orders:1", "where": where(("o_orderstatus", "=", "F")), "select": ["_id"]})


@add("find_inc_del", f"SELECT _id, _del FROM {SNAP} WHERE o_orderstatus = 'F'")
def find_inc_del(spark, sf_dir):
    c = Catalog(spark)
    c.put_kind("orders:1", orders(spark, sf_dir))
    return c.find({"from": "orders:1", "where": where(("o_orderstatus", "=", "F")), "incDel": True, "select": ["_id", "_del"]})


# --- writes


@add("put_upsert", f"WITH n AS (SELECT o_orderkey + 500 AS _id, o_totalprice * 2 AS t FROM orders WHERE o_orderkey % 2 = 0) SELECT coalesce(s._id, n._id) AS _id, CASE WHEN n._id IS NULL THEN s.o_totalprice ELSE n.t END AS o_totalprice, CASE WHEN n._id IS NULL OR (NOT s._del AND s.o_totalprice IS NOT DISTINCT FROM n.t AND s.o_orderstatus = 'N' AND s.o_orderkey = n._id) THEN s._rev ELSE 100 END AS _rev FROM {SNAP} s FULL JOIN n ON s._id = n._id")
def put_upsert(spark, sf_dir):
    new = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey % 2 = 0").select((F.col("o_orderkey") + 500).alias("_id"), (F.col("o_orderkey") + 500).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), (F.col("o_totalprice") * 2).alias("o_totalprice"))
    return mutate.put(orders(spark, sf_dir), new, check=False).select("_id", "o_totalprice", "_rev")


@add("put_conflicts", f"SELECT _id, CASE WHEN _id % 3 = 0 THEN 'RevNotSpecified' ELSE 'RevisionMismatch' END AS error FROM {SNAP} WHERE NOT _del AND (_id % 3 = 0 OR _id % 3 = 1)")
def put_conflicts(spark, sf_dir):
    old = orders(spark, sf_dir)
    new = old.select("_id", F.when(F.col("_id") % 3 == 0, None).when(F.col("_id") % 3 == 1, F.col("_rev") + 1).otherwise(F.col("_rev")).alias("_rev"))
    return mutate.conflicts(old, new)


@add("merge_objects", f"SELECT _id, o_totalprice, CASE WHEN _id % 5 = 0 AND NOT _del THEN 'M' ELSE o_orderstatus END AS o_orderstatus FROM {SNAP} WHERE NOT _del")
def merge_objects(spark, sf_dir):
    old = orders(spark, sf_dir)
    new = old.where("_id % 5 = 0 AND NOT _del").select("_id", F.lit("M").alias("o_orderstatus"))
    return mutate.merge(old, new, ignore_missing=True).where("NOT _del").select("_id", "o_totalprice", "o_orderstatus")


@add("merge_query", f"SELECT _id, CASE WHEN o_totalprice > 100000 AND NOT _del THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_totalprice > 100000 AND NOT _del THEN 100 ELSE _rev END AS _rev FROM {SNAP}")
def merge_query(spark, sf_dir):
    old = orders(spark, sf_dir)
    return mutate.merge_where(old, F.col("o_totalprice") > 100000, {"o_orderstatus": F.lit("X")}).select("_id", "o_orderstatus", "_rev")


@add("merge_put", f"SELECT _id, o_orderstatus FROM {SNAP} UNION ALL SELECT -1, 'new'")
def merge_put(spark, sf_dir):
    new = spark.createDataFrame([(-1, -1, "new", 0.0)], "_id long, o_orderkey long, o_orderstatus string, o_totalprice double")
    return mutate.merge_put(orders(spark, sf_dir), F.col("o_orderstatus") == "none", {"o_orderstatus": F.lit("new")}, new).select("_id", "o_orderstatus")


@add("del_query", f"SELECT _id FROM {SNAP} WHERE NOT (o_orderstatus = 'F')")
def del_query(spark, sf_dir):
    return mutate.delete(orders(spark, sf_dir), F.col("o_orderstatus") == "F").select("_id")


@add("del_tombstone", f"SELECT _id, _del OR _id % 4 = 0 AS _del, CASE WHEN _id % 4 = 0 AND NOT _del THEN 100 ELSE _rev END AS _rev FROM {SNAP}")
def del_tombstone(spark, sf_dir):
    old = orders(spark, sf_dir)
    return mutate.delete_ids(old, old.where("_id % 4 = 0").select("_id"), purge=False).select("_id", "_del", "_rev")


@add("purge_tombstones", f"SELECT _id, _del FROM {SNAP} WHERE NOT (_del AND _rev <= 40)")
def purge_tombstones(spark, sf_dir):
    times = spark.range(0, 100, 10).select(F.col("id").alias("rev"), F.col("id").alias("ts"))
    return mutate.purge(orders(spark, sf_dir), times, F.lit(45)).select("_id", "_del")


@add("revision_sets", f"SELECT _id, CASE WHEN _id % 3 = 0 THEN 200 END AS status_rev, CASE WHEN _id % 2 = 0 THEN 200 END AS price_rev FROM {SNAP}")
def revision_sets(spark, sf_dir):
    old = orders(spark, sf_dir)
    changed = old.withColumns({"o_orderstatus": F.when(F.col("_id") % 3 == 0, "Z").otherwise(F.col("o_orderstatus")), "o_totalprice": F.when(F.col("_id") % 2 == 0, -1.0).otherwise(F.col("o_totalprice")), "_rev": F.lit(200).cast("long")})
    return mutate.revision_sets(old, changed, {"status_rev": ["o_orderstatus"], "price_rev": ["o_totalprice"]}).select("_id", "status_rev", "price_rev")


@add("latest_versions", "SELECT o_custkey AS _id, max(o_orderkey) AS _rev FROM orders GROUP BY 1")
def latest_versions(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("_id"), F.col("o_orderkey").alias("_rev"))
    return mutate.latest(df)


@add("incremental_backup", f"SELECT _id, _rev FROM {SNAP} WHERE _rev > 60")
def incremental_backup(spark, sf_dir):
    from kindframe.sources.jsonio import incremental

    return incremental(orders(spark, sf_dir), 60)[0].select("_id", "_rev")


# --- administration


@add("stats_kind", f"SELECT 'orders:1' AS kind, count(*) FILTER (WHERE NOT _del) AS count, count(*) FILTER (WHERE _del) AS del_count, count(*) FILTER (WHERE NOT _del AND o_orderstatus IS NOT NULL) AS index_status_count FROM {SNAP}")
def stats_kind(spark, sf_dir):
    return admin.kind_stats(orders(spark, sf_dir), "orders:1", {"status": ["o_orderstatus"]}).drop("size", "del_size")


@add("quota_usage", "SELECT 'a' AS owner, CAST(sum(strlen('{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}')) AS BIGINT) AS size FROM nation")
def quota_usage(spark, sf_dir):
    return admin.usage([("a", spark.read.parquet(f"{sf_dir}/nation.parquet"))])


@add("schema_validate", "SELECT p_partkey FROM part WHERE NOT (p_size >= 5 AND p_size <= 45 AND p_size % 3 = 0 AND length(p_name) <= 9 AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#17', 'Brand#22', 'Brand#23') AND regexp_matches(p_type, '^[A-P ]'))")
def schema_validate(spark, sf_dir):
    schema = {"type": "object", "properties": {"p_size": {"type": "integer", "minimum": 5, "maximum": 45, "divisibleBy": 3}, "p_name": {"type": "string", "maxLength": 9}, "p_brand": {"enum": ["Brand#1", "Brand#2", "Brand#3", "Brand#17", "Brand#22", "Brand#23"]}, "p_type": {"type": "string", "pattern": "^[A-P ]"}, "p_partkey": {"type": "integer"}, "p_retailprice": {"type": "number"}}, "additionalProperties": False}
    return validate.validate(spark.read.parquet(f"{sf_dir}/part.parquet"), schema).where(F.size("_failed") > 0).select("p_partkey")


@add("watch_range", "SELECT event_id, value FROM events WHERE value > 90")
def watch_range(spark, sf_dir):
    """The changes that fire a watch, here over a finished feed."""
    feed = spark.read.parquet(f"{sf_dir}/events.parquet")
    return watch.fired(feed, {"from": "events:1", "where": where(("value", ">", 90.0))}).select("event_id", "value")


@add("change_feed", f"SELECT _id, o_orderstatus, _del FROM (SELECT _id, CASE WHEN _id % 3 = 0 THEN 'C' ELSE o_orderstatus END AS o_orderstatus, false AS _del FROM {SNAP} WHERE NOT _del AND _id % 3 = 0 AND _id % 5 <> 0 UNION ALL SELECT _id, o_orderstatus, true FROM {SNAP} WHERE _id % 5 = 0)")
def change_feed(spark, sf_dir):
    old = orders(spark, sf_dir)
    new = mutate.merge_where(old.where("_id % 5 <> 0"), F.col("_id") % 3 == 0, {"o_orderstatus": F.lit("C")}, rev=1000)
    return watch.changes_between(old, new).select("_id", "o_orderstatus", "_del")


@add("text_tokens", "SELECT p_partkey, CAST(len(regexp_extract_all(p_name, '[\\p{L}\\p{N}]+')) AS INTEGER) AS n, array_to_string(regexp_extract_all(p_name, '[\\p{L}\\p{N}]+'), '|') AS words FROM part")
def text_tokens(spark, sf_dir):
    t = text.tokens(F.col("p_name"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.size(t).alias("n"), F.array_join(t, "|").alias("words"))


# --- schemaless kinds


def documents_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as objects: the type, the value and the parsed props."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    doc = F.concat(F.lit('{"type":"'), "event_type", F.lit('","value":'), F.col("value").cast("string"), F.lit(',"props":'), "props", F.lit("}"))
    return mutate.with_system(e.select("event_id", F.parse_json(doc).alias("_doc")), "event_id", 5)


K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def _shown(df: DataFrame) -> DataFrame:
    get = lambda p, t: F.try_variant_get("_doc", f"$.{p}", t)
    return df.select("_id", get("type", "string").alias("type"), get("props.k", "bigint").alias("k"), get("props.more", "boolean").alias("more"), "_rev")


@add("put_variant", f"SELECT event_id AS _id, CASE WHEN event_id % 3 = 0 THEN 'new' ELSE event_type END AS type, CASE WHEN event_id % 3 <> 0 THEN {K} END AS k, CAST(NULL AS BOOLEAN) AS more, CASE WHEN event_id % 3 = 0 THEN 6 ELSE 5 END AS _rev FROM events")
def put_variant(spark, sf_dir):
    """Objects take the place of others; those of other ids that are put as they were keep their revision."""
    old = documents_of_events(spark, sf_dir)
    new = old.where("_id % 3 = 0").select("_id", F.parse_json(F.lit('{"type":"new"}')).alias("_doc"), F.col("_id").alias("event_id"))
    return _shown(mutate.put(old, new.unionByName(old.where("_id % 3 = 1").select("_id", "_doc", "event_id")), check=False))


@add("merge_variant", f"SELECT event_id AS _id, event_type AS type, {K} AS k, CASE WHEN event_id % 3 = 0 THEN true END AS more, CASE WHEN event_id % 3 = 0 THEN 6 ELSE 5 END AS _rev FROM events")
def merge_variant(spark, sf_dir):
    """A deep merge adds a property to an object inside the object."""
    old = documents_of_events(spark, sf_dir)
    new = old.where("_id % 3 = 0").select("_id", F.parse_json(F.lit('{"props":{"more":true}}')).alias("_doc"))
    return _shown(mutate.merge(old, new))


@add("validate_variant", f"SELECT event_id AS _id FROM events WHERE NOT (event_type IN ('click', 'view', 'error') AND value <= 60 AND {K} >= 10 AND {K} % 2 = 0)")
def validate_variant(spark, sf_dir):
    schema = {"type": "object", "properties": {"type": {"type": "string", "enum": ["click", "view", "error"]}, "value": {"type": "number", "maximum": 60}, "props": {"type": "object", "properties": {"k": {"type": "integer", "minimum": 10, "divisibleBy": 2}}, "additionalProperties": False}}}
    docs = documents_of_events(spark, sf_dir)
    return docs.where(~validate.valid(F.col("_doc"), docs.schema["_doc"].dataType, schema)).select("_id")


@add("last_string_id", "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, 'e' || event_id) AS n FROM events) WHERE n = 1")
def last_string_id(spark, sf_dir):
    c = Catalog(spark)
    c.put_kind("events:1", spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("_id", F.concat(F.lit("e"), "event_id")))
    return c.find({"from": "events:1", "aggregate": {"groupBy": ["event_type"], "last": ["value"]}}).select("event_type", F.col("last_value.event_id").alias("event_id"))


@add("page_variant", f"SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY {K}, event_id) AS n FROM events) WHERE n BETWEEN 31 AND 60")
def page_variant(spark, sf_dir):
    """The second page in order of a schemaless property."""
    c = Catalog(spark)
    c.put_kind("events:1", spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.try_variant_get(F.parse_json("props"), "$.k", "variant").alias("k")), "event_id")
    query = {"from": "events:1", "orderBy": "k", "limit": 30, "select": ["event_id"]}
    return c.find(query | {"page": c.find_page(query)[1]})


@add("group_variant", f"SELECT CAST({K} AS VARCHAR) AS k, count(event_id) AS cnt_event_id FROM events GROUP BY 1")
def group_variant(spark, sf_dir):
    c = Catalog(spark)
    c.put_kind("events:1", spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("props", F.parse_json("props")), "event_id")
    out = c.find({"from": "events:1", "aggregate": {"groupBy": ["props.k"], "cnt": ["event_id"]}})
    return out.select(F.col("k"), "cnt_event_id")


@add("find_wildcard", f"SELECT event_id FROM events WHERE {K} > 90")
def find_wildcard(spark, sf_dir):
    """* stands for all of an object's values."""
    c = Catalog(spark)
    c.put_kind("events:1", spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("props", F.from_json("props", "map<string,bigint>")), "event_id")
    return c.find({"from": "events:1", "where": where(("props.*", ">", 90)), "select": ["event_id"]})


@add("order_by_index", "SELECT p_partkey FROM part WHERE p_brand = 'Brand#4' ORDER BY p_size DESC, p_retailprice DESC, p_partkey DESC LIMIT 15")
def order_by_index(spark, sf_dir):
    """Rows of one value stand in order of the index's further properties."""
    c = catalog(spark, sf_dir, "part")
    c.kinds["part:1"].indexes.append(Index(["p_brand", "p_size", "p_retailprice"]))
    return c.find({"from": "part:1", "where": where(("p_brand", "=", "Brand#4")), "orderBy": "p_size", "desc": True, "limit": 15, "select": ["p_partkey"]})


# --- calls on a database


def database(spark: SparkSession, sf_dir: str, **kw) -> Database:
    db = Database(Catalog(spark), **kw)
    db.put_kind("orders:1", orders(spark, sf_dir), owner="shop")
    return db


@add("batch_calls", f"SELECT 'found' AS answer, count(*) AS n FROM {SNAP} WHERE NOT _del AND _id % 4 <> 0 AND o_orderstatus = 'F' UNION ALL SELECT 'left', count(*) FROM {SNAP} WHERE _id % 4 <> 0")
def batch_calls(spark, sf_dir):
    """A find between writes sees those before it."""
    db = database(spark, sf_dir)
    ids = db.catalog.kind("orders:1").df.where("_id % 4 = 0").select("_id")
    out = db.batch([{"method": "del", "params": {"kind": "orders:1", "ids": ids}}, {"method": "find", "params": {"query": {"from": "orders:1", "where": where(("o_orderstatus", "=", "F"))}}}])
    return out[1].agg(F.lit("found").alias("answer"), F.count("*").alias("n")).unionAll(db.catalog.kind("orders:1").df.agg(F.lit("left"), F.count("*")))


@add("permissions_of_calls", "SELECT * FROM (VALUES ('create', false), ('delete', false), ('extend', false), ('read', true), ('update', true)) AS t(operation, may)")
def permissions_of_calls(spark, sf_dir):
    db = database(spark, sf_dir, caller="com.app.list")
    db.put_permissions([{"object": "orders:1", "caller": "com.app.*", "operations": {"read": "allow", "update": "allow", "delete": "deny"}}])
    return spark.createDataFrame([(o, db.may(o, "orders:1")) for o in admin.OPERATIONS], "operation string, may boolean")


@add("watched_find", f"WITH t AS (SELECT * FROM {SNAP} WHERE NOT _del ORDER BY o_totalprice, _id LIMIT 10) SELECT _id FROM {SNAP} WHERE (o_totalprice, _id) <= (SELECT (o_totalprice, _id) FROM t ORDER BY o_totalprice DESC, _id DESC LIMIT 1)")
def watched_find(spark, sf_dir):
    """Changes up to a limited find's last row fire its watch; here all rows are changes."""
    db = database(spark, sf_dir)
    _, w = db.find_watched({"from": "orders:1", "orderBy": "o_totalprice", "limit": 10})
    return w.fired(orders(spark, sf_dir)).select("_id")


@add("purge_status", f"SELECT (SELECT max(_rev) // 10 * 10 FROM {SNAP} WHERE _rev <= 45) AS rev, count(*) AS n FROM {SNAP} WHERE NOT (_del AND _rev <= 40)")
def purge_status(spark, sf_dir):
    db = database(spark, sf_dir)
    db.purge(spark.range(0, 100, 10).select(F.col("id").alias("rev"), F.col("id").alias("ts")), F.lit(45))
    return db.catalog.kind("orders:1").df.agg(F.lit(db.purge_status()).cast("long").alias("rev"), F.count("*").alias("n"))


@add("shards_activated", "SELECT n_nationkey AS _shard FROM nation WHERE n_regionkey = 2")
def shards_activated(spark, sf_dir):
    """A region's shards become active: all watches fire for them."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").withColumnRenamed("n_nationkey", "_shard")
    return watch.activated(n.where("n_regionkey < 2"), n.where("n_regionkey <= 2"))


@add("profile_of_calls", "SELECT 'find' AS operation, 2 AS cnt_seconds UNION ALL SELECT 'merge', 1")
def profile_of_calls(spark, sf_dir):
    db = database(spark, sf_dir)
    db.start_profile()
    db.find({"from": "orders:1", "limit": 1})
    db.find({"from": "orders:1", "where": where(("o_orderstatus", "=", "F"))})
    db.merge_query({"from": "orders:1", "where": where(("o_orderstatus", "=", "F"))}, {"o_orderstatus": F.lit("G")})
    return db.get_profile({"from": "Profile:1", "aggregate": {"groupBy": ["operation"], "cnt": ["seconds"]}})


@add("quota_stats", "SELECT 'a' AS owner, CAST(sum(strlen('{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}')) AS BIGINT) AS size FROM nation")
def quota_stats(spark, sf_dir):
    db = Database(Catalog(spark))
    db.put_kind("nation:1", spark.read.parquet(f"{sf_dir}/nation.parquet"), owner="a", id_col="n_nationkey")
    return db.quota_stats()


@add("group_objects", "SELECT o_orderpriority AS priority, o_orderstatus AS status, count(o_custkey) AS cnt_o_custkey FROM orders GROUP BY 1, 2")
def group_objects(spark, sf_dir):
    """Groups of whole objects."""
    c = Catalog(spark)
    c.put_kind("orders:1", spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("of", F.struct(F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s"))), "o_orderkey")
    return c.find({"from": "orders:1", "aggregate": {"groupBy": ["of"], "cnt": ["o_custkey"]}}).select(F.col("of.p").alias("priority"), F.col("of.s").alias("status"), "cnt_o_custkey")


@add("collated_prefix_list", "SELECT p_partkey FROM part WHERE starts_with(upper(p_name), 'RED') OR starts_with(upper(p_name), 'BLUE')")
def collated_prefix_list(spark, sf_dir):
    """Prefixes in a language's collation, in which case does not count."""
    c = catalog(spark, sf_dir, "part")
    c.set_locale("fr")
    return c.search({"from": "part:1", "where": [{"prop": "p_name", "op": "%", "val": ["RED", "blue"], "collate": "primary"}], "select": ["p_partkey"]})


@add("collated_numbers", "SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0 ORDER BY c_custkey LIMIT 40 OFFSET 40")
def collated_numbers(spark, sf_dir):
    """The second page of texts whose numbers count by value, though some are padded."""
    c = Catalog(spark)
    label = F.concat(F.lit("no "), F.when(F.col("c_custkey") % 4 == 0, F.lit("00")).otherwise(F.lit("")), F.col("c_custkey").cast("string"))
    c.put_kind("customer:1", spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 2 = 0").select("c_custkey", label.alias("label")), "c_custkey", indexes=[Index(["label"], collate={"label": "identical"})])
    query = {"from": "customer:1", "where": [{"prop": "label", "op": "%", "val": "no ", "collate": "identical"}], "orderBy": "label", "limit": 40, "select": ["c_custkey"]}
    return c.find(query | {"page": c.find_page(query)[1]})


# --- scalar helpers


@add("coerced_values", f"SELECT event_id, CAST(trunc(value) AS BIGINT) AS whole, CAST({K} <> 0 AS BOOLEAN) AS flag, CAST({K} AS VARCHAR) AS shown, CAST(CAST(value AS DECIMAL(19, 6)) AS DOUBLE) AS number FROM events")
def coerced_values(spark, sf_dir):
    docs = documents_of_events(spark, sf_dir)
    get = lambda p: F.try_variant_get("_doc", f"$.{p}", "variant")
    return docs.select(F.col("_id").alias("event_id"), values.as_int(get("value")).alias("whole"), values.as_bool(get("props.k")).alias("flag"), values.as_text(get("props.k")).alias("shown"), values.as_decimal(get("value")).cast("double").alias("number"))


@add("base64_texts", "SELECT s_suppkey, base64(CAST(s_name AS BLOB)) AS mime, s_name AS again FROM supplier")
def base64_texts(spark, sf_dir):
    """There and back, through the alphabet of ids too."""
    raw = F.encode("s_name", "utf-8")
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", values.to_base64(raw).alias("mime"), F.decode(values.from_base64(values.to_base64(raw, True), True), "utf-8").alias("again"))


@add("object_hashes", "SELECT count(DISTINCT (event_type, value, props)) AS n FROM events")
def object_hashes(spark, sf_dir):
    return documents_of_events(spark, sf_dir).agg(F.count_distinct(values.object_hash(F.col("_doc"))).alias("n"))


@add("string_helpers", "SELECT p_partkey, string_split(p_name, ' ')[1] AS first_word, len(string_split(p_name, ' ')) AS n, upper(p_name) = upper('BLUE bolt') AS same, CASE WHEN upper(p_name) < 'H' THEN -1 WHEN upper(p_name) > 'H' THEN 1 ELSE 0 END AS side FROM part")
def string_helpers(spark, sf_dir):
    words = text.pieces(F.col("p_name"), " ")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", words[0].alias("first_word"), F.size(words).cast("long").alias("n"), text.equal_caseless(F.col("p_name"), F.lit("BLUE bolt")).alias("same"), text.compare_caseless(F.col("p_name"), F.lit("h")).alias("side"))


def entry(spark: SparkSession) -> DataFrame:
    """The flagship: the largest open orders."""
    return catalog(spark, "/root/testdata/sf0.001", "orders").find({"from": "orders:1", "where": where(("o_orderstatus", "=", "O")), "orderBy": "o_totalprice", "desc": True, "limit": 10})

"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindframe.llm.store import dealt_anew, dropped, stored

#: A bound that no table meets: the rounds grow with the logarithm of the number of nodes.
ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours, linked to the least of them and the node: the larger neighbours, or the node and its smaller ones."""
    if large:
        near = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    # The join deals both sides anew and can split a node of very many neighbours over tasks.
    met = near.select(dealt_anew("a").alias("_at"), "a", "b").join(least.select(dealt_anew("a").alias("_at"), "m"), "_at")
    if large:
        # Each edge gives one row at most.
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    else:
        out = met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
    out = stored(out, "edges")
    dropped(edges)
    return out


def _settled(edges: DataFrame) -> bool:
    """Whether each node is linked to its root alone, and roots to no other."""
    ends = edges.select(F.col("a").alias("_node"), F.lit(1).alias("_up"), F.lit(0).alias("_root")).unionAll(edges.select(F.col("b").alias("_node"), F.lit(0).alias("_up"), F.lit(1).alias("_root")))
    return ends.groupBy("_node").agg(F.sum("_up").alias("_up"), F.max("_root").alias("_root")).where("_up + _root > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root), a stored table, for each node of edges (a, b: long); root is the smallest node of its component.

    Loops and repeated edges do no harm, nulls are left out, and no edges give no rows.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges")
    for _ in range(ROUNDS):
        if _settled(now):
            break
        now = _star(_star(now, True), False)
    else:
        raise RuntimeError(f"components are not settled after {ROUNDS} rounds")
    out = stored(now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), "components")
    dropped(now)
    return out

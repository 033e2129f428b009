"""Mixing sources to target weights by entropy balancing. Native DataFrame operations only.

Of all ways to repeat or leave out documents that give each source its target number of words, the one nearest to the
corpus as it is (least relative entropy, at most MOST copies of a document) takes a document of size x at the rate
min(MOST, exp(lambda * x)), with one lambda a source: the solution of the convex dual. Newton's method finds the lambdas,
all sources at once, over (source, size) counts; each iteration is one aggregation. The rates are then rounded to whole
copies: within a source, in order of size, each cell of equal documents takes as many extra copies as the running sum
of its fractions passes whole numbers, so that the source's total misses its target by a part of one document's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindframe.llm.store import WORD, dropped, row_key, stored, tasks

MOST = 3
ITERATIONS = 60
#: Cells of equal size and source are cut in this many parts, so that a group of copies is not one task's.
PARTS = 256
#: Parts in which equal rows are numbered.
SALTS = 64
#: Starts that are tried for the running sums of the rounding.
STARTS = 32


def word_count(text: Column) -> Column:
    return F.when(text.isNull(), 0).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def _source(c: Column) -> Column:
    """A source as a key without nulls whose byte order is code point order, null last."""
    return F.when(c.isNull(), "1").otherwise(F.concat(F.lit("0"), c.cast("string")))


def _targets(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """(_src, _source_size, _target) from (_src, _source_size). Few scalars reach the driver."""
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    # Ranks by ranges of sources and the number of those in earlier ranges: no task has all sources.
    ranged = stored(sources.repartitionByRange(tasks(sources.sparkSession), "_src").withColumn("_p", F.spark_partition_id()), "sources")
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_in"))
    earlier = counts.select("_p", (F.sum("_in").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_in")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_p").orderBy("_src")) - 1 + F.col("_before")
    t = ranged.join(earlier, "_p").withColumn("_w", F.get(cycle, (rank % len(weights)).cast("int"))).drop("_p", "_before")
    t = stored(t.withColumn("_cap", (F.col("_source_size") * MOST).cast("double")), "weights")
    whole = float(t.agg(F.sum("_source_size")).first()[0] or 0)
    # The capped sources are those whose cap is below their weight times the level; each round can only add to them.
    level = 0.0
    while whole:
        capped = F.col("_cap") < F.col("_w") * level if level else F.lit(False)
        fixed, rest = t.agg(F.sum(F.when(capped, F.col("_cap"))), F.sum(F.when(~capped, F.col("_w")))).first()
        new = (whole - (fixed or 0.0)) / rest if rest else level
        if new <= level:
            break
        level = new
    return t.select("_src", "_source_size", F.least("_cap", F.col("_w") * level).alias("_target"))


def _rate() -> Column:
    tilted = F.least(F.exp(F.least(F.col("_lambda") * F.col("_size") / F.col("_mean"), F.lit(5.0))), F.lit(float(MOST)))
    return F.when((F.col("_size") == 0) | F.col("_mean").isNull(), 1.0).otherwise(tilted)


def _solved(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(_src, _lambda, _mean) by Newton steps inside a bracket that shrinks with each evaluation. A lambda is per mean size."""
    mean = sizes.groupBy("_src").agg((F.sum(F.col("_size") * F.col("_n")) / F.sum(F.when(F.col("_size") > 0, F.col("_n")))).alias("_mean"))
    # With _hi even a document of one word is taken MOST times; at _lo nothing is.
    hi = F.lit(1.1) * F.col("_mean") + 1
    full = F.col("_target") >= MOST * F.col("_source_size")
    state = stored(targets.join(mean, "_src").select("_src", "_target", "_mean", F.when(full, hi).otherwise(0.0).alias("_lambda"), F.lit(-1e4).alias("_lo"), hi.alias("_hi")), "dual")
    for _ in range(ITERATIONS):
        words = F.col("_n") * F.col("_size")
        slope = F.when(_rate() < MOST, words * F.col("_size") / F.col("_mean") * _rate()).otherwise(0.0)
        got = sizes.join(state.select("_src", "_lambda", "_mean"), "_src").groupBy("_src").agg(F.sum(words * _rate()).alias("_f"), F.sum(slope).alias("_d"))
        over = F.col("_f") > F.col("_target")
        met = state.join(got, "_src").withColumn("_off", F.abs(F.col("_f") - F.col("_target")) / F.greatest(F.col("_target"), F.lit(1.0)))
        met = met.withColumn("_a", F.when(over, F.col("_lo")).otherwise(F.col("_lambda"))).withColumn("_b", F.when(over, F.col("_lambda")).otherwise(F.col("_hi")))
        step = F.col("_lambda") - (F.col("_f") - F.col("_target")) / F.nullif(F.col("_d"), F.lit(0.0))
        # The side of negative lambdas is long, so halving goes by ratio there.
        half = F.when((F.col("_b") <= 0) & (F.col("_a") < -1), -F.sqrt(F.abs(F.col("_a")) * F.greatest(F.abs(F.col("_b")), F.lit(0.01)))).otherwise((F.col("_a") + F.col("_b")) / 2)
        new = F.when(F.col("_off") < 1e-7, F.col("_lambda")).when((step > F.col("_a")) & (step < F.col("_b")), step).otherwise(half)
        last, state = state, stored(met.select("_src", "_target", "_mean", new.alias("_lambda"), F.col("_a").alias("_lo"), F.col("_b").alias("_hi"), "_off"), "dual")
        dropped(last)
        if (state.agg(F.max("_off")).first()[0] or 0.0) < 1e-6:
            break
    else:
        # Where sizes are so few that the words taken jump over the target, the bracket has closed on the jump.
        open_ = state.where((F.col("_off") >= 1e-6) & (F.col("_hi") - F.col("_lo") > 1e-6 * (1 + F.abs(F.col("_lambda"))))).count()
        if open_:
            raise RuntimeError(f"{open_} sources have no solution after {ITERATIONS} steps")
    # Sums of doubles differ in their last digits from run to run; rounded, they give the same copies.
    return state.select("_src", F.round("_lambda", 9).alias("_lambda"), F.round("_mean", 6).alias("_mean"))


def _quotas(rows: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Stored: each distinct (_src, _row) of rows (_src, _size, _row) with its _size, number _c, _source_size, _target, and its
    copies: all rows are taken _base times, and _x of them once more."""
    keys = rows.groupBy("_src", "_row").agg(F.min("_size").alias("_size"), F.count("*").alias("_c"))
    keys = stored(keys.withColumn("_part", F.pmod(F.col("_row"), F.lit(PARTS)).cast("int")), "sizes")
    cells = stored(keys.groupBy("_src", "_size", "_part").agg(F.sum("_c").alias("_n")), "cells")
    sizes = stored(cells.groupBy("_src", "_size").agg(F.sum("_n").alias("_n")), "histogram")
    targets = stored(_targets(sizes.groupBy("_src").agg(F.sum(F.col("_size") * F.col("_n")).alias("_source_size")), weights), "targets")
    rated = cells.join(_solved(sizes, targets), "_src").withColumn("_rate", F.round(_rate(), 9)).withColumn("_base", F.floor("_rate"))
    # Fractions in whole units of 2^-32, so that their sums are exact in any order.
    unit = 1 << 32
    rated = rated.withColumn("_frac", F.col("_n") * F.round((F.col("_rate") - F.col("_base")) * unit).cast("long")).withColumn("_block", F.floor(F.col("_size") / 1024))
    # Running sums of the fractions in three steps, over blocks of sizes, sizes of a block, and parts of a size: no window
    # holds a whole source, nor all cells of its most common sizes.
    up_to = Window.unboundedPreceding, 0
    of_size = stored(rated.groupBy("_src", "_block", "_size").agg(F.sum("_frac").alias("_in")), "size-sums")
    of_block = of_size.groupBy("_src", "_block").agg(F.sum("_in").alias("_all"))
    blocks = of_block.select("_src", "_block", (F.sum("_all").over(Window.partitionBy("_src").orderBy("_block").rowsBetween(*up_to)) - F.col("_all")).alias("_b"))
    earlier = F.sum("_in").over(Window.partitionBy("_src", "_block").orderBy("_size").rowsBetween(*up_to)) - F.col("_in")
    before = stored(of_size.withColumn("_s", earlier).join(blocks, ["_src", "_block"]).select("_src", "_size", (F.col("_b") + F.col("_s")).alias("_before")), "sums-before")
    end = F.col("_before") + F.sum("_frac").over(Window.partitionBy("_src", "_size").orderBy("_part").rowsBetween(*up_to))
    rated = stored(rated.join(before, ["_src", "_size"]).withColumn("_end", end), "rated")

    def extra(start: Column) -> Column:
        return F.shiftright(F.col("_end") + start, 32) - F.shiftright(F.col("_end") - F.col("_frac") + start, 32)

    # Of the possible starts of the running sum, the one whose total comes nearest to the source's target.
    starts = [unit * (2 * k + 1) // (2 * STARTS) for k in range(STARTS)]
    totals = rated.groupBy("_src").agg(*[F.sum(F.col("_size") * (F.col("_n") * F.col("_base") + extra(F.lit(x)))).alias(f"_t{k}") for k, x in enumerate(starts)])
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"_t{k}") - F.col("_target")).alias("off"), F.lit(x).alias("at")) for k, x in enumerate(starts)]))
    # Written: one row a source, so mostly broadcast, and else dealt anew with the cells of a large source split.
    chosen = stored(targets.join(totals, "_src").select("_src", "_source_size", "_target", best["at"].alias("_start")), "starts")
    taken = rated.join(chosen, "_src").select("_src", "_size", "_part", "_base", extra(F.col("_start")).alias("_extra"), "_source_size", "_target")
    # The first documents of a cell in order of their key take the extra copies.
    upto = F.sum("_c").over(Window.partitionBy("_src", "_size", "_part").orderBy("_row").rowsBetween(*up_to))
    met = keys.withColumn("_upto", upto).join(taken, ["_src", "_size", "_part"])
    x = F.greatest(F.least(F.col("_extra") - F.col("_upto") + F.col("_c"), F.col("_c")), F.lit(0))
    out = stored(met.select("_src", "_size", "_row", "_c", "_source_size", "_target", "_base", x.alias("_x")), "quotas")
    dropped(keys, cells, sizes, targets, of_size, before, rated, chosen)
    return out


def _copied(rows: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """rows (_src, _size, _row, and whatever else) plus _source_size, _target, _copies."""
    quotas = _quotas(rows.select("_src", "_size", "_row"), weights)
    # The size comes with the quota, so that words are counted once.
    met = rows.drop("_size").join(quotas, ["_src", "_row"])
    whole = met.where("_x = 0 OR _x = _c").withColumn("_copies", F.col("_base") + F.when(F.col("_x") > 0, 1).otherwise(0))
    split = quotas.where("_x > 0 AND _x < _c").select("_src", "_row", "_c", "_x")
    if split.isEmpty():
        return _told(whole)
    # Of equal rows, at most one key a cell, some take one copy more. They are numbered in SALTS parts, as they may be many.
    some = stored(met.where("_x > 0 AND _x < _c").withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))), "repeated")
    counts = some.groupBy("_src", "_row", "_salt").agg(F.count("*").alias("_in"), F.first("_x").alias("_x0"))
    earlier = F.sum("_in").over(Window.partitionBy("_src", "_row").orderBy("_salt").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_in")
    rest = counts.select("_src", "_row", "_salt", (F.col("_x0") - earlier).alias("_more"))
    nth = F.row_number().over(Window.partitionBy("_src", "_row", "_salt").orderBy(F.lit(0)))
    part = some.withColumn("_nth", nth).join(rest, ["_src", "_row", "_salt"]).withColumn("_copies", F.col("_base") + (F.col("_nth") <= F.col("_more")).cast("int"))
    return _told(whole).unionByName(_told(part.drop("_salt", "_nth", "_more")))


def _told(met: DataFrame) -> DataFrame:
    return met.withColumn("_copies", F.col("_copies").cast("int")).drop("_c", "_x", "_base")


def with_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1)) -> DataFrame:
    """docs plus size, source_size, target and copies (0 to 3): how often the mix takes each document.

    A document's size is its number of words; null texts have none. Sources in order of code point, null last, weigh
    `weights`, repeating, and share the words of all documents; no source gets more than 3 times its words. Documents
    without words are taken once. Repeated rows are documents of their own. The same rows give the same copies
    however they are partitioned. Input columns of the names that are added are replaced; others pass through, and an
    empty table gives an empty table. Rows whose 64-bit keys collide share their extra copies, as repeated rows do.
    """
    added = ("size", "source_size", "target", "copies")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in added]).alias("_doc"))
    text, ident, src = (F.col("_doc").getField(c) for c in (text_col, id_col, source_col))
    met = _copied(packed.select("_doc", _source(src).alias("_src"), word_count(text).alias("_size"), row_key(ident, text).alias("_row")), weights)
    return met.select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns if c not in added], F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_copies").alias("copies"))


def mix(docs: DataFrame, **kw) -> DataFrame:
    """docs as the mix takes them: each row as often as its copies, the columns of docs only."""
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    kept = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    arg = {k: names[kw.pop(k, v)] for k, v in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"))}
    copied = with_copies(kept, **arg, **kw)
    return copied.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select(*[F.col(n).alias(c) for c, n in names.items()])


def op2_source_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", _source(F.col("source")).alias("_src"), word_count(F.col("text")).alias("_size"), row_key(F.col("doc_id"), F.col("text")).alias("_row"))
    out = _copied(rows, (5, 2, 1))
    return out.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"), F.col("_copies").alias("copies"))

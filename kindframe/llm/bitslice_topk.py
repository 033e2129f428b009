"""Exact top-k inner product search with a bit-sliced index.

Each block of at most BLOCK rows holds its quantised components as bitmaps: one bitmap for each bit (slice) of each
dimension. A query's scores over a block are a weighted sum of these bitmaps, made by carry-save addition of bitmaps
alone: a full adder turns three bitmaps of one weight into one of that weight and one of the next. The sum is itself
bit-sliced, so the top rows are chosen from the most significant slice downward. Rows that tie at the boundary are put in
order of id. Query blocks meet index blocks in a grid that is cut on both sides, and each meeting yields k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindframe.llm.store import records, slim, stored

BLOCK, QUERIES = 8192, 128
#: Bytes of either side that meet in a cell of the grid.
CELL = 64 << 20
ONE = np.uint64(1)


def _quantised(column: pa.ListArray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that take part, and their floor(scale * x), padded with zeros to the longest. Rounding is that of doubles."""
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    values = np.asarray(column.flatten().cast(pa.float64()).fill_null(np.nan), dtype=np.float64)
    at = np.repeat(np.arange(len(lengths)), np.maximum(lengths, 0))
    good = lengths >= 0
    good[at[~np.isfinite(values)]] = False
    out = np.zeros((len(lengths), max(int(lengths.max(initial=0)), 0)), dtype=np.int64)
    starts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
    keep = good[at]
    out[at[keep], (np.arange(len(values)) - starts[at])[keep]] = np.floor(scale * values[keep]).astype(np.int64)
    return np.flatnonzero(good), out


def sliced(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bitmaps (all slices of all dimensions, one after another), each dimension's smallest value, and its slices' number."""
    rows, words = len(x), -(-len(x) // 64)
    low = x.min(axis=0, initial=np.iinfo(np.int64).max) if rows else np.zeros(x.shape[1], np.int64)
    up = (x - low).T.astype(np.uint64)
    depth = np.array([int(v).bit_length() for v in up.max(axis=1, initial=0)], dtype=np.int64)
    maps = []
    for d, n in enumerate(depth):
        bits = np.zeros((n, words * 64), np.uint8)
        for i in range(n):
            bits[i, :rows] = (up[d] >> np.uint64(i)) & ONE
        maps.append(np.packbits(bits, axis=1, bitorder="little").view(np.uint64))
    return (np.concatenate(maps) if maps else np.zeros((0, words), np.uint64)), low, depth


def summed(maps: np.ndarray, depth: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, int]:
    """The bit-sliced sum of |q| * y over the dimensions, least slice first, and what the true sum has more.

    y is the stored value where q is positive and its complement where q is negative, so that all terms add.
    """
    own_dim = np.repeat(np.arange(len(depth)), depth)
    own_bit = np.arange(len(own_dim)) - np.repeat(np.cumsum(depth) - depth, depth)
    q = np.concatenate((q, np.zeros(max(0, len(depth) - len(q)), np.int64)))[: len(depth)]
    size = np.abs(q)
    more = -sum(int(size[d]) * ((1 << int(depth[d])) - 1) for d in np.flatnonzero(q < 0))
    signed = maps ^ np.where(q < 0, ~np.uint64(0), np.uint64(0))[own_dim][:, None]
    rows, weights = [], []
    for bit in range(int(size.max(initial=0)).bit_length()):
        r = np.flatnonzero((size >> bit & 1)[own_dim])
        rows.append(r)
        weights.append(own_bit[r] + bit)
    if not rows or not sum(map(len, rows)):
        return np.zeros((1, maps.shape[1]), np.uint64), more
    rows, weights = np.concatenate(rows), np.concatenate(weights)
    order = np.argsort(weights, kind="stable")
    terms, ends = signed[rows[order]], np.cumsum(np.bincount(weights))
    out, carried, at = [], [], 0
    while at < len(ends) or carried:
        own = terms[ends[at - 1] if at else 0 : ends[at]] if at < len(ends) else terms[:0]
        now, carried = (np.concatenate((own, *carried)) if carried else own), []
        while len(now) > 2:
            k = len(now) // 3
            a, b, c = now[:k], now[k : 2 * k], now[2 * k : 3 * k]
            ab = a ^ b
            both = a & b
            both |= c & ab
            carried.append(both)
            ab ^= c
            now = np.concatenate((ab, now[3 * k :])) if len(now) > 3 * k else ab
        if len(now) == 2:
            carried.append(now[:1] & now[1:])
            now = now[:1] ^ now[1:]
        out.append(now[0] if len(now) else np.zeros(maps.shape[1], np.uint64))
        at += 1
    return np.stack(out), more


def top_rows(sums: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k largest sums and all that tie with the last of them, from the most significant slice downward."""
    sure, open_ = np.zeros_like(allowed), allowed
    have = 0
    for s in sums[::-1]:
        ones = open_ & s
        n = int(np.bitwise_count(ones).sum())
        if have + n <= k:
            sure, have = sure | ones, have + n
            open_ = open_ & ~s
            if have == k:
                open_ = np.zeros_like(open_)
                break
        else:
            open_ = ones
    return np.flatnonzero(np.unpackbits((sure | open_).view(np.uint8), bitorder="little"))


def _values(sums: np.ndarray, rows: np.ndarray) -> list[int]:
    """The sums of single rows, read from their slices."""
    word, bit = rows // 64, (rows % 64).astype(np.uint64)
    bits = (sums[:, word] >> bit) & ONE
    return [sum(int(b) << i for i, b in enumerate(col)) for col in bits.T]


INDEX = T.StructType([T.StructField("_ids", T.BinaryType()), T.StructField("_low", T.BinaryType()), T.StructField("_depth", T.BinaryType()), T.StructField("_maps", T.BinaryType()), T.StructField("_block", T.LongType())])
QUERY = T.StructType([T.StructField("_qids", T.BinaryType()), T.StructField("_q", T.BinaryType()), T.StructField("_dims", T.LongType()), T.StructField("_batch", T.LongType())])
HITS = "_query long, _row long, _score long"


def _blocks(batches: Iterator[pa.RecordBatch], scale: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, values) of at most `most` rows."""
    ids, rows = [], []
    for b in batches:
        good, x = _quantised(b.column(1), scale)
        own = np.asarray(b.column(0).cast(pa.int64()).fill_null(0))
        good = good[np.asarray(b.column(0).is_valid())[good]]
        ids += [own[good]]
        rows += [x[good]]
        while sum(map(len, ids)) >= most:
            i, r = np.concatenate(ids), _stacked(rows)
            yield i[:most], r[:most]
            ids, rows = [i[most:]], [r[most:]]
    if sum(map(len, ids)):
        yield np.concatenate(ids), _stacked(rows)


def _stacked(rows: list[np.ndarray]) -> np.ndarray:
    width = max(r.shape[1] for r in rows)
    return np.concatenate([np.pad(r, ((0, 0), (0, width - r.shape[1]))) for r in rows])


def build_index(rows: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """One row for each block: ids and bitmaps. Built where the rows lie, without a shuffle; every valid row is in it."""

    @slim
    def build(batches):
        for n, (ids, x) in enumerate(_blocks(batches, scale, BLOCK)):
            maps, low, depth = sliced(x)
            yield pa.RecordBatch.from_pydict({"_ids": [ids.tobytes()], "_low": [low.tobytes()], "_depth": [depth.tobytes()], "_maps": [maps.tobytes()], "_block": [n]})

    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(build, INDEX)


def top_k(rows: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, row_id, score): each query's k rows of the largest integer inner product, itself left out.

    Components become floor(scale * x). Ties go to the smaller id; fewer than k rows give fewer results. Rows and queries
    whose id or vector is null, or whose vector holds null, NaN or infinity, take no part; shorter vectors count as padded
    with zeros. Rows that repeat an id are rows of their own, except that none of them answers a query of that id;
    repeated queries are asked once. Other columns are ignored, and an empty side gives an empty table. Sums must fit in
    64 bits.
    """
    spark = rows.sparkSession
    index = stored(build_index(rows, id_col, vector_col, scale), "bit-slices")
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id IS NOT NULL").dropDuplicates(["id"])

    def batch(batches):
        for n, (ids, x) in enumerate(_blocks(batches, scale, QUERIES)):
            yield pa.RecordBatch.from_pydict({"_qids": [ids.tobytes()], "_q": [x.tobytes()], "_dims": [x.shape[1]], "_batch": [n]})

    batches = stored(asked.mapInArrow(batch, QUERY), "query-batches")
    n_index, size = index.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("_maps")), F.lit(0))).first()
    n_batches, asked_size = batches.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("_q")), F.lit(0))).first()
    # Each side is cut into slots of CELL bytes, and finer while there are cores without a cell: first the index, as the
    # batches are the smaller side to copy. Slots are hashes, so nothing has to be numbered in one place.
    slots, asks = max(1, -(-size // CELL)), max(1, -(-asked_size // CELL))
    cores = 2 * spark.sparkContext.defaultParallelism
    slots = max(slots, min(n_index, -(-cores // asks)))
    asks = max(asks, min(n_batches, -(-cores // slots)))
    left = index.withColumn("_slot", F.pmod(F.xxhash64("_ids"), F.lit(slots))).withColumn("_ask", F.explode(F.sequence(F.lit(0), F.lit(asks - 1))))
    right = batches.withColumn("_ask", F.pmod(F.xxhash64("_qids"), F.lit(asks)).cast("int")).withColumn("_slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(asks * slots, 100_000))
    met = left.repartition(tasks, "_slot", "_ask").join(right.repartition(tasks, "_slot", "_ask"), ["_slot", "_ask"]).select("_ids", "_low", "_depth", "_maps", "_qids", "_q", "_dims")

    @slim
    def answer(batches):
        for b in batches:
            for r in records(b):
                ids, low, depth = (np.frombuffer(r[c], np.int64) for c in ("_ids", "_low", "_depth"))
                maps = np.frombuffer(r["_maps"], np.uint64).reshape(-1, -(-len(ids) // 64))
                qids = np.frombuffer(r["_qids"], np.int64)
                qs = np.frombuffer(r["_q"], np.int64).reshape(len(qids), r["_dims"])[:, : len(low)]
                every = np.packbits(np.arange(maps.shape[1] * 64) < len(ids), bitorder="little").view(np.uint64)
                out: tuple[list, list, list] = ([], [], [])
                for qid, q in zip(qids, qs, strict=True):
                    allowed = every
                    for i in np.flatnonzero(ids == qid):
                        allowed = allowed.copy()
                        allowed[i // 64] &= ~(ONE << np.uint64(i % 64))
                    sums, more = summed(maps, depth, q)
                    found = top_rows(sums, allowed, k)
                    more += sum(int(a) * int(b) for a, b in zip(q, low, strict=False))
                    best = sorted(((-v, int(ids[i])) for v, i in zip(_values(sums, found), found, strict=True)))[:k]
                    out[0].extend([int(qid)] * len(best))
                    out[1].extend(i for _, i in best)
                    out[2].extend(more - v for v, _ in best)
                yield pa.RecordBatch.from_pydict({"_query": pa.array(out[0], pa.int64()), "_row": pa.array(out[1], pa.int64()), "_score": pa.array(out[2], pa.int64())})

    spark_rank = F.row_number().over(Window.partitionBy("_query").orderBy(F.desc("_score"), "_row"))
    return met.mapInArrow(answer, HITS).withColumn("_rank", spark_rank).where(F.col("_rank") <= k).select(F.col("_query").alias("query_id"), F.col("_rank").alias("rank"), F.col("_row").alias("row_id"), F.col("_score").alias("score"))


def op3_bitslice_topk(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(rows, rows.where(F.col("vec_id") % 50 == 0)).withColumnRenamed("row_id", "vec_id")


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""

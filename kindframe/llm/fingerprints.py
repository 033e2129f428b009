"""Document fingerprints by locally consistent parsing.

A text is a row of symbols, at first its code points. In each round, runs of one symbol become one symbol; deterministic
coin tossing then labels each symbol by where it first differs from its left neighbour, three times over, until a few
labels are left; blocks begin at labels that are larger than both neighbours, and a block's name, a hash of its symbols,
is a symbol of the next round. A block's limits depend on a few symbols around it alone, so equal substrings get
equal names inside, at whatever offset they stand. The fingerprint is the bottom-K sketch of a text's phrase names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindframe.llm.store import slim, tasks

K, LEVELS, FROM_LEVEL, FEW = 48, 6, 3, 4
#: Texts are parsed together up to so many code points.
BATCH = 1_000_000
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= MIX[0]
    x ^= x >> np.uint64(27)
    x *= MIX[1]
    return x ^ (x >> np.uint64(31))


#: Number of the lowest bit of 16 bits that is set (16 for none).
LOW = np.array([16] + [(i & -i).bit_length() - 1 for i in range(1, 1 << 16)], np.uint8)


def _coins(x: np.ndarray, first: np.ndarray, wide: bool) -> np.ndarray:
    """2 * place + bit of the lowest bit in which a symbol differs from its left neighbour; at a text's start, from 0."""
    left = np.empty_like(x)
    left[1:] = x[:-1]
    left[first] = 0
    place = LOW[(x ^ left).astype(np.uint16)]
    if wide:
        for shift in (16, 32, 48):
            more = np.flatnonzero(place == shift)
            if not len(more):
                break
            place[more] += LOW[(((x[more] ^ left[more]) >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)]
    place = np.minimum(place, 63)
    return (2 * place + ((x >> place.astype(x.dtype)) & x.dtype.type(1)).astype(np.uint8)).astype(np.uint8)


def next_level(symbols: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Block names of adjacent symbols, and the texts (ascending numbers) that they belong to."""
    n = len(symbols)
    new = np.empty(n, bool)
    new[:1] = True
    new[1:] = (symbols[1:] != symbols[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(at, append=n)
    x, t = symbols[at], text[at]
    long = np.flatnonzero(runs > 1)
    x[long] = mixed(x[long] + runs[long].astype(np.uint64) * MIX[2])
    n = len(x)
    first = np.empty(n, bool)
    first[:1] = True
    first[1:] = t[1:] != t[:-1]
    label = _coins(_coins(_coins(x, first, True), first, False), first, False)
    after = np.append(label[1:], np.uint8(0))
    after[:-1][first[1:]] = 0
    starts = np.empty(n, bool)
    starts[:1] = True
    starts[1:] = (label[1:] > label[:-1]) & (label[1:] > after[1:])
    starts |= first
    s = np.flatnonzero(starts)
    place = np.arange(n) - np.repeat(s, np.diff(s, append=n))
    return mixed(np.add.reduceat(mixed(x + place.astype(np.uint64) * MIX[2]), s)), t[s]


def sketches(texts: list[str], k: int = K) -> list[np.ndarray]:
    """Ascending 32-bit values, at most k, of each text's phrase names from FROM_LEVEL up; of short texts from lower levels."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    text = np.repeat(np.arange(len(texts), dtype=np.int32), [len(x) for x in texts])
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
    if not len(points):
        return out
    symbols = mixed(points.astype(np.uint64) + MIX[2])
    levels = [(symbols, text)]
    for _ in range(LEVELS):
        symbols, text = next_level(symbols, text)
        levels.append((symbols, text))
    # The lowest level that counts: FROM_LEVEL, or the highest below it that still has FEW phrases, or the code points.
    base = np.full(len(texts), FROM_LEVEL)
    for level in range(FROM_LEVEL, 0, -1):
        counts = np.bincount(levels[level][1], minlength=len(texts))
        base[(base == level) & (counts < FEW)] = level - 1
    names, owners = [], []
    for level, (s, t) in enumerate(levels):
        if level < FROM_LEVEL and not (base <= level).any():
            continue
        keep = base[t] <= level
        # A phrase that no longer changes from level to level counts once, by its level's hash.
        names.append((mixed(s[keep] + np.uint64(level)) >> np.uint64(32)).astype(np.uint32))
        owners.append(t[keep])
    key = np.unique(np.concatenate(owners).astype(np.uint64) << np.uint64(32) | np.concatenate(names))
    owner, value = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    ends = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [value[a : min(a + k, b)] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def fingerprint(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The Jaccard coefficient of the phrase sets, from two sketches; exact where both hold their whole set."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a, b)[:k]
    return float((np.isin(both, a, assume_unique=True) & np.isin(both, b, assume_unique=True)).mean())


OUT = "_row binary, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


@slim
def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order; the last of a partition, marked, stands for the first of the next and yields nothing."""
    names = [x.split()[0] for x in OUT.split(", ")]

    def results(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
        texts = [t for _, t in rows]
        edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, texts[1:], strict=False)]
        found = sketches(texts + edited)
        own, other = found[: len(texts)], found[len(texts) :]
        cols = (
            [r for r, _ in rows[:-1]],
            [len(t) for t in texts[:-1]],
            [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
            [fingerprint(x) for x in own[:-1]],
            [fingerprint(x) for x in other],
            [likeness(a, b) for a, b in zip(own, other, strict=False)],
            [likeness(a, b) for a, b in zip(own, own[1:], strict=False)],
        )
        kinds = (pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    rows, size, over = [], 0, False
    for b in batches:
        for row, text, mark in zip(*(c for c in b.columns), strict=True):
            if over:
                continue  # copies of a mark
            rows.append((row.as_py(), text.as_py() or ""))
            size += len(rows[-1][1])
            over = mark.as_py()
            if size >= BATCH and len(rows) > 1:
                yield results(rows)
                rows = rows[-1:]
                size = len(rows[0][1])
    if len(rows) > 1:
        yield results(rows)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_chars, fingerprint, and the likeness to an edited text and to the next document.

    The next document is that of the next smaller id, after the last the first; null ids come last, and rows of one id
    are in order of a hash of their texts. The edited text has the last floor(n_chars / 2) code points replaced by as many
    of the next document's first ones, or all it has. Null texts are empty; the empty text's fingerprint is the
    empty string, like only itself (likeness 1). Other columns are ignored; an empty table gives an empty table; a single
    row is its own next document. Ids may be of any type that has an order.

    One shuffle deals the texts into ranges of ids; the first row of each range is copied to the end of the range before.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn("_tie", F.xxhash64("_text"))
    # The first key of each range, from a sort of the keys alone: one a partition, to the driver.
    key = F.struct("_id", "_tie")
    sorted_ = rows.select("_id", "_tie").repartitionByRange(tasks(spark), F.desc_nulls_last("_id"), F.desc("_tie"))
    found = sorted_.select(F.spark_partition_id().alias("_p"), key.alias("_k")).groupBy("_p").agg(F.max("_k").alias("_k")).select("_k").distinct().orderBy(F.desc("_k")).collect()
    firsts = [F.struct(F.lit(r["_k"]["_id"]).cast(kind).alias("_id"), F.lit(r["_k"]["_tie"]).cast("long").alias("_tie")) for r in found]
    # A row is in the range after as many first keys as it is not above; a first row is also the mark at the end of the range before.
    at = F.size(F.filter(F.array(*firsts[1:]), lambda x: key <= x)) if len(firsts) > 1 else F.lit(0)
    ranged = rows.withColumn("_range", at)
    is_first = F.get(F.array(*firsts), F.col("_range")) == key if firsts else F.lit(False)
    place = lambda x, mark: F.struct(x.cast("int").alias("at"), F.lit(mark).alias("mark"))
    n = max(1, len(firsts))
    own, before = place(F.col("_range"), False), place(F.pmod(F.col("_range") - 1, F.lit(n)), True)
    dealt = ranged.withColumn("_p", F.explode(F.when(is_first, F.array(own, before)).otherwise(F.array(own)))).select("_id", "_text", "_tie", F.col("_p.at").alias("_at"), F.col("_p.mark").alias("_mark"))
    dealt = dealt.repartitionById(n, F.col("_at")).sortWithinPartitions("_mark", F.desc_nulls_last("_id"), F.desc("_tie"))
    done = dealt.select(F.encode(F.col("_id").cast("string"), "utf-8").alias("_row"), "_text", "_mark").mapInArrow(_compared, OUT)
    return done.select(F.decode("_row", "utf-8").cast(kind).alias(id_col), *[x.split()[0] for x in OUT.split(", ")[1:]])


def op6_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

"""N-gram Jaccard join by a token-group matrix: exact near-duplicate components at a similarity of 3/4 or more.

1. Each text becomes the set of its five-word shingles' 64-bit hashes; texts of one set are one class from here on.
2. A class can have a partner only if three quarters of its tokens occur in other classes. Tokens meet in buckets, as
   sorted arrays; what comes back is how many of a class's tokens are shared. Most classes end here.
3. Groups of similar classes: those with one least token, under three orders of the tokens. A group's members are held
   against its first; those links and their components make the groups of the matrix.
   A class that links with no first joins the group of a first that it was held against.
4. Token-group matrix: tokens meet once more, each component's once whatever its size. The tokens that several components
   hold come back, and a class stays only if three quarters of its tokens are among them.
5. A class asks a group if they share one of the class's rarest tokens, as many as an overlap of three quarters cannot
   all miss, if their sizes allow a link, and if the group has larger components than its own. Asking classes meet
   blocks of the group's members; a block is opened for a class only if its overlap with the block's union reaches three
   quarters, and then it is held against each member of a larger component.
Links inside a component are implied; all others are found by 4 and 5, so components are exact (but for
collisions of single shingles' 64-bit hashes; 48 bits of them in the buckets can only let more classes through). Sets
that share a key by chance are found and keyed anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindframe.llm.components import components
from kindframe.llm.store import dealt_anew, dropped, each, records, row_key, slim, stored, tasks

WORDS = 5
#: Tokens sorted together on the map side, tokens of a bucket, and tokens of a stored chunk.
CHUNK, BUCKET, STORED = 800_000, 1_000_000, 150_000
#: Buckets are dealt to at most so many tasks, which take theirs one after another.
MOST_TASKS = 20_000
#: Classes and tokens of a block of a group, and of a batch that asks it: whichever is reached first.
BLOCK, ASKS, BLOCK_TOKENS = 128, 64, 200_000
MARK = 0xFFFF
#: Bits of the map of the rows whose texts are asked for, for each of them and at most: 8 MB.
BITS_EACH, MOST_BITS = 16, 1 << 26
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
SEEDS = tuple(np.uint64(s) for s in (0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= B
    return x ^ (x >> np.uint64(32))


class Words(dict):
    """Word -> 64-bit hash. Emptied when large, as it only saves time."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 120_000:
            self.clear()
        self[word] = v = xxhash.xxh3_64_intdigest(word)
        return v


def shingles(text: str | None, words: Words) -> np.ndarray:
    """The ascending distinct hashes of a text's shingles. bytes.lower and bytes.split know ASCII letters and white space only."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    n = min(len(w), WORDS)
    h = np.full(len(w) - n + 1, np.uint64(n))
    for k in range(n):
        h = h * A + w[k : len(w) - n + 1 + k]
    h = np.sort(mixed(h))
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def set_key(tokens: np.ndarray, met: frozenset[int] = frozenset()) -> int:
    """63 bits for a set. met has the keys that unlike sets were found to share: these have another one."""
    raw = tokens.tobytes()
    key = xxhash.xxh3_64_intdigest(raw) >> 1
    return other_key(raw) if key in met else key


def other_key(raw: bytes) -> int:
    return xxhash.xxh3_64_intdigest(raw, seed=7) >> 1


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether 100 * intersection >= 75 * union."""
    if 4 * min(len(a), len(b)) < 3 * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 75 * (len(a) + len(b) - both)


def least_overlap(n: int) -> int:
    return -(-3 * n // 4)


# --- 1 and 2: classes, and those whose tokens others share


@slim
def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_id, _row, _text -> _id, _row, _n, _set, _other."""
    words = Words()
    for b in batches:
        n, keys, others = [], [], []
        for t in each(b.column(2)):
            s = shingles(t, words)
            n.append(len(s))
            keys.append(set_key(s))
            others.append(other_key(s.tobytes()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, pa.int64()) for c in (n, keys, others)]], ["_id", "_row", "_n", "_set", "_other"])


BLOBS = "_bucket int, _chunk long, _keys binary, _sets binary, _sizes binary"


@slim
def _dealt(batches: Iterator[pa.RecordBatch], buckets: int, met: frozenset[int]) -> Iterator[pa.RecordBatch]:
    """Sorted keys (48 bits of a token, 16 of its owner in the chunk) by bucket; and each chunk's sets once, to some bucket."""
    words, serial, base = Words(), 0, TaskContext.get().partitionId() << 24
    limits = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)
    tokens, owners, sets, sizes, seen, held = [], [], [], [], set(), 0

    def blob(bucket, chunk, keys=None, own=None, n=None):
        cols = {"_bucket": pa.array([bucket], pa.int32()), "_chunk": pa.array([chunk], pa.int64())}
        return pa.RecordBatch.from_pydict(cols | {k: pa.array([None if v is None else v.tobytes()], pa.binary()) for k, v in (("_keys", keys), ("_sets", own), ("_sizes", n))})

    def close():
        nonlocal serial, held
        key = np.sort((np.concatenate(tokens) & ~np.uint64(MARK)) | np.repeat(np.arange(len(sets), dtype=np.uint64), sizes))
        token, chunk = key >> np.uint64(16), base + serial
        start = np.concatenate(([True], token[1:] != token[:-1]))
        at = np.flatnonzero(start)
        many = np.diff(at, append=len(key)) > 1
        # What two sets of a chunk share is settled for them here, and goes on once, as a mark without an owner.
        inside = np.repeat(many, np.diff(at, append=len(key)))
        local = np.bincount((key[inside] & np.uint64(MARK)).astype(np.int64), minlength=len(sets))
        sent = key[at] | np.where(many, np.uint64(MARK), np.uint64(0))
        cuts = np.searchsorted(sent, limits)
        for i, part in enumerate(np.split(sent, cuts)):
            if len(part):
                yield blob(i, chunk, keys=part)
        yield blob(chunk % buckets, chunk, own=np.array([sets, local], np.int64), n=np.array(sizes, np.int64))
        serial, held = serial + 1, 0
        for x in (tokens, owners, sets, sizes, seen):
            x.clear()

    for b in batches:
        for t in each(b.column(0)):
            s = shingles(t, words)
            if not len(s) or (k := set_key(s, met)) in seen:
                continue
            seen.add(k)
            tokens.append(s)
            sets.append(k)
            sizes.append(len(s))
            held += len(s)
            if held >= CHUNK or len(sets) == MARK - 1:
                yield from close()
    if sets:
        yield from close()


SHARED = "_chunk long, _owners binary, _counts binary, _sets binary, _sizes binary"


@slim
def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's keys -> for each chunk, its owners' numbers of tokens that other sets have too."""
    names = [x.split()[0] for x in SHARED.split(", ")]
    for rows in _buckets(batches):
        blobs = []
        for r in rows:
            if r["_keys"] is None:
                yield pa.RecordBatch.from_arrays([pa.array([r["_chunk"]], pa.int64()), pa.array([None], pa.binary()), pa.array([None], pa.binary()), pa.array([r["_sets"]], pa.binary()), pa.array([r["_sizes"]], pa.binary())], names)
            else:
                blobs.append((r["_chunk"], np.frombuffer(r["_keys"], np.uint64)))
        del rows
        if not blobs:
            continue
        token = np.sort(np.concatenate([k >> np.uint64(16) for _, k in blobs]))
        marked = [k[(k & np.uint64(MARK)) == MARK] >> np.uint64(16) for _, k in blobs]
        shared = np.unique(np.concatenate([token[1:][token[1:] == token[:-1]], *marked]))
        del token
        for chunk, k in blobs if len(shared) else ():
            own, t = (k & np.uint64(MARK)).astype(np.int64), k >> np.uint64(16)
            at = np.minimum(np.searchsorted(shared, t), len(shared) - 1)
            owners, counts = np.unique(own[(shared[at] == t) & (own != MARK)], return_counts=True)
            if len(owners):
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([owners.astype(np.uint16).tobytes()], pa.binary()), pa.array([counts.astype(np.int32).tobytes()], pa.binary()), pa.array([None], pa.binary()), pa.array([None], pa.binary())], names)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each bucket; rows come in order of bucket."""
    now, rows = None, []
    for b in batches:
        for r in records(b):
            if r["_bucket"] != now and rows:
                yield rows
                rows = []
            now = r["_bucket"]
            rows.append(r)
    if rows:
        yield rows


def _dealt_out(blobs: DataFrame, buckets: int) -> DataFrame:
    """Blobs so that a task has all of its buckets, one after another."""
    parts = min(buckets, MOST_TASKS)
    return blobs.repartitionById(parts, F.floor(F.col("_bucket").cast("long") * parts / buckets).cast("int")).sortWithinPartitions("_bucket")


@slim
def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets of whose tokens three quarters are shared, and how many in 1000 are not; rows come in order of chunk."""
    state: list = [None, [], None, None]

    def close():
        _, parts, sets, sizes = state
        (key, total), size = np.frombuffer(sets, np.int64).reshape(2, -1).copy(), np.frombuffer(sizes, np.int64)
        for o, c in parts:
            total[np.frombuffer(o, np.uint16)] += np.frombuffer(c, np.int32)
        able = 4 * total >= 3 * size
        return pa.RecordBatch.from_arrays([pa.array(key[able]), pa.array((1000 * (size - total) // size)[able])], ["_set", "_apart"])

    for b in batches:
        for r in records(b):
            if r["_chunk"] != state[0]:
                if state[0] is not None:
                    yield close()
                state = [r["_chunk"], [], None, None]
            if r["_sets"] is None:
                state[1].append((r["_owners"], r["_counts"]))
            else:
                state[2:] = [r["_sets"], r["_sizes"]]
    if state[0] is not None:
        yield close()


# --- 3: groups


def _asked_for(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Those rows (_row, _text) whose _row is in keys (_row), and some others, so that few texts are shuffled to meet keys.

    A map of bits goes to all tasks, at most MOST_BITS of them; the more keys there are beyond that, the more others come back.
    """
    n = keys.count()
    bits = 64
    while bits < min(n * BITS_EACH, MOST_BITS):
        bits *= 2
    at = F.pmod(F.xxhash64("_row"), F.lit(bits))
    words = keys.select(at.alias("_at")).groupBy(F.shiftright("_at", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_at & 63 AS INT))")).alias("_bits")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[words.column(0).to_numpy()] = words.column(1).to_numpy().view(np.uint64)
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column(2).to_numpy().astype(np.uint64)
            hit = (shared.value[h >> np.uint64(6)] >> (h & np.uint64(63))) & np.uint64(1)
            yield b.select([0, 1]).filter(pa.array(hit.astype(bool)))

    return rows.select("_row", "_text", at.alias("_at")).mapInArrow(kept, "_row long, _text string")


CHUNKS = "_chunk long, _sets binary, _sizes binary, _aparts binary, _tokens binary"


@slim
def _chunked(batches: Iterator[pa.RecordBatch], met: frozenset[int]) -> Iterator[pa.RecordBatch]:
    """_set, _apart, _text -> chunks of classes with their tokens. A text that came by a row's key but has another set is left out."""
    words, serial, base = Words(), 0, TaskContext.get().partitionId() << 24
    sets, aparts, tokens, held = [], [], [], 0

    def close():
        return pa.RecordBatch.from_pydict({"_chunk": [base + serial], "_sets": [np.array(sets, np.int64).tobytes()], "_sizes": [np.array([len(t) for t in tokens], np.int64).tobytes()], "_aparts": [np.array(aparts, np.int64).tobytes()], "_tokens": [np.concatenate(tokens).tobytes()]})

    for b in batches:
        for k, apart, t in zip(*(each(c) for c in b.columns), strict=True):
            s = shingles(t, words)
            if set_key(s, met) != k:
                continue
            sets.append(k)
            aparts.append(apart)
            tokens.append(s)
            held += len(s)
            if held >= STORED:
                yield close()
                sets, aparts, tokens, held, serial = [], [], [], 0, serial + 1
    if sets:
        yield close()


def _classes(r: dict) -> Iterator[tuple[int, int, np.ndarray]]:
    sizes, tokens, at = np.frombuffer(r["_sizes"], np.int64), np.frombuffer(r["_tokens"], np.uint64), 0
    for i, (k, n) in enumerate(zip(np.frombuffer(r["_sets"], np.int64).tolist(), sizes.tolist(), strict=True)):
        yield i, k, tokens[at : at + n]
        at += n


@slim
def _minima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_key, _set, _apart) for each class and order of the tokens; the tokens themselves are not copied here."""
    for b in batches:
        for r in records(b):
            key, own, apart = [], [], np.frombuffer(r["_aparts"], np.int64)
            for _, k, s in _classes(r):
                for seed in SEEDS:
                    key.append(int(mixed(s ^ seed).min() ^ seed) & 0x7FFFFFFFFFFFFFFF)
                    own.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(own, pa.int64()), pa.array(np.repeat(apart, len(SEEDS)))], ["_key", "_set", "_apart"])


@slim
def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in records(b):
            found = list(_classes(r))
            yield pa.RecordBatch.from_arrays([pa.array([k for _, k, _ in found], pa.int64()), pa.array([s.tobytes() for *_, s in found], pa.binary())], ["_set", "_tokens"])


@slim
def _held_against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_set, _tokens, _first, _others) -> edges."""
    for b in batches:
        a, z = [], []
        for k, s, first, others in zip(*(each(c) for c in b.columns), strict=True):
            if linked(np.frombuffer(s, np.uint64), np.frombuffer(others, np.uint64)):
                a.append(k)
                z.append(first)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], ["a", "b"])


def _grouped(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b) between classes and the first of the groups they are in, and all such pairs. The first is the one of fewest
    tokens of its own, as an original is nearer to its altered copies than these are to each other."""
    minima = stored(chunks.mapInArrow(_minima, "_key long, _set long, _apart long"), "minima")
    first = F.min_by("_set", F.struct("_apart", "_set"))
    # A large group meets its first: both sides are dealt anew, so that its rows can be split.
    firsts = minima.groupBy("_key").agg(first.alias("_first"), F.count("*").alias("_n")).where("_n > 1").select(dealt_anew("_key").alias("_at"), "_first")
    pairs = stored(minima.select(dealt_anew("_key").alias("_at"), "_set").join(firsts, "_at").where("_set <> _first").select("_set", "_first").distinct(), "pairs")
    sets = stored(chunks.mapInArrow(_each, "_set long, _tokens binary"), "sets")
    leaders = sets.join(pairs.select(F.col("_first").alias("_set")).distinct(), "_set").select(dealt_anew("_set").alias("_at"), F.col("_tokens").alias("_others"))
    met = pairs.join(sets, "_set").withColumn("_at", dealt_anew("_first")).join(leaders, "_at").select("_set", "_tokens", "_first", "_others")
    links = stored(met.mapInArrow(_held_against, "a long, b long"), "links")
    dropped(minima, sets)
    return links, pairs


# --- 4: the token-group matrix


MATRIX = "_bucket int, _chunk long, _tokens binary, _groups binary"


@slim
def _rows_of_matrix(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Each chunk's distinct (token, component), by bucket. _labels has component, its size and group of each class."""
    limits = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)
    for b in batches:
        for r in records(b):
            tokens, sizes = np.frombuffer(r["_tokens"], np.uint64), np.frombuffer(r["_sizes"], np.int64)
            groups = np.repeat(np.array([x["_c"] for x in r["_labels"]], np.int64), sizes)
            order = np.lexsort((groups, tokens))
            t, g = tokens[order], groups[order]
            new = np.concatenate(([True], (t[1:] != t[:-1]) | (g[1:] != g[:-1])))
            t, g = t[new], g[new]
            cuts = np.searchsorted(t, limits)
            for i, (tt, gg) in enumerate(zip(np.split(t, cuts), np.split(g, cuts), strict=True)):
                if len(tt):
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([r["_chunk"]], pa.int64()), pa.array([tt.tobytes()], pa.binary()), pa.array([gg.tobytes()], pa.binary())], ["_bucket", "_chunk", "_tokens", "_groups"])


@slim
def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk, those of its tokens that several components hold, and how many."""
    for rows in _buckets(batches):
        tokens = np.concatenate([np.frombuffer(r["_tokens"], np.uint64) for r in rows])
        groups = np.concatenate([np.frombuffer(r["_groups"], np.int64) for r in rows])
        order = np.lexsort((groups, tokens))
        t, g = tokens[order], groups[order]
        new = np.concatenate(([True], (t[1:] != t[:-1]) | (g[1:] != g[:-1])))
        token, count = np.unique(t[new], return_counts=True)
        token, count = token[count > 1], count[count > 1]
        for r in rows:
            own = np.unique(np.frombuffer(r["_tokens"], np.uint64))
            at = np.minimum(np.searchsorted(token, own), max(len(token) - 1, 0))
            hit = token[at] == own if len(token) else np.zeros(len(own), bool)
            if hit.any():
                yield pa.RecordBatch.from_arrays([pa.array([r["_chunk"]], pa.int64()), pa.array([own[hit].tobytes()], pa.binary()), pa.array([count[at[hit]].astype(np.int32).tobytes()], pa.binary())], ["_chunk", "_common", "_in"])


QUERIES = "_set long, _c long, _size long, _group long, _n long, _most long, _tokens binary, _rare array<long>"


@slim
def _queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes that can have a partner in another component, with the tokens of which a partner has at least one, and the most
    tokens that a partner can have: with s tokens in common at best, 7 s >= 3 (n + most)."""
    for b in batches:
        for r in records(b):
            parts = [(np.frombuffer(x["_common"], np.uint64), np.frombuffer(x["_in"], np.int32)) for x in r["_parts"]]
            common, number = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(common)
            common, number = common[order], number[order]
            out: tuple[list, ...] = ([], [], [], [], [], [], [], [])
            for i, k, s in _classes(r):
                at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                hit = common[at] == s
                spare = int(hit.sum()) - least_overlap(len(s))
                if spare < 0:
                    continue
                own, many = s[hit], number[at[hit]]
                rare = own[np.lexsort((own, many))[: spare + 1]]
                own_label = r["_labels"][i]
                for col, v in zip(out, (k, own_label["_c"], own_label["_size"], own_label["_group"], len(s), 7 * len(own) // 3 - len(s), s.tobytes(), rare.view(np.int64)), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (*[pa.int64()] * 6, pa.binary(), pa.list_(pa.int64())), strict=True)], [x.split()[0] for x in QUERIES.split(", ")])


# --- 5: meetings


@slim
def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_asks, _members) -> edges between components. Both are arrays of (_set, _c, _size, _tokens): asking classes, and a block of a group."""
    for b in batches:
        a, z = [], []
        for asks, members in zip(*(each(c) for c in b.columns), strict=True):
            tokens = [np.frombuffer(m["_tokens"], np.uint64) for m in members]
            every, size = np.concatenate(tokens), np.array([len(t) for t in tokens])
            starts = np.cumsum(size) - size
            union = np.unique(every)
            for x in asks:
                s = np.frombuffer(x["_tokens"], np.uint64)
                at = np.minimum(np.searchsorted(union, s), len(union) - 1)
                if int((union[at] == s).sum()) < least_overlap(len(s)):
                    continue
                at = np.minimum(np.searchsorted(s, every), len(s) - 1)
                both = np.add.reduceat((s[at] == every).astype(np.int64), starts)
                for i in np.flatnonzero(100 * both >= 75 * (size + len(s) - both)):
                    m = members[i]
                    if (m["_size"], m["_c"]) > (x["_size"], x["_c"]):
                        a.append(x["_c"])
                        z.append(m["_c"])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], ["a", "b"])


def _between(chunks: DataFrame, roots: DataFrame, pairs: DataFrame, buckets: int) -> DataFrame | None:
    """Edges between components, by their roots, or None where no class can have one."""
    root = roots.withColumnRenamed("node", "_set")
    kin = pairs.join(root.select(F.col("_set").alias("_first"), "root"), "_first", "left").groupBy("_set").agg(F.min(F.coalesce("root", "_first")).alias("_kin"))
    rows = chunks.mapInArrow(_members, "_chunk long, _i int, _set long").join(root, "_set", "left").join(kin, "_set", "left")
    each_label = stored(rows.select("_chunk", "_i", F.coalesce("root", "_set").alias("_c"), F.coalesce("root", "_kin", "_set").alias("_group")), "labels")
    # Only components of several classes, dealt anew, so that the rows of a very large one can be split.
    sizes = each_label.groupBy("_c").agg(F.count("*").alias("_size")).where("_size > 1").select(dealt_anew("_c").alias("_at"), "_size")
    labelled = each_label.withColumn("_at", dealt_anew("_c")).join(sizes, "_at", "left").withColumn("_size", F.coalesce("_size", F.lit(1)).cast("long"))
    labels = labelled.groupBy("_chunk").agg(F.array_sort(F.collect_list(F.struct("_i", "_c", "_size", "_group"))).alias("_labels"))
    full = stored(chunks.join(labels, "_chunk"), "chunks")
    matrix = _dealt_out(full.mapInArrow(lambda b: _rows_of_matrix(b, buckets), MATRIX), buckets)
    parts = matrix.mapInArrow(_across, "_chunk long, _common binary, _in binary").groupBy("_chunk").agg(F.collect_list(F.struct("_common", "_in")).alias("_parts"))
    queries = stored(full.join(parts, "_chunk").select("_sets", "_sizes", "_tokens", "_labels", "_parts").mapInArrow(_queries, QUERIES), "queries")
    if queries.isEmpty():
        dropped(each_label, full, queries)
        return None
    names = [x.split()[0] for x in QUERIES.split(", ")]
    rare = queries.select(F.explode("_rare").alias("_token"), *names[:6])
    # A token's groups, once each, with the sizes that members have and bear, and the largest component.
    top = F.max(F.struct("_size", "_c")).alias("_top")
    held = rare.groupBy("_token", F.col("_group").alias("_other")).agg(F.min("_n").alias("_small"), F.max("_n").alias("_large"), F.max("_most").alias("_bears"), top)
    fits = "_small <= _most AND _n <= _bears AND 4 * _large >= 3 * _n AND 4 * _n >= 3 * _small AND struct(_size, _c) < _top"
    meets = stored(rare.join(held, "_token").where(fits).select("_set", "_other").distinct(), "meetings")

    def batched(rows: DataFrame, most: int, name: str) -> DataFrame:
        """Rows of a group, about `most` of them or BLOCK_TOKENS tokens together."""
        counts = rows.groupBy("_other").agg(F.greatest(F.count("*") / most, F.sum("_n") / BLOCK_TOKENS).alias("_k")).select(dealt_anew("_other").alias("_at"), "_k")
        part = F.pmod(F.xxhash64("_set"), F.ceil("_k"))
        return rows.withColumn("_at", dealt_anew("_other")).join(counts, "_at").groupBy("_other", part.alias("_part")).agg(F.collect_list(F.struct("_set", "_c", "_size", "_tokens")).alias(name)).drop("_part")

    one = queries.select("_set", "_c", "_size", "_n", "_tokens", F.col("_group").alias("_other"))
    members = batched(one, BLOCK, "_members")
    asks = batched(meets.join(one.drop("_other"), "_set"), ASKS, "_asks")
    edges = stored(asks.join(members, "_other").select("_asks", "_members").mapInArrow(_opened, "a long, b long"), "opened")
    dropped(each_label, full, queries, meets)
    return edges


@slim
def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in records(b):
            k = np.frombuffer(r["_sets"], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), r["_chunk"])), pa.array(np.arange(len(k), dtype=np.int32)), pa.array(k)], ["_chunk", "_i", "_set"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_linked without the root."""
    return _linked(docs, id_col, text_col).drop("_root")


def _linked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_shingles, component_id, set_id, row_key, _root) for each row of docs.

    A set is the distinct five-word shingles of the words (A-Z lower-cased, parted by ASCII white space); of fewer words,
    their whole sequence. Two rows link if 100 * intersection >= 75 * union of their sets; component_id is the smallest
    id that links reach. A text that is null or has no words has an empty set and links with nothing: its component is
    its own id. _root is the same for rows of one component and no others, whatever their ids. Repeated rows stay; null ids take part and are no component's id unless it has no other. Other columns
    are ignored; an empty table gives an empty table.
    """
    rows = docs.select(F.col(id_col).alias("_id"), row_key(F.col(id_col), F.col(text_col)).alias("_row"), F.col(text_col).alias("_text"))
    kind = dict(rows.dtypes)["_id"]
    hashed = stored(rows.mapInArrow(_keyed, f"_id {kind}, _row long, _n long, _set long, _other long"), "classes")
    total = hashed.agg(F.sum("_n")).first()[0] or 0
    # Of n texts about n^2 / 2^64 pairs of unlike sets share a key, hardly one in 4 billion texts: so few that all tasks know them.
    shared_keys = hashed.groupBy("_set").agg(F.min("_other").alias("_a"), F.max("_other").alias("_z")).where("_a < _z").select("_set").collect()
    met = frozenset(r["_set"] for r in shared_keys)
    keyed = hashed.withColumn("_set", F.when(F.col("_set").isin(list(met)), F.col("_other")).otherwise(F.col("_set"))) if met else hashed
    buckets = max(tasks(docs.sparkSession), -(-total // BUCKET))
    blobs = rows.select("_text").mapInArrow(lambda b: _dealt(b, buckets, met), BLOBS)
    shared = _dealt_out(blobs, buckets).mapInArrow(_met, SHARED).repartition("_chunk").sortWithinPartitions("_chunk")
    able = shared.mapInArrow(_summed, "_set long, _apart long").groupBy("_set").agg(F.min("_apart").alias("_apart"))
    # One row of each of these classes brings its text.
    one = stored(keyed.groupBy("_set").agg(F.min("_row").alias("_row")).join(able, "_set"), "representatives")
    chunks = stored(_asked_for(rows.select("_row", "_text"), one).join(one, "_row").select("_set", "_apart", "_text").mapInArrow(lambda b: _chunked(b, met), CHUNKS), "tokens")
    near, pairs = _grouped(chunks)
    roots = components(near)
    more = _between(chunks, roots, pairs, buckets)
    dropped(one, chunks, near, pairs)
    whole = keyed.join(roots.withColumnRenamed("node", "_set"), "_set", "left").withColumn("_c", F.coalesce("root", "_set")).drop("root")
    joined = None
    if more is not None:
        # Linked components are nodes of a smaller graph.
        joined = components(more)
        whole = whole.join(joined.withColumnRenamed("node", "_c"), "_c", "left").withColumn("_c", F.coalesce("root", "_c"))
        dropped(more)
    whole = stored(whole.select("_id", "_row", "_n", "_set", "_c"), "members")
    dropped(hashed, roots, joined)
    least = whole.where("_n > 0").groupBy("_c").agg(F.min("_id").alias("_least"), F.count("*").alias("_size")).where("_size > 1").select(dealt_anew("_c").alias("_at"), "_least")
    out = whole.withColumn("_at", dealt_anew("_c")).join(least, "_at", "left")
    return out.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), F.when(F.col("_n") > 0, F.coalesce("_least", "_id")).otherwise(F.col("_id")).alias("component_id"), F.col("_set").alias("set_id"), F.col("_row").alias("row_key"), F.col("_c").alias("_root"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near-duplicates: of each component the row of the smallest id stays; texts without words all stay.

    Of rows that repeat that id with other texts, those of the smallest row key stay, and of equal rows one.
    """
    told = _linked(docs, id_col, text_col)
    best = F.struct(F.col(id_col).isNull(), F.col(id_col), "row_key")
    kept = told.where("n_shingles > 0").groupBy("_root").agg(F.min(best).alias("_b")).select(F.col("_b.row_key").alias("_stay"))
    empty = told.where("n_shingles = 0").select(F.col("row_key").alias("_stay")).distinct()
    # Keys of more than one row, of which a component keeps one.
    again = told.where("n_shingles > 0").groupBy("row_key").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("row_key").alias("_stay"), F.lit(True).alias("_many"))
    stay = stored(kept.unionAll(empty).join(again, "_stay", "left"), "stay")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    key = row_key(F.col("_doc").getField(id_col), F.col("_doc").getField(text_col))
    keyed = packed.withColumn("_row", key)
    single = keyed.join(stay.where("_many IS NULL"), F.col("_row") == F.col("_stay"), "left_semi").select("_doc.*")
    # Partial aggregation sends one row of a key a task. A second hash tells rows apart whose keys meet by chance.
    other = F.xxhash64(F.lit("other"), F.col("_doc").getField(id_col), F.col("_doc").getField(text_col))
    first = keyed.join(stay.where("_many"), F.col("_row") == F.col("_stay"), "left_semi").groupBy("_row", other.alias("_other")).agg(F.first("_doc").alias("_doc")).select("_doc.*")
    return single.unionAll(first)


def op7_jaccard_join(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_shingles", "component_id")


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM w
), n AS (
  SELECT w.doc_id, count(s) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)
), r AS (
  SELECT doc_id, doc_id AS root FROM n UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id
)
SELECT doc_id, n AS n_shingles, (SELECT min(root) FROM r WHERE r.doc_id = n.doc_id) AS component_id FROM n
"""

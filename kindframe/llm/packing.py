"""Cost-balanced packing of tokenized documents into sequences of a fixed length.

A piece's cost is ALPHA * tokens + BETA * tokens^2 (linear layers and attention). Each document gives as many full
sequences as it can; the pieces that remain go, in descending order of cost, to the sequence of lowest cost that has room.
Pieces that find no room are cut to fill the rooms that are left, and the last sequence of a window is cut into lengths
that are powers of two, which need no padding. Packing happens where documents are tokenized, over windows of a bounded
number of pieces: token ids never leave the task, and nothing is shuffled.
"""

from __future__ import annotations

import heapq
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH, END = 1024, 0
WINDOW = 8192
ALPHA, BETA = 1.0, 1.0 / 1024
END_OF_TEXT = "<|endoftext|>"
PIECES = "_row binary, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def encoder(path: str):
    """text -> ids (uint32) by the byte-level BPE of a tokenizers file, as that library encodes without special tokens added.

    tiktoken runs the same vocabulary several times faster; tests hold both against each other.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    # The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on.
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    bpe = tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    names = tuple(special)

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in names):
            return np.array(bpe.encode(text, allowed_special="all"), np.uint32)
        return bpe.encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)

    return encode


def cost(tokens: int) -> float:
    return ALPHA * tokens + BETA * tokens * tokens


def pack(lengths: list[int], room: int = LENGTH) -> list[list[tuple[int, int, int]]]:
    """Sequences of (piece, start in the piece, tokens) for pieces shorter than a sequence."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    count = -(-sum(lengths) // room)
    bins: list[list[tuple[int, int, int]]] = [[] for _ in range(count)]
    free = [room] * count
    # Sequences by free room, the lowest cost first in each; only the rooms that occur are looked at.
    by_room = {room: [(0.0, b) for b in range(count)]} if count else {}
    left: list[int] = []
    for i in order:
        fitting = [(heap[0], r) for r, heap in by_room.items() if r >= lengths[i]]
        if not fitting:
            left.append(i)
            continue
        (spent, b), r = min(fitting)
        heapq.heappop(by_room[r])
        if not by_room[r]:
            del by_room[r]
        bins[b].append((i, 0, lengths[i]))
        free[b] -= lengths[i]
        heapq.heappush(by_room.setdefault(free[b], []), (spent + cost(lengths[i]), b))
    # What found no room fills the rooms that are left, and so does what the emptiest sequence holds: only that one,
    # which comes last, can then be short.
    if count:
        last = max(range(count), key=lambda b: (free[b], b))
        left += [i for i, _, _ in bins[last]]
        bins[last], free[last] = [], room
        rooms = [*sorted((b for b in range(count) if free[b] and b != last), key=lambda b: (-free[b], b)), last]
    at = 0
    for i in left:
        start = 0
        while start < lengths[i]:
            b = rooms[at]
            n = min(free[b], lengths[i] - start)
            bins[b].append((i, start, n))
            free[b] -= n
            start += n
            at += not free[b]
    return bins


def unpadded(bins: list[list[tuple[int, int, int]]], room: int = LENGTH) -> list[list[tuple[int, int, int]]]:
    """Sequences that are neither full nor as long as a power of two, cut into lengths that are."""
    out = []
    for b in bins:
        used = sum(n for _, _, n in b)
        if used == room or used & (used - 1) == 0:
            out.append(b)
            continue
        pieces = list(b)
        for size in (1 << k for k in range(used.bit_length() - 1, -1, -1)):
            if used & size:
                part, need = [], size
                while need:
                    i, start, n = pieces.pop(0)
                    take = min(n, need)
                    part.append((i, start, take))
                    need -= take
                    if take < n:
                        pieces.insert(0, (i, start + take, n - take))
                out.append(part)
    return [b for b in out if b]


def _packed(batches: Iterator[pa.RecordBatch], tokenizer: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    encode = encoder(tokenizer)
    serial, base = 0, TaskContext.get().partitionId() << 40
    out: list[tuple] = []
    waiting: list[tuple] = []

    def emit(row, start, ids, total, seq, offset):
        raw = ids.astype("<u4").tobytes()
        out.append((row, start, len(ids), zlib.crc32(raw), total, base + seq, offset, raw if with_ids else None))

    def flush():
        nonlocal serial
        # A sequence of few pieces at the end of a window is left with the lowest cost, so the window ends unpadded.
        bins = unpadded(pack([len(w[2]) for w in waiting]))
        for b in bins:
            offset = 0
            for i, start, n in b:
                row, first, ids, total = waiting[i]
                emit(row, first + start, ids[start : start + n], total, serial, offset)
                offset += n
            serial += 1
        waiting.clear()

    def batch():
        cols = list(zip(*out, strict=True)) if out else [[]] * 8
        kinds = (pa.binary(), *[pa.int64()] * 6, pa.binary())
        names = [x.split()[0] for x in PIECES.split(", ")]
        made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)
        out.clear()
        return made

    for b in batches:
        for row, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            ids = np.append(encode(text.as_py() or ""), np.uint32(END))
            whole = len(ids) // LENGTH * LENGTH
            for start in range(0, whole, LENGTH):
                emit(row, start, ids[start : start + LENGTH], len(ids), serial, 0)
                serial += 1
            if whole < len(ids):
                waiting.append((row, whole, ids[whole:].copy(), len(ids)))
                if len(waiting) >= WINDOW:
                    flush()
            if len(out) >= 4096:
                yield batch()
    flush()
    yield batch()


def packed(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, its ids.

    A document is its text's ids and one id 0; a null text has only that. Each row of docs is a document of its own, so
    rows that repeat an id are packed as often as they occur; null ids pass through. Every id lies in one piece, pieces of
    a sequence follow each other without gaps from offset 0, and a sequence is LENGTH ids or a power of two. ids is
    binary, unsigned little-endian 32-bit integers. Other columns are ignored; an empty table gives an empty table.
    The sequences depend on how docs are partitioned: rows of different partitions never share one.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.encode(F.col(id_col).cast("string"), "utf-8").alias("_row"), F.col(text_col).cast("string").alias("_text"))
    out = rows.mapInArrow(lambda batches: _packed(batches, tokenizer, with_ids), PIECES)
    out = out.select(F.decode("_row", "utf-8").cast(kind).alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")
    return out if with_ids else out.drop("ids")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return packed(docs, default_tokenizer(), with_ids=False)

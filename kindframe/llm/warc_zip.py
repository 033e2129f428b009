"""WARC archives in ZIP packages: written per task, and read back by byte ranges without extraction.

A package holds stored (uncompressed) members only: archive/data.warc.gz, in which each record is a gzip member of its own,
and indexes/index.cdxj, one line for each record with its place in the archive. The reader takes the central directory
from the package's tail (ZIP64 where there is one), finds archive members and indexes, and then reads nothing but the
records' ranges. Executors write under names of their own and report them; a package that a lost task left behind is
in no report, so nobody reads it.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import itertools
import json
import struct
import urllib.parse
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindframe.llm.store import new_path, slim, stored, tasks

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: A package is closed at this many bytes of records; reads that touch are joined up to the second figure.
PACKAGE, READ = 32 << 20, 4 << 20
#: One task reads such a stretch of a package.
SPLIT = 32 << 20
LEAST = 100
PAGE = "urn:page:"
PACKAGES = "path string, records long"
RECORDS = "page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


# --- writing


def record(page_id: str, url: str | None, kind: str, refers_to: str | None, payload: bytes, digest: str) -> bytes:
    """One WARC record. A revisit keeps the HTTP header, which has the full payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<{PAGE}{urllib.parse.quote(page_id)}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": urllib.parse.quote(url or "", safe="!#$&'()*+,/:;=?@[]%~"),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": str(len(block)),
    }
    if kind == "revisit":
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<{PAGE}{urllib.parse.quote(refers_to or '')}>"}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def package(records: list[bytes], lines: list[dict]) -> bytes:
    out, at = io.BytesIO(), 0
    for r, x in zip(records, lines, strict=True):
        x |= {"filename": ARCHIVE, "offset": at, "length": len(r)}
        at += len(r)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        z.writestr(ARCHIVE, b"".join(records))
        z.writestr(INDEX, "".join(f"{x['key']} 19700101000000 {json.dumps(x)}\n" for x in lines))
    return out.getvalue()


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    fs, base = opened(folder)
    fs.create_dir(base, recursive=True)
    records, lines, size = [], [], 0

    def close():
        name = f"{uuid.uuid4().hex}.wacz"
        with fs.open_output_stream(f"{base}/{name}.part") as f:
            f.write(package(records, lines))
        fs.move(f"{base}/{name}.part", f"{base}/{name}")
        return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [len(records)]})

    for b in batches:
        for r in zip(*(c for c in b.columns), strict=True):
            page_id, url, payload, digest, refers_to = (x.as_py() for x in r)
            kind = "response" if refers_to is None else "revisit"
            records.append(gzip.compress(record(page_id, url, kind, refers_to, payload, digest), 6, mtime=0))
            lines.append({"key": urllib.parse.quote(url or "-"), "url": url})
            size += len(records[-1])
            if size >= PACKAGE:
                yield close()
                records, lines, size = [], [], 0
    if records:
        yield close()


def deduplicated(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, refers_to) with ids as strings. The smallest id of a payload has no refers_to."""
    kind = dict(pages.dtypes)[id_col]
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "utf-8").alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256))
    first = p.where(F.octet_length("payload") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").select(F.col("digest").alias("of"), "first")
    # Written, so that the join deals pages anew and can split those of a very common payload. Small pages meet nothing, each
    # by a key of its own, as they may all have one payload.
    first = stored(first, "first")
    own = F.when(F.octet_length("payload") >= LEAST, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64(F.monotonically_increasing_id()).cast("string")))
    met = p.withColumn("own", own).join(first, F.col("own") == F.col("of"), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    text = lambda c: F.coalesce(c.cast("string"), F.lit("")) if kind != "string" else c
    return met.select(text(F.col("page_id")).alias("page_id"), "url", "payload", "digest", refers.cast("string").alias("refers_to"))


def write_packages(pages: DataFrame, folder: str, **cols) -> DataFrame:
    """(path, records) of the packages that hold a record for each row of pages; null html is an empty payload.

    Of records with equal payloads of at least LEAST bytes, the smallest id's is a response and the others are revisits
    of it; rows that repeat that id are all responses. Rows with a null id can only be revisits of another row's id. Other
    columns are ignored; an empty table gives no package.
    """
    rows = deduplicated(pages, **cols).withColumn("page_id", F.coalesce("page_id", F.lit("")))
    return stored(rows.mapInArrow(lambda b: _write(b, folder), PACKAGES), "packages")


# --- reading


@dataclass
class Member:
    name: str
    method: int
    size: int
    header: int


def directory(f: pa.NativeFile) -> list[Member]:
    """The members in a package's central directory, by the ZIP64 records where the classic fields are full."""
    size = f.size()
    tail_at = max(0, size - 65557)
    f.seek(tail_at)
    tail = f.read(size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory: not a ZIP package, or a cut one")
    count, length, start = struct.unpack("<HII", tail[end + 10 : end + 20])
    if tail[end - 20 : end - 16] == b"PK\x06\x07" and end >= 20:
        (at,) = struct.unpack("<Q", tail[end - 12 : end - 4])
        f.seek(at)
        big = f.read(56)
        if big[:4] != b"PK\x06\x06":
            raise ValueError("the ZIP64 locator points to no ZIP64 record")
        count, length, start = struct.unpack("<32x3Q", big)
    f.seek(start)
    raw, at, members = f.read(length), 0, []
    for _ in range(count):
        if raw[at : at + 4] != b"PK\x01\x02":
            raise ValueError("damaged central directory")
        flags, method, packed, plain, n, m, k, header = struct.unpack("<8xHH8xIIHHH8xI", raw[at : at + 46])
        name = raw[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        extra, e = raw[at + 46 + n : at + 46 + n + m], 0
        while e + 4 <= len(extra):
            tag, width = struct.unpack("<HH", extra[e : e + 4])
            if tag == 1:  # only the fields that are full have their place here, in this order
                own = e + 4
                for full in ("plain", "packed", "header"):
                    if {"plain": plain, "packed": packed, "header": header}[full] == 0xFFFFFFFF:
                        (v,) = struct.unpack("<Q", extra[own : own + 8])
                        own += 8
                        plain, packed, header = (v if full == x else y for x, y in (("plain", plain), ("packed", packed), ("header", header)))
            e += 4 + width
        members.append(Member(name, method, packed, header))
        at += 46 + n + m + k
    return members


def _lines(f: pa.NativeFile, at: int, m: Member) -> Iterator[str]:
    """An index's lines, read by pieces; it may be deflated in its package, a gzip file, or both."""
    inflate = [zlib.decompressobj(-15)] if m.method else []
    gz, rest, pos = m.name.endswith(".gz"), b"", at
    if gz:
        inflate.append(zlib.decompressobj(31))
    while pos < at + m.size:
        f.seek(pos)
        data = f.read(min(1 << 20, at + m.size - pos))
        pos += len(data)
        if m.method:
            data = inflate[0].decompress(data)
        while gz and data:
            out, gz_now = inflate[-1].decompress(data), inflate[-1]
            rest += out
            data = gz_now.unused_data
            if gz_now.eof:  # another gzip member may follow
                inflate[-1] = zlib.decompressobj(31)
        *whole, rest = (rest + data).split(b"\n")
        yield from (x.decode() for x in whole)
    if rest:
        yield rest.decode()


def content_at(f: pa.NativeFile, m: Member) -> int:
    """Where a member's bytes begin. The local header's name and extra field may differ in length from the directory's."""
    if m.method and (m.name.startswith("archive/") or m.method != 8):
        raise ValueError(f"{m.name} is compressed in its package: its records have no ranges")
    f.seek(m.header)
    head = f.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"{m.name}: damaged local header")
    n, k = struct.unpack("<HH", head[26:30])
    return m.header + 30 + n + k


def _walked(f: pa.NativeFile, at: int, m: Member) -> Iterator[tuple[int, int]]:
    """Ranges of a compressed archive's records where no index has them: gzip members, one after another."""
    end, pos = at + m.size, at
    while pos < end:
        d, read = zlib.decompressobj(31), pos
        while not d.eof and read < end:
            f.seek(read)
            chunk = f.read(min(1 << 16, end - read))
            d.decompress(chunk)
            read += len(chunk)
        yield pos, read - len(d.unused_data) - pos
        pos = read - len(d.unused_data)


def ranges(f: pa.NativeFile) -> Iterator[tuple[int, int, str | None]]:
    """(offset in the package, length, URL if the index has it) of each record: those of indexes in their order, then those of
    archives that no index names."""
    members = {m.name: m for m in directory(f)}
    starts = {n: content_at(f, m) for n, m in members.items() if n.startswith(("archive/", "indexes/"))}
    indexed = set()
    for n in starts:
        if n.startswith("indexes/") and n.endswith((".cdx", ".cdxj", ".cdx.gz", ".cdxj.gz")):
            for line in _lines(f, starts[n], members[n]):
                if "{" not in line:  # a header
                    continue
                x = json.loads(line[line.index("{") :])
                name = x["filename"] if "/" in x["filename"] else f"archive/{x['filename']}"
                indexed.add(name)
                yield starts[name] + int(x["offset"]), int(x["length"]), x.get("url")
    for n in starts:
        if n.startswith("archive/") and n not in indexed:
            yield from ((*r, None) for r in _walked(f, starts[n], members[n]))


def parsed(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """A record's fields, its HTTP header and its payload."""
    data = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def _page(uri: str | None) -> str | None:
    return urllib.parse.unquote(uri.strip("<>").removeprefix(PAGE)) if uri else None


@slim
def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packages -> their records' places, some at a time."""
    for b in batches:
        for path in b.column(0).to_pylist():
            fs, name = opened(path)
            with fs.open_input_file(name) as f:
                places = ranges(f)
                while some := list(itertools.islice(places, 10_000)):
                    at, n, url = zip(*some, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(at)), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(url, pa.string())], ["path", "at", "n", "url"])


@slim
def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places in order of path and offset -> records. Places that touch are read together."""
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    rows, size, now, f = [], 0, None, None

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    try:
        for b in batches:
            todo = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
            i = 0
            while i < len(todo):
                path, first = todo[i][:2]
                j, end = i + 1, first + todo[i][2]
                while j < len(todo) and todo[j][0] == path and todo[j][1] == end and end - first < READ:
                    end += todo[j][2]
                    j += 1
                if path != now:
                    if f:
                        f.close()
                    fs, name = opened(path)
                    now, f = path, fs.open_input_file(name)
                f.seek(first)
                chunk = f.read(end - first)
                for _, at, n, url in todo[i:j]:
                    fields, http, payload = parsed(chunk[at - first : at - first + n])
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    kind = fields["WARC-Type"]
                    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{path}: the payload at {at} does not have its record's digest")
                    length = int(http.lower().partition(b"content-length:")[2].split(b"\r\n")[0])
                    rows.append((_page(fields["WARC-Record-ID"]), url, kind, _page(fields.get("WARC-Refers-To")), length, digest, payload if kind == "response" else None))
                    size += len(payload)
                    if size > READ:
                        yield batch()
                        rows, size = [], 0
                i = j
        if rows:
            yield batch()
    finally:
        if f:
            f.close()


def read_packages(packages: DataFrame) -> DataFrame:
    """The records of packages (path, ...): page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload.

    Records' places are listed from each package's directory and index, and dealt by stretches of SPLIT bytes, so that a
    large package is read by many tasks. A revisit's payload is null; its size and digest are the full payload's. Null URLs
    stay null, and no package gives no row.
    """
    n = max(1, packages.count())
    places = packages.select("path").repartition(n).mapInArrow(_listed, "path string, at long, n long, url string")
    dealt = places.repartition(max(n, tasks(packages.sparkSession)), "path", F.floor(F.col("at") / SPLIT)).sortWithinPartitions("path", "at")
    return dealt.mapInArrow(_read, RECORDS)


def op5_warc_zip(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    kind = dict(pages.dtypes)["page_id"]
    back = read_packages(write_packages(pages, new_path(spark, "wacz")))
    as_id = lambda c: F.nullif(F.col(c), F.lit("")).cast(kind)
    return back.select(as_id("page_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", as_id("refers_to").alias("refers_to"), "url")


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, url FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p WHERE strlen(html) >= 100 GROUP BY html)
SELECT page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, sha256(p.html) AS payload_digest,
  CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to, url
FROM p LEFT JOIN f USING (html)
"""

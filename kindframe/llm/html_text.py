"""HTML extraction with a host suffix array.

A page becomes blocks of text with the elements that enclose them. The blocks' words are the page's token stream; the
streams of a host, one after another with a separator that occurs once, are its text. Its suffix array is built sparsely
and only to a depth of DEPTH tokens: suffixes are taken at the positions whose token hash is least among its
neighbours', which chooses the same positions in equal substrings, and suffixes that agree on DEPTH tokens get one rank,
the hash of those tokens (ranks double in depth from round to round, as in prefix doubling). A longer repeat is a row of
such suffixes, so deeper ranks would cover no other tokens. Blocks too short to hold a chosen suffix for certain have a
rank of their own, that of the whole block. No host is gathered anywhere: ranks are grouped, not hosts.

Near-equal pages of a host (by bands of least hashes of their article and open blocks' ranks, linked to components) are
one class. A rank that pages of two classes hold is a repeated substring, so its tokens are covered: copies of one page
do not make its text boilerplate.

Repetition alone cannot tell the article: copies of a page repeat their articles, and adverts and footers are often
unique. So every block of every page is in the stream, and coverage decides about blocks that the markup leaves open,
those outside an article or main element on a page that has one or has neither, while elements that are never article
text (FURNITURE, or NAMES in class, id or role) go. A page's article keeps its repeated passages, as pages do share
paragraphs, but not the blocks that more than half of the host's classes of pages hold: those are the site's. Beside an
article, an open block of fewer than DEPTH tokens is too short for coverage to tell: it stays if it is in one run of open
blocks with a longer one that stays.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindframe.llm.components import components
from kindframe.llm.store import each, slim, stored

# Fixed element names of HTML, by what they mean here.
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
FURNITURE = frozenset("head nav footer aside form button select dialog menu svg canvas object video audio noscript template iframe script style textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Words of class, id and role attributes that mark what is not the article, as a whole name or as its last part.
NAMES = frozenset("ad ads adv advert adverts advertisement advertisements advertising adsense breadcrumb breadcrumbs comments consent cookie cookies disqus footer gdpr menu modal nav navbar navigation navigationlinks newsletter notice notices pagination pager popup promo promoted promotion related sidebar sidebars signup skyscraper sponsor sponsored subscribe subscription toolbar widget widgets".split())
#: Those that are only so as a whole name, and those that are so as the first part too.
ALONE = frozenset("banner comment complementary contentinfo notification respond search share sharing social".split())
FIRST = frozenset("ad ads advert advertisement adsense breadcrumb comment comments cookie cookies footer gdpr nav navbar newsletter pagination promo sidebar sponsor sponsored".split())
#: Parts that say that something is not there, or around what it is.
AROUND = frozenset("has have no not non without with hide hidden show is free disabled enabled layout wrapper open closed left right".split())
#: Whole names of page headers, which do not count in an article, and of articles that are not the page's.
HEADER, OTHER = frozenset("header masthead site-header page-header topbar".split()), frozenset("ad ads advert advertisement comment comments sponsored promo related".split())
ARTICLE = frozenset(("article", "main"))
#: A start tag that ends an open p.
ENDS_P = BLOCK - frozenset("br option optgroup body html head caption td th tr tbody thead tfoot".split())
TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?:[!?]|/(?![a-zA-Z]))[^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.S)
SPACE = re.compile(r"[ \t\n\r\f\v]+")
DEPTH, NEAR = 8, 4
#: An article's block goes too if more than this share of a host's classes of pages hold it, and there are so many.
SITE, SITE_PAGES = 0.5, 8
#: Pages that agree in all hashes of one of BANDS bands are near-equal: nearly always from a likeness of 0.85, hardly ever below 0.5.
BANDS, HASHES = 16, 8
SEEDS = np.random.default_rng(10).integers(0, 1 << 64, (BANDS * HASHES, 1), np.uint64) | np.uint64(1)
WHITE = " \t\n\r\f\v"


def _names(attributes: str) -> list[str]:
    """The names in class, id and role."""
    return [n for k, a, b, c in ATTRIBUTE.findall(attributes) if k.lower() in ("class", "id", "role") for n in html.unescape(a or b or c).lower().split()]


def _named(name: str, inside: bool) -> bool:
    """Whether a name marks furniture. Of a compound only its first or last part tells, and nothing where it says what is around."""
    if name in NAMES or name in ALONE or name in HEADER and not inside:
        return True
    parts = re.split(r"[^a-z0-9]+", name)
    return len(parts) > 1 and AROUND.isdisjoint(parts) and (parts[0] in FIRST or parts[-1] in NAMES)


def blocks(page: str) -> list[tuple[str, int]]:
    """(text, zone) of each block: 0 in an article, 1 left open, 2 furniture. If names alone hide every article, they do not count around it."""
    out = _blocks(page, False)
    if not any(z == 0 for _, z in out) and re.search(r"<(?:article|main)[\s>]", page, re.I):
        out = _blocks(page, True)
    return out


def _blocks(page: str, through: bool) -> list[tuple[str, int]]:
    """blocks(); furniture inside a line is left out, unclosed and stray tags are tolerated. through: an article inside
    what a name marks (zone 4 here) is an article."""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, int]] = []  # open elements, and the zone inside them
    zone, parts, at, n = 1, [], 0, len(page)
    owner = 1  # the zone of parts
    # Where there are articles, a main element around them is no article itself.
    articles = ARTICLE if re.search(r"<article[\s>]", page, re.I) is None else frozenset(("article",))

    def flush():
        if parts:
            text = SPACE.sub(" ", "".join(parts)).strip(WHITE)
            parts.clear()
            if text:
                out.append((text, min(owner, 2)))

    def add(text: str):
        nonlocal owner
        if zone != 3:  # furniture inside a line is not text, and does not break the line
            owner = zone
            parts.append(html.unescape(text))

    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            add(re.sub(r"<[/!?a-zA-Z][^<]*\Z", "", page[at:]))
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name, closing = m[2].lower(), m[1]
        if closing:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), -1)
            if name in BLOCK:
                flush()
            # An inline end tag does not reach beyond the block that holds it.
            if depth >= 0 and (name in BLOCK or not any(s in BLOCK for s, _ in stack[depth + 1 :])):
                del stack[depth:]
                zone = stack[-1][1] if stack else 1
            continue
        if name in BLOCK:
            flush()
        if name in ENDS_P:
            # An open p ends here, with whatever inline elements it left open.
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    del stack[i:]
                    zone = stack[-1][1] if stack else 1
                    break
                if stack[i][0] in BLOCK:
                    break
        if name in VOID:
            continue
        attributes, inside = m[3], zone
        if zone < 2:
            own = _names(attributes) if attributes.strip("/ \n\t\r\f") and name not in ("html", "body", "main") else []
            if name in FURNITURE or name == "header" and zone != 0:
                inside = 2 if name in BLOCK else 3
            elif not OTHER.isdisjoint(own) if name == "article" else any(_named(n, zone == 0) for n in own):
                inside = 4 if name in BLOCK else 3
            elif name in articles:
                inside = 0
        elif through and zone == 4 and name in articles:
            inside = 0
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>|\Z", re.I).search(page, at)
            at = end.end()
            continue
        if attributes.endswith("/") and name in ("svg", "path"):
            continue
        stack.append((name, inside))
        zone = inside
    flush()
    return out


def host(url: Column) -> Column:
    """A hash of a URL's host; no host is one of its own."""
    return F.xxhash64(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Ranks(dict):
    """Token -> its first rank, a 64-bit hash. Emptied when large, as it only saves time."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = v = xxhash.xxh3_64_intdigest(word)
        return v


def ranked(words: list[str], ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """The first ranks of all tokens, and the ranks at DEPTH of all suffixes that are that long."""
    first = rank = np.fromiter(map(ranks.__getitem__, words), np.uint64, len(words))
    depth = 1
    while depth < DEPTH:
        rank = _mix(rank[: max(len(rank) - depth, 0)] * np.uint64(0x9E3779B97F4A7C15) + rank[depth:])
        depth *= 2
    return first, rank


def suffixes(words: list[str], ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Positions and ranks of the sparse suffixes of a stream that are at least DEPTH tokens long."""
    if len(words) < DEPTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first, rank = ranked(words, ranks)
    m = len(rank)
    around = np.lib.stride_tricks.sliding_window_view(np.concatenate((np.full(NEAR - 1, ~np.uint64(0)), _mix(first[:m]), np.full(NEAR - 1, ~np.uint64(0)))), NEAR).min(axis=1)
    # A position is taken if it is the least of some window of NEAR positions.
    own = _mix(first[:m])
    taken = np.zeros(m, bool)
    for k in range(NEAR):
        taken |= own == around[k : k + m]
    at = np.flatnonzero(taken)
    return at, rank[at]


def stream_of(texts: list[str]) -> tuple[list[str], list[int]]:
    """Tokens of blocks, each followed by a separator, and the block of each token."""
    words, owner = [], []
    for i, t in enumerate(texts):
        own = (*t.split(), "\x00")
        words += own
        owner += [i] * len(own)
    return words, owner


def whole(text: str) -> int | None:
    """The rank of a block that is too short to hold a chosen suffix for certain."""
    own = text.split()
    return xxhash.xxh3_64_intdigest("\x00".join(("", *own))) if len(own) < DEPTH + NEAR - 1 else None


def found(texts: list[str], ranks: Ranks, host: int) -> np.ndarray:
    """The distinct ranks of blocks, of their host."""
    short = np.array([w for t in texts if (w := whole(t)) is not None], np.uint64)
    return np.unique(_mix(np.concatenate((suffixes(stream_of(texts)[0], ranks)[1], short)) ^ np.uint64(host)))


def bands(rank: np.ndarray) -> np.ndarray:
    """A hash of each band's least hashes, and so of a page without ranks none."""
    if not len(rank):
        return np.zeros(0, np.uint64)
    # Ranks are hashes already, so odd factors give hashes of them.
    least = np.min([(rank[i : i + 4096] * SEEDS).min(axis=1) for i in range(0, len(rank), 4096)], axis=0).reshape(BANDS, HASHES)
    out = np.arange(BANDS, dtype=np.uint64)
    for k in range(HASHES):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + least[:, k])
    return out


def uncovered(texts: list[str], runs: list[int], host: int, covered: set[int], ranks: Ranks) -> list[str]:
    """The article's blocks (run 0) and the open ones that are not covered, as a whole or mostly.

    On a page without an article all of them if none is, as that page repeats others' texts and is not furniture.
    """
    article = 0 in runs
    if not covered and not article:
        return texts
    words, owner = stream_of(texts)
    of_host = lambda x: _mix(x ^ np.uint64(host)).view(np.int64).tolist()
    hit = np.zeros(len(words) + 1, np.int64)
    for a, r in enumerate(of_host(ranked(words, ranks)[1])):
        if r in covered:
            hit[a] += 1
            hit[a + DEPTH] -= 1
    share = np.bincount(owner, np.cumsum(hit)[:-1] > 0, len(texts)) / np.bincount(owner, minlength=len(texts))
    for i, t in enumerate(texts):
        if (w := whole(t)) is not None and of_host(np.array([w], np.uint64))[0] in covered:
            share[i] = 1
    if not article:
        return [t for t, s in zip(texts, share, strict=True) if s <= 0.5] or texts
    long = np.bincount(owner, minlength=len(texts)) >= DEPTH
    led = {0, *(r for r, s, k in zip(runs, share, long, strict=True) if k and s <= 0.5)}
    return [t for t, r, s in zip(texts, runs, share, strict=True) if not r or s <= 0.5 and r in led]


PARSED = (("_main", T.StringType()), ("_texts", T.ArrayType(T.StringType())), ("_runs", T.ArrayType(T.IntegerType())), ("_ranks", T.ArrayType(T.LongType())), ("_bands", T.ArrayType(T.LongType())))


@slim
def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last two columns, html and the host's hash, become the hash and PARSED.

    Those are the article's text, or else, where blocks are open, those and the article's with the run of each (0 in the
    article, else counted from 1); where blocks are open, the ranks of those and the article's; and their bands.
    """
    ranks = Ranks()
    for b in batches:
        main, texts, runs, held, like = [], [], [], [], []
        for page, own in zip(each(b.column(b.num_columns - 2)), b.column(b.num_columns - 1).to_pylist(), strict=True):
            kept, run, before = [], 0, 0
            for t, z in blocks(page or ""):
                run += z == 1 != before
                before = z
                if z < 2:
                    kept.append((t, z and run))
            settled = bool(kept) and not any(r for _, r in kept)
            main.append("\n".join(t for t, _ in kept) if settled else None)
            texts.append(None if settled else [t for t, _ in kept])
            runs.append(None if settled else [r for _, r in kept])
            rank = found([t for t, _ in kept], ranks, own % (1 << 64))
            held.append(None if settled else rank.view(np.int64))
            like.append(bands(rank).view(np.int64))
        cols = [pa.array(main, pa.string()), pa.array(texts, pa.list_(pa.string())), pa.array(runs, pa.list_(pa.int32())), pa.array(held, pa.list_(pa.int64())), pa.array(like, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*b.columns[:-2], b.column(b.num_columns - 1), *cols], [*b.schema.names[:-2], "_host", *[n for n, _ in PARSED]])


@slim
def _ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Key, host's hash and html become the key and the ranks of all blocks."""
    ranks = Ranks()
    for b in batches:
        of = [found([t for t, _ in blocks(page or "")], ranks, h % (1 << 64)).view(np.int64) for h, page in zip(b.column(1).to_pylist(), each(b.column(2)), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(of, pa.list_(pa.int64()))], ["_key", "_ranks"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", covered: bool = True) -> DataFrame:
    """pages without html plus text: the article's blocks and the open ones that stay, joined by newlines; empty if there are none.

    Null html is empty. Repeated rows stay; they are one class of pages, so they cover nothing. Pages without a URL or host
    share the empty host. White space is that of ASCII. A column named text is replaced; others pass through, and an
    empty table gives an empty table. With covered=False markup alone decides, and open blocks all stay.
    """
    keep = [c for c in pages.columns if c not in (html_col, "text")]
    names = {c: f"_k{i}" for i, c in enumerate(keep)}
    url, page = F.col(url_col).cast("string"), F.col(html_col)
    key = F.xxhash64(F.coalesce(url, F.lit("")), F.coalesce(page, F.lit("")))
    rows = pages.select(F.monotonically_increasing_id().alias("_page"), key.alias("_key"), *[F.col(f"`{c}`").alias(n) for c, n in names.items()], page.alias("_html"), host(url).alias("_host"))
    schema = T.StructType([f for f in rows.schema if f.name != "_html"] + [T.StructField(*f) for f in PARSED])
    parsed = stored(rows.mapInArrow(_parsed, schema), "blocks")
    renamed = [F.col(n).alias(c) for c, n in names.items()]
    if not covered:
        return parsed.select(*renamed, F.coalesce("_main", F.array_join("_texts", "\n")).alias("text"))
    undecided = parsed.where("_main IS NULL")
    banded = parsed.select("_key", F.explode("_bands").alias("_band"))
    shared = stored(banded.groupBy("_band").agg(F.min("_key").alias("b"), F.max("_key").alias("_last")).where("b < _last").select("_band", "b"), "bands")
    classes = components(banded.join(shared, "_band").select(F.col("_key").alias("a"), "b").distinct())
    classes = classes.withColumnRenamed("node", "_key")
    # Ranks of all pages are many, so pages of hosts with open blocks are read again for them, and no others.
    hosts = stored(undecided.select("_host").distinct(), "hosts")
    met = pages.select(key.alias("_key"), host(url).alias("_host"), page.alias("_html")).join(hosts, "_host", "left_semi").select("_key", "_host", "_html").mapInArrow(_ranks, "_key long, _ranks array<long>")
    # Of which class a page is: its own, if no other page is like it.
    by_page = met.join(classes, "_key", "left").select(F.coalesce("root", "_key").alias("_class"), F.explode("_ranks").alias("_rank"))
    held = by_page.groupBy("_rank").agg(F.min("_class").alias("_least"), F.max("_class").alias("_most")).where("_least < _most").select("_rank")
    mine = undecided.select("_page", F.explode("_ranks").alias("_rank")).join(held, "_rank").groupBy("_page").agg(F.collect_list("_rank").alias("_covered"))
    told = undecided.join(mine, "_page", "left").select(*names.values(), "_host", "_texts", "_runs", "_covered")
    out = T.StructType([*[f for f in told.schema if f.name in (*names.values(), "_host")], T.StructField("_text", T.StringType())])

    @slim
    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = Ranks()
        for b in batches:
            texts = ["\n".join(uncovered(t or [], r or [], h % (1 << 64), set(c or ()), ranks)) for h, t, r, c in zip(*(each(c) for c in b.columns[-4:]), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-3], pa.array(texts, pa.string())], [*b.schema.names[:-3], "_text"])

    both = parsed.where("_main IS NOT NULL").select(*names.values(), "_host", F.col("_main").alias("_text")).unionAll(told.mapInArrow(decide, out))
    met = both.join(_of_the_site(parsed, classes), "_host", "left")
    left = F.array_join(F.filter(F.split("_text", "\n"), lambda t: ~F.array_contains("_sitewide", F.xxhash64(t))), "\n")
    text = F.when(F.col("_sitewide").isNull() | (left == ""), F.col("_text")).otherwise(left)
    return met.select(*renamed, text.alias("text"))


def _of_the_site(parsed: DataFrame, classes: DataFrame) -> DataFrame:
    """(_host, _sitewide): hashes of the blocks that more than SITE of a host's classes of pages hold, of at least SITE_PAGES.

    A page holds few blocks, so few of them can be in half of a host's pages.
    """
    article = F.coalesce(F.split("_main", "\n"), F.transform(F.filter(F.arrays_zip("_texts", "_runs"), lambda x: x["_runs"] == 0), lambda x: x["_texts"]))
    of = parsed.select("_key", "_host", F.array_distinct(F.transform(article, lambda t: F.xxhash64(t))).alias("_in")).join(classes, "_key", "left").withColumn("_class", F.coalesce("root", "_key"))
    pages = stored(of.groupBy("_host", "_class").agg(F.count("*").alias("_n")).groupBy("_host").agg(F.count("*").alias("_pages")).where(F.col("_pages") >= SITE_PAGES), "host-pages")
    held = of.select("_host", "_class", F.explode("_in").alias("_block")).groupBy("_host", "_block", "_class").agg(F.count("*").alias("_n")).groupBy("_host", "_block").agg(F.count("*").alias("_n")).where(F.col("_n") > SITE_PAGES * SITE)
    wide = held.join(pages, "_host").where(F.col("_n") > F.col("_pages") * SITE)
    return stored(wide.groupBy("_host").agg(F.collect_list("_block").alias("_sitewide")), "sitewide")


def op10_html_text(spark, sf_dir: str) -> DataFrame:
    out = extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))

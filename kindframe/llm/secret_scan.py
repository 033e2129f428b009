"""Secret scans with corpus-wide ownership frequency. Native DataFrame operations only.

Candidates are found by patterns. The text between the matches and the matches alternate, so running sums of their lengths
are the offsets; they run over exploded rows, as a text may have any number of matches. The values' hashes are then
counted over the corpus by distinct repositories and distinct owners: a value that many owners hold is a copied example, one
of few owners looks live. That adds spans: loose tokens that look random and that few owners hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindframe.llm.store import stored

# Fixed patterns: kind, pattern, the group that is the value, the least length of what is measured, whether that is the
# value (or the whole match). A match that is too short is dropped, but has used up its text.
KINDS = (
    ("assign", r"((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: Loose tokens: long runs of the value alphabet.
LOOSE = ("owned", r"[A-Za-z0-9+/_=-]{20,}", 0, 20)
#: What looks random has so many digits and letters, and changes between digits, capitals and small letters once in so many characters.
MIXED, CHANGES, EVERY = 3, r"[a-z][A-Z0-9]|[A-Z][0-9]|[0-9][A-Za-z]", 6
#: A value that more distinct owners than this hold is an example, not a credential.
MOST_OWNERS = 2
NONE = "array<struct<order:int,pos:int,gap:int,length:int,size:int,value_hash:string>>"


def random_looking(value: Column) -> Column:
    count = lambda p: F.regexp_count(value, F.lit(p))
    return (count("[0-9]") >= MIXED) & (count("[A-Za-z]") >= MIXED) & (count(CHANGES) * EVERY >= F.length(value))


def matches(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Array of a pattern's matches, leftmost first and not overlapping, each with the length of the gap before it."""
    order = [k for k, *_ in (*KINDS, LOOSE)].index(kind)
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = lambda m: F.regexp_extract(m, pattern, group) if group else m

    def one(gap: Column, m: Column) -> Column:
        v = value(m)
        size = F.when(random_looking(v), F.length(v)).otherwise(0) if kind == LOOSE[0] else F.length(v)
        return F.struct(gap.alias("gap"), F.length(m).alias("length"), size.alias("size"), F.sha2(v, 256).alias("value_hash"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, one)
    placed = F.transform(pairs, lambda x, i: F.struct(F.lit(order).alias("order"), i.cast("int").alias("pos"), x["gap"].alias("gap"), x["length"].alias("length"), x["size"].alias("size"), x["value_hash"].alias("value_hash")))
    some = F.regexp_like(text, F.lit(pattern))
    # Where no match is long enough, nothing of the kind need go on.
    return F.when(some & F.exists(placed, lambda x: x["size"] >= least), placed).otherwise(F.array().cast(NONE))


def scan(docs: DataFrame, text_col: str = "text", owner_col: str = "source", repo_col: str | None = None, most_owners: int = MOST_OWNERS) -> DataFrame:
    """docs without their text plus base and added: arrays of (start, end, order, kind, value_hash, repos, owners, verdict).

    Offsets are in code points, ends exclusive; a null text is empty. base has the matches of KINDS. A span's verdict is
    "copied" where more than most_owners distinct owners hold its value and "live" otherwise. added has the loose tokens
    that look random, are live and overlap no base span. Owners and repositories are counted over all of docs, null as
    one of its own; without repo_col each row is a repository. Repeated rows stay. Columns named base, added or
    text_col are replaced; an empty table gives an empty table.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keep = [c for c in docs.columns if c not in (text_col, "base", "added")]
    owner = F.col(owner_col).cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_doc"), owner.alias("_owner"), (F.col(repo_col).cast("string") if repo_col else F.lit(None).cast("string")).alias("_repo"), text.alias("_text"), F.monotonically_increasing_id().alias("_at"))
    if not repo_col:
        rows = rows.withColumn("_repo", F.col("_at").cast("string"))
    rows = stored(rows.withColumn("_found", F.concat(*[matches(F.col("_text"), *k) for k in (*KINDS, LOOSE)])).drop("_text"), "candidates")
    least = F.array(*[F.lit(k[3]) for k in (*KINDS, LOOSE)])
    kinds = F.array(*[F.lit(k[0]) for k in (*KINDS, LOOSE)])
    before = Window.partitionBy("_at", "_s.order").orderBy("_s.pos").rowsBetween(Window.unboundedPreceding, 0)
    hits = rows.select("_at", "_owner", "_repo", F.explode("_found").alias("_s")).withColumn("_end", F.sum(F.col("_s.gap") + F.col("_s.length")).over(before).cast("int"))
    hits = hits.where(F.col("_s.size") >= F.get(least, F.col("_s.order")))
    hits = stored(hits.select("_at", "_owner", "_repo", (F.col("_end") - F.col("_s.length")).alias("start"), F.col("_end").alias("end"), "_s.order", F.get(kinds, F.col("_s.order")).alias("kind"), "_s.value_hash"), "spans")
    # Owners and repositories of each value: once each first, so a value that everybody copies is as many rows as it has of them.
    pairs = hits.groupBy("value_hash", "_owner", "_repo").agg(F.count("*").alias("_n"))
    distinct = lambda c: F.count_distinct(F.coalesce(F.concat(F.lit("="), c), F.lit("")))
    owned = stored(pairs.groupBy(F.col("value_hash").alias("_hash")).agg(distinct(F.col("_owner")).alias("owners"), distinct(F.col("_repo")).alias("repos")), "owned")
    told = hits.join(owned, F.col("value_hash") == F.col("_hash")).withColumn("verdict", F.when(F.col("owners") > most_owners, "copied").otherwise("live"))
    one = F.struct("start", "end", "order", "kind", "value_hash", "repos", "owners", "verdict")
    regrouped = told.groupBy("_at").agg(F.array_sort(F.collect_list(one)).alias("_all")).withColumnRenamed("_at", "_of")
    met = rows.select("_doc", "_at").join(regrouped, F.col("_at") == F.col("_of"), "left")
    every = F.coalesce(F.col("_all"), F.array().cast(regrouped.schema["_all"].dataType))
    met = met.withColumn("_base", F.filter(every, lambda x: x["kind"] != LOOSE[0])).withColumn("_every", every)
    apart = lambda x: ~F.exists(F.col("_base"), lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    added = F.filter("_every", lambda x: (x["kind"] == LOOSE[0]) & (x["verdict"] == "live") & apart(x))
    return met.select(*[F.col("_doc").getField(c).alias(c) for c in keep], F.col("_base").alias("base"), added.alias("added"))


def joined(spans: Column, *more: str) -> Column:
    """kind:start:end of spans by start, then in order of KINDS, and whatever else of them is asked for."""
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"), *[x[m].cast("string") for m in more])), ",")


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    """A document's source owns it, and each document is a repository."""
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"), repo_col="doc_id")
    n = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    every = F.concat("base", "added")
    live = F.size(F.filter("base", lambda x: x["verdict"] == "live")).cast("long").alias("n_live")
    return out.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(every).alias("spans"), live, joined(every, "repos", "owners", "verdict").alias("verdicts"))


def _sql() -> str:
    """The same in DuckDB's SQL, whose patterns are RE2's."""
    assign = r"(?i:password|passwd|secret|token|api_?key)[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
    patterns = [(assign, *KINDS[0][2:]), *[(k[1], *k[2:]) for k in (*KINDS[1:], LOOSE)]]
    parts = []
    for order, (pattern, group, least) in enumerate(patterns):
        name = (*KINDS, LOOSE)[order][0]
        grouped = 1 if group else 0
        mixed = f"AND len(regexp_extract_all(v, '[0-9]')) >= {MIXED} AND len(regexp_extract_all(v, '[A-Za-z]')) >= {MIXED} AND len(regexp_extract_all(v, '{CHANGES}')) * {EVERY} >= length(v)" if name == LOOSE[0] else ""
        parts.append(f"""SELECT doc_id, source, {order} AS o, '{name}' AS kind, e - length(m) AS s, e, v FROM (
  SELECT doc_id, source, m, v, sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (
    SELECT doc_id, source, unnest(regexp_extract_all(t, '{pattern}')) AS m, unnest(regexp_extract_all(t, '{pattern}', {grouped})) AS v,
      unnest(string_split_regex(t, '{pattern}')[:len(regexp_extract_all(t, '{pattern}'))]) AS g, unnest(range(len(regexp_extract_all(t, '{pattern}')))) AS i FROM d))
WHERE length(v) >= {least} {mixed}""")
    union = "\nUNION ALL\n".join(parts)
    return f"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents), f AS ({union}),
w AS (SELECT v, count(DISTINCT coalesce('=' || source, '')) AS owners, count(DISTINCT doc_id) AS repos FROM f GROUP BY v),
told AS (SELECT f.*, owners, repos, CASE WHEN owners > {MOST_OWNERS} THEN 'copied' ELSE 'live' END AS verdict FROM f JOIN w USING (v)),
base AS (SELECT * FROM told WHERE o < {len(KINDS)}),
every AS (SELECT * FROM base UNION ALL SELECT * FROM told l WHERE o = {len(KINDS)} AND verdict = 'live' AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = l.doc_id AND b.s < l.e AND l.s < b.e))
SELECT d.doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, e, o) FILTER (WHERE o < {len(KINDS)}), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, e, o), '') AS spans, count(*) FILTER (WHERE o < {len(KINDS)} AND verdict = 'live') AS n_live,
  coalesce(string_agg(kind || ':' || s || ':' || e || ':' || repos || ':' || owners || ':' || verdict, ',' ORDER BY s, e, o), '') AS verdicts
FROM d LEFT JOIN every USING (doc_id) GROUP BY d.doc_id"""


OP8_SQL = _sql()

"""Line dedup: lines that many documents share are dropped from all of them but one.

Native DataFrame operations only. The texts themselves are shuffled once, to meet the positions of their dropped
lines; what is exploded, hashed and counted are positions with 128 bits of hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindframe.llm.store import WHITE, ascii_lower, row_key, stored


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(_row, _id, _drop): for each document that loses lines, the sorted positions of those lines.

    A line's key is the line stripped of ASCII white space, A-Z lower-cased. Keys of at least min_chars code points
    that at least min_docs distinct ids hold are dropped everywhere but in the largest id that holds them.
    """
    rows = docs.select(F.col(id_col).alias("_id"), row_key(F.col(id_col), F.col(text_col)).alias("_row"), F.transform(_lines(F.col(text_col)), lambda x: F.btrim(x, F.lit(WHITE))).alias("_lines"))
    lowered = F.transform("_lines", lambda x: F.when(F.length(x) >= min_chars, ascii_lower(x)))
    # Two hashes, 128 bits: with one, some of very many lines would meet a common one by chance.
    hashes = lambda x: F.when(x.isNotNull(), F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit("b"), x).alias("b")))
    keyed = rows.select("_id", "_row", F.transform(lowered, hashes).alias("_keys"))
    held = stored(keyed.select("_id", "_row", F.posexplode("_keys").alias("_pos", "_key")).where("_key IS NOT NULL").select("_id", "_row", "_pos", F.col("_key.a").alias("_key"), F.col("_key.b").alias("_key2")), "lines")
    # A null id is one document of its own; it is never the largest unless it is alone.
    counts = held.groupBy("_key", "_key2").agg((F.count_distinct("_id") + F.max(F.col("_id").isNull().cast("int"))).alias("_n"), F.max("_id").alias("_keep"))
    # Written, so that the join deals both sides anew and can split the rows of a very common line over tasks.
    common = stored(counts.where(F.col("_n") >= min_docs).select("_key", "_key2", "_keep"), "common")
    lost = held.join(common, ["_key", "_key2"]).where(~F.col("_id").eqNullSafe(F.col("_keep")))
    return lost.groupBy("_row", "_id").agg(F.sort_array(F.collect_set("_pos")).alias("_drop"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs with their texts cut, plus n_lines and n_dropped (long).

    Every row stays. A null or empty text is one empty line. Documents are told apart by id: rows that repeat an id
    count as one document for min_docs, and each of them keeps the line if theirs is the largest id. An n_chars
    column, if there is one, is set to the new length. Input columns named n_lines or n_dropped are replaced;
    any other column passes through, and an empty table gives an empty table.
    """
    lost = repeated_lines(docs, id_col, text_col, min_chars, min_docs).select(F.col("_row").alias("_at"), F.col("_id").alias("_of"), "_drop")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    text, ident = F.col("_doc").getField(text_col), F.col("_doc").getField(id_col)
    met = packed.withColumn("_row", row_key(ident, text)).join(lost, (F.col("_row") == F.col("_at")) & ident.eqNullSafe(F.col("_of")), "left")
    all_of, n = _lines(text), F.col("_n_lines")
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), (n - 1).cast("int")), F.col("_drop")), lambda i: F.col("_all")[i]), "\n")
    met = met.withColumn("_all", all_of).withColumn("_n_lines", F.size("_all").cast("long"))
    met = met.withColumn("_text", F.when(F.col("_drop").isNull(), F.coalesce(text, F.lit(""))).otherwise(kept))
    new = {text_col: F.col("_text"), "n_chars": F.length("_text").cast(dict(docs.dtypes).get("n_chars", "long"))}
    cols = [new.get(c, F.col("_doc").getField(c)).alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return met.select(*cols, n.alias("n_lines"), F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"))


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", F.greatest("n_dropped", F.lit(0)).alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), common AS (
  SELECT k, max(doc_id) AS keep FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE c.k IS NOT NULL AND doc_id <> keep) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.k IS NULL OR doc_id = keep), '')) AS kept_sha256
FROM keyed LEFT JOIN common c USING (k) GROUP BY doc_id
"""

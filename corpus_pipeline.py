"""The corpus pipeline: quality classifier, line dedup, n-gram Jaccard join, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept, and returns a DataFrame that is written as
Parquet and reread as the next one's docs. All but the last return the columns of documents, and any others that docs has.

All stages take null ids, texts, languages and sources, empty and very long texts, repeated rows, and columns of whatever
other names; an empty table gives an empty table. A null text counts as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindframe.llm import cotraining, jaccard_join, line_dedup, packing, source_mix
from kindframe.llm.store import dropped, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects, as poor or as toxic, go.

    Without labels of both kinds for a question that question rejects nothing. Repeated rows share one fate, as each row
    is judged by its own text, language and source; an exact tie at probability 1/2 keeps the quality and rejects the toxic.
    """
    model = cotraining.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    told = cotraining.score(_inside(docs), model, text_col="_doc.text", lang_col="_doc.lang", source_col="_doc.source")
    return told.where("keep").select("_doc.*")


def _inside(docs: DataFrame) -> DataFrame:
    """docs as one column _doc, so that no column of theirs can meet one that a stage adds."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five or more documents share stay in the one of the largest id; every row stays, n_chars follows the text.

    Rows that repeat an id are one document; null ids are one document of their own. A null text becomes empty.
    """
    names = {c: c if c in ("doc_id", "text", "n_chars") else f"_c{i}" for i, c in enumerate(docs.columns)}
    cut = line_dedup.drop_repeated_lines(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]))
    return cut.select(*[F.col(n).alias(c) for c, n in names.items()])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest id stays, null ids last; of equal rows one.

    Texts without words are in no group and all stay.
    """
    return jaccard_join.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out or repeated until sources have their target weights, null being a source of its own.

    Documents without words are taken once. Of equal rows, which ones are taken more often does not matter.
    """
    return source_mix.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens, one row a piece. Repeated ids are documents of their own; null ids pass through."""
    return packing.packed(docs, packing.default_tokenizer(), with_ids=False)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("n-gram Jaccard join", near_copies), ("source mixing", mixed), ("packing", packed)]

#: A fitted classifier and a packing order have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        dropped(before)
        before = docs
    return docs

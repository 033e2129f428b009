"""The pipeline's stages one after another, held against brute force where one exists, and each on awkward tables."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import brute_components
from tests.oracle import SF


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(corpus_pipeline.stored(stage(spark, seen[-1], SF), "stage"))
    assert all(d.columns == docs.columns for d in seen[:-1])
    scored, cut, single, mixed, packed = seen[1:]
    assert 0 < scored.count() < docs.count() and cut.count() == scored.count()
    rows = sorted((r.doc_id, r.text) for r in cut.collect())
    want = brute_components([t for _, t in rows])
    assert {r.doc_id for r in single.collect()} == {rows[c][0] for _, c in want.values()}
    copies = {}
    for r in mixed.collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert set(copies) <= {r.doc_id for r in single.collect()} and max(copies.values()) <= 3
    tokens = packed.where("start = 0").groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in tokens} == copies


LONG = " ".join(f"w{i}" for i in range(40_000))
LINE = "this line is long enough to count as one that repeats"
ROWS = [(1, None, None, None), (2, "", "en", "a"), (None, "a b c", "en", "a"), (None, "a b c", "en", "a"), (3, LONG, "en", None), (4, LONG, "de", "b"), (5, "x", "", ""), (5, "x", "", ""), (5, "y z", "fr", "b")]
ROWS += [(10 + i, f"{LINE}\nown words of document number {i}", "en", "c") for i in range(6)]
NAMES = ["doc_id", "text", "lang", "source", "n_chars", "n_lines", "keep", "_row", "copies", "size", "p_quality", "_doc", "_text"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, len(r[1] or ""), *[f"{n}{i}" for n in NAMES[5:]]) for i, r in enumerate(ROWS)]
    return spark.createDataFrame(rows, ", ".join(f"{n} {'long' if n in ('doc_id', 'n_chars') else 'string'}" for n in NAMES))


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_and_empty_tables(spark, odd, stage):
    out = stage(spark, odd.repartition(3), SF)
    none = stage(spark, odd.limit(0), SF)
    assert none.count() == 0
    if stage is not corpus_pipeline.packed:
        assert out.columns == none.columns == NAMES and [t for _, t in out.dtypes] == [t for _, t in odd.dtypes]
        others = Counter(tuple(r)[5:] for r in out.collect())
        assert set(others) <= {tuple(r)[5:] for r in odd.collect()}


def test_lines_of_odd_tables(spark, odd):
    out = Counter((r.doc_id, r.text, r.n_chars) for r in corpus_pipeline.lines(spark, odd, SF).collect())
    want = Counter()
    for i, t, *_ in ROWS:
        t = t or ""
        if i is not None and 10 <= i < 15:
            t = t.split("\n")[1]
        want[i, t, len(t)] += 1
    assert out == want


def test_near_copies_of_odd_tables(spark, odd):
    out = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, odd, SF).collect())
    assert out == Counter({(1, None): 1, (2, ""): 1, (None, "a b c"): 1, (3, LONG): 1, (5, "x"): 1, (5, "y z"): 1, (10, ROWS[9][1]): 1})  # 10 to 15 differ in one word


def test_mix_of_odd_tables(spark, odd):
    out = corpus_pipeline.mixed(spark, odd, SF).groupBy("doc_id", "text", "lang").count().collect()
    assert all(r["count"] <= 3 * (2 if r.text in ("a b c", "x") else 1) for r in out) and {r.doc_id for r in out} >= {1, 2}


def test_packing_of_odd_tables(spark, odd):
    out = corpus_pipeline.packed(spark, odd, SF)
    assert Counter(r.doc_id for r in out.where("start = 0").collect()) == Counter(i for i, *_ in ROWS)


def test_quality_without_labels_of_both_kinds(spark, odd, tmp_path):
    spark.createDataFrame([(1, 1, None), (2, 1, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.quality(spark, odd, str(tmp_path))
    assert out.count() == len(ROWS) and out.where(F.col("text").isNull()).count() == 1

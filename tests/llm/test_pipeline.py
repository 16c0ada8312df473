from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from readloom.llm import hyperdimensional
from tests.llm import brute


def ids(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in df.select("doc_id").collect())


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "packing"]


def test_run_equals_its_stages_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")]
    keep = set(brute.near_copies(rows))
    want = {i for i, t in rows if i in keep and not brute.decontaminate(t, items)[-1]}
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, sf).select("doc_id").distinct().collect()}
    assert want == got


@pytest.mark.parametrize("k", [0, 1, 2])
def test_stages_keep_columns_and_take_odd_rows(spark, sf, odd_docs, empty_docs, k):
    _, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, odd_docs, sf)
    assert out.columns == odd_docs.columns and 0 < out.count() <= odd_docs.count()
    assert stage(spark, empty_docs, sf).count() == 0


def test_language_stage_drops_texts_without_letters(spark, sf, odd_docs):
    out = corpus_pipeline.identify_language(spark, odd_docs, sf)
    assert out.filter(F.col("text").isNull() | ~F.col("text").rlike(r"\p{L}")).count() == 0
    known = hyperdimensional.fit(odd_docs.filter(hyperdimensional.training_rows(odd_docs)), "text", "lang")
    assert known[0]


def test_packing_stage(spark, sf, odd_docs, empty_docs):
    out = corpus_pipeline.pack(spark, odd_docs, sf)
    assert out.select("doc_id").distinct().count() == odd_docs.select("doc_id").distinct().count()
    assert corpus_pipeline.pack(spark, empty_docs, sf).count() == 0


def test_stages_leave_columns_of_any_name_alone(spark, sf, odd_docs):
    names = ("_lang_pred", "_lang_score", "_n_words", "_spans", "_items", "__spans", "__n_words")
    docs = odd_docs
    for i, name in enumerate(names):
        docs = docs.withColumn(name, F.lit(f"mine {i}"))
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, sf)
        assert out.dtypes == docs.dtypes
        assert {tuple(r) for r in out.select(*names).distinct().collect()} == {tuple(f"mine {i}" for i in range(len(names)))}


def test_decontamination_with_odd_items(spark, sf, odd_docs, tmp_path):
    items = [("a", None), ("b", ""), (None, "one"), ("c", " ... "), ("c", "gnu general public license apache license cc by mit license")]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = corpus_pipeline.decontaminate(spark, odd_docs, str(tmp_path))
    want = [i for i, t in ((r["doc_id"], r["text"]) for r in odd_docs.collect()) if not brute.decontaminate(t, items)[-1]]
    assert sorted(map(str, want)) == sorted(str(r["doc_id"]) for r in left.collect()) and len(want) < odd_docs.count()
    spark.createDataFrame([], "item_id string, text string").write.parquet(str(tmp_path / "none" / "benchmark.parquet"))
    assert corpus_pipeline.decontaminate(spark, odd_docs, str(tmp_path / "none")).count() == odd_docs.count()

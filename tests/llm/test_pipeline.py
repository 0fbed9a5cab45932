"""The pipeline's stages: what each removes, against plain versions, and its columns."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests_llm_brute import brute_groups, brute_hits

D = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="session")
def stages(spark, tmp_path_factory):
    """The result of each stage on the smallest tables."""
    docs, out = spark.read.parquet(f"{D}/documents.parquet"), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, docs, D).write.parquet(path)
        out[name] = (docs, docs := spark.read.parquet(path))
    return out


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "language identification", "n-gram Jaccard join", "benchmark decontamination", "packing"]
    assert all(out.columns == COLUMNS for name, (_, out) in stages.items() if name != "packing")


def test_quality_and_language_keep_clean_documents(spark, stages):
    labels = spark.read.parquet(f"{D}/labels.parquet")
    before, after = stages["quality classifier"]
    rate = lambda df, w: df.join(labels.filter(w), "doc_id").count()
    assert rate(after, "quality = 1 AND toxic = 0") >= 0.95 * rate(before, "quality = 1 AND toxic = 0")
    assert rate(after, "quality = 0") < rate(before, "quality = 0")  # few labels here: in doubt, documents stay
    before, after = stages["language identification"]
    assert after.count() >= 0.98 * before.count()
    gone = before.join(after, "doc_id", "left_anti").filter(F.col("text").rlike(r"\p{L}")).count()
    assert gone <= 0.02 * before.count()


def test_near_duplicates_and_benchmark(spark, stages):
    before, after = stages["n-gram Jaccard join"]
    groups = brute_groups(dict(before.select("doc_id", "text").collect()), 5, 80)
    assert sorted(r.doc_id for r in after.collect()) == sorted(d for d, (_, c) in groups.items() if d == c)
    before, after = stages["benchmark decontamination"]
    bench = dict(spark.read.parquet(f"{D}/benchmark.parquet").select("item_id", "text").collect())
    hits = brute_hits(dict(before.select("doc_id", "text").collect()), bench)
    assert sorted(r.doc_id for r in after.collect()) == sorted(d for d, h in hits.items() if not h[-1])


def test_packing(stages):
    before, after = stages["packing"]
    assert {r.doc_id for r in after.select("doc_id").distinct().collect()} == {r.doc_id for r in before.collect()}
    full = after.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert all(r.n == 2048 or re.fullmatch("0b10*", bin(r.n)) for r in full)


def test_odd_documents(spark, tmp_path):
    """Null keys, texts and languages, repeated rows, a very long text and columns whose names stages use themselves."""
    long = " ".join(f"word{i % 700}" for i in range(60_000))
    rows = [(None, "a text without a key, as it is found in tables", "en", None, None), (1, None, None, "s", 0), (2, "", "en", "s", 0), (3, long, "en", "s", len(long)), (3, long, "en", "s", len(long)), (4, "...", None, "s", 3)]
    docs = spark.createDataFrame([(*r, 7, "clash", 0.5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, row int, own string, score double")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, D)
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
    kept = [r.doc_id for r in docs.collect()]
    assert kept.count(3) <= 1 and set(kept) <= {None, 3}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, D)
    assert packed.select("doc_id").distinct().count() == len(set(kept))


def test_empty_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, D).count() == 0, name

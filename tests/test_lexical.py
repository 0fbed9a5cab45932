"""The stored inverted index against scoring by reading all texts."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vaultspark.operators import lexical, search

TERMS = ["the", "und", "les", "fox", "absent"]


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):
    return lexical.LexicalIndex.build(docs, str(tmp_path_factory.mktemp("index") / "i"), buckets=8, blocks=16)


def plain(spark, docs, terms):
    asked = spark.createDataFrame([(0, t) for t in terms], "qid long, term string")
    return [(r.doc_id, r.score) for r in search.bm25(docs, asked).orderBy("rank").collect()]


def test_scores_are_those_of_a_full_read(spark, docs, index):
    want = plain(spark, docs, TERMS)
    assert [(r.key, r.score) for r in index.scores(TERMS).orderBy(F.desc("score"), "key").collect()] == want and len(want) > 50
    asked = spark.createDataFrame([(0, t) for t in TERMS] + [(1, "fox"), (2, "absent")], "qid long, term string")
    for most in (10_000, 2):  # terms as a filter, and joined
        got = lexical.bm25(index, asked, most_terms=most).orderBy("qid", "rank").collect()
        assert [(r.key, r.score) for r in got if r.qid == 0] == want and not [r for r in got if r.qid == 2]


@pytest.mark.parametrize("n", [1, 3, 10, 80, 10_000])
def test_first_n_in_waves(spark, docs, index, n):
    vocabulary = [r.t for r in docs.select(F.explode(search.tokens(F.col("text"))).alias("t")).groupBy("t").count().filter("count > 3").orderBy("t").collect()]
    rnd = random.Random(n)
    for terms in (TERMS, ["the"], rnd.sample(vocabulary, 4), ["absent"], []):
        want = plain(spark, docs, terms)[:n] if terms else []
        assert [(k, s) for k, s, _ in index.search(terms, n)] == want
    assert [r for _, _, r in index.search(["the"], 5)] == list(range(1, 6)) and index.search(["the"], 0) == []


def test_second_wave_reads_only_blocks_that_may_do_better(index, monkeypatch):
    read = []
    scored = lexical.LexicalIndex._scored
    monkeypatch.setattr(lexical.LexicalIndex, "_scored", lambda self, idf, blocks=None: read.append(blocks) or scored(self, idf, blocks))
    best = index.search(["the", "les"], 2)
    _, bounds = index.bounds(["the", "les"])
    blocks = [b for wave in read for b in wave]
    assert len(blocks) == len(set(blocks)) < len(bounds)
    assert all(bounds[b][0] + 1e-6 < best[-1][1] for b in set(bounds) - set(blocks))


def test_plan_scans_postings_with_pushed_filters(spark, index, capsys):
    index.scores(["the", "und"]).explain("formatted")
    plan = capsys.readouterr().out
    assert plan.count("Location") == 1 and "PartitionFilters" in plan and "In(term" in plan and "regexp" not in plan


def test_keys_under_other_names_and_reopened(spark, index):
    other = lexical.LexicalIndex.open(spark, index.folder).named(lambda k: F.concat(F.lit("n"), k.cast("string")))
    best = other.search(["the"], 20)
    assert {k for k, *_ in best} and all(k.startswith("n") for k, *_ in best)
    assert [k for k, s, _ in best if s == best[0][1]] == sorted(k for k, s, _ in best if s == best[0][1])


def test_odd_tables(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "!!"), (4, "fox fox"), (4, "fox"), (None, "fox den")]
    got = lexical.LexicalIndex.build(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "odd"))
    assert got.docs == 3 and {k for k, *_ in got.search(["fox"], 9)} == {4, None}
    none = lexical.LexicalIndex.build(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "none"))
    assert none.search(["fox"], 9) == [] and none.scores(["fox"]).count() == 0 and none.avgdl == 0


def test_built_anew_when_files_change(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame([(1, "red")], "doc_id long, text string").write.parquet(path)
    first = lexical.index_of(spark, path)
    assert lexical.index_of(spark, path).folder == first.folder and [k for k, *_ in first.search(["red"], 5)] == [1]
    spark.createDataFrame([(2, "red blue")], "doc_id long, text string").write.mode("append").parquet(path)
    assert sorted(k for k, *_ in lexical.index_of(spark, path).search(["red"], 5)) == [1, 2]


def test_postings_of_a_bucket_are_dealt_over_tasks(spark, docs, index, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "PART_BYTES", 20_000)
    dealt = lexical.LexicalIndex.build(docs, str(tmp_path / "dealt"), buckets=8, blocks=16)
    whole = dealt.table("postings").select("bucket", "term", "block", F.input_file_name().alias("f")).distinct()
    files = whole.select("bucket", "f").distinct().groupBy("bucket").count().collect()
    assert len(files) == 8 and all(r["count"] > 1 for r in files)
    assert whole.groupBy("bucket", "term", "block").count().filter("count > 1").count() == 0  # what a search skips lies together
    assert dealt.stat["docs"] == index.stat["docs"] and dealt.stat["words"] == index.stat["words"]
    key = ["term", "block", "key", "tf", "dl", "head"]
    assert sorted(map(tuple, dealt.table("postings").select(key).collect())) == sorted(map(tuple, index.table("postings").select(key).collect()))
    assert dealt.search(TERMS, 80) == index.search(TERMS, 80)


def test_words_are_counted_in_steps(monkeypatch):
    texts = [["b", "a", "b"], None, [], ["c"] * 7, ["a"], ["d", "c"]]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4, None, 6]), pa.array(texts, pa.list_(pa.string()))], ["key", "w"])
    want = {(t, k, w.count(t), len(w), w[0] == t) for k, w in zip([1, 2, 3, 4, None, 6], texts) if w for t in w}
    for step in (1, 3, 4, 100):
        monkeypatch.setattr(lexical, "STEP_WORDS", step)
        got = [tuple(r.values()) for out in lexical._counted([batch]) for r in out.to_pylist()]
        assert len(got) == len(want) and set(got) == want


def test_runs_of_two_batches_add_up():
    rows = [("a", 1, 0.5, 0), ("a", 1, 0.7, 0), ("a", 2, 0.1, 0), ("b", 2, 0.3, 0), ("b", 2, 0.2, 1)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("term", "block", "top", "bucket"), r)) for r in part], pa.schema([("term", pa.string()), ("block", pa.int32()), ("top", pa.float64()), ("bucket", pa.int32())])) for part in (rows[:1], [], rows[1:])]
    got = [tuple(r.values()) for out in lexical._runs(batches) for r in out.to_pylist()]
    assert got == [("a", 1, 1, 0.5, 0), ("a", 1, 1, 0.7, 0), ("a", 2, 1, 0.1, 0), ("b", 2, 1, 0.3, 0), ("b", 2, 1, 0.2, 1)]

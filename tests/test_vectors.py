"""The stored vector table against a plain dictionary of vectors."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from vaultspark.operators import vectors
from vaultspark.operators.vectors import VectorTable, centroids, closest, unit
from vaultspark.plans import custom
from vaultspark.sources.bucketed import Conflict

V = "vec_id long, embedding array<double>"


def rows(spark, vectors):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in vectors.items()], V)


def asked(spark, vectors):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in vectors.items()], "qid long, q array<double>")


def plain(vectors, questions, n):
    ids = np.array(sorted(vectors))
    x = unit(np.array([vectors[i] for i in ids], float))
    out = {}
    for q, v in questions.items():
        s = np.round(x @ unit(np.array([v], float))[0], 6)
        out[q] = [int(i) for i in ids[np.argsort(-s, kind="stable")][:n]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("qid", "rank").collect():
        out.setdefault(r.qid, []).append(r.vec_id)
    return out


@pytest.fixture(scope="module")
def clustered():
    rnd = np.random.default_rng(3)
    middle = rnd.normal(size=(12, 16))
    return {i: middle[i % 12] + 0.4 * rnd.normal(size=16) for i in range(400)}


def test_changes_are_those_of_a_dictionary(spark, tmp_path, clustered):
    t, want = VectorTable(spark, str(tmp_path / "v")), dict(list(clustered.items())[:250])
    t.setup(rows(spark, want), lists=8)
    more = {**dict(list(clustered.items())[200:300]), 5: np.ones(16), 399: np.zeros(16)}
    t.upsert(rows(spark, more))
    want |= more
    t.delete(spark.createDataFrame([(7,), (210,), (99_999,)], "vec_id long"))
    want = {k: v for k, v in want.items() if k not in (7, 210)}
    t.upsert(rows(spark, {210: np.arange(16)}))
    want[210] = np.arange(16)
    questions = {i: clustered[i] for i in range(0, 400, 37)}
    for _ in range(2):  # before and after the changes are folded into the base
        assert {r.vec_id for r in t.rows().collect()} == set(want)
        assert found(t.search(asked(spark, questions), 7, probes=None)) == plain(want, questions, 7)
        got = {r.vec_id: r.embedding for r in t.get(spark.createDataFrame([(5,), (7,), (210,), (210,)], "vec_id long")).collect()}
        assert set(got) == {5, 210} and np.allclose(got[5], unit(np.ones((1, 16)))[0])
        t.compact()
    assert len(t.manifest()["parts"]) == 1


def test_probes_read_their_lists_only(spark, tmp_path, clustered, capsys):
    t = VectorTable(spark, str(tmp_path / "v"))
    t.setup(rows(spark, clustered), lists=12)
    questions = {i: clustered[i] for i in range(0, 400, 25)}
    exact = plain(clustered, questions, 10)
    got = found(t.search(asked(spark, questions), 10, probes=3, block=5))  # several blocks of questions
    assert sum(len(set(got[q]) & set(exact[q])) for q in exact) / sum(map(len, exact.values())) >= 0.95
    one = t.search(asked(spark, {0: clustered[0]}), 10, probes=1)
    one.explain()
    assert "PartitionFilters: [" in (plan := capsys.readouterr().out) and "list" in plan.split("PartitionFilters")[1][:60]
    probes = t.calibrate(target=0.95)["probes"]
    assert 1 <= probes <= 6 and t.recall(asked(spark, questions), 10, probes) >= 0.9
    assert found(t.search(asked(spark, questions), 10)) == found(t.search(asked(spark, questions), 10, probes=probes))


def test_calibration_searches_once(spark, tmp_path, clustered, monkeypatch):
    """The fewest probes that reach the target come from one exact search; a task sends on its best rows of a question, not those of each list."""
    t = VectorTable(spark, str(tmp_path / "v"))
    t.setup(rows(spark, clustered), lists=12)
    exact, calls = vectors.nearest, []
    monkeypatch.setattr(vectors, "nearest", lambda *a, **b: calls.append(1) or exact(*a, **b))
    probes = t.calibrate(target=0.9, sample=400)["probes"]
    assert len(calls) == 1
    every = asked(spark, clustered)
    assert t.recall(every, 10, probes) >= 0.9 and (probes == 1 or t.recall(every, 10, probes - 1) < 0.9)
    looked = np.ones((400, 12), bool)
    names = np.arange(400)
    pdf = t.rows().toPandas()
    sent = list(vectors._best_of_lists(type("", (), {"value": (names, unit(np.array([clustered[i] for i in names])), looked)}), "vec_id", "embedding", 10)([pdf, pdf.iloc[:0]]))
    assert sum(map(len, sent)) == 400 * 10


def test_a_hot_vector_is_split(spark, tmp_path):
    t = VectorTable(spark, str(tmp_path / "v"))
    t.setup(rows(spark, {i: [1.0, 0.0] if i < 900 else [0.0, 1.0 + i] for i in range(1000)}), lists=4)
    assert len(t.manifest()["centroids"]) <= 4
    assert found(t.search(asked(spark, {0: [1.0, 0.1]}), 5, probes=1)) == {0: [0, 1, 2, 3, 4]}


def test_wrong_uses(spark, tmp_path, clustered):
    t = VectorTable(spark, str(tmp_path / "v"))
    with pytest.raises(FileNotFoundError):
        t.manifest()
    t.setup(rows(spark, clustered), lists=4)
    with pytest.raises(Conflict):
        t.setup(rows(spark, clustered))
    with pytest.raises(ValueError):
        t.upsert(rows(spark, {1: np.ones(16)}).union(rows(spark, {1: np.zeros(16)})))
    with pytest.raises(Exception, match="numbers in a table"):
        t.upsert(spark.createDataFrame([(1, [1.0, 2.0])], V))
    t.upsert(spark.createDataFrame([(None, [1.0] * 16), (3, None)], V))
    assert t.rows().count() == 400


def test_empty_table(spark, tmp_path):
    t = VectorTable(spark, str(tmp_path / "v"))
    t.setup(spark.createDataFrame([], V))
    assert t.rows().count() == 0 and t.search(asked(spark, {1: [1.0]}), 3, probes=None).count() == 0


def test_centroids_are_of_distinct_vectors():
    assert centroids(np.array([[1.0, 0.0]] * 50), 8).shape == (1, 2)


def test_recall_on_the_tables(spark, data):
    (got,) = custom.vector_backend_recall(spark, data).collect()
    assert got.recall >= 0.95 and got.probes <= got.lists


def test_a_fit_holds_no_product_of_all_rows_and_lists():
    x = unit(np.random.default_rng(5).normal(size=(256 * 200, 8)))
    tracemalloc.start()
    c = centroids(x, 200)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < len(x) * len(c) * 8 / 2
    assert np.array_equal(closest(x[:3000], c), (x[:3000] @ c.T).argmax(1)) and len(closest(x[:0], c)) == 0

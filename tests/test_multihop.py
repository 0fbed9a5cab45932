"""The gate, the walk of many questions at once, and the fusion of multi-hop retrieval."""

import pytest

from vaultspark.operators import graph, multihop

NOTES = [("a", "Red Fox", "person"), ("b", "blue-whale plan!", "project"), ("c", "fox", "concept"), ("d", "Data", "concept"), ("e", "Red Fox", "company"), ("f", "Hub Company", "company"), ("g", "Red", "note")]


@pytest.fixture
def notes(spark):
    return spark.createDataFrame(NOTES, "id string, title string, type string")


@pytest.fixture
def edges(spark):
    rows = [("a", "x"), ("b", "x"), ("x", "y"), ("c", "z"), ("f", "y")] + [("f", f"n{i}") for i in range(40)]
    return spark.createDataFrame(rows, "src string, dst string")


def asked(spark, *questions):
    return spark.createDataFrame(list(enumerate(questions)), "qid int, question string")


def test_mentions_are_whole_words_of_titles(spark, notes):
    q = asked(spark, "what of the RED fox and Blue Whale plan?", "redfox, foxes", "data red", "", "fox")
    got = sorted((r.qid, r.id) for r in multihop.mentions(notes, q).collect())
    assert got == [(0, "a"), (0, "b"), (0, "e")]  # titles of three letters, general ones and plain notes name nothing


def test_hubs_are_beyond_the_quantile(edges):
    assert [r.v for r in multihop.hubs(edges, 0.97).collect()] == ["f"]


def test_walks_of_many_questions_are_those_of_each(spark, edges):
    seeds = {0: ["a"], 1: ["c", "f"], 2: ["nowhere"]}
    rows = spark.createDataFrame([(q, v) for q, vs in seeds.items() for v in vs], "qid int, v string")
    got = {}
    for r in multihop.expand(edges, rows).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.v)
    want = {q: [r.v for r in graph.graph_expand(edges, spark.createDataFrame([(v,) for v in vs], "v string"), k=30).collect()] for q, vs in seeds.items() if q < 2}
    assert got == want


def test_gate_and_fusion(spark, notes, edges):
    q = asked(spark, "red fox and blue whale plan", "hub company and blue whale plan", "nothing")
    flat = spark.createDataFrame([(i, v, r) for i in range(3) for r, v in enumerate(("m", "y", "q"), 1)], "qid int, id string, rank int")
    rows = multihop.gated(flat, q, notes, edges, hub_quantile=0.97).orderBy("qid", "rank").collect()
    of = lambda i: [r.id for r in rows if r.qid == i]
    fired = {r.qid: r.fired for r in rows}
    assert fired == {0: True, 1: False, 2: False}  # a hub and one entity are not two entities
    assert of(1) == of(2) == ["m", "y", "q"]
    assert of(0)[0] == "m" and set(of(0)) >= {"m", "y", "q", "x"}
    best = {r.id: r.score for r in rows if r.qid == 0}
    assert best["m"] == round(1 / 61, 9) and best["x"] <= 0.5 / 61 + 1e-9

"""Operators against plain Python on small cases."""

import io
import zipfile
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from vaultspark.functions import stats, text
from vaultspark.operators import base, graph, multiple, overlap, search
from vaultspark.plans import custom
from vaultspark.sources import ingest
from vaultspark.sources.snapshots import Generations, append_once, diff_sync, supersede
from vaultspark.streaming import ledger


def test_components_and_hops(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (7, 8), (9, 9)], "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 7, 8, 9, 10)], "v long")
    assert dict(graph.components(e, nodes).collect()) == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 9, 10: 10}
    path = spark.createDataFrame([(i, i + 1) for i in range(6)], "src long, dst long")
    assert dict(graph.bfs(path, spark.createDataFrame([(0,)], "v long"), 3).collect()) == {1: 1, 2: 2, 3: 3}


def test_pagerank_is_a_distribution(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 1), (4, 5)], "src long, dst long")
    r = {x.v: x.p for x in graph.personalized_pagerank(e, spark.createDataFrame([(1,)], "v long"), alpha=0.5, rounds=12).collect()}
    assert abs(sum(r.values()) - 1) < 1e-6
    m = np.zeros((5, 5))
    for a, b in ((0, 1), (1, 2), (2, 3), (3, 0), (3, 4)):
        m[a, b] = m[b, a] = 1
    m /= m.sum(1, keepdims=True)
    p = np.array([1.0, 0, 0, 0, 0])
    for _ in range(200):
        p = 0.5 * p @ m + 0.5 * np.array([1.0, 0, 0, 0, 0])
    assert all(abs(r[i + 1] - p[i]) < 1e-3 for i in range(5))


def test_graph_queries_run_their_whole_loops(spark, data):
    """40 rounds and hops to depth 2, in plain Python."""
    e = {(r.src, r.dst) for r in custom._edges(spark, data).collect()}
    near = {}
    for a, b in e:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    p = {1: 0.5, 2: 0.5}
    for _ in range(40):
        q = {s: (0.15 + 0.85 * sum(x for v, x in p.items() if v not in near)) / 2 for s in (1, 2)}
        for v, x in p.items():
            for b in near.get(v, ()):
                q[b] = q.get(b, 0) + 0.85 * x / len(near[v])
        moved, p = sum(abs(q.get(v, 0) - p.get(v, 0)) for v in q.keys() | p.keys()), q
        if moved < 1e-9:
            break
    got = dict(custom.pagerank_converged(spark, data).collect())
    assert got.keys() == p.keys() and all(abs(got[v] - p[v]) < 1e-6 for v in p)
    one = set().union(*(near.get(s, set()) for s in (1, 2))) - {1, 2}
    two = set().union(*(near[v] for v in one)) - one - {1, 2}
    hop = {v: 1 for v in one} | {v: 2 for v in two}
    first = sorted(((-round(x, 12), hop.get(v, 99), v) for v, x in p.items() if v not in (1, 2)))[:20]
    rows = custom.graph_expand_converged(spark, data).collect()
    assert {(r.v, r.hop) for r in rows} == {(v, h) for _, h, v in first} and any(r.hop == 2 for r in rows)


def test_degree_cap(spark):
    e = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.8), (1, 4, 0.7), (2, 3, 0.6)], "a long, b long, score double")
    assert sorted((r.a, r.b) for r in graph.degree_capped(e, cap=2).collect()) == [(1, 2), (1, 3), (2, 3)]


def test_degree_cap_is_the_sequential_rule(spark):
    rng = np.random.default_rng(3)
    e = [(int(a), int(b), float(s)) for a, b, s in {(a, b): (a, b, rng.integers(20) / 20) for a, b in rng.integers(0, 40, (400, 2)) if a < b}.values()]
    used, want = {}, []
    for a, b, s in sorted(e, key=lambda x: (-x[2], x[0], x[1])):
        if used.get(a, 0) < 3 and used.get(b, 0) < 3:
            used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
            want.append((a, b, s))
    df = spark.createDataFrame(e, "a long, b long, score double")
    assert sorted(map(tuple, graph.degree_capped(df, cap=3).collect())) == sorted(want)
    assert sorted(map(tuple, graph.degree_capped(df, cap=3, most=20).collect())) == sorted(want[:20])


@pytest.mark.parametrize("depth", [3, 4, 12])
def test_capped_edges_of_vectors_are_those_of_all_pairs(spark, depth):
    rnd = np.random.default_rng(depth)
    x = rnd.integers(-2, 3, (70, 5)) / 2.0  # many ties
    x[40:52] = x[40]  # copies
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(99, None)], "vec_id long, embedding array<double>")
    pairs = sorted((-round(float(x[a] @ x[b]), 6), a, b) for a in range(70) for b in range(a + 1, 70) if x[a] @ x[b] >= 0.5)
    degree, want = dict.fromkeys(range(70), 0), []
    for s, a, b in pairs:
        if degree[a] < 3 and degree[b] < 3:
            degree[a], degree[b] = degree[a] + 1, degree[b] + 1
            want.append((a, b, -s))
    got = graph.similar_capped(df, 0.5, cap=3, depth=depth)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 50
    lists = search.similar_lists(df, 0.5, 4, small=16)
    near = [(a, b, -s) for s, a, b in sorted([(s, a, b) for s, a, b in pairs] + [(s, b, a) for s, a, b in pairs])]
    assert sorted(map(tuple, lists.select("v", "u", "score").collect())) == sorted(r for v in range(70) for r in [p for p in near if p[0] == v][:4])
    assert graph.similar_capped(df, 99.0).count() == 0


def test_vector_pairs_and_clusters_are_of_all_vectors(spark, data, tmp_path):
    """Ids that 20 doesn't divide, copies, and clusters joined by other members."""
    x = np.random.default_rng(1).normal(size=(60, 16))
    x[7], x[9] = x[3] + 0.05 * x[50], x[3] + 0.05 * x[50] + 0.05 * x[51]
    x[33] = x[31] = x[21]
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    for name, df in (("embeddings", v), ("documents", spark.range(40).withColumnRenamed("id", "doc_id"))):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    for path in Path(data).glob("*.parquet"):
        if not (tmp_path / path.name).exists():
            (tmp_path / path.name).symlink_to(path)
    dots = np.round(x.astype(float) @ x.astype(float).T, 6)
    want = lambda least: {(i, j) for i in range(60) for j in range(i + 1, 60) if dots[i, j] >= least}
    assert want(0.9) >= {(3, 7), (7, 9), (21, 31), (21, 33), (31, 33)}
    assert {(r.a, r.b) for r in search.similar_pairs(v, 0.35, block=16).collect()} == want(0.35)
    assert {(r.a, r.b) for r in search.similar_pairs(v, 0.9, block=16).collect()} == want(0.9)
    assert {(r.a, r.b) for r in custom.near_duplicate_vector_pairs(spark, str(tmp_path)).collect()} == want(0.3)
    assert dict(search.similar_clusters(v, 0.9, block=16).collect()) == {3: 3, 7: 3, 9: 3, 21: 21, 31: 21, 33: 21}
    root = {i: i for pair in want(0.4) for i in pair}
    while any(root[a] != root[b] for a, b in want(0.4)):
        for a, b in want(0.4):
            root[a] = root[b] = min(root[a], root[b])
    assert dict(custom.semantic_clusters(spark, str(tmp_path)).collect()) == root
    chosen = custom.capped_edge_selection(spark, str(tmp_path)).collect()
    assert {(r.a, r.b) for r in chosen} >= {(3, 7), (7, 9), (21, 31)} and len(chosen) <= 2 * custom._edges(spark, str(tmp_path)).count()


def test_cross_tier_pairs(spark):
    rng = np.random.default_rng(5)
    texts = []
    for i in range(12):
        base = [f"w{x}" for x in rng.integers(0, 300, 60)]
        texts += [base, base[:50] + [f"v{i}{x}" for x in range(10)], [str(x) for x in rng.permutation(base)], base]
    rows = [(i, i % 3, t) for i, t in enumerate(texts)] + [(100, 0, []), (101, 1, ["w1"]), (102, 2, ["w1"]), (103, 2, None)]
    got = overlap.cross_tier_pairs(spark.createDataFrame(rows, "k long, tier int, tokens array<string>")).collect()
    jac = lambda x, y: len(x & y) / len(x | y) if x and y else 0.0
    runs = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    want, classes = {}, {}
    for i, s, t in rows:
        classes.setdefault((s, str(t)), (i, s, t))  # the fourth of four equals the first, in its tier
    for i, s, t in classes.values():
        for j, r, u in classes.values():
            if i < j and s != r and t and u:
                sj, wj = jac(runs(t), runs(u)), jac(set(t), set(u))
                if max(sj, wj) >= 0.6:
                    want[i, j] = (round(sj, 6), round(wj, 6), "decided" if sj >= 0.6 else "undecided")
    assert {(r.a, r.b): (r.shingle_jaccard, r.word_jaccard, r.verdict) for r in got} == want
    assert {v[2] for v in want.values()} == {"decided", "undecided"} and {r.copies_a for r in got} >= {1, 2}


def test_cross_tier_candidates_are_few(spark):
    """Texts of one small vocabulary share many words, but hardly a pair of them may reach the value; none that does is lost, in blocks of any size."""
    rng = np.random.default_rng(11)
    docs = [[f"w{x}" for x in rng.zipf(1.3, 80) if x < 2000] for _ in range(150)]
    docs += [t[:-3] + ["other", "end"] for t in docs[:20]]
    table = spark.createDataFrame([(i, i % 4, t) for i, t in enumerate(docs)], "k long, tier int, tokens array<string>")
    jac = lambda x, y: len(x & y) / len(x | y)
    want = {(i, j) for i in range(170) for j in range(i + 1, 170) if i % 4 != j % 4 and jac(set(docs[i]), set(docs[j])) >= 0.6}
    assert len(want) >= 10
    for block in (2, 2000):
        got = {(r.a, r.b) for r in overlap.candidates(table, shingle=5, percent=60, block=block).collect()}
        assert want <= got and len(got) <= 3 * len(want) + 50


def test_cross_tier_candidates_shuffle_no_pairs(spark):
    """Texts of common words share many of their rarest ones, but no row is shuffled for an item or for a pair that shares too little."""
    rng = np.random.default_rng(13)
    docs = [[f"w{x}" for x in rng.integers(0, 2000, 120)] for _ in range(600)]
    table = spark.createDataFrame([(i, i % 4, t) for i, t in enumerate([*docs, *(t[:-2] for t in docs[:9])])], "k long, tier int, tokens array<string>")

    def shuffled():
        context = spark.sparkContext._jsc.sc()
        context.listenerBus().waitUntilEmpty(30_000)
        stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = shuffled()
    got = {(r.a, r.b) for r in overlap.candidates(table, shingle=5, percent=60).collect()}
    assert {(i, 600 + i) for i in range(9) if i % 4 != (600 + i) % 4} <= got
    assert shuffled() - before < 10 * len(docs)


def test_sketches_are_mergeable_and_screened_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(7)
    texts = [[f"w{x}" for x in rng.integers(0, 400, n)] for n in (0, 3, 90, 500, 900)]
    rows = spark.createDataFrame([(texts[i], texts[j]) for i in range(5) for j in range(5)], "a array<string>, b array<string>")
    assert rows.filter(overlap.sketch(F.concat("a", "b")) != overlap.merged(overlap.sketch(F.col("a")), overlap.sketch(F.col("b")))).count() == 0
    docs = []
    for i in range(30):
        base = ["common"] * 5 + [f"w{x}" for x in rng.integers(0, 200, 60)]
        docs += [base, base[:55] + [f"v{i}{x}" for x in range(6)], ["common", *base]]
    table = spark.createDataFrame([(i, i % 4, t) for i, t in enumerate(docs)], "k long, tier int, tokens array<string>")
    whole = sorted(map(str, overlap.cross_tier_screened(table).collect()))
    assert len(whole) > 20 and whole == sorted(map(str, overlap.cross_tier_screened(table, block=3).collect()))
    assert set(whole) <= set(map(str, overlap.cross_tier_pairs(table, least_tokens=40).collect()))
    (told,) = overlap.coverage(table).collect()
    assert told.population == told.comparable == 90 and told.recall >= 0.95


def test_fusion_and_priors(spark):
    a = spark.createDataFrame([(0, 1, 1), (0, 2, 2)], "qid long, doc_id long, rank int")
    b = spark.createDataFrame([(0, 2, 1)], "qid long, doc_id long, rank int")
    got = {r.doc_id: r.score for r in search.fuse({"lexical": a, "dense": b}).collect()}
    assert got == {1: 0.25, 2: 0.45}
    assert search.fusion_constant(60) == (3, True) and search.fusion_constant(10) == (10, False)
    d = spark.createDataFrame([("2024-01-01",), ("2030-01-01",), ("unknown",), (None,)], "d string")
    f = [r[0] for r in d.select(search.recency(F.col("d"), "2024-06-29")).collect()]
    assert f[1:] == [1.0, 1.0, 1.0] and abs(f[0] - (1 - 0.25 * 0.5)) < 1e-9


def test_bm25_and_nearest(spark):
    docs = spark.createDataFrame([(1, "red fox red"), (2, "blue fox"), (3, None)], "doc_id long, text string")
    q = spark.createDataFrame([(0, "red"), (0, "fox")], "qid long, term string")
    got = [r.doc_id for r in search.bm25(docs, q).orderBy("rank").collect()]
    assert got == [1, 2]
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "vec_id long, embedding array<float>")
    near = search.nearest(v, spark.createDataFrame([(9, [4.0, 1.0])], "qid long, q array<double>"), n=2).orderBy("rank").collect()
    assert [r.vec_id for r in near] == [4, 3]


def test_demotion(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], 0.9), (2, [1.0, 0.01], 0.8), (3, [0.0, 1.0], 0.7)], "vec_id long, embedding array<double>, score double")
    assert [(r.vec_id, r.demoted) for r in search.near_duplicate_demotion(v, threshold=0.95).orderBy("place").collect()] == [(1, False), (3, False), (2, True)]


def test_demotion_of_many_is_the_walk(spark):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(25, 4))
    rows = [(i, (base[i % 25] + 0.05 * rng.normal(size=4)).tolist(), float(np.round(rng.random(), 2)), bool(i % 4)) for i in range(120)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double, may boolean")
    for eligible in (None, "may"):
        one, many = (sorted(map(tuple, search.near_duplicate_demotion(v, threshold=0.98, eligible=eligible, limit=n).select("vec_id", "place", "demoted").collect())) for n in (8000, 10))
        assert one == many and sum(d for *_, d in one) > 20


def test_statistics():
    assert stats.paired_permutation([1, 1, 1]) == 0.25 and stats.paired_permutation([]) == 1.0
    mean, low, high = stats.bootstrap_ci([0.1, 0.2, 0.3])
    assert low <= mean <= high and stats.bootstrap_ci([]) == (0.0, 0.0, 0.0)
    adjusted, out = stats.benjamini_hochberg([0.01, 0.04, 0.03, 0.5])
    assert np.allclose(adjusted, [0.04, 0.04 * 4 / 3, 0.04 * 4 / 3, 0.5]) and out == [True, False, False, False]
    assert stats.minimum_detectable_effect(100, 0) == 0 and 0.27 < stats.minimum_detectable_effect(100, 1) < 0.29
    assert abs(stats.achieved_power(stats.minimum_detectable_effect(50, 1), 50, 1) - 0.8) < 1e-3


def test_text_functions():
    assert text.identity("  Café  STRASSE ") == "café strasse"
    assert text.fold("Ação—Über!") == "acao-uber" or text.fold("Ação Über!") == "acao-uber"
    meta, body = text.split_front_matter("---\nid: a\naliases:\n  - x\n  - y\ntags: [p, q]\n---\nBody")
    assert meta == {"id": "a", "aliases": ["x", "y"], "tags": ["p", "q"]} and body == "Body"
    assert text.split_front_matter("no fence") == ({}, "no fence")
    assert "b: 2" in text.set_keys("---\na: 1\nb: 1\n---\nx", {"b": "2"})
    parts = text.chunks("# One\n\nshort\n\nalso short\n\n# Two\n\n" + "word " * 600)
    assert parts[0]["text"] == "short\n\nalso short" and all(len(p["text"]) <= 1400 for p in parts)
    assert "".join(p["text"] for p in parts).replace(" ", "").endswith("word")
    page = text.html_to_text("<title>A &amp; B</title><script>x()</script><p>one<br>two</p>")
    assert page["title"] == "A & B" and "x()" not in page["body"] and "one\ntwo" in page["body"]
    assert text.markdown_table([["a", ""], [None, None], ["1", "x\ny"]]) == "| a |  |\n| --- | --- |\n| 1 | x y |"
    assert text.markdown_table([["a", "b"], ["1"]]) == "```table-unparsed\na | b\n1\n```" and text.markdown_table([[""]]) == ""
    assert text.markdown_table([["a", "b"]]).startswith("```table-unparsed")
    meta, body = text.split_front_matter("---\nid: 'a: b'\nempty:\nlist: []\n---\n\nx\n---\ny")
    assert meta == {"id": "a: b", "list": []} and body == "x\n---\ny" and text.split_front_matter("--- no\n---\n")[0] == {}
    assert text.set_keys("---\na: 1\n---\nx", {"a": "2", "c": "3"}) == "---\na: 2\nc: 3\n---\nx"
    page = text.html_to_text("<p>a &lt;b&gt;</p><!-- <p>no</p> --><STYLE>x</STYLE><div>c<b>d</b></div><script>y")
    assert page == {"title": "", "body": "a <b>\n\ncd"}
    assert abs(np.linalg.norm(text.hash_vector("some words here")) - 1) < 1e-12 and not text.hash_vector("").any()


def test_archives_that_lie():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("big.txt", "a" * 5_000_000)
        for name in ("C:/x.txt", "../up.txt", "/abs.txt", " "):
            z.writestr(name, "x")
        device = zipfile.ZipInfo("dev")
        device.create_system, device.external_attr = 3, 0o020644 << 16
        z.writestr(device, "x")
    raw = out.getvalue().replace((5_000_000).to_bytes(4, "little"), (10).to_bytes(4, "little"))  # declares ten bytes
    found = {n.partition("!")[2]: x for n, x in ingest.expand("a.zip", raw)}
    assert all(isinstance(x, ingest.Quarantine) for x in found.values()) and len(found) == 6
    z = zipfile.ZipFile(io.BytesIO(out.getvalue()))
    assert ingest._unpacked(z, z.getinfo("big.txt"), 4_000_000) is None and len(ingest._unpacked(z, z.getinfo("big.txt"), 5_000_000)) == 5_000_000


def test_ingest(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T\n\n" + "plenty of text in this note " * 3)
    (tmp_path / "b.txt").write_text("short")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-")
    (tmp_path / "m.eml").write_bytes(b"From: a@b.c\r\nSubject: Hi\r\nMessage-ID: <1@x>\r\nReferences: <0@x> <9@x>\r\n\r\n" + b"a long enough body of a message, really long\r\n")
    inner, outer = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep.txt", "text that lies deep in nested archives, and is long")
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("in.zip", inner.getvalue())
        z.writestr("../evil.txt", "x")
    (tmp_path / "z.zip").write_bytes(outer.getvalue())
    rows = {r.member.rsplit("/", 1)[-1].split("!")[-1]: r for r in ingest.ingest(spark, str(tmp_path)).collect()}
    assert rows["a.md"].status == rows["m.eml"].status == rows["deep.txt"].status == "processed"
    assert '"conversation_id": "<0@x>"' in rows["m.eml"].meta and rows["m.eml"].title == "Hi"
    assert rows["b.txt"].reason == "too little text" and rows["c.pdf"].status == "quarantined"
    assert any("leaves the archive" in (r.reason or "") for r in rows.values())
    known = spark.createDataFrame([(rows["a.md"].sha256,)], "sha256 string")
    assert {r.member.rsplit("/", 1)[-1]: r.status for r in ingest.ingest(spark, str(tmp_path), known).collect()}["a.md"] == "duplicate"


def test_vault_scan(spark, tmp_path):
    for name, body in (("brain/a.md", "---\nid: a\ntitle: A\n---\nx"), ("raw/b.md", "---\ntitle: B\n---\ny"), ("brain/plain.md", "no front matter"), ("inbox/c.md", "---\nid: c\n---\nz"), ("brain/backlinks.md", "---\nid: d\n---\nz")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    got = {r.id: (r.type, r.zone) for r in ingest.vault_notes(spark, str(tmp_path)).collect()}
    assert got == {"a": ("note", "brain"), "b": ("source", "raw")}


def test_sinks(spark, tmp_path):
    g = Generations(spark, str(tmp_path / "t"))
    for n in (1, 2, 3):
        assert g.write(spark.range(n), keep=2) == n
    assert g.numbers() == [2, 3] and g.read().count() == 3 and g.read(2).count() == 2
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], "path string, content_hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("e", "3"), ("f", "5")], "path string, content_hash string")
    assert {r.path: r.action for r in diff_sync(old, new).collect()} == {"a": "unchanged", "b": "updated", "e": "rebased", "f": "added", "d": "deleted"}
    notes = spark.createDataFrame([("x", None, None, None, None), ("y", None, None, None, None)], "id string, is_latest_version string, superseded_by string, superseded_date string, previous_version string")
    got = {r.id: r for r in supersede(notes, spark.createDataFrame([("x", "y")], "old_id string, new_id string"), "2024-05-01").collect()}
    assert got["x"].is_latest_version == "false" and got["x"].superseded_by == "y" and got["y"].previous_version == "x"
    assert append_once(old, old.unionByName(new), "path").count() == 2


def test_late_events_change_nothing(spark, tmp_path):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    rows = [(3, "2024-01-03 00:00:00", 1, "purchase"), (1, "2024-01-01 00:00:00", 1, "error"), (2, "2024-01-02 00:00:00", 2, "view")]
    for i, r in enumerate(rows):  # a file for each batch, out of order
        one = spark.createDataFrame([r], "event_id long, t string, user_id long, event_type string").selectExpr("event_id", "CAST(t AS timestamp_ntz) AS ts", "user_id", "event_type", "1.0D AS value", "'{}' AS props")
        one.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = ledger.spine(ledger.events_stream(spark, str(tmp_path / "in"), schema, files_per_batch=1))
    got = {r.commitment_id: (r.events, r.status, r.last_event) for r in ledger.drain(s, str(tmp_path / "out"), "update", last_by="commitment_id").collect()}
    assert got == {1: (2, "done", 3), 2: (1, "open", 2)}


def test_adjusted_p_values(spark):
    rng = np.random.default_rng(4)
    p = [*map(float, np.round(rng.random(300), 3)), 0.0, 1.0, 1.0]
    order = np.argsort(p, kind="stable")
    raw = np.minimum(1.0, np.minimum.accumulate((np.array(p)[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1])
    want = dict(zip(order.tolist(), raw.tolist()))
    table = spark.createDataFrame([*enumerate(p), (999, None)], "i int, p double").repartition(5)
    got = {r.i: r.adjusted for r in multiple.benjamini_hochberg(table, key="i").collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want)
    assert multiple.benjamini_hochberg(table.limit(0), key="i").count() == 0


def test_numbers_in_order(spark):
    rows = spark.createDataFrame([(i, i % 7) for i in range(500)], "i int, k int").repartition(6)
    got, _ = base.in_order(rows, F.desc("k"), F.col("i"))
    assert [(r.k, r.i) for r in got.orderBy("n_").collect()] == sorted(((k % 7, k) for k in range(500)), key=lambda x: (-x[0], x[1])) and sorted(r.n_ for r in got.collect()) == list(range(1, 501))

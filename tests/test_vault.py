"""The vault's verbs, plugged-in parts and append-only logs on small cases."""

import datetime

import pytest
from pyspark.sql import functions as F

from vaultspark.api import Vault
from vaultspark.functions import languages, text
from vaultspark.operators import alerts, probes, protocols, structured, versions
from vaultspark.sources import ledgers

NOTE = "id string, title string, type string, classification string, zone string, path string, created string, updated string, document_date string, effective_date string, superseded_date string, is_latest_version string, superseded_by string, body string"


@pytest.fixture(scope="session")
def notes(spark):
    rows = [
        ("a", "Red Fox Plan", "decision", "Public", "brain", "brain/a.md", "2024-01-01", "2024-02-01", "", "", "2024-06-01", "false", "b", "the red fox\nold plan [[b]]"),
        ("b", "Red Fox Plan Two", "decision", "Internal", "brain", "brain/b.md", "2024-05-01", "2024-06-01", "", "", "", "true", None, "the red fox\nnew plan [[c|Source]] [[nowhere]]"),
        ("c", "Fox source", "source", None, "raw", "raw/c.md", "2024-07-01", "2024-07-01", "unknown", "", "", None, None, "a source about the fox"),
        ("d", "Other", "note", "internal", "brain", "brain/d.md", "2024-03-01", "2024-03-01", "", "2023-01-01", "", None, None, "nothing here"),
        ("e", "Copy", "note", "Public", "brain", "brain/e.md", "2024-03-02", "2024-03-02", "", "", "", None, None, "nothing here  "),
    ]
    return spark.createDataFrame(rows, NOTE)


def ids(df):
    return [r.id for r in df.collect()]


def test_structured_reads(notes):
    v = Vault(notes)
    assert ids(v.bases_query({"type": "decision", "unknown": 1})) == ["b", "a"]
    assert ids(v.bases_query({"type": "decision"}, latest_only=True)) == ["b"]
    assert ids(v.bases_query(as_of="2024-05-15", order_by="nonsense")) == ["b", "e", "d", "a"]
    assert ids(v.bases_query(as_of="2024-06-01", k=2)) == ["b", "e"] and ids(v.bases_query(k=0)) == []
    assert ids(v.recent(2)) == ["c", "b"] and ids(v.get("d")) == ["d"]
    assert [(r.id, r.match_count, r.terms_matched) for r in v.grep("red plan").collect()] == [("a", 2, 2), ("b", 2, 2)]
    assert ids(v.grep("fo.$", regex=True)) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        v.grep("x" * 201)
    assert v.stats().first().live == 4


def test_tiers(notes):
    kept, report = structured.egress(notes, "Internal")
    assert sorted(ids(kept)) == ["a", "b", "e"]
    assert tuple(report.first()) == (5, 3, 2, 2, 1)
    assert ids(structured.unclassified(notes)) == ["c", "d"]
    assert structured.clamp("Restricted", "Internal") == "Internal" and structured.clamp("bad", "Internal") == "Public"
    assert tuple(structured.freshness(notes, "2024-01-15", "Internal").first()) == (2, "2024-05-01")


def test_chains_and_links(spark, notes):
    heads = structured.chain_heads(notes, notes.select("id")).collect()
    assert [tuple(r) for r in heads] == [("a", "b", 1)]
    loop = spark.createDataFrame([("x", "y"), ("y", "x")], "id string, superseded_by string")
    assert {(r.start_id, r.at_id) for r in structured.supersession_chain(loop, loop.select("id")).collect()} == {("x", "y"), ("y", "x")}
    edges, lost = structured.link_graph(notes)
    assert sorted(map(tuple, edges.collect())) == [("a", "b"), ("b", "c")] and [tuple(r) for r in lost.collect()] == [("b", "nowhere")]
    assert [r.v for r in Vault(notes).expand(["a"], depth=1, k=5).collect()][0] == "b"


def test_search(spark, notes):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 1.0]), ("d", [0.1, 0.9])], "id string, embedding array<double>")
    v = Vault(notes, vectors)
    hits = v.search("red fox plan", [0.0, 1.0], k=5).collect()
    assert hits[0].id == "a" and hits[0].evidence == "exact_title_match" and hits[0].create_safety == "exists"
    by = {h.id: h for h in hits}
    assert by["b"].evidence == "title_phrase_match" and by["c"].source == "both" and by["d"].evidence == "high_vector_match"
    assert {h.id for h in v.search("red fox plan", [0.0, 1.0], k=5, max_tier="Public").collect()} <= {"a", "e"}
    assert {h.id for h in v.search("fox", rrf_k=10, k=5).collect()} == {"a", "b", "c"}
    assert v.search("zebra", k=5).count() == 0 and v.search("fox", k=0).count() == 0
    assert v.search_multi(["fox", " FOX ", "red"], k=5).first().id in ("a", "b")
    parts = {(r.id, r.part): r.tensions for r in v.dossier("fox", k=4).collect()}
    assert parts[("b", "decision")] == 1 and ("a", "decision") not in parts  # an "unknown" date sorts after every date


def test_search_stages(spark):
    long = "red whale " * 200
    row = lambda i, title, zone="brain", latest=None, by=None, body=long, path=None, tier="Public": (i, title, "note", tier, zone, path or f"{zone}/{i}.md", "2024-01-01", "2024-01-01", "", "", "", latest, by, body)
    rows = [
        row("v1", "Old", latest="false", by="v2", path="brain/x/v1.md"), row("v2", "Mid", latest="false", by="v3"), row("v3", "New"),  # one family: v3 stands for it
        row("w1", "Loop", by="w2", tier="Public"), row("w2", "Loop two", by="w1", tier="MNPI"),  # tiers differ: not folded
        row("s1", "Stub", by="s2", body="red"), row("s2", "Stub two", body="red"),  # below the floor
        row("o1", "Same Name", latest="false", body="same name same name"), row("o2", "Same Name", body="same name of another"),
        row("t1", "Call", zone="transcript", body="x"), row("t2", "Call again", zone="transcript", body="y"), row("t3", "Base", body="z"),
    ]
    vectors = spark.createDataFrame([("t3", [1.0, 0.0]), ("t1", [0.99, 0.1]), ("t2", [0.98, 0.1]), ("v1", [0.0, 1.0])], "id string, embedding array<double>")
    v = Vault(spark.createDataFrame(rows, NOTE), vectors)
    hits = {h.id: h for h in v.search("red", k=20).collect()}
    assert set(hits) == {"v3", "w1", "w2", "s1", "s2"} and hits["v3"].duplicates == ["v1", "v2"] and not hits["s2"].duplicates
    assert len(v.search("red", k=20, collapse=False).collect()) == 7
    owners = [(h.id, h.evidence, h.create_safety) for h in v.search("same name", k=20).collect()]
    assert owners == [("o2", "exact_title_match", "probable"), ("o1", "exact_title_match", "probable")]  # the live one first, in the places that they hold
    order = [h.id for h in v.search("nothing", [1.0, 0.0], k=4).collect()]
    assert order == ["t3", "t1", "t2", "v3"]  # v3 stands for v1
    assert [h.id for h in v.search("nothing", [1.0, 0.0], k=4, demote=0.95).collect()] == ["t3", "v3", "t1", "t2"]
    assert [h.id for h in v.search("nothing", [1.0, 0.0], k=4, zones={"transcript": 3.0}).collect()][:2] == ["t1", "t2"]


def test_aliases(spark, notes):
    """An alias is the stronger name: its owner is found, pinned, and told by it; only notes of the brain have any."""
    some = notes.withColumn("aliases", F.when(F.col("id").isin("d", "c"), F.array(F.lit("Night  Owl"), F.lit("Copy"))))
    owners = {(r.name, r.id): (r.by_alias, r.owners, r.place) for r in structured.name_owners(some).collect()}
    assert owners["night owl", "d"] == (1, 1, 1) and owners["copy", "d"][:2] == (1, 2) and owners["copy", "e"][:2] == (0, 2) and ("night owl", "c") not in owners
    hit = Vault(some).search("night owl").first()
    assert (hit.id, hit.evidence, hit.create_safety) == ("d", "alias_hit", "exists")
    two = {r.id: (r.evidence, r.create_safety) for r in Vault(some).search("COPY").collect()}
    assert two["d"] == ("alias_hit", "probable") and two["e"] == ("exact_title_match", "probable")


def test_inline_lists_respect_quotes():
    meta, _ = text.split_front_matter("---\naliases: [\"a, b\", 'it''s', c d , \"say \\\"x\\\"\"]\ntitle: T # comment\nhash: '#x'\nempty: []\nlist:\n  - \"p, q\"\n  - r\n---\nbody")
    assert meta == {"aliases": ["a, b", "it's", "c d", 'say "x"'], "title": "T", "hash": "#x", "empty": [], "list": ["p, q", "r"]}


def test_duplicates(notes):
    assert {(r.id, r.canonical) for r in Vault(notes).exact_duplicates().collect()} == {("e", True), ("d", False)}


def test_plugged_in_parts(spark):
    rows = spark.createDataFrame([(1, "red fox"), (2, None), (3, "blue whale")], "doc_id long, text string")
    got = {r.doc_id: r.embedding for r in protocols.embed(rows, protocols.HashEmbedder(), key="doc_id", text="text").collect()}
    assert len(got[1]) == 384 and not any(got[2]) and abs(sum(x * x for x in got[3]) - 1) < 1e-9
    t = protocols.VectorTable(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>"))
    t = t.upsert(spark.createDataFrame([(2, [1.0, 0.1]), (3, [0.5, 0.5])], "vec_id long, embedding array<double>")).delete(spark.createDataFrame([(1,)], "vec_id long"))
    q = spark.createDataFrame([(0, [1.0, 0.0])], "qid long, q array<double>")
    assert [r.vec_id for r in t.search(q, 2).orderBy("rank").collect()] == [2, 3]

    class ByLength:
        def rerank(self, query, passages):
            return [len(p) for p in passages]

    hits = spark.createDataFrame([(i, i, "x" * i) for i in range(1, 13)], "doc_id long, rank int, text string")
    order = [r.doc_id for r in protocols.rerank(hits, ByLength(), "q", window=10).orderBy("rank").collect()]
    assert order == [*range(10, 0, -1), 11, 12]


def test_audit_chain(spark, tmp_path):
    folder = str(tmp_path / "audit")
    ledgers.append_audit(spark, folder, [{"ts": "1", "verb": "write", "path": "a", "reason": "r", "content_sha256": "x"}, {"ts": "2", "verb": "write", "path": "b", "reason": "r"}])
    ledgers.append_audit(spark, folder, [{"ts": "3", "verb": "delete", "path": "a", "reason": "r"}])
    rows = spark.read.parquet(folder)
    assert rows.count() == 3 and ledgers.verify_audit(rows).count() == 0
    bad = rows.withColumn("line", F.when(F.col("seq") == 1, F.concat("line", F.lit(" "))).otherwise(F.col("line")))
    assert [tuple(r) for r in ledgers.verify_audit(bad).collect()] == [(2, "broken link")]
    assert [tuple(r) for r in ledgers.verify_audit(rows.filter("seq <> 2")).collect()] == [(3, "gap")]


def test_logs(spark, tmp_path):
    folder = str(tmp_path / "log")
    ledgers.write_monthly(spark.createDataFrame([("2024-01-05", 1), ("2024-03-01", 2), ("2024-05-09", 3)], "at string, n int"), folder)
    assert ledgers.prune_months(spark, folder, datetime.date(2024, 5, 20)) == ["2024-01"]
    assert spark.read.json(folder).count() == 2
    live = spark.createDataFrame([("r1", 2, "2024-05-02", 1.0), ("r2", 3, "2024-05-03", 2.0)], "run_id string, seq long, ts string, v double")
    old = spark.createDataFrame([("r1", 1, "2024-05-01", 9.0), ("r0", 0, "2023-01-01", 9.0)], "run_id string, seq long, ts string, v double")
    assert [(r.run_id, r.v) for r in ledgers.health_records(live, old, since="2024-04-01").collect()] == [("r1", 1.0), ("r2", 2.0)]
    text = ledgers.draft("hello", "n1", "2024-05-01")
    assert text.startswith("---\nid: n1\n") and "classification: MNPI" in text and text.endswith("hello")


def test_inbox_stream(spark, tmp_path):
    box = tmp_path / "inbox"
    box.mkdir()
    (box / "a.txt").write_text("a text that is long enough to become a note of its own")
    (box / "b.bin").write_bytes(b"\0\1")
    go = lambda: ledgers.drain_inbox(spark, str(box), str(tmp_path / "out"), str(tmp_path / "bad"), str(tmp_path / "cp"))
    go()
    (box / "c.txt").write_text("another text that is long enough to become a note, later")
    go()
    read = lambda p: spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / p)).count()
    assert read("out") == 2 and read("bad") == 1


def test_health_log(spark, tmp_path):
    folder = str(tmp_path / "health")
    put = lambda day, **o: ledgers.append_health(spark, folder, {"run": day, "v": 1}, now=f"{day}T10:00:00", **o)
    assert put("2024-01-01") is None and put("2024-01-02") is None
    assert spark.read.json(f"{folder}/live").count() == 2
    first = put("2024-01-03", most_bytes=60)
    assert first == "health-20240103T100000" and spark.read.json(f"{folder}/live").count() == 1
    assert put("2024-01-03", most_bytes=10) == first + "-1" and spark.read.json(f"{folder}/archive/*").count() == 3
    assert put("2024-06-01", most_bytes=10) == "health-20240601T100000"  # the parts of January are over ninety days old
    assert [r.run for r in spark.read.json(f"{folder}/archive/*").collect()] == ["2024-01-03"]


def test_alerts(spark):
    feeds = spark.createDataFrame([("a", "2024-05-01", True, True), ("b", "2024-04-01", True, True), ("c", None, True, True), ("d", None, False, True), ("e", None, False, False), ("f", "2024-05-02", True, True)], "vault string, at string, has_feed boolean, has_run boolean")
    findings = spark.createDataFrame([("a", "drift"), ("a", "drift"), ("a", "blocked:x"), ("a", "new-thing"), ("a", "Bad Key"), ("a", "synthesis-watchdog"), ("a", None), ("b", "drift")], "vault string, key string")
    got = alerts.collect(alerts.degradation(feeds, findings, today="2024-05-02", declared=F.col("key").isin("drift", "blocked:x"))).collect()
    assert sorted(map(tuple, got)) == [
        ("a", "degradation", "blocked:x, drift"), ("a", "degradation:unrecognised-key", "1"), ("a", "degradation:untriaged", "new-thing"),
        ("b", "maintain:stale", "31 days"), ("c", "maintain:unparseable-feed", ""), ("d", "maintain:no-feed", ""),
    ]
    assert alerts.degradation(feeds.limit(0), findings.limit(0), today="2024-05-02", declared=F.lit(True)).count() == 0


def test_probes(notes):
    v = Vault(notes)
    asked = [
        {"id": "current", "class": "currency", "anchor_id": "a", "weight": 2},
        {"id": "lost", "class": "currency", "anchor_id": "zz"},
        {"id": "fresh", "class": "freshness", "max_age_days": 30},
        {"id": "old", "class": "freshness", "max_age_days": 3},
        {"id": "state", "class": "decision_state", "query": "fox", "anchor_id": "a"},
        {"id": "claim", "class": "decision_state", "query": "fox", "claim_any": ["NEW plan"]},
        {"id": "tension", "class": "tension", "query": "fox", "anchor_id": "a"},
        {"id": "bad", "class": "other"},
        {"id": "none", "class": "decision_state", "query": "fox"},
    ]
    rows = probes.run_probes(v, asked, today="2024-07-11").collect()
    assert {r.probe: r.status for r in rows} == {"current": "pass", "lost": "invalid", "fresh": "pass", "old": "fail", "state": "pass", "claim": "pass", "tension": "pass", "bad": "invalid", "none": "invalid"}
    assert {(r.score, r.disposition) for r in rows} == {(round(6 / 7, 4), "regression")}
    assert {r.disposition for r in probes.run_probes(v, asked[:2], today="2024-07-11").collect()} == {"action_required"}
    assert {r.disposition for r in probes.run_probes(v, asked[:1], today="2024-07-11").collect()} == {"ok"}


def test_languages(spark):
    told = languages.telling(languages.merged({"xx": {"stopwords": ["the", " Foo "]}, "bad": {"stopwords": []}, "worse": 3}))
    assert "the" not in told["en"] and told["xx"] == ["foo"] and "bad" not in told and "de" not in told["pt"] and "de" not in told["es"]
    rows = [("The plan is for the team", "en"), ("IS OF TO", "unknown"), ("The IS of", "unknown"), ("el los las", "es"), ("el los the and", "unknown"), ("não também já", "pt"), ("", "unknown"), (None, "unknown"), ("Foo foo foo " * 900, "unknown")]
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, text string").select("i", languages.language_of("text", languages.BUILT_IN).alias("l")).orderBy("i").collect()
    assert [r.l for r in got] == [lang for _, lang in rows]
    assert languages.merged({"profiles": {"FR": {"stopwords": ["le"]}}})["fr"] == ("le",)


def test_version_links(spark):
    names = spark.createDataFrame([("Contract_v2 final.docx",), ("2024-05-01 Contract (2).pdf",), ("contract draft",), ("doc v3",), ("Revisão 12 do plano",), (None,)], "n string")
    got = [(r.s, tuple(r.m) if r.m else None) for r in names.select(versions.stem(F.col("n")).alias("s"), versions.marker(F.col("n")).alias("m")).collect()]
    assert got == [("contract", ("num", 2)), ("contract", None), ("contract", ("word", 0)), (None, ("num", 3)), ("do plano", ("num", 12)), (None, None)]
    schema = "id string, date string, committed string, stem string, conversation string, sender string, marker struct<scale: string, n: int>, retired boolean, has_predecessor boolean, body_sha string, vector array<double>"
    note = lambda i, date, stem=None, mark=None, conv=None, sha=None, retired=False, vec=None: (i, date, date, stem, conv, None, mark, retired, False, sha or i, vec)
    rows = [
        note("a1", "2024-01-01", "plan", ("num", 1)), note("a2", "2024-02-01", "plan", ("num", 2)), note("a3", "2024-03-01", "plan", ("word", 0)),
        note("b1", "2024-01-01", "note", vec=[1.0, 0.0]), note("b2", "2024-02-01", "note", vec=[1.0, 0.01]), note("b3", "2024-02-02", "note", vec=[0.0, 1.0]), note("b4", "2024-02-03", "note", sha="b1", retired=True),
        note("c1", "2024-01-01", "mail", conv="x"), note("c2", "2024-02-01", "mail two", conv="x"), note("d1", "", "none"), note("d2", "2024-01-01", "none"),
    ]
    pairs = versions.candidates(spark.createDataFrame(rows, schema))
    told = {(r.old_id, r.new_id): r.verdict for r in pairs.collect()}
    assert told == {("a1", "a2"): "propose", ("a1", "a3"): "ambiguous", ("a2", "a3"): "ambiguous", ("b1", "b2"): "propose", ("b1", "b3"): "skip", ("b2", "b3"): "skip", ("c1", "c2"): "skip", ("d1", "d2"): "skip"}
    run = versions.generate(pairs)
    assert [(r["old_id"], r["new_id"], r["verdict"]) for r in run] == [("a2", "a3", "ambiguous"), ("a1", "a3", "ambiguous"), ("b1", "b2", "propose"), ("a1", "a2", "propose")]
    assert versions.generate(pairs, exclude=(("b2", "b1"),), most=3) == run[:2]

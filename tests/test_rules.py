"""Query-log records, conventions of notes and prefixes, each fault by itself."""

import json
import random

import pytest

from vaultspark.operators import rules
from vaultspark.sources import records

GOOD = {"version": 1, "query": "q", "mode": "search", "k": 5, "rrf_k": 60, "vault_fingerprint": "f", "top": [{"id": "a", "pre_rerank_score": 0.5, "final_rank": 1}, {"id": "b", "final_rank": 2}], "latency_ms": 1.5, "rerank": {"requested": False}, "candidate_digest": {}}


def without(field):
    return {k: v for k, v in GOOD.items() if k != field}


def top(*items):
    return GOOD | {"top": list(items)}


CASES = [
    (GOOD, None), (GOOD | {"rerank_mode": "applied", "max_tier": "MNPI", "latency_ms": 3}, None), (GOOD | {"top": []}, None), (top({"id": "a", "final_rank": 1, "pre_rerank_score": None}), None),
    (without("version"), "unsupported record version"), (GOOD | {"version": 2}, "unsupported record version"), (GOOD | {"version": "1"}, "unsupported record version"), (GOOD | {"query": 5}, "missing query"), (GOOD | {"query": None}, "missing query"),
    (GOOD | {"mode": "lookup"}, "unsupported mode"), (GOOD | {"k": -1}, "invalid k"), (GOOD | {"k": 2.5}, "invalid k"), (GOOD | {"k": "3"}, "invalid k"), (GOOD | {"rrf_k": 0}, "invalid rrf_k"), (GOOD | {"vault_fingerprint": " "}, "missing vault fingerprint"),
    (GOOD | {"top": {}}, "invalid top list"), (GOOD | {"latency_ms": "7"}, "invalid latency"), (GOOD | {"rerank": []}, "invalid rerank metadata"), (GOOD | {"rerank": {"requested": 1}}, "invalid rerank metadata"),
    (GOOD | {"rerank_mode": "maybe"}, "invalid rerank mode"), (GOOD | {"max_tier": "internal"}, "invalid max tier"), (without("candidate_digest"), "invalid candidate digest"),
    (top({"id": 5, "final_rank": 1}), "invalid top result"), (top("a"), "invalid top result"), (top({"id": "a", "final_rank": 1, "pre_rerank_score": "x"}), "invalid top score"), (top({"id": "a", "final_rank": 0}), "invalid top rank"), (top({"id": "a", "final_rank": 1.5}), "invalid top rank"),
    (top({"id": "a", "final_rank": 1}, {"id": "a", "final_rank": 2}), "duplicate top id"), ([1], "not an object"), ("text", "not an object"),
]


def test_each_fault_of_a_record(spark):
    rows = [(i, json.dumps(r)) for i, (r, _) in enumerate(CASES)] + [(900, '{"version": 1,'), (901, ""), (902, None)]
    got = {r.i: r.problem for r in records.validated(spark.createDataFrame(rows, "i int, value string")).collect()}
    assert got == {i: p for i, (_, p) in enumerate(CASES)} | {900: "malformed JSON", 901: "empty line", 902: "empty line"}


def test_permissive_and_strict_reads(spark, tmp_path):
    (tmp_path / "2024-01.jsonl").write_text("\n".join([json.dumps(GOOD), "", "{broken", json.dumps(GOOD | {"k": -3})]) + "\n")
    rows = records.read_log(spark, str(tmp_path)).collect()
    assert sorted(str(r.problem) for r in rows) == ["None", "invalid k", "malformed JSON"]
    with pytest.raises(Exception, match="malformed JSON|invalid k"):
        records.read_log(spark, str(tmp_path), strict=True).collect()
    (tmp_path / "good").mkdir()
    (tmp_path / "good" / "a.jsonl").write_text(json.dumps(GOOD) + "\n")
    assert records.read_log(spark, str(tmp_path / "good"), strict=True).count() == 1


NOTE = "id string, zone string, title string, type string, classification string, created string, updated string, document_date string, effective_date string, superseded_date string, is_latest_version string, superseded_by string, captured string, origin string, immutable string"
FINE = {"id": "n", "zone": "brain", "title": "T", "type": "note", "classification": "Public", "created": "2024-01-01", "updated": "2024-01-01", "document_date": None, "effective_date": "", "superseded_date": None, "is_latest_version": None, "superseded_by": None, "captured": None, "origin": None, "immutable": None}
RAW = FINE | {"zone": "raw", "title": None, "type": "source", "captured": "2024-01-01", "origin": "mail", "immutable": "true"}
FAULTS = [
    ({"title": " "}, ["missing title"]), ({"created": None}, ["missing created"]), ({"classification": "internal"}, ["unknown tier"]), ({"classification": None}, ["missing classification"]), ({"type": "source"}, ["unknown type"]), ({"document_date": "2024-1-1"}, ["document_date is no date"]),
    ({"is_latest_version": "maybe"}, ["is_latest_version is no boolean"]), ({"is_latest_version": "False"}, ["retired without successor"]), ({"superseded_date": "2024-05-01"}, ["superseded_date without successor"]), ({"superseded_by": "n9"}, ["supersedes itself"]),
    ({"superseded_date": "2023-01-01", "superseded_by": "x"}, ["superseded before it was created"]), ({"title": "Twice"}, ["title of several notes"]), ({"title": "twice "}, ["title of several notes"]), ({}, []), ({"superseded_by": "x", "is_latest_version": "false", "superseded_date": "2024-02-02"}, []),
]


def test_each_rule_of_a_note(spark):
    rows = [FINE | {"title": f"T{i}"} | change | {"id": f"n{i}"} for i, (change, _) in enumerate(FAULTS)]
    rows += [RAW | {"id": "r1", "title": "Twice"}, RAW | {"id": "r2", "origin": None, "immutable": ""}]
    notes = spark.createDataFrame([tuple(r[c.split()[0]] for c in NOTE.split(", ")) for r in rows], NOTE)
    found = rules.lint(notes)
    got = {}
    for r in found.collect():
        got.setdefault(r.id, []).append(r.rule)
    assert {k: sorted(v) for k, v in got.items()} == {f"n{i}": want for i, (_, want) in enumerate(FAULTS) if want} | {"r2": ["missing immutable", "missing origin"]}
    assert rules.lint(notes.drop("origin")).filter("rule = 'missing origin'").count() == 2 and rules.lint(notes.limit(0)).count() == 0
    assert rules.lint(notes, [("long", None, "one_of", "title", "T0|T1")]).count() == len([r for r in rows if (r["title"] or "").strip() not in ("", "T0", "T1")])


def test_prefixes_of_any_length(spark):
    rnd = random.Random(3)
    keys = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 20))) for _ in range(300)})
    asked = sorted({k[: rnd.randint(1, 20)] for k in keys} | {"zz", "a", "abcabcabcabcabcabcabc", ""})
    got = {r.prefix: (r.status, r.key, r.owners) for r in rules.resolve_prefixes(spark.createDataFrame([(a,) for a in asked * 2] + [(None,)], "prefix string"), spark.createDataFrame([(k,) for k in keys * 2] + [(None,)], "key string")).collect()}
    want = {}
    for a in filter(None, asked):
        mine = [k for k in keys if k.startswith(a)]
        want[a] = ("exact", a, len(mine)) if a in mine else ("absent", None, 0) if not mine else ("found", mine[0], 1) if len(mine) == 1 else ("ambiguous", None, len(mine))
    assert got == want and {s for s, *_ in want.values()} == {"exact", "found", "ambiguous", "absent"}
    none = spark.createDataFrame([], "prefix string")
    assert rules.resolve_prefixes(none, spark.createDataFrame([("a",)], "key string")).count() == 0

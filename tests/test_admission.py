"""Ingest with memory: stages in order, failures over batches, stale claims, and runs that a systemic error ends."""

import os

import pytest
from pyspark.sql import functions as F

from vaultspark.streaming import admission


def stream(spark, folder):
    return spark.readStream.schema(admission.ARRIVAL).option("maxFilesPerTrigger", 1).parquet(folder)


def batch(spark, folder, n, rows):
    """One more file of arrivals (id, content, seconds, outcome, before, after)."""
    full = [(i, c, s * 1_000_000, before, after, outcome) for i, c, s, outcome, before, after in rows]
    spark.createDataFrame(full, admission.ARRIVAL).coalesce(1).write.parquet(f"{folder}/tmp-{n}")
    part = next(f for f in os.listdir(f"{folder}/tmp-{n}") if f.endswith(".parquet"))
    os.makedirs(f"{folder}/in", exist_ok=True)
    os.rename(f"{folder}/tmp-{n}/{part}", f"{folder}/in/{n:03d}.parquet")
    os.utime(f"{folder}/in/{n:03d}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))


def found(spark, folder):
    return {r.id: (r.bucket, r.reason) for r in spark.read.parquet(f"{folder}/out").collect()}


def plain(i, content, at, outcome, before=None, after=None):
    return i, content, at, outcome, before, after


def test_failures_are_counted_over_batches(spark, tmp_path):
    f = str(tmp_path)
    batch(spark, f, 1, [plain("a1", "x", 1, "error:OSError"), plain("b1", "y", 1, "ok"), plain("c1", "z", 2, "ok", ("skipped", "claimed_elsewhere"))])
    batch(spark, f, 2, [plain("a2", "x", 5, "error:ValueError"), plain("b2", "y", 5, "ok"), plain("c2", "z", 6, "ok", None, ("quarantined", "too_little_text"))])
    assert admission.drain(stream(spark, f"{f}/in"), f"{f}/run") == {"stopped": None}
    batch(spark, f, 3, [plain("a3", "x", 9, "error:ValueError"), plain("a4", "x", 10, "error:ValueError"), plain("a5", "x", 11, "ok"), plain("a6", "x", 12, "error:E"), plain("c3", "z", 9, "ok")])
    admission.drain(stream(spark, f"{f}/in"), f"{f}/run")
    assert found(spark, f"{f}/run") == {
        "a1": ("skipped", "processing_error:OSError (attempt 1/3)"), "a2": ("skipped", "processing_error:ValueError (attempt 2/3)"), "a3": ("quarantined", "repeated_ingest_failure"),
        "a4": ("skipped", "processing_error:ValueError (attempt 1/3)"), "a5": ("processed", ""), "a6": ("duplicates", "same_content"),
        "b1": ("processed", ""), "b2": ("duplicates", "same_content"), "c1": ("skipped", "claimed_elsewhere"), "c2": ("quarantined", "too_little_text"), "c3": ("processed", ""),
    }


def test_a_systemic_error_ends_the_run(spark, tmp_path):
    f = str(tmp_path)
    batch(spark, f, 1, [plain("a1", "x", 1, "ok")])
    batch(spark, f, 2, [plain("b1", "y", 2, "error:E"), plain("b2", "w", 3, "systemic:ENOSPC")])
    batch(spark, f, 3, [plain("c1", "z", 4, "ok")])
    done = admission.drain(stream(spark, f"{f}/in"), f"{f}/run")
    assert done["stopped"] and "b2: systemic:ENOSPC" in done["stopped"]
    assert found(spark, f"{f}/run") == {"a1": ("processed", "")}  # neither the batch nor what comes after it
    # the outage is over: the same arrivals end well, and nothing of the lost batch was counted
    os.remove(f"{f}/in/002.parquet")
    batch(spark, f, 2_0, [])
    os.rename(f"{f}/in/020.parquet", f"{f}/in/002.parquet")
    full = [("b1", "y", 2_000_000, None, None, "error:E"), ("b2", "w", 3_000_000, None, None, "ok")]
    spark.createDataFrame(full, admission.ARRIVAL).coalesce(1).write.parquet(f"{f}/again")
    part = next(x for x in os.listdir(f"{f}/again") if x.endswith(".parquet"))
    os.replace(f"{f}/again/{part}", f"{f}/in/002.parquet")
    assert admission.drain(stream(spark, f"{f}/in"), f"{f}/run") == {"stopped": None}
    assert found(spark, f"{f}/run") == {"a1": ("processed", ""), "b1": ("skipped", "processing_error:E (attempt 1/3)"), "b2": ("processed", ""), "c1": ("processed", "")}


def test_stale_claims_are_swept(spark, tmp_path):
    f = str(tmp_path)
    for n in range(3):
        batch(spark, f, n, [plain(f"a{n}", "x", n, "claimed"), plain(f"o{n}", f"other{n}", 0, "ok")])
    batch(spark, f, 3, [plain("b", "y", 1, "claimed"), plain("b2", "y", 2, "ok"), plain("c", "z", 1, "claimed")])
    batch(spark, f, 4, [plain("later", "other4", 1, "ok")])
    admission.drain(stream(spark, f"{f}/in"), f"{f}/run", stale_ms=1)
    got = found(spark, f"{f}/run")
    assert got["c"] == ("skipped", "stale_claim (attempt 1/3)")
    assert got["a0"] == ("skipped", "stale_claim (attempt 1/3)") and got["a1"] == ("skipped", "stale_claim (attempt 2/3)") and got["a2"] == ("quarantined", "repeated_ingest_failure")
    assert "b" not in got and got["b2"] == ("processed", "")


def test_stages_come_in_order(spark):
    before, after = admission.standard_stages(max_bytes=100, extensions=("md", "txt"))
    base = {"claimed_by": None, "kind": "file", "size": 10, "anchor": "ok", "released": False, "declared": None, "extension": "md", "problem": None, "words": 9, "need_words": 5, "tier_verdict": "ok"}
    cases = [({}, None, None), ({"claimed_by": "w", "size": 999}, "claimed_elsewhere", None), ({"size": 999, "kind": "link"}, "file_too_large", None), ({"kind": "link", "anchor": "mismatch"}, "irregular_entry", None), ({"anchor": "mismatch", "declared": "log"}, "approved_anchor_mismatch", None), ({"anchor": None, "released": True}, "approved_anchor_missing", None), ({"declared": "log"}, "operational_artifact:log", None)]
    cases += [({"extension": "exe", "problem": "p"}, None, "no_handler_for_extension"), ({"extension": None}, None, "no_handler_for_extension"), ({"problem": "missing_dependency:x", "words": 0}, None, "missing_dependency:x"), ({"words": 4, "tier_verdict": "refused"}, None, "too_little_text"), ({"tier_verdict": "refused"}, None, "tier_guard")]
    schema = "claimed_by string, kind string, size long, anchor string, released boolean, declared string, extension string, problem string, words int, need_words int, tier_verdict string"
    rows = spark.createDataFrame([tuple((base | c).values()) for c, *_ in cases], schema).coalesce(1)
    got = rows.select(admission.verdict(before).alias("b"), admission.verdict(after).alias("a")).collect()
    assert [(r.b and r.b.reason, r.a and r.a.reason) for r in got] == [(b, a) for _, b, a in cases]
    assert [s.name for s in before + after] == ["claim", "size", "kind", "anchor", "release", "operational", "handler", "extraction", "density", "tier"]


@pytest.mark.parametrize("most", [1, 5])
def test_the_limit_is_a_parameter(spark, tmp_path, most):
    f = str(tmp_path)
    batch(spark, f, 1, [plain(f"a{i}", "x", i, "error:E") for i in range(5)])
    admission.drain(stream(spark, f"{f}/in"), f"{f}/run", max_failures=most)
    assert sum(b == "quarantined" for b, _ in found(spark, f"{f}/run").values()) == 5 // most

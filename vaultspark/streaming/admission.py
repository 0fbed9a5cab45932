"""Ingest as a process: arrivals pass ordered stages, and what happened to a content is remembered across batches.

Each arrival ends in one bucket (`processed`, `quarantined`, `duplicates`, `skipped`) for one reason, that of the first
stage that holds it. Stages before the duplicate check look at the arrival alone, then comes the state of its content,
then the stages of the extraction, and at last the attempt itself. By content, the state knows whether it was
processed, and how often an attempt failed: the last allowed failure quarantines the content and clears the count. A
claim that nobody finishes is swept by a batch after its timer has ended, and counts as a failure. A systemic error (a full disk, a
missing key) belongs to no content: it ends the run, the batch isn't committed, and the next run takes it up again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Failed attempts of one content that quarantine it, and milliseconds after which a claim is stale.
MAX_FAILURES, STALE_MS = 3, 15 * 60 * 1000

#: Of an arrival: which, the content's hash, when (microseconds), what the stages said, and how the attempt ended
#: (`ok`, `claimed` for one that never ended, `error:<kind>`, `systemic:<kind>`).
ARRIVAL = "id string, content string, us long, before struct<bucket: string, reason: string>, after struct<bucket: string, reason: string>, outcome string"
OUT = "id string, content string, us long, bucket string, reason string"
_COLUMNS = [c.split()[0] for c in OUT.split(", ")]


class Stage(NamedTuple):
    """A check of an arrival: where it goes if the condition holds."""

    name: str
    holds: Column
    bucket: str
    reason: Column


def verdict(stages: list[Stage]) -> Column:
    """The bucket and reason of the first stage that holds an arrival; null if none does."""
    out = F.lit(None).cast("struct<bucket: string, reason: string>")
    for stage in reversed(stages):
        out = F.when(F.coalesce(stage.holds, F.lit(False)), F.struct(F.lit(stage.bucket).alias("bucket"), stage.reason.alias("reason"))).otherwise(out)
    return out


def standard_stages(*, max_bytes: int = 200 << 20, extensions: tuple[str, ...] = ()) -> tuple[list[Stage], list[Stage]]:
    """The stages before and after the duplicate check, over columns claimed_by, kind, size, anchor, released, declared,
    extension, problem, words, need_words and tier_verdict."""
    before = [
        Stage("claim", F.col("claimed_by").isNotNull(), "skipped", F.lit("claimed_elsewhere")),
        Stage("size", F.col("size") > max_bytes, "quarantined", F.lit("file_too_large")),
        Stage("kind", F.col("kind") != "file", "quarantined", F.lit("irregular_entry")),
        Stage("anchor", F.col("anchor") == "mismatch", "quarantined", F.lit("approved_anchor_mismatch")),
        Stage("release", F.col("anchor").isNull() & F.col("released"), "quarantined", F.lit("approved_anchor_missing")),
        Stage("operational", F.col("declared").isNotNull(), "skipped", F.concat(F.lit("operational_artifact:"), F.col("declared"))),
    ]
    after = [
        Stage("handler", ~F.coalesce(F.col("extension"), F.lit("")).isin(*extensions), "quarantined", F.lit("no_handler_for_extension")),
        Stage("extraction", F.col("problem").isNotNull(), "quarantined", F.col("problem")),
        Stage("density", F.col("words") < F.col("need_words"), "quarantined", F.lit("too_little_text")),
        Stage("tier", F.col("tier_verdict") == "refused", "quarantined", F.lit("tier_guard")),
    ]
    return before, after


class Admission(StatefulProcessor):
    """The state of each content: whether it was processed, and its failed attempts."""

    def __init__(self, max_failures: int = MAX_FAILURES, stale_ms: int = STALE_MS):
        self.max_failures, self.stale_ms = max_failures, stale_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("content", "processed boolean, failures int")
        self.claims = handle.getMapState("claims", "ends long, id string", "us long")

    def _failed(self, failures: int, kind: str) -> tuple[int, str, str]:
        """The count after one more failure, and the bucket and reason of the attempt."""
        failures += 1
        if failures >= self.max_failures:
            return 0, "quarantined", "repeated_ingest_failure"
        return failures, "skipped", f"{kind} (attempt {failures}/{self.max_failures})"

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrivals = pd.concat(list(rows))
        arrivals = arrivals.sort_values(["us", "id"], kind="stable")  # in the order of time, whatever order a batch has
        processed, failures = self.state.get() if self.state.exists() else (False, 0)
        out = []
        for a in arrivals.itertuples(index=False):
            say = lambda bucket, reason: out.append((a.id, a.content, a.us, bucket, reason))  # noqa: B023, E731
            held = a.before if isinstance(a.before, dict) else None
            later = a.after if isinstance(a.after, dict) else None
            if held:
                say(held["bucket"], held["reason"])
            elif processed:
                say("duplicates", "same_content")
            elif later:
                say(later["bucket"], later["reason"])
            elif a.outcome.startswith("systemic:"):
                say("stopped", a.outcome)
            elif a.outcome.startswith("error:"):
                failures, bucket, reason = self._failed(failures, f"processing_error:{a.outcome[6:]}")
                say(bucket, reason)
            elif a.outcome == "claimed":
                ends = a.now_ms + self.stale_ms
                self.claims.updateValue((ends, a.id), (a.us,))
                self.handle.registerTimer(ends)
            else:
                processed, failures = True, 0
                self.claims.clear()
                say("processed", "")
        self.state.update((processed, failures))
        yield pd.DataFrame(out, columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        stale = sorted((*claim, us) for claim, (us,) in self.claims.iterator() if claim[0] <= now) if self.claims.exists() else []
        processed, failures = self.state.get() if self.state.exists() else (False, 0)
        out = []
        for ends, ident, us in stale:
            self.claims.removeKey((ends, ident))
            if not processed:
                failures, bucket, reason = self._failed(failures, "stale_claim")
                out.append((ident, key[0], us, bucket, reason))
        self.state.update((processed, failures))
        yield pd.DataFrame(out, columns=_COLUMNS)


class Stopped(RuntimeError):
    """A systemic error has ended the run."""


def admit(arrivals: DataFrame, **options) -> DataFrame:
    """A stream of buckets for a stream of arrivals (see ARRIVAL)."""
    # the clock is the batches' own: under a watermark over `us`, arrivals older than others would be dropped
    timed = arrivals.withColumn("now", F.current_timestamp()).withWatermark("now", "0 seconds").withColumn("now_ms", F.unix_millis("now"))
    return timed.groupBy("content").transformWithStateInPandas(statefulProcessor=Admission(**options), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


def drain(arrivals: DataFrame, folder: str, **options) -> dict:
    """Runs what has arrived through the stages; rows go to folder/out by batch. {"stopped": a systemic error or None}.

    State and progress are in folder/checkpoint: the next drain goes on from there. A batch with a systemic error is not
    committed, so none of its rows are kept or counted and the next drain sees it again."""
    spark = arrivals.sparkSession
    names = ("spark.sql.streaming.stateStore.providerClass",)
    before = {n: spark.conf.get(n, None) for n in names}
    spark.conf.set(names[0], "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def keep(df: DataFrame, batch: int) -> None:
        df = df.persist()
        try:
            stop = df.filter("bucket = 'stopped'").orderBy("us", "id").first()
            if stop is not None:
                raise Stopped(f"{stop['id']}: {stop['reason']}")
            df.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")
        finally:
            df.unpersist()

    try:
        query = admit(arrivals, **options).writeStream.outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(keep).queryName(f"admission-{uuid.uuid4().hex[:8]}").start()
        try:
            query.awaitTermination()
        except Exception as error:
            if "Stopped" not in str(error):
                raise
            reason = str(error).split("Stopped: ", 1)[1].split("\n")[0]
            return {"stopped": reason.strip()}
    finally:
        for n, value in before.items():
            spark.conf.set(n, value) if value is not None else spark.conf.unset(n)
    return {"stopped": None}

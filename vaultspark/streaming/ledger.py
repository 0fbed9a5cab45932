"""Streams of events: windows under a watermark, late data, once-only keys, and the state of commitments.

Each function takes and gives a streaming DataFrame; `drain` runs one over what its source has and returns a table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events_stream(spark: SparkSession, path: str, schema: str = EVENTS, files_per_batch: int = 1000) -> DataFrame:
    # as a pattern, a path may be one file or a folder of them
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]").withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per window and type; events later than the watermark allows are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding_counts(events: DataFrame, size: str = "6 hours", step: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, step), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def session_counts(events: DataFrame, gap: str = "3 hours", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def once_only(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """The first event of each key while the watermark remembers it."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


_STATE = "events long, status string, last_us long, last_id long"
_OUT = "commitment_id long, events long, status string, last_event long"
_STATUS = {"purchase": "done", "error": "cancelled"}


def _reduce(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    n, status, us, last = state.get if state.exists else (0, "open", -(1 << 62), -1)
    for pdf in batches:
        n += len(pdf)
        for t, i, kind in zip(pdf["us"], pdf["event_id"], pdf["event_type"]):
            if (t, i) > (us, last):  # an older event that comes late changes nothing
                us, last, status = int(t), int(i), _STATUS.get(kind, "open")
    state.update((n, status, us, last))
    yield pd.DataFrame([(key[0], n, status, last)], columns=["commitment_id", "events", "status", "last_event"])


def spine(events: DataFrame) -> DataFrame:
    """The state of each commitment (user_id) after each batch; order is (ts, event_id) whatever order events come in."""
    rows = events.select("user_id", "event_id", "event_type", F.unix_micros("ts").alias("us"))
    return rows.groupBy("user_id").applyInPandasWithState(_reduce, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, folder: str, mode: str, last_by: str | None = None) -> DataFrame:
    """Runs a stream over what is there and reads its output. last_by: of each key, only the latest batch's row."""
    spark = stream.sparkSession
    out = f"{folder.rstrip('/')}/{uuid.uuid4().hex[:12]}"

    def keep(df: DataFrame, batch: int) -> None:
        # a batch that is run again writes its own folder again
        df.withColumn("batch_", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/out/batch={batch}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    rows = spark.read.option("recursiveFileLookup", "true").parquet(f"{out}/out")
    if mode == "complete":
        top = rows.agg(F.max("batch_").alias("b"))
        rows = rows.join(F.broadcast(top), rows.batch_ == top.b).drop("b")
    if last_by:
        rows = rows.groupBy(last_by).agg(F.max_by(F.struct(*[c for c in rows.columns if c != last_by]), "batch_").alias("x")).select(last_by, "x.*")
    return rows.drop("batch_")

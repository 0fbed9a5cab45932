"""Append-only logs: a hash-linked audit chain, monthly query logs, drafts, health records and the inbox stream."""

from __future__ import annotations

import datetime
import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultspark.sources.ingest import OUT, rows_of

AUDIT = "seq long, ts string, verb string, path string, reason string, content_sha256 string, prev_hash string, line string"


def canonical(record: dict) -> str:
    return json.dumps(record, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def chain(entries: list[dict], seq: int = 0, last_line: str = "") -> list[tuple]:
    """Rows of the chain for new entries (ts, verb, path, reason, content_sha256), linked after the last line.

    A chain has one writer, and a batch of it is what that writer appends at once."""
    out = []
    for e in entries:
        record = {k: e.get(k) for k in ("ts", "verb", "path", "reason", "content_sha256")} | {"prev_hash": hashlib.sha256(last_line.encode()).hexdigest()}
        last_line = canonical(record)
        seq += 1
        out.append((seq, *(record[k] for k in ("ts", "verb", "path", "reason", "content_sha256", "prev_hash")), last_line))
    return out


def append_audit(spark: SparkSession, folder: str, entries: list[dict]) -> None:
    """Appends entries to the chain of a folder."""
    try:
        last = spark.read.schema(AUDIT).parquet(folder).orderBy(F.desc("seq")).select("seq", "line").first()
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        last = None
    rows = chain(entries, last["seq"] if last else 0, last["line"] if last else "")
    spark.createDataFrame(rows, AUDIT).coalesce(1).write.mode("append").parquet(folder)


def verify_audit(rows: DataFrame) -> DataFrame:
    """(seq, issue): rows whose link or canonical form is broken, and gaps; found by an equi-join on seq, not by a scan in order."""
    before = rows.select((F.col("seq") + 1).alias("seq"), F.sha2("line", 256).alias("expected"))
    first = F.sha2(F.lit(""), 256)
    found = rows.join(before, "seq", "left").withColumn("issue", F.when((F.col("seq") > 1) & F.col("expected").isNull(), "gap").when(F.col("prev_hash") != F.coalesce("expected", first), "broken link").when(F.get_json_object("line", "$.prev_hash") != F.col("prev_hash"), "altered line"))
    return found.filter(F.col("issue").isNotNull()).select("seq", "issue")


def write_monthly(rows: DataFrame, folder: str, ts: str = "at") -> None:
    """Appends log rows in partitions by month."""
    rows.withColumn("month", F.substring(F.col(ts).cast("string"), 1, 7)).write.mode("append").partitionBy("month").json(folder)


def expired_months(months: list[str], today: datetime.date, retention: int = 3) -> list[str]:
    """Months before the first of the month `retention` - 1 months ago."""
    n = today.year * 12 + today.month - 1 - (retention - 1)
    cutoff = f"{n // 12:04d}-{n % 12 + 1:02d}"
    return sorted(m for m in months if m < cutoff)


def prune_months(spark: SparkSession, folder: str, today: datetime.date, retention: int = 3) -> list[str]:
    """Deletes whole expired months; the rest isn't rewritten."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    months = [s.getPath().getName()[6:] for s in fs.listStatus(path(folder)) if s.getPath().getName().startswith("month=")]
    gone = expired_months(months, today, retention)
    for m in gone:
        fs.delete(path(f"{folder}/month={m}"), True)
    return gone


def draft(content: str, ident: str, today: str, *, source: bool = False) -> str:
    """A note text with the front matter that every note needs."""
    body = content.split("---", 2)[-1].lstrip("\n") if content.startswith("---") else content
    keys = {"id": ident, "type": "source" if source else "note", "classification": "MNPI", **({"captured": today, "immutable": "true"} if source else {"created": today, "updated": today})}
    return "---\n" + "\n".join(f"{k}: {v}" for k, v in keys.items()) + "\n---\n" + body


def health_records(live: DataFrame, rotated: DataFrame, *, since: str) -> DataFrame:
    """Live and rotated records newer than a time, the last of each run, in the order of time."""
    both = live.unionByName(rotated).filter(F.col("ts") >= since)
    cols = [c for c in both.columns if c != "run_id"]
    return both.groupBy("run_id").agg(F.max_by(F.struct(*cols), F.struct("ts", "seq")).alias("x")).select("run_id", "x.*").orderBy("ts")


def append_health(spark: SparkSession, folder: str, record: dict, *, now: str, most_bytes: int = 1_000_000, keep_days: int = 90) -> str | None:
    """Appends a record to folder/live; a live part that would pass most_bytes moves to folder/archive first.

    Archived parts older than keep_days (by their name's time) are deleted. Has one writer. The name of a part that moved, or None."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    live, archive = path(f"{folder}/live"), path(f"{folder}/archive")
    fs = live.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    line, moved = json.dumps(record, sort_keys=True), None
    if fs.exists(live) and fs.getContentSummary(live).getLength() + len(line.encode()) + 1 > most_bytes:
        fs.mkdirs(archive)
        stem = "health-" + now.replace(":", "").replace("-", "")
        taken = {s.getPath().getName() for s in fs.listStatus(archive)}
        moved = next(n for n in (stem, *(f"{stem}-{i}" for i in range(1, len(taken) + 2))) if n not in taken)
        if not fs.rename(live, path(f"{folder}/archive/{moved}")):
            raise OSError(f"{folder}: the live part can't be moved")
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(f"{folder}/live")
    cutoff = (datetime.date.fromisoformat(now[:10]) - datetime.timedelta(days=keep_days)).strftime("health-%Y%m%d")
    for s in fs.listStatus(archive) if fs.exists(archive) else ():
        if s.getPath().getName()[: len(cutoff)] < cutoff:
            fs.delete(s.getPath(), True)
    return moved


def drain_inbox(spark: SparkSession, inbox: str, out: str, quarantine: str, checkpoint: str) -> None:
    """Streams the files of an inbox through the handlers: what was processed goes to out, the rest to quarantine."""
    import pandas as pd

    names = [c.split()[0] for c in OUT.split(", ")]
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(inbox).select("path", "content")

    def over(batches):
        for pdf in batches:
            for path, raw in zip(pdf["path"], pdf["content"]):
                yield pd.DataFrame(list(rows_of(path, bytes(raw))), columns=names)

    def keep(df: DataFrame, batch: int) -> None:
        done = df.withColumn("batch", F.lit(batch))
        for status, folder in (("processed", out), ("quarantined", quarantine)):
            done.filter(F.col("status") == status).write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    files.mapInPandas(over, OUT).writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

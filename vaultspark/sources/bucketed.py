"""Tables that change in place: a merge that rewrites touched buckets only, and a rebuild that can be resumed.

A `BucketedTable` is a folder of bucket files and of numbered manifests. Rows lie in buckets by a hash of their key;
a manifest names the folder of each bucket. A change writes new folders for the buckets that it touches, then a
manifest that refers to them and, for all other buckets, to the folders of the manifest before. Readers see the last
complete manifest; a manifest's name can be taken once, so of two writers of one version the second is refused.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vaultspark.operators.base import checkpointed, hadoop_path
from vaultspark.sources.snapshots import diff_sync


class Conflict(RuntimeError):
    """Another writer has committed the version first."""


def put_once(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file under a name that nobody has taken; False if it is taken.

    The text is written beside it first, so the name never stands for half a file."""
    target, files = hadoop_path(spark, path)
    if files.exists(target):
        return False
    part, _ = hadoop_path(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = files.create(part, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    # a rename that refuses a taken name
    try:
        jvm = spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(part, target, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as error:
        files.delete(part, False)
        if "FileAlreadyExists" in str(error):
            return False
        raise
    return True


def get_text(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    target, files = hadoop_path(spark, path)
    stream = files.open(target)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


class BucketedTable:
    """A table of rows with a key and a content hash, in buckets behind manifests."""

    def __init__(self, spark: SparkSession, folder: str, *, key: str = "path", digest: str = "content_hash", buckets: int = 64):
        self.spark, self.folder, self.key, self.digest, self.buckets = spark, folder.rstrip("/"), key, digest, buckets

    # manifests

    def versions(self) -> list[int]:
        root, files = hadoop_path(self.spark, f"{self.folder}/manifests")
        names = [s.getPath().getName() for s in files.listStatus(root)] if files.exists(root) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        found = self.versions()
        if not found:
            return {"version": 0, "buckets": {}, "schema": None, "count": self.buckets}
        return json.loads(get_text(self.spark, f"{self.folder}/manifests/{version or found[-1]:08d}.json"))

    def _commit(self, manifest: dict) -> dict:
        if not put_once(self.spark, f"{self.folder}/manifests/{manifest['version']:08d}.json", json.dumps(manifest, sort_keys=True)):
            raise Conflict(f"version {manifest['version']} of {self.folder} is taken")
        return manifest

    # rows

    def bucket(self, key: str):
        return F.pmod(F.xxhash64(F.col(key)), F.lit(self.buckets)).cast("int")

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The rows of a version (the last one), or of some of its buckets."""
        m = self.manifest(version)
        if m["schema"] is None:
            raise FileNotFoundError(f"no version in {self.folder}")
        paths = [path for b, path in sorted(m["buckets"].items()) if only is None or int(b) in only]
        schema = StructType.fromJson(json.loads(m["schema"]))
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{p}" for p in paths])

    def _write(self, rows: DataFrame, touched: list[int] | None) -> dict[str, str]:
        """Writes rows into a new data folder by bucket; the folders of the buckets that have rows."""
        name = f"data/{uuid.uuid4().hex}"
        n = max(1, len(touched) if touched is not None else self.buckets)
        rows.withColumn("bucket_", self.bucket(self.key)).repartition(n, "bucket_").write.partitionBy("bucket_").parquet(f"{self.folder}/{name}")
        root, files = hadoop_path(self.spark, f"{self.folder}/{name}")
        found = [s.getPath().getName() for s in files.listStatus(root)]
        return {f.split("=")[1]: f"{name}/{f}" for f in found if f.startswith("bucket_=")}

    def create(self, rows: DataFrame) -> dict:
        """The first version."""
        if self.versions():
            raise Conflict(f"{self.folder} has versions already")
        return self._commit({"version": 1, "buckets": self._write(rows, None), "schema": rows.schema.json(), "count": self.buckets})

    def sync(self, new: DataFrame, derive: Callable[[DataFrame], DataFrame] | None = None) -> dict:
        """Makes the table hold the rows of `new`; returns the manifest with the number of rows of each action.

        Only keys and digests of the old rows are read to compare. Rows whose content is new go through `derive`, which
        adds the derived columns; those that only moved (rebased) keep what was derived for them, those that are as they
        were aren't touched. Buckets without a change keep their files."""
        old = self.manifest()
        if old["schema"] is None:
            raise FileNotFoundError(f"no version in {self.folder}; create one")
        self.buckets = old["count"]
        schema = StructType.fromJson(json.loads(old["schema"]))
        if new.select(self.key).groupBy(self.key).count().filter("count > 1 OR " + f"`{self.key}` IS NULL").limit(1).count():
            raise ValueError(f"{self.key} is null or not unique")
        actions = checkpointed(diff_sync(self.read().select(self.key, self.digest), new.select(self.key, self.digest), path=self.key, digest=self.digest).withColumnRenamed("path", "to_"))
        changed = actions.filter("action <> 'unchanged'")
        both = changed.select(F.explode(F.array(F.when(F.col("action") != "deleted", F.col("to_")), F.col("old_path"))).alias(self.key)).dropna()
        touched = sorted(r["b"] for r in both.select(self.bucket(self.key).alias("b")).distinct().collect())  # at most one row a bucket
        counts = {r["action"]: r["count"] for r in actions.groupBy("action").count().collect()}
        next_ = {**old, "version": old["version"] + 1, "actions": counts, "rewritten": touched}
        if not touched:
            return {**old, "actions": counts, "rewritten": []}
        mine = self.read(only=touched)
        gone = changed.select(F.col("old_path").alias(self.key)).dropna()
        stay = mine.join(gone, self.key, "left_anti")
        given = [f.name for f in schema if f.name in new.columns]
        fresh = new.join(changed.filter("action IN ('added', 'updated')").select(F.col("to_").alias(self.key)), self.key, "left_semi").select(given)
        if derive is not None:
            fresh = derive(fresh)
        moved = changed.filter("action = 'rebased'").select(F.col("to_").alias("k_"), F.col("old_path").alias("o_"))
        derived = [f.name for f in schema if f.name not in given]
        kept = mine.select(F.col(self.key).alias("o_"), *derived)
        rebased = new.select(given).join(moved, F.col(self.key) == F.col("k_")).join(kept, "o_").select(*given, *derived)
        rows = stay.select(schema.names).unionByName(fresh.select(schema.names)).unionByName(rebased.select(schema.names))
        written = self._write(rows, touched)
        buckets = {b: path for b, path in old["buckets"].items() if int(b) not in touched} | written
        return self._commit({**next_, "buckets": buckets})

    def vacuum(self, keep: int = 2) -> list[str]:
        """Drops manifests before the last `keep` ones and the folders that no kept manifest names."""
        found = self.versions()
        root, files = hadoop_path(self.spark, f"{self.folder}/data")
        named = {p for v in found[-keep:] for p in self.manifest(v)["buckets"].values()}
        gone = []
        for run in files.listStatus(root) if files.exists(root) else ():
            for part in files.listStatus(run.getPath()):
                path = f"data/{run.getPath().getName()}/{part.getPath().getName()}"
                if part.isDirectory() and path not in named:
                    files.delete(part.getPath(), True)
                    gone.append(path)
        for v in found[:-keep]:
            files.delete(hadoop_path(self.spark, f"{self.folder}/manifests/{v:08d}.json")[0], False)
        return sorted(gone)


def fingerprint(rows: DataFrame, key: str, digest: str, **settings) -> str:
    """A text that changes with the rows' keys or contents (in any order) or with a setting such as schema, model or dimension."""
    each = F.xxhash64(F.col(key), F.col(digest))
    # sums of both halves of the hashes: order doesn't matter, repeated rows count
    low, high = each.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(each, 32)
    told = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(low.cast("decimal(38,0)")).alias("low"), F.sum(high.cast("decimal(38,0)")).alias("high")).first()
    return hashlib.sha256(json.dumps([told["n"], str(told["low"]), str(told["high"]), settings], sort_keys=True).encode()).hexdigest()


class Rebuild:
    """A full rebuild in batches of keys, each committed by itself, that takes up where a run ended.

    Batches are dealt by a hash of the key. A batch's rows are written to the run's folder and then logged; a run with
    the same fingerprint skips logged batches, one with another fingerprint starts anew. When the last batch is there,
    the pointer to the finished table is set in one step; until then readers see the table before."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _names(self, path: str) -> list[str]:
        root, files = hadoop_path(self.spark, path)
        return [s.getPath().getName() for s in files.listStatus(root)] if files.exists(root) else []

    def committed(self, mark: str) -> list[int]:
        return sorted(int(n[6:-5]) for n in self._names(f"{self.folder}/runs/{mark}/log") if n.startswith("batch-") and n.endswith(".json"))

    def finished(self) -> list[str]:
        """Fingerprints of finished runs, the last one last."""
        names = sorted(n for n in self._names(f"{self.folder}/current") if n.endswith(".json"))
        return [json.loads(get_text(self.spark, f"{self.folder}/current/{n}"))["mark"] for n in names]

    def read(self) -> DataFrame:
        """The table of the last finished run."""
        done = self.finished()
        if not done:
            raise FileNotFoundError(f"no finished rebuild in {self.folder}")
        plan = json.loads(get_text(self.spark, f"{self.folder}/runs/{done[-1]}/plan.json"))
        return self.spark.read.schema(StructType.fromJson(json.loads(plan["schema"]))).parquet(*[f"{self.folder}/runs/{done[-1]}/batch={i}" for i in range(plan["batches"])])

    def run(self, rows: DataFrame, compute: Callable[[DataFrame], DataFrame], *, key: str, digest: str, per_batch: int = 1_000_000, most: int | None = None, **settings) -> dict:
        """Computes what isn't yet (at most `most` batches of it); {"mark", "batches", "resumed" (batches found), "computed" (now)}."""
        mark = fingerprint(rows, key, digest, **settings)
        base = f"{self.folder}/runs/{mark}"
        if self.finished()[-1:] == [mark]:
            return {"mark": mark, "batches": len(self.committed(mark)), "resumed": len(self.committed(mark)), "computed": 0}
        for other in self._names(f"{self.folder}/runs"):  # other unfinished runs are of another state: they don't go on
            if other != mark and other not in self.finished():
                path, files = hadoop_path(self.spark, f"{self.folder}/runs/{other}")
                files.delete(path, True)
        if "plan.json" not in self._names(base):
            n = max(1, -(-rows.count() // per_batch))
            put_once(self.spark, f"{base}/plan.json", json.dumps({"batches": n, "schema": compute(rows).schema.json(), "settings": settings}, sort_keys=True))
        n = json.loads(get_text(self.spark, f"{base}/plan.json"))["batches"]
        found = self.committed(mark)
        left = sorted(set(range(n)) - set(found))
        for i in left[:most]:
            part = rows.filter(F.pmod(F.xxhash64(F.col(key)), F.lit(n)) == i)
            compute(part).write.mode("overwrite").parquet(f"{base}/batch={i}")
            put_once(self.spark, f"{base}/log/batch-{i}.json", json.dumps({"batch": i}))
        if most is not None and most < len(left):
            return {"mark": mark, "batches": n, "resumed": len(found), "computed": most}
        put_once(self.spark, f"{self.folder}/current/{len(self._names(f'{self.folder}/current')) + 1:08d}.json", json.dumps({"mark": mark}))
        return {"mark": mark, "batches": n, "resumed": len(found), "computed": n - len(found)}

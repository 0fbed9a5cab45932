"""Size-tiered compaction of immutable shards under a versioned manifest.

Arrivals are appended as small Parquet shards that never change. Compaction sorts the shards below the target size by
size and cuts them into tiers (sizes within a factor of `factor` of the tier's smallest). A tier of at least `fan_in`
shards is merged in runs of neighbours, each run up to the target size; all runs of a round are one Spark job, a run
a task. Each append and each round is committed as one manifest, which comes to its final name whole and only if no
other has that name: by a hard link on local disks, by a rename that never replaces on file systems that have one, and
by a create that never replaces on object stores, where a file shows only when it is closed. So readers see either
version, of two writers of one version exactly one wins, and the other starts over from the new one. Files that no kept
version names are deleted once the versions that named them are older than `retain_seconds`.

Defined cases: arrivals without a value come first; an empty arrival commits a version without new shards; a table without a version reads as no rows of
the given schema; shards at or over the target are left alone; a failed job leaves files that no manifest names;
repeated rows are kept each; rows with null in any column and very long texts are rows like others.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TARGET_BYTES = 128 << 20
FAN_IN, FACTOR = 4, 4.0
#: How long files of replaced versions stay for those who are still reading them.
RETAIN_SECONDS = 3600.0
#: File systems whose renames can refuse to replace; others but local disks are taken for object stores.
RENAMING = ("hdfs", "viewfs", "webhdfs", "ofs", "o3fs", "abfs", "abfss")


class Conflict(RuntimeError):
    """Another writer has committed the version."""


class ShardTable:
    """A folder of shards and manifests on any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, folder: str, *, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN, factor: float = FACTOR, keep_versions: int = 1, retain_seconds: float = RETAIN_SECONDS):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.target, self.fan_in, self.factor, self.keep, self.retain = target_bytes, fan_in, factor, keep_versions, retain_seconds
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, text: str):
        return self._jvm.org.apache.hadoop.fs.Path(text)

    # manifests

    def versions(self) -> list[int]:
        at = self._path(f"{self.folder}/manifests")
        if not self._fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, the last by default; version 0 is the empty table."""
        version = version if version is not None else max(self.versions(), default=0)
        if version == 0:
            return {"version": 0, "shards": []}
        stream = self._fs.open(self._path(f"{self.folder}/manifests/v{version:08d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, shards: list[dict], parent: int) -> int:
        """Makes a version of the shards; Conflict if the parent is not the last version any more."""
        version = parent + 1
        final = f"{self.folder}/manifests/v{version:08d}.json"
        text = json.dumps({"version": version, "parent": parent, "shards": sorted(shards, key=lambda s: s["path"])})
        if max(self.versions(), default=0) != parent or not self._publish(text, final):
            raise Conflict(f"version {version} is taken")
        return version

    def _publish(self, text: str, final: str) -> bool:
        """Makes a file whole or not at all; False if there is one of its name."""
        scheme = self._fs.getUri().getScheme()
        direct = scheme != "file" and scheme not in RENAMING
        part = self._path(final if direct else f"{self.folder}/manifests/.{uuid.uuid4().hex}.tmp")
        try:
            out = self._fs.create(part, False)
            try:
                out.write(text.encode())
            finally:
                out.close()
            if scheme == "file":
                nio = self._jvm.java.nio.file
                names = [nio.Path.of(p.toUri().getPath(), self._strings()) for p in (self._fs.makeQualified(self._path(final)), self._fs.makeQualified(part))]
                nio.Files.createLink(*names)
            elif not direct:
                kind = self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
                options = self._jvm.java.lang.reflect.Array.newInstance(kind, 1)
                options[0] = next(c for c in kind.getEnumConstants() if c.name() == "NONE")
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri()).rename(part, self._path(final), options)
        except Py4JJavaError as error:
            name = error.java_exception.getClass().getName()
            if name.endswith(("FileAlreadyExistsException", "PathExistsException")) or direct and "412" in str(error.java_exception.getMessage()):
                return False
            raise
        finally:
            if not direct:
                self._fs.delete(part, False)
        return True

    def _strings(self):
        return self.spark.sparkContext._gateway.new_array(self._jvm.java.lang.String, 0)

    def _update(self, change) -> dict:
        """Commits change(manifest) -> shards, again from the new version after a conflict."""
        while True:
            now = self.manifest()
            try:
                self.commit(change(now), now["version"])
                return self.manifest()
            except Conflict:
                continue

    # appending

    def _described(self, folder: str, schema: StructType, first=None) -> list[dict]:
        """The shards that a job has written: path, bytes and rows of each file with rows, in the order of `first` (a column)."""
        read = self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(folder)
        rows = read.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")).agg(F.count(F.lit(1)).alias("rows"), F.min(F.lit(0) if first is None else first).alias("first"))
        return [{"path": r["path"], "bytes": r["bytes"], "rows": r["rows"]} for r in rows.orderBy(F.asc_nulls_first("first"), "path").collect()]

    def append(self, rows: DataFrame, arrival: str | None = None) -> dict:
        """Appends rows as shards. arrival names a column of few values: each value is a version of its own, in the order of its values."""
        folder = f"{self.folder}/data/{uuid.uuid4().hex}"
        if arrival is None:
            rows.write.option("compression", "zstd").parquet(folder)
            new = self._described(folder, rows.schema)
            return self._update(lambda m: [*m["shards"], *new])
        kept = rows.withColumn("arrival_", F.col(arrival))
        kept.write.option("compression", "zstd").partitionBy("arrival_").parquet(folder)
        parts: dict[str, list[dict]] = {}
        for s in self._described(folder, rows.schema, F.col(arrival)):
            parts.setdefault(s["path"].rpartition("/")[0], []).append(s)
        out = self.manifest()
        for some in parts.values():
            out = self._update(lambda m, some=some: [*m["shards"], *some])
        return out

    # compacting

    def runs(self, shards: list[dict]) -> list[list[dict]]:
        """Runs of similarly sized shards to merge, each up to the target size."""
        small = sorted((s for s in shards if s["bytes"] < self.target), key=lambda s: (s["bytes"], s["path"]))
        tiers: list[list[dict]] = []
        for s in small:
            if tiers and s["bytes"] <= self.factor * tiers[-1][0]["bytes"]:
                tiers[-1].append(s)
            else:
                tiers.append([s])
        out = []
        for tier in tiers:
            if len(tier) < self.fan_in:
                continue
            run, size = [], 0
            for s in tier:
                if run and size + s["bytes"] > self.target:
                    out.append(run)
                    run, size = [], 0
                run.append(s)
                size += s["bytes"]
            out.append(run)
        return [r for r in out if len(r) > 1]

    def compact_once(self, schema: StructType) -> bool:
        """One round of merges in one job; False if there was nothing to merge."""
        before = self.manifest()
        runs = self.runs(before["shards"])
        if not runs:
            return False
        where = [(s["path"], i) for i, run in enumerate(runs) for s in run]
        # a row per shard of the round: as large as the manifest, which the driver holds
        names = F.broadcast(self.spark.createDataFrame(where, "path_ string, run_ int"))
        read = self.spark.read.schema(schema).parquet(*(p for p, _ in where))
        dealt = read.withColumn("path_", F.col("_metadata.file_path")).join(names, "path_").drop("path_").repartitionById(len(runs), F.col("run_"))
        folder = f"{self.folder}/data/{uuid.uuid4().hex}"
        dealt.drop("run_").write.option("compression", "zstd").parquet(folder)
        new, old = self._described(folder, schema), {p for p, _ in where}
        if sum(s["rows"] for s in new) != sum(s["rows"] for run in runs for s in run):
            raise RuntimeError("a merge has lost rows")

        def change(m):
            if not old <= {s["path"] for s in m["shards"]}:
                raise RuntimeError("another compaction has merged these shards")
            return [*(s for s in m["shards"] if s["path"] not in old), *new]

        self._update(change)
        self.clean()
        return True

    def compact(self, schema: StructType) -> dict:
        """Rounds until no tier is full. Each round makes fewer shards."""
        while self.compact_once(schema):
            pass
        return self.manifest()

    def clean(self) -> None:
        """Deletes manifests before the kept versions that were replaced long enough ago, and the files that only those named."""
        versions = self.versions()
        made = {v: self._fs.getFileStatus(self._path(f"{self.folder}/manifests/v{v:08d}.json")).getModificationTime() / 1000 for v in versions}
        now = time.time()
        old = [v for v, after in zip(versions, versions[1:]) if v in versions[: -self.keep] and now - made[after] >= self.retain]
        kept = {s["path"] for v in versions if v not in old for s in self.manifest(v)["shards"]}
        for v in old:
            for s in self.manifest(v)["shards"]:
                if s["path"] not in kept:
                    self._fs.delete(self._path(s["path"]), False)
            self._fs.delete(self._path(f"{self.folder}/manifests/v{v:08d}.json"), False)

    def read(self, schema: StructType, version: int | None = None) -> DataFrame:
        paths = [s["path"] for s in self.manifest(version)["shards"]]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

"""Sinks: generations of a table behind a pointer, incremental merges, and append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Generations:
    """A table as numbered folders; the last complete one (it has _SUCCESS) is what readers see."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        if not self._fs.exists(self._path(self.folder)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))]
        found = [int(n[4:]) for n in names if n.startswith("gen=")]
        return sorted(n for n in found if self._fs.exists(self._path(f"{self.folder}/gen={n}/_SUCCESS")))

    def write(self, df: DataFrame, keep: int = 2) -> int:
        """Writes the next generation and drops those before the kept ones."""
        n = max(self.numbers(), default=0) + 1
        df.write.mode("overwrite").parquet(f"{self.folder}/gen={n}")
        for old in self.numbers()[:-keep]:
            self._fs.delete(self._path(f"{self.folder}/gen={old}"), True)
        return n

    def read(self, n: int | None = None) -> DataFrame:
        found = self.numbers()
        if not found:
            raise FileNotFoundError(f"no generation in {self.folder}")
        return self.spark.read.parquet(f"{self.folder}/gen={n or found[-1]}")


def diff_sync(old: DataFrame, new: DataFrame, *, path: str = "path", digest: str = "content_hash") -> DataFrame:
    """(path, old_path, action): added, updated, unchanged, deleted or rebased (equal content at another path)."""
    o, n = old.select(F.col(path).alias("op"), F.col(digest).alias("oh")), new.select(F.col(path).alias("np"), F.col(digest).alias("nh"))
    both = o.join(n, o.op == n.np, "full")
    from pyspark.sql import Window

    gone = both.filter("np IS NULL").select("op", F.col("oh").alias("h")).withColumn("r", F.row_number().over(Window.partitionBy("h").orderBy("op")))
    came = both.filter("op IS NULL").select("np", F.col("nh").alias("h")).withColumn("r", F.row_number().over(Window.partitionBy("h").orderBy("np")))
    moved = gone.join(came, ["h", "r"]).select("op", "np")
    left = both.join(moved.select(F.col("op").alias("mo")), both.op == F.col("mo"), "left").join(moved.select(F.col("np").alias("mn")), both.np == F.col("mn"), "left").filter("mo IS NULL AND mn IS NULL")
    action = F.when(F.col("op").isNull(), "added").when(F.col("np").isNull(), "deleted").when(F.col("oh") == F.col("nh"), "unchanged").otherwise("updated")
    plain = left.select(F.coalesce("np", "op").alias("path"), F.col("op").alias("old_path"), action.alias("action"))
    return plain.unionByName(moved.select(F.col("np").alias("path"), F.col("op").alias("old_path"), F.lit("rebased").alias("action")))


def supersede(notes: DataFrame, pairs: DataFrame, date: str) -> DataFrame:
    """notes after the (old_id, new_id) supersessions: both sides say so."""
    by_old = pairs.select(F.col("old_id").alias("id"), F.col("new_id").alias("to_id"))
    by_new = pairs.groupBy(F.col("new_id").alias("id")).agg(F.min("old_id").alias("from_id"))
    x = notes.join(by_old, "id", "left").join(by_new, "id", "left")
    retired = F.col("to_id").isNotNull()
    x = x.withColumns({"is_latest_version": F.when(retired, "false").otherwise(F.col("is_latest_version")), "superseded_by": F.coalesce("to_id", "superseded_by"), "superseded_date": F.when(retired, date).otherwise(F.col("superseded_date")), "previous_version": F.coalesce("from_id", "previous_version")})
    return x.select(notes.columns)


def append_once(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key the target lacks, each key once."""
    return rows.dropDuplicates([key]).join(target.select(key), key, "left_anti")

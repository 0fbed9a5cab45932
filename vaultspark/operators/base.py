"""What operators share: sessions and checkpoints."""

from __future__ import annotations

import os
import shutil
import sys
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(name: str = "vaultspark", **conf: str) -> SparkSession:
    """A session with adaptive plans, UTC and Arrow; other settings come from the cluster."""
    builder = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k.replace("_", "."), v)
    return builder.getOrCreate()


def hadoop_path(spark: SparkSession, path: str):
    """A path and its file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder's path under spark.checkpoint.dir; what is there goes when the application ends."""
    base = checkpoint_dir(spark)
    root, files = hadoop_path(spark, f"{base}/work")
    files.mkdirs(root)
    files.deleteOnExit(root)
    return f"{base}/work/{name}-{uuid.uuid4().hex[:12]}"


_stored: dict[tuple, tuple] = {}


def table_state(spark: SparkSession, path: str) -> int:
    """A number that changes when the files of a table do."""
    root, files = hadoop_path(spark, path)
    return hash(tuple(sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in (files.listStatus(root) if files.exists(root) else ()))))


def stored(spark: SparkSession, path: str, name: str, build) -> DataFrame:
    """What `build()` derives from the table at a path, written once for an application and anew when its files change."""
    token = (spark.sparkContext.applicationId, path, name, table_state(spark, path))
    if token not in _stored:
        df = build()
        folder = work_dir(spark, name)
        df.write.parquet(folder)
        _stored[token] = folder, df.schema
    folder, schema = _stored[token]
    return spark.read.schema(schema).parquet(folder)


def in_order(df: DataFrame, *order) -> tuple[DataFrame, list[tuple]]:
    """df with p_ (a range partition) and n_ (a row's number in the whole order), and the (p_, rows before it) of the partitions.

    Numbers come from the sizes of range partitions, one row of each on the driver, so no task sees all rows."""
    part = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("p_", F.spark_partition_id()).withColumn("i_", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    part = checkpointed(part)
    starts, at = [], 0
    for p, n in sorted(tuple(r) for r in part.groupBy("p_").agg(F.count(F.lit(1)).alias("n")).collect()):
        starts.append((p, at))
        at += n
    first = part.sparkSession.createDataFrame(starts or [(0, 0)], "p_ int, first_ long")
    return part.join(F.broadcast(first), "p_").withColumn("n_", F.col("first_") + F.col("i_") + 1).drop("first_", "i_"), starts


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in spark.checkpoint.dir, which all executors share; lineage ends there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints of the application; a temporary one on a single machine without the setting."""
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not folder:
            if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="vaultspark-checkpoints-")
        spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors' Python once, unless they find it as the driver does (PYTHONPATH, folder)."""
    import vaultspark

    root = os.path.dirname(os.path.dirname(os.path.abspath(vaultspark.__file__)))
    near = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    app = spark.sparkContext.applicationId
    if app in _shipped or root in near or os.path.abspath(os.getcwd()) == root or root.startswith(sys.prefix):
        return
    out = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="vaultspark-"), "vaultspark-package"), "zip", root, "vaultspark")
    spark.sparkContext.addPyFile(out)
    _shipped.add(app)

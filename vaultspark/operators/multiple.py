"""Adjusted p values over tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vaultspark.operators.base import checkpointed, in_order


def benjamini_hochberg(tests: DataFrame, *, key: str, p: str = "p") -> DataFrame:
    """tests with `adjusted`: the step-up values, min over all tests from a rank on of p * m / rank, one at most.

    Ranks and running minima are taken within range partitions of p; of each partition its smallest value is carried on
    to those before it, so no task sees all tests. Tests without a p value have none and don't count."""
    rows, _ = in_order(tests.filter(F.col(p).isNotNull()), F.col(p), F.col(key))
    m = rows.agg(F.count(F.lit(1)).alias("m")).first()["m"]
    raw = checkpointed(rows.withColumn("raw_", F.col(p) * F.lit(m) / F.col("n_")))
    least, carried = 1.0, []
    for r in sorted(raw.groupBy("p_").agg(F.min("raw_").alias("x")).collect(), key=lambda r: -r["p_"]):  # one row a partition
        carried.append((r["p_"], least))
        least = min(least, r["x"])
    after = tests.sparkSession.createDataFrame(carried or [(0, 1.0)], "p_ int, after_ double")
    own = F.min("raw_").over(Window.partitionBy("p_").orderBy(F.desc("n_")).rowsBetween(Window.unboundedPreceding, 0))
    return raw.withColumn("own_", own).join(F.broadcast(after), "p_").withColumn("adjusted", F.least(F.col("own_"), F.col("after_"), F.lit(1.0))).select(*tests.columns, "adjusted")

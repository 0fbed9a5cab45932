"""Alerts of vaults: what the last run found, and runs that are missing, unreadable or old."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Findings older than this are not recited; the run itself is the alert then.
STALE_DAYS = 2
#: Keys that may be shown.
KEY = r"^[a-z0-9:_-]{1,64}$"
#: Findings that another source reports.
ELSEWHERE = ("synthesis-watchdog",)


def degradation(feeds: DataFrame, findings: DataFrame, *, today: str, declared: Column) -> DataFrame:
    """(vault, alert, detail) of each vault's feed.

    feeds (vault, at text or null, has_feed, has_run): a row per vault; findings (vault, key). A vault without a feed is
    an alert if it ever ran. Of a fresh feed the declared keys are one alert, keys that nothing has declared (by the
    column `declared` over key) another, and keys outside the alphabet are counted only."""
    at = F.try_to_date(F.substring("at", 1, 10))
    age = F.datediff(F.to_date(F.lit(today)), at)
    state = (
        F.when(~F.col("has_feed"), F.when(F.col("has_run"), "maintain:no-feed"))
        .when(at.isNull(), "maintain:unparseable-feed")
        .when(age > STALE_DAYS, "maintain:stale")
        .otherwise("fresh")
    )
    told = feeds.select("vault", state.alias("alert"), F.when(age > STALE_DAYS, F.concat(age.cast("string"), F.lit(" days"))).otherwise("").alias("detail"))
    fresh = told.filter("alert = 'fresh'").select("vault")
    keys = findings.filter(F.coalesce("key", F.lit("")) != "").filter(~F.col("key").isin(*ELSEWHERE)).select("vault", "key").distinct().join(fresh, "vault", "left_semi")
    kind = F.when(~F.col("key").rlike(KEY), "degradation:unrecognised-key").when(declared, "degradation").otherwise("degradation:untriaged")
    grouped = keys.withColumn("alert", kind).groupBy("vault", "alert").agg(F.array_join(F.array_sort(F.collect_set("key")), ", ").alias("names"), F.count(F.lit(1)).alias("n"))
    detail = F.when(F.col("alert") == "degradation:unrecognised-key", F.col("n").cast("string")).otherwise(F.col("names"))
    return told.filter("alert <> 'fresh'").unionByName(grouped.select("vault", "alert", detail.alias("detail")))


def collect(*sources: DataFrame) -> DataFrame:
    """The union of all sources' alerts (vault, alert, detail), each once."""
    return reduce(DataFrame.unionByName, sources).distinct()

"""Gated multi-hop retrieval: questions that name two entities or more get their flat results fused with the link graph.

Entities are notes of some types, known by their titles. A question's runs of words are joined with the titles, so
many questions meet many titles in one equi-join. Entities with a degree beyond a quantile are hubs: they may seed the
walk, but don't open the gate. Questions that don't pass it keep their flat results as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vaultspark.operators.base import checkpointed
from vaultspark.operators.graph import both_ways
from vaultspark.operators.search import tokens

#: Fixed values that must match: types of entities, and titles that are too general to name one.
ENTITY_TYPES = ("person", "company", "decision", "project", "concept")
GENERIC = ("governance", "legal", "budget", "roadmap", "strategy", "security", "compliance", "risk", "data", "cloud", "digital")
LEAST_CHARS, FLAT_SEEDS, CANDIDATES, FUSE = 4, 3, 30, 60


def mentions(notes: DataFrame, questions: DataFrame, *, key: str = "id") -> DataFrame:
    """(qid, key, surface): entities whose title stands in a question (qid, question) as whole words."""
    words = lambda c: tokens(F.col(c))
    names = notes.filter(F.col("type").isin(*ENTITY_TYPES)).select(key, words("title").alias("w"))
    names = names.select(key, F.array_join("w", " ").alias("surface"), F.size("w").alias("n")).filter((F.length("surface") >= LEAST_CHARS) & ~F.col("surface").isin(*GENERIC))
    longest = names.agg(F.max("n")).first()[0] or 0
    asked = questions.select("qid", words("question").alias("w")).filter(F.size("w") > 0)
    starts = asked.select("qid", "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("i"))
    runs = starts.select("qid", "w", "i", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(longest), F.size("w") - F.col("i") + 1)))).alias("n"))
    runs = runs.select("qid", F.array_join(F.slice("w", F.col("i"), F.col("n")), " ").alias("surface")).distinct()
    return runs.join(names, "surface").select("qid", key, "surface").distinct()


def hubs(edges: DataFrame, quantile: float) -> DataFrame:
    """(v): nodes with a degree beyond the quantile of all degrees."""
    degrees = both_ways(edges).groupBy(F.col("a").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    most = degrees.agg(F.expr(f"percentile_disc({quantile}) WITHIN GROUP (ORDER BY n)").alias("most"))
    return degrees.crossJoin(F.broadcast(most)).filter("n > most").select("v")  # one row


def expand(edges: DataFrame, seeds: DataFrame, *, depth: int = 2, rounds: int = 40, tol: float = 1e-9, alpha: float = 0.85, limit: int = CANDIDATES) -> DataFrame:
    """(qid, v, rank): of each question's seeds (qid, v) the nodes by personalised rank, hops and name, all questions at once."""
    pairs = both_ways(edges)
    links = checkpointed(pairs.join(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "a"))
    start = checkpointed(seeds.select("qid", "v").distinct().join(links.select(F.col("a").alias("v")).distinct(), "v", "left_semi"))
    share = start.groupBy("qid").agg((1.0 / F.count(F.lit(1))).alias("share"))
    home = checkpointed(start.join(share, "qid"))
    ranks = home.select("qid", "v", F.col("share").alias("p"))
    for _ in range(rounds):  # every node that is reached has a neighbour, so no rank is lost
        flow = ranks.join(links, ranks.v == links.a).select("qid", F.col("b").alias("v"), (F.lit(alpha) * F.col("p") / F.col("n")).alias("p"))
        nxt = checkpointed(flow.unionByName(home.select("qid", "v", ((1 - alpha) * F.col("share")).alias("p"))).groupBy("qid", "v").agg(F.sum("p").alias("p")))
        moved = nxt.alias("n").join(ranks.alias("o"), ["qid", "v"], "full").groupBy("qid").agg(F.sum(F.abs(F.coalesce("n.p", F.lit(0.0)) - F.coalesce("o.p", F.lit(0.0)))).alias("d")).agg(F.max("d")).first()[0]
        ranks = nxt
        if moved is None or moved < tol:
            break
    found, front = start.withColumn("hop", F.lit(0)), start
    for i in range(1, depth + 1):
        front = front.join(links.select("a", "b"), front.v == F.col("a")).select("qid", F.col("b").alias("v")).distinct().join(found, ["qid", "v"], "left_anti")
        front = checkpointed(front)
        found = found.unionByName(front.withColumn("hop", F.lit(i)))
    near = found.filter("hop > 0")
    both = ranks.join(near, ["qid", "v"], "full").join(start, ["qid", "v"], "left_anti").select("qid", "v", F.round(F.coalesce("p", F.lit(0.0)), 9).alias("p"), F.coalesce("hop", F.lit(99)).alias("hop"))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("p"), "hop", "v"))).filter(F.col("rank") <= limit).select("qid", "v", "rank")


def gated(flat: DataFrame, questions: DataFrame, notes: DataFrame, edges: DataFrame, *, key: str = "id", hub_quantile: float = 0.99, weight: float = 0.5, rrf_k: int = FUSE, **expansion) -> DataFrame:
    """(qid, key, rank, score, fired) from flat results (qid, key, rank): fused with the graph where the gate opens.

    score is 1 / (rrf_k + rank) of both lists, the graph's with a smaller weight, so the best flat hit stays first."""
    named = checkpointed(mentions(notes, questions, key=key))
    open_ = named.join(hubs(edges, hub_quantile), F.col(key) == F.col("v"), "left_anti").groupBy("qid").agg(F.countDistinct(key).alias("n")).filter("n >= 2").select("qid")
    open_ = checkpointed(open_)
    seeds = named.select("qid", F.col(key).alias("v")).unionByName(flat.filter(F.col("rank") <= FLAT_SEEDS).select("qid", F.col(key).alias("v"))).join(open_, "qid", "left_semi")
    walked = expand(edges, seeds, **expansion).select("qid", F.col("v").alias(key), F.col("rank").alias("g"))
    both = flat.select("qid", key, F.col("rank").alias("f")).join(walked, ["qid", key], "full").join(open_.withColumn("fired", F.lit(True)), "qid", "left")
    score = F.coalesce(1.0 / (rrf_k + F.col("f")), F.lit(0.0)) + F.coalesce(weight / (rrf_k + F.col("g")), F.lit(0.0))
    rows = both.select("qid", key, F.coalesce("fired", F.lit(False)).alias("fired"), F.round(score, 9).alias("score"), F.coalesce("f", F.lit(10_000) + F.col("g")).alias("order"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "order"))).select("qid", key, "rank", "score", "fired")

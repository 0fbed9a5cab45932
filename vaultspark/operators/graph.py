"""Graph operators over an edges DataFrame (src, dst): hops, ranks, components, clusters and capped selection.

Loops run a job per round and cut lineage with checkpoint() into the folder that the cluster shares.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from vaultspark.operators.base import checkpointed


def both_ways(edges: DataFrame) -> DataFrame:
    """Undirected edges as pairs (a, b) in both directions, each once."""
    e = edges.filter("src <> dst")
    return e.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(e.select("dst", "src")).distinct()


def bfs(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(v, hop): nodes within depth of the seeds (column v), seeds left out."""
    pairs = checkpointed(both_ways(edges))
    found = seeds.select("v").distinct().withColumn("hop", F.lit(0))
    front = found
    for i in range(1, depth + 1):
        front = front.join(pairs, front.v == pairs.a).select(F.col("b").alias("v")).distinct().join(found.select("v"), "v", "left_anti").withColumn("hop", F.lit(i))
        front = checkpointed(front)
        found = found.unionByName(front)
        if not front.limit(1).count():
            break
    return found.filter("hop > 0")


def personalized_pagerank(edges: DataFrame, seeds: DataFrame, *, alpha: float = 0.85, rounds: int = 40, tol: float = 1e-9) -> DataFrame:
    """(v, p): random walks that restart at the seeds; nodes without neighbours send their mass there, too."""
    pairs = both_ways(edges)
    links = checkpointed(pairs.join(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "a"))
    start = seeds.select("v").distinct()
    k = start.count()
    if not k:
        return start.withColumn("p", F.lit(0.0))
    linked = links.select(F.col("a").alias("v")).distinct()
    ranks = checkpointed(start.withColumn("p", F.lit(1.0 / k)))
    for _ in range(rounds):
        flow = ranks.join(links, ranks.v == links.a).select(F.col("b").alias("v"), (F.lit(alpha) * F.col("p") / F.col("n")).alias("p"))
        lost = ranks.join(linked, "v", "left_anti").agg(F.coalesce(F.sum("p"), F.lit(0.0)).alias("lost")).first()["lost"]
        home = start.withColumn("p", F.lit((1 - alpha + alpha * lost) / k))
        nxt = checkpointed(flow.unionByName(home).groupBy("v").agg(F.sum("p").alias("p")))
        moved = nxt.alias("n").join(ranks.alias("o"), "v", "full").agg(F.sum(F.abs(F.coalesce("n.p", F.lit(0.0)) - F.coalesce("o.p", F.lit(0.0)))).alias("d")).first()["d"]
        ranks = nxt
        if moved < tol:
            break
    return ranks


def graph_expand(edges: DataFrame, seeds: DataFrame, *, depth: int = 2, k: int = 20) -> DataFrame:
    """The first k nodes by rank, then hops (99 beyond depth), then node."""
    near = bfs(edges, seeds, depth)
    ranks = personalized_pagerank(edges, seeds)
    both = ranks.join(near, "v", "full").join(seeds.select("v"), "v", "left_anti")
    return both.select("v", F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("hop", F.lit(99)).alias("hop")).orderBy(F.round("p", 12).desc(), "hop", "v").limit(k)


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(v, root): the smallest node of each node's component; lone nodes are their own."""
    pairs = checkpointed(both_ways(edges))
    labels = pairs.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("root"))
    labels = checkpointed(labels)
    while True:
        near = pairs.join(labels.select(F.col("v").alias("b"), "root"), "b").groupBy(F.col("a").alias("v")).agg(F.min("root").alias("m"))
        step = labels.join(near, "v").select("v", F.least("root", "m").alias("root"), (F.col("m") < F.col("root")).alias("moved"))
        lead = step.select(F.col("v").alias("root"), F.col("root").alias("lead"))
        nxt = checkpointed(step.join(lead, "root").select("v", F.least("root", "lead").alias("root"), (F.col("moved") | (F.col("lead") < F.col("root"))).alias("moved")))
        labels = nxt.select("v", "root")
        if not nxt.filter("moved").limit(1).count():
            break
    if nodes is not None:
        labels = nodes.select("v").distinct().join(labels, "v", "left").select("v", F.coalesce("root", "v").alias("root"))
    return labels


def degree_capped(pairs: DataFrame, *, cap: int = 5, most: int | None = None) -> DataFrame:
    """Edges (a, b, score) taken by score (then a, b) while neither end has `cap` of them, `most` at the most.

    Gives what the sequential rule gives, in rounds: an edge that is among the first free ones of both its ends is
    taken, since no edge before it can fill them; edges of full nodes leave. Nodes are a window each, not the table."""
    order = [F.desc("score"), "a", "b"]
    left = checkpointed(pairs.select("a", "b", "score").filter("a <> b").distinct())
    taken = left.limit(0)
    while left.limit(1).count():
        used = taken.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("used"))
        ends = left.select("a", "b", "score", F.explode(F.array("a", "b")).alias("v")).withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy(*order)))
        free = F.lit(cap) - F.coalesce("used", F.lit(0))
        told = ends.join(used, "v", "left").groupBy("a", "b", "score").agg(F.min(F.col("r") <= free).alias("first"), F.min(free).alias("free"))
        told = checkpointed(told)
        taken = checkpointed(taken.unionByName(told.filter("first").select("a", "b", "score")))
        left = told.filter("NOT first AND free > 0").select("a", "b", "score")
    return taken if most is None else taken.orderBy(*order).limit(most)


def similar_capped(vectors: DataFrame, least: float, *, cap: int = 5, most: int | None = None, depth: int | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(a, b, score): degree_capped of all pairs of vectors whose product is `least` or more, without all pairs being written.

    A pass takes the best `depth` others of each vector that has a free place, so it shuffles rows by vectors, not by pairs. An edge
    is taken when both ends list it among their first free ones; all better edges of both are known then. A pass ends when no
    edge can be taken so; the next one lists what full vectors have left. Each takes the best edge that is left at least, and
    a pass whose lists are all complete is the last."""
    from vaultspark.operators.search import similar_lists

    depth = max(depth or 4 * cap, cap)
    rows = vectors.select(F.col(key).alias("v"), F.col(vector).alias("x")).dropna()
    ends = lambda df: df.select(F.explode(F.array("a", "b")).alias("v"))
    left, taken = rows, None
    while True:
        lists = checkpointed(similar_lists(left, least, depth, key="v", vector="x"))
        cut = lists.filter(F.col("r") == depth).select("v")
        edges = lists.select(F.least("v", "u").alias("a"), F.greatest("v", "u").alias("b"), "score", "v").groupBy("a", "b").agg(F.max("score").alias("score"), F.bool_or(F.col("v") == F.col("a")).alias("known_a"), F.bool_or(F.col("v") == F.col("b")).alias("known_b"))
        edges = edges.withColumns({"free_a": F.lit(cap), "free_b": F.lit(cap), "take": F.lit(False)})
        if taken is not None:
            used = ends(taken).groupBy("v").agg(F.count(F.lit(1)).cast("int").alias("used"))
            edges = edges.join(taken.select("a", "b"), ["a", "b"], "left_anti")
            for e in "ab":
                edges = edges.join(used.select(F.col("v").alias(e), "used"), e, "left").withColumn(f"free_{e}", F.lit(cap) - F.coalesce("used", F.lit(0))).drop("used")
        found, size = [], None
        while True:
            sides = [F.struct(F.col(e).alias("v"), F.col(o).alias("u"), F.col(f"known_{e}").alias("known"), F.col(f"free_{e}").alias("free")) for e, o in ("ab", "ba")]
            sided = edges.select("score", "take", F.explode(F.array(*sides)).alias("e")).select("score", "take", "e.*")
            sided = sided.withColumn("free", F.col("free") - F.sum(F.col("take").cast("int")).over(Window.partitionBy("v")).cast("int"))
            place = F.row_number().over(Window.partitionBy("v").orderBy("take", F.desc("score"), "u"))  # taken ones come last
            sided = sided.withColumn("first", F.col("known") & (place <= F.col("free"))).filter("NOT take")
            of = lambda e, c: F.max(F.when(F.col("v") == F.col(e), F.col(c))).alias(f"{c}_{e}")
            told = sided.withColumns({"a": F.least("v", "u"), "b": F.greatest("v", "u")}).groupBy("a", "b").agg(F.max("score").alias("score"), *[of(e, c) for e in "ab" for c in ("known", "free")], F.bool_and("first").alias("take"))
            edges = checkpointed(told.filter("free_a > 0 AND free_b > 0"))
            now = edges.filter("take").select("a", "b", "score")
            n, taking = edges.agg(F.count(F.lit(1)), F.count_if("take")).first()
            if not taking and n == size:  # none went, and none lost an end that got full
                break
            size = n - taking
            found.append(now)
        for now in found:
            taken = now if taken is None else taken.unionByName(now)
        taken = checkpointed(taken)
        if not cut.limit(1).count():
            break
        full = ends(taken).groupBy("v").agg(F.count(F.lit(1)).alias("used")).filter(F.col("used") >= cap)
        left = checkpointed(rows.join(ends(edges).unionByName(cut).distinct().join(full, "v", "left_anti"), "v", "left_semi"))
    return taken if most is None else taken.orderBy(F.desc("score"), "a", "b").limit(most)

"""A vault of notes: the read verbs over any notes, vectors and links."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vaultspark.operators import graph, search, structured
from vaultspark.operators.lexical import LexicalIndex
from vaultspark.operators.base import checkpointed
from vaultspark.operators.protocols import RERANK, NoopReranker, Reranker, rerank

#: Candidates of each leg for k results, and variants of a query at most.
CANDIDATES, VARIANTS = 8, 4
#: Weights of the exact leg: a name with one owner, with several, and part of a title.
UNIQUE, COLLIDING, PARTIAL = 2.25, 1.0, 0.25
#: Owners of a name, and of names that hold the query, in the exact leg.
OWNERS = 16
#: Words (English and Portuguese) of a question about the present; fixed values.
TEMPORAL = (
    "latest|newest|current(?:ly)?|recent(?:ly)?|as of|today|now|up[- ]to[- ]date|this (?:week|month|quarter|year)|"
    "atual(?:mente)?|mais recentes?|últim[oa]s?|recentes?|hoje|est[ae] (?:semana|mês|trimestre|ano)"
)


def temporal(query: str) -> bool:
    """Whether a query asks for what is recent."""
    return re.search(rf"(?<!\w)(?:{TEMPORAL})(?!\w)", query.lower()) is not None


def literal(query: str):
    """Whether the query stands in a title or body as whole words; one word has to look like an identifier."""
    ask = " ".join(query.lower().split())
    words = re.findall(r"\w+", ask)
    if not words or (len(words) == 1 and not (len(words[0]) >= 8 or re.search(r"[\d_/-]", ask))):
        return F.lit(False)
    inside = re.sub(r"([^\w ])", r"\\\1", ask)
    found = [F.lower(F.regexp_replace(c, r"\s+", " ")).rlike(rf"(?<![\p{{L}}\p{{N}}_]){inside}(?![\p{{L}}\p{{N}}_])") for c in ("title", "body")]
    return F.coalesce(found[0], F.lit(False)) | F.coalesce(found[1], F.lit(False))


def weight_of(zones: dict[str, float]):
    """The weight of a note's zone; one unless set."""
    out = F.lit(1.0)
    for zone, w in zones.items():
        out = F.when(F.col("zone") == zone, float(w)).otherwise(out)
    return out


def owner_order(zones: dict[str, float]) -> list:
    """Owners of one name: live ones, heavy zones, new ones, then by id. Texts that are no dates come last."""
    return [F.col("live").desc(), weight_of(zones).desc(), F.try_to_date("d").desc_nulls_last(), "id"]


class Vault:
    """notes: see operators.structured; vectors: (id, embedding), optional. Every verb gives a DataFrame.

    index: a stored lexical index of the bodies by id; without one, a search reads all bodies."""

    def __init__(self, notes: DataFrame, vectors: DataFrame | None = None, index: LexicalIndex | None = None):
        self.notes, self.vectors, self.index, self.spark = notes, vectors, index, notes.sparkSession

    # structured

    def bases_query(self, filters=None, **options) -> DataFrame:
        return structured.bases_query(self.notes, filters, **options)

    def get(self, note_id: str) -> DataFrame:
        return structured.get(self.notes, note_id)

    def recent(self, limit: int = 20) -> DataFrame:
        return structured.recent(self.notes, limit)

    def grep(self, pattern: str, **options) -> DataFrame:
        return structured.grep(self.notes, pattern, **options)

    def stats(self) -> DataFrame:
        return self.notes.agg(F.count(F.lit(1)).alias("notes"), F.count_if(structured.is_live()).alias("live"), F.countDistinct("zone").alias("zones"))

    # ranked

    def _owns(self, query: str):
        """Whether a note's title or one of its aliases is the query, and whether the query is most of its title in one piece."""
        words = query.lower().split()
        name = F.lower(F.trim(F.regexp_replace("title", r"\s+", " ")))
        title, n = F.split(name, " "), len(words)
        full = F.coalesce(name == " ".join(words), F.lit(False)) | structured.has_alias(" ".join(words), self.notes) if words else F.lit(False)
        if n < 2:
            return full, F.lit(False)
        part = (F.size(title) > n) & (F.lit(n) / F.size(title) >= 0.6) & F.contains(F.concat(F.lit(" "), name, F.lit(" ")), F.lit(f" {' '.join(words)} "))
        return full, F.coalesce(part, F.lit(False))

    def _owned(self, query: str) -> DataFrame:
        """The notes that own the query as a title or part of one, kept: titles are read once, not for each use."""
        full, part = self._owns(query)
        rows = self.notes.select("id", "zone", full.alias("full"), part.alias("part"), structured.is_live().alias("live"), structured.valid_date().alias("d"))
        return checkpointed(rows.filter("full OR part"))

    def _exact(self, rows: DataFrame, zones: dict[str, float]) -> DataFrame:
        """(id, rank, w) from _owned: owners of the query as a title, then of titles that it is most of, sixteen of each at most."""
        best = [rows.filter(kind).orderBy(*owner_order(zones)).limit(OWNERS) for kind in ("full", "part AND NOT full")]
        one = rows.filter("full").agg(F.count(F.lit(1)).alias("owners"))
        w = F.when(F.col("full") & (F.col("owners") == 1), UNIQUE).when(F.col("full"), COLLIDING).otherwise(PARTIAL)
        place = F.row_number().over(Window.orderBy(F.col("full").desc(), *owner_order(zones)))
        return best[0].unionByName(best[1]).crossJoin(F.broadcast(one)).select("id", place.alias("rank"), w.alias("w"))

    def search(
        self, query: str, vector: list[float] | None = None, *, k: int = 10, rrf_k: int = search.ASKED, today: str | None = None, max_tier: str = "MNPI",
        reranker: Reranker | None = None, zones: dict[str, float] | None = None, collapse: bool = True, demote: float | None = None, demoted_zones: tuple[str, ...] = ("transcript",),
    ) -> DataFrame:
        """id, score, rank, source, evidence and create_safety of the first k; the tier cap comes after the cut.

        Legs, family collapse, fusion, zone prior (on hits of the vector leg alone), recency, demotion of near copies,
        the pin of a title's only owner, reranking, the order of a title's owners, the cut, evidence, the tier cap."""
        const, exact_on = search.fusion_constant(rrf_k)
        zones, n = zones or {}, max(CANDIDATES * k, k)
        terms = list(dict.fromkeys(query.lower().split()))
        none = F.lit(None).cast("double")
        legs: dict[str, list[tuple]] = {"lexical": [], "dense": []}  # at most n rows each
        if terms and n > 0 and self.index is not None:
            legs["lexical"] = [(key, rank, None) for key, _, rank in self.index.search(terms, n)]
        elif terms and n > 0:
            found = search.bm25_terms(self.notes.select("id", F.col("body").alias("text")), terms, key="id", n=n)
            legs["lexical"] = [(r["id"], r["rank"], None) for r in found.collect()]
        if self.vectors is not None and vector is not None and n > 0:
            one = self.spark.createDataFrame([(0, [float(x) for x in vector])], "qid long, q array<double>")
            legs["dense"] = [(r["id"], r["rank"], r["score"]) for r in search.nearest(self.vectors, one, key="id", n=n).collect()]
        full, part = self._owns(query)
        owned = self._owned(query)
        heads = search.family_canonicals([r[0] for leg in legs.values() for r in leg], self.notes, full | part) if collapse else {}
        legs = {name: search.fold(leg, heads) for name, leg in legs.items()}
        frames = {name: self.spark.createDataFrame(leg, "id string, rank int, sim double") for name, leg in legs.items()}
        fused = search.fuse({name: f.select(F.lit(0).alias("qid"), "id", "rank") for name, f in frames.items()}, key="id", k=const).drop("qid")
        if exact_on:
            e = self._exact(owned, zones).withColumnRenamed("rank", "exact_rank")
            fused = fused.join(e, "id", "full").withColumn("score", F.coalesce("score", F.lit(0.0)) + F.coalesce(F.col("w") / (const + F.col("exact_rank")), F.lit(0.0)))
        else:
            fused = fused.withColumns({"exact_rank": F.lit(None).cast("int"), "w": none})
        owners = owned.filter("full").agg(F.count(F.lit(1)).alias("owners"))
        absorbed: dict[str, list[str]] = {}
        for i, head in sorted(heads.items()):
            absorbed.setdefault(head, []).append(i)
        twins = self.spark.createDataFrame(list(absorbed.items()), "canonical string, duplicates array<string>")
        rows = self.notes.join(F.broadcast(fused), "id").join(F.broadcast(frames["dense"].select("id", "sim")), "id", "left")
        rows = rows.join(F.broadcast(twins), F.col("id") == F.col("canonical"), "left").crossJoin(F.broadcast(owners))
        rows = rows.withColumns({"full": full, "part": part, "live": structured.is_live(), "d": structured.valid_date(), "literal": literal(query)})
        alone = F.col("lexical_rank").isNull() & F.col("exact_rank").isNull()
        rows = rows.withColumn("score", F.col("score") * F.when(alone, weight_of(zones)).otherwise(1.0))
        if today:
            weight, half = (0.5, 90) if temporal(query) else (0.25, 180)
            rows = rows.withColumn("score", F.col("score") * search.recency(F.col("d"), today, weight=weight, half_life=half))
        pin = F.col("full") & (F.col("owners") == 1) if exact_on else F.lit(False)
        rows = rows.withColumn("down", F.lit(False))
        if demote is not None and self.vectors is not None:
            may = alone & ~F.col("full") & F.col("zone").isin(*demoted_zones)
            rows = checkpointed(rows)  # a few rows, used twice
            near = rows.select("id", "score", may.alias("may")).join(self.vectors.select("id", "embedding"), "id")
            gone = search.near_duplicate_demotion(near, threshold=demote, key="id", eligible="may").filter("demoted").select("id", F.lit(True).alias("gone"))
            rows = rows.join(gone, "id", "left").withColumn("down", F.coalesce("gone", F.lit(False))).drop("gone")
        rows = rows.withColumn("rank", F.row_number().over(Window.orderBy(pin.desc(), F.col("down"), F.round("score", 9).desc(), "id")))
        if reranker is not None:
            rows = checkpointed(rows)
        if reranker is not None and not isinstance(reranker, NoopReranker) and not rows.filter(pin).limit(1).count():
            new = rerank(rows.select("id", "rank", F.col("body").alias("text")), reranker, query, window=RERANK, key="id")
            rows = rows.drop("rank").join(new, "id")
        if exact_on:  # owners of one title keep their places and fill them in their own order
            slots = F.array_sort(F.collect_list(F.when(F.col("full"), F.col("rank"))).over(Window.partitionBy()))
            place = F.row_number().over(Window.orderBy(F.col("full").desc(), *owner_order(zones)))
            rows = rows.withColumns({"slots": slots, "place": place}).withColumn("rank", F.when(F.col("full"), F.get("slots", F.col("place") - 1)).otherwise(F.col("rank")))
        rows = rows.filter(F.col("rank") <= max(k, 0))
        alias = structured.has_alias(" ".join(query.lower().split()), self.notes)
        rows = rows.withColumn("by_alias", alias)
        evidence = F.when(F.col("by_alias"), "alias_hit").when(F.col("full"), "exact_title_match").when(F.col("part"), "title_phrase_match").when(F.col("literal"), "keyword_exact").when((F.col("dense_rank") <= 3) & (F.col("sim") >= 0.8), "high_vector_match").otherwise("weak_semantic")
        both = F.col("lexical_rank").isNotNull() & F.col("dense_rank").isNotNull()
        source = F.when(both, "both").when(F.col("lexical_rank").isNotNull(), "lexical").when(F.col("dense_rank").isNotNull(), "semantic").otherwise("exact")
        safety = F.when(F.col("full") & (F.col("owners") == 1), "exists").when(evidence == "weak_semantic", "unknown").otherwise("probable")
        out = rows.select("id", "title", "type", "zone", "classification", F.round("score", 6).alias("score"), "rank", source.alias("source"), evidence.alias("evidence"), safety.alias("create_safety"), "is_latest_version", F.col("d").alias("date"), structured.snippet("body").alias("snippet"), F.coalesce("duplicates", F.array().cast("array<string>")).alias("duplicates"))
        return structured.egress(out, max_tier)[0].orderBy("rank")

    def search_multi(self, queries: list[str], *, k: int = 10, **options) -> DataFrame:
        """(id, score): up to four different variants, fused over 60."""
        seen = list(dict.fromkeys(" ".join(q.lower().split()) for q in queries if q.strip()))[:VARIANTS]
        rows = None
        for q in seen:
            one = self.search(q, k=k, **options).select("id", "rank")
            rows = one if rows is None else rows.unionByName(one)
        if rows is None:
            return self.spark.createDataFrame([], "id string, score double")
        return rows.groupBy("id").agg(F.round(F.sum(1.0 / (search.ASKED + F.col("rank"))), 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)

    def dossier(self, query: str, *, k: int = 10, **options) -> DataFrame:
        """Live hits as decisions (at most max(5, k / 2)) and sources (at most k), with the number of newer sources of each decision."""
        hits = self.search(query, k=max(2 * k, 60), **options).filter(structured.is_live())
        part = F.when(F.col("type") == "decision", "decision").otherwise("source")
        rows = hits.withColumn("part", part).withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy("rank")))
        rows = rows.filter((F.col("place") <= F.when(F.col("part") == "decision", max(5, k // 2)).otherwise(k)))
        newer = F.when((F.col("part") == "decision") & (F.col("date") != ""), F.size(F.filter(F.collect_list(F.when(F.col("part") == "source", F.col("date"))).over(Window.partitionBy()), lambda d: d > F.col("date"))))
        return rows.withColumn("tensions", newer).select("id", "part", "place", "score", "date", "tensions").orderBy("part", "place")

    # links and duplicates

    def expand(self, ids: list[str], *, depth: int = 2, k: int = 20) -> DataFrame:
        edges, _ = structured.link_graph(self.notes)
        return graph.graph_expand(edges, self.spark.createDataFrame([(i,) for i in ids], "v string"), depth=depth, k=k)

    def exact_duplicates(self) -> DataFrame:
        """(h, id, members, canonical): equal bodies in the same zone and type, the newest first."""
        body = F.trim(F.regexp_replace("body", r"[ \t]+(\n|$)", "$1"))
        rows = self.notes.select("id", "zone", "type", structured.valid_date().alias("d"), F.sha2(body, 256).alias("h"))
        w = Window.partitionBy("h", "zone", "type")
        return rows.withColumn("members", F.count(F.lit(1)).over(w)).withColumn("canonical", F.row_number().over(w.orderBy(F.desc("d"), "id")) == 1).filter("members > 1").select("h", "id", "members", "canonical")

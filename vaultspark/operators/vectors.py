"""A stored vector table: set up, upsert, delete, search and get, over lists around centroids.

Vectors are stored as unit vectors, partitioned by the list of their nearest centroid. Centroids are fitted by
spherical k-means on a bounded sample. Changes are appended: upserts as delta rows in lists, deletions as tombstones;
each change has a number, and of an id only its last change counts. `compact` folds them into a new base. A manifest
names the parts, and is committed under a number that can be taken once.

A search takes each question's nearest lists (its probes), reads these lists only, and compares each batch of stored
vectors with the questions that probe its lists; every task sends on its best n of a question. Questions are
broadcast in blocks of a fixed size. A large list is split over tasks, so a list may hold any share of the rows.
`probes=None` compares all lists and is exact. `calibrate` finds the exact nearest of some stored vectors once, with
their lists, and keeps the fewest probes that reach a target.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vaultspark.operators.base import checkpointed, hadoop_path
from vaultspark.operators.search import STEP_QUERIES, STEP_VECTORS, Best, nearest
from vaultspark.sources.bucketed import Conflict, get_text, put_once

#: Vectors that centroids are fitted on at most, for each list; rounds of fitting; questions in one broadcast.
SAMPLE_PER_LIST, ROUNDS, QUESTIONS = 256, 12, 1 << 14
#: Numbers that a product with all centroids has at most.
NUMBERS = 1 << 21


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm == 0, 1, norm)


def closest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The centroid of the largest product of each row, some rows at a time."""
    step = max(1, NUMBERS // max(1, len(c)))
    return np.concatenate([(x[i : i + step] @ c.T).argmax(1) for i in range(0, len(x), step)]) if len(x) else np.zeros(0, int)


def nearest_lists(x: np.ndarray, c: np.ndarray, probes: int) -> np.ndarray:
    """The centroids of the largest products of each row, in their order, some rows at a time; of equal ones the first."""
    step = max(1, NUMBERS // max(1, len(c)))
    return np.concatenate([np.argsort(-(x[i : i + step] @ c.T), axis=1, kind="stable")[:, :probes] for i in range(0, max(1, len(x)), step)])


def centroids(sample: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit vectors by k-means; fewer if the sample has fewer distinct vectors."""
    x = np.unique(sample, axis=0)
    rnd = np.random.default_rng(seed)
    c = x[rnd.permutation(len(x))[: max(1, lists)]]
    for _ in range(ROUNDS):
        at = closest(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        full = np.bincount(at, minlength=len(c)) > 0
        c = np.where(full[:, None], unit(sums), c)
    return c


class VectorTable:
    """Vectors by id (a column of any orderable type) in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, *, key: str = "vec_id", vector: str = "embedding"):
        self.spark, self.folder, self.key, self.vector = spark, folder.rstrip("/"), key, vector

    # manifests

    def versions(self) -> list[int]:
        root, files = hadoop_path(self.spark, f"{self.folder}/manifests")
        names = [s.getPath().getName() for s in files.listStatus(root)] if files.exists(root) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def manifest(self) -> dict:
        found = self.versions()
        if not found:
            raise FileNotFoundError(f"{self.folder} is not set up")
        return json.loads(get_text(self.spark, f"{self.folder}/manifests/{found[-1]:08d}.json"))

    def _commit(self, m: dict) -> dict:
        if not put_once(self.spark, f"{self.folder}/manifests/{m['version']:08d}.json", json.dumps(m)):
            raise Conflict(f"version {m['version']} of {self.folder} is taken")
        return m

    # writing

    def setup(self, rows: DataFrame, *, lists: int | None = None, probes: int | None = None) -> dict:
        """The first version: centroids of a sample of the rows, and the rows in their lists."""
        if self.versions():
            raise Conflict(f"{self.folder} is set up already")
        rows = rows.select(self.key, self.vector).dropna()
        n = rows.count()
        lists = lists or max(1, min(4096, int(np.sqrt(n))))
        most = SAMPLE_PER_LIST * lists
        share = min(1.0, 1.5 * most / max(1, n))
        some = rows.filter(F.pmod(F.xxhash64(self.key), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(most)
        sample = np.array([r[0] for r in some.select(self.vector).collect()], float)
        dim = sample.shape[1] if len(sample) else 0
        c = centroids(unit(sample), lists) if len(sample) else np.zeros((1, dim))
        m = {"version": 1, "dim": dim, "key": rows.schema[self.key].dataType.simpleString(), "centroids": c.tolist(), "probes": probes, "parts": [], "change": 0}
        return self._commit(self._with(m, rows, compacted=True))

    def _with(self, m: dict, rows: DataFrame, compacted: bool = False) -> dict:
        """The manifest with a part of live rows written."""
        name = f"parts/{uuid.uuid4().hex}"
        c, key, vector = np.array(m["centroids"]), self.key, self.vector
        shared, dim = self.spark.sparkContext.broadcast(c), m["dim"]

        def assign(batches):
            for pdf in batches:
                if not len(pdf):
                    continue
                x = np.stack(pdf[vector]).astype(float)
                if x.shape[1] != dim:
                    raise ValueError(f"vectors of {x.shape[1]} numbers in a table of {dim}")
                x = unit(x)
                yield pd.DataFrame({key: pdf[key], vector: list(x), "list": closest(x, shared.value).astype("int32")})

        placed = rows.mapInPandas(assign, f"`{key}` {m['key']}, `{vector}` array<double>, list int")
        number = m["change"] + 1
        placed.withColumn("change", F.lit(number)).hint("rebalance", "list").write.partitionBy("list").parquet(f"{self.folder}/{name}")
        part = {"path": name, "kind": "base" if compacted else "delta"}
        return {**m, "change": number, "parts": [part] if compacted else [*m["parts"], part]}

    def upsert(self, rows: DataFrame) -> dict:
        """Adds rows, or replaces those of the same id; repeated ids in one call are an error."""
        rows = rows.select(self.key, self.vector).dropna()
        if rows.groupBy(self.key).count().filter("count > 1").limit(1).count():
            raise ValueError(f"{self.key} repeats in one upsert")
        m = self.manifest()
        return self._commit(self._with({**m, "version": m["version"] + 1}, rows))

    def delete(self, ids: DataFrame) -> dict:
        """Ids (a column of the key's name) get tombstones."""
        m = self.manifest()
        name, number = f"parts/{uuid.uuid4().hex}", m["change"] + 1
        ids.select(self.key).dropna().distinct().withColumn("change", F.lit(number)).write.parquet(f"{self.folder}/{name}")
        return self._commit({**m, "version": m["version"] + 1, "change": number, "parts": [*m["parts"], {"path": name, "kind": "tombstones"}]})

    def compact(self) -> dict:
        """One base part of what is live."""
        m = self.manifest()
        rows = self.rows().select(self.key, self.vector)
        return self._commit(self._with({**m, "version": m["version"] + 1}, rows, compacted=True))

    # reading

    def _part(self, m: dict, part: dict) -> DataFrame:
        if part["kind"] == "tombstones":
            return self.spark.read.schema(f"`{self.key}` {m['key']}, change int").parquet(f"{self.folder}/{part['path']}")
        return self.spark.read.schema(f"`{self.key}` {m['key']}, `{self.vector}` array<double>, change int, list int").parquet(f"{self.folder}/{part['path']}")

    def rows(self, lists: list[int] | None = None) -> DataFrame:
        """(key, vector, list) of live rows, of some lists; the list filter reaches the scans."""
        m = self.manifest()
        live = [self._part(m, p) for p in m["parts"] if p["kind"] != "tombstones"]
        out = live[0]
        for part in live[1:]:
            out = out.unionByName(part)
        if lists is not None:
            out = out.filter(F.col("list").isin(lists))
        if len(m["parts"]) > 1:  # of an id only its last change counts: changes are few against the base
            changes = None
            for p in m["parts"][1:]:
                one = self._part(m, p).select(self.key, "change")
                changes = one if changes is None else changes.unionByName(one)
            last = changes.groupBy(self.key).agg(F.max("change").alias("last"))
            out = out.join(last, self.key, "left").filter(F.col("last").isNull() | (F.col("change") == F.col("last"))).drop("last")
        return out.select(self.key, self.vector, "list")

    def get(self, ids: DataFrame) -> DataFrame:
        """(key, vector) of ids that are live."""
        return self.rows().join(ids.select(self.key).distinct(), self.key, "left_semi").select(self.key, self.vector)

    def search(self, questions: DataFrame, n: int, *, probes: int | None = -1, block: int = QUESTIONS) -> DataFrame:
        """(qid, key, score, rank) for questions (qid, q). probes: lists to look at; -1: the calibrated number; None: all, exact."""
        m = self.manifest()
        probes = m["probes"] if probes == -1 else probes
        c = np.array(m["centroids"])
        if probes is None or probes >= len(c):
            return nearest(self.rows(), questions, key=self.key, vector=self.vector, n=n, block=block)
        asked = questions.select("qid", F.col("q").cast("array<double>").alias("q"))
        blocks = max(1, -(-asked.count() // block))
        kind = questions.schema["qid"].dataType.simpleString()
        out = None
        for i in range(blocks):
            some = (asked.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i) if blocks > 1 else asked).toPandas()
            mat = unit(np.stack(some["q"]).astype(float)) if len(some) else np.zeros((0, m["dim"]))
            looked = np.zeros((len(mat), len(c)), bool)  # a byte for a question and list
            np.put_along_axis(looked, nearest_lists(mat, c, probes), True, 1)
            shared = self.spark.sparkContext.broadcast((some["qid"].to_numpy(), mat, looked))
            part = self.rows([int(l) for l in np.flatnonzero(looked.any(0))]).mapInPandas(_best_of_lists(shared, self.key, self.vector, n), f"qid {kind}, `{self.key}` {m['key']}, score double")
            out = part if out is None else out.unionByName(part)
        return out.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), self.key))).filter(F.col("rank") <= n)

    def recall(self, questions: DataFrame, n: int, probes: int) -> float:
        """The share of the exact n nearest that a search with so many probes finds."""
        exact = self.search(questions, n, probes=None).select("qid", self.key)
        found = self.search(questions, n, probes=probes).select("qid", self.key, F.lit(1).alias("hit"))
        told = exact.join(found, ["qid", self.key], "left").agg(F.count(F.lit(1)).alias("total"), F.count("hit").alias("hits")).first()
        return told["hits"] / told["total"] if told["total"] else 1.0

    def calibrate(self, *, target: float = 0.95, n: int = 10, sample: int = 200) -> dict:
        """Keeps the fewest probes that reach the target on at most `sample` stored vectors (the lowest hashes of ids)."""
        m = self.manifest()
        asked = checkpointed(self.rows().orderBy(F.xxhash64(self.key), self.key).limit(sample).select(F.col(self.key).alias("qid"), F.col(self.vector).alias("q")))
        exact = nearest(self.rows(), asked, key=self.key, vector=self.vector, n=n).select("qid", self.key)
        rows = exact.join(self.rows().select(self.key, "list"), self.key).groupBy("qid").agg(F.collect_list("list").alias("lists")).join(asked, "qid").select("q", "lists").collect()  # of the sample only
        c, low = np.array(m["centroids"]), 1
        if rows:  # a neighbour is found when its list is among those looked at, so its list's place is the number of probes that it takes
            order = nearest_lists(unit(np.array([r["q"] for r in rows], float)), c, len(c))
            takes = np.sort(np.concatenate([np.argsort(o)[r["lists"]] for o, r in zip(order, rows)])) + 1
            low = next((int(p) for p in np.unique(takes) if np.searchsorted(takes, p, "right") / len(takes) >= target), len(c))
        return self._commit({**m, "version": m["version"] + 1, "probes": low})


def _best_of_lists(shared, key: str, vector: str, n: int):
    def over(batches):
        names, mat, looked = shared.value
        best = Best(len(names), n)
        for pdf in batches:
            pdf = pdf.sort_values("list", kind="stable")
            for start in range(0, len(pdf), STEP_VECTORS):
                some = pdf.iloc[start : start + STEP_VECTORS]
                x, lists, keys = np.stack(some[vector]).astype(float).T, some["list"].to_numpy(), some[key].to_numpy()
                asked = np.flatnonzero(looked[:, np.unique(lists)].any(1))
                for first in range(0, len(asked), STEP_QUERIES):
                    these = asked[first : first + STEP_QUERIES]
                    best.add(these, np.round(mat[these] @ x, 6), keys, looked[these][:, lists])
        if len(best.at):
            yield pd.DataFrame({"qid": names[best.at], key: best.keys, "score": best.scores})

    return over

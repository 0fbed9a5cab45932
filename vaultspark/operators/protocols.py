"""What may be plugged in: embedders, vector backends and rerankers, and how they run on executors."""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vaultspark.functions.text import HASH_DIM, hash_vector
from vaultspark.operators import search

#: Hits that a reranker looks at: the default, and the least and most that may be asked for.
RERANK, RERANK_LEAST, RERANK_MOST = 20, 10, 50
PASSAGE_CHARS = 2000


class Embedder(Protocol):
    dim: int

    def embed_batch(self, texts: list[str]) -> list[np.ndarray]: ...


class Reranker(Protocol):
    def rerank(self, query: str, passages: list[str]) -> list[float]: ...


class HashEmbedder:
    """Signed feature hashing: no model, the same everywhere."""

    dim = HASH_DIM

    def embed_batch(self, texts: list[str]) -> list[np.ndarray]:
        return [hash_vector(t, self.dim) for t in texts]


class NoopReranker:
    def rerank(self, query: str, passages: list[str]) -> list[float]:
        return [float(-i) for i in range(len(passages))]


def embed(rows: DataFrame, embedder: Embedder, *, key: str, text: str, out: str = "embedding") -> DataFrame:
    """(key, out): texts are embedded in batches of like length."""
    kind = rows.schema[key].dataType.simpleString()

    def over(batches):
        for pdf in batches:
            texts = pdf[text].fillna("").tolist()
            order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
            vectors: list = [None] * len(texts)
            for i, v in zip(order, embedder.embed_batch([texts[i] for i in order])):
                vectors[i] = np.asarray(v, float).tolist()
            yield pd.DataFrame({key: pdf[key], out: vectors})

    return rows.select(key, text).mapInPandas(over, f"{key} {kind}, {out} array<double>")


class VectorTable:
    """Vectors as a DataFrame: upserts, deletes and exact search."""

    def __init__(self, rows: DataFrame, *, key: str = "vec_id", vector: str = "embedding"):
        self.rows, self.key, self.vector = rows, key, vector

    def upsert(self, rows: DataFrame) -> VectorTable:
        kept = self.rows.join(rows.select(self.key), self.key, "left_anti")
        return VectorTable(kept.select(self.rows.columns).unionByName(rows.select(self.rows.columns)), key=self.key, vector=self.vector)

    def delete(self, keys: DataFrame) -> VectorTable:
        return VectorTable(self.rows.join(keys.select(self.key), self.key, "left_anti"), key=self.key, vector=self.vector)

    def search(self, queries: DataFrame, n: int = 20) -> DataFrame:
        return search.nearest(self.rows, queries, key=self.key, vector=self.vector, n=n)


def rerank(hits: DataFrame, reranker: Reranker, query: str, *, window: int = RERANK, key: str = "doc_id", text: str = "text") -> DataFrame:
    """hits (key, rank, text) with new ranks: the head is scored and sorted, the tail stays as it is.

    The head is at most RERANK_MOST rows of one query, so they meet in one group."""
    window = max(RERANK_LEAST, min(RERANK_MOST, window))
    kind = hits.schema[key].dataType.simpleString()

    def score(pdf):
        pdf = pdf.sort_values("rank")
        out = pdf[[key, "rank"]].copy()
        out["s"] = reranker.rerank(query, [(t or "")[:PASSAGE_CHARS] for t in pdf[text]])
        return out

    head = hits.filter(F.col("rank") <= window).select(key, "rank", text).withColumn("one_", F.lit(1)).groupBy("one_").applyInPandas(lambda pdf: score(pdf), f"{key} {kind}, rank long, s double")
    both = hits.select(key, F.col("rank").cast("long").alias("rank")).join(head.drop("rank"), key, "left")
    order = Window.orderBy(F.col("s").isNull(), F.col("s").desc(), "rank")
    return both.withColumn("rank", F.row_number().over(order)).drop("s")

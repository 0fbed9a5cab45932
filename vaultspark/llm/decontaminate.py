"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over token windows.

Words are runs of ASCII digits, letters and non-ASCII bytes after lower-casing A-Z. Each item gives its windows
of `width` consecutive words; an item with fewer words (but some) is one window. Hashes of all windows of a
document are looked up in a bitmap and then in the sorted hash set; what is found is verified byte by byte.

Benchmarks are data too: their windows are made on executors and counted, and dealt by hash into blocks of about
`block_windows`, each of which is collected and broadcast alone, so that no broadcast grows beyond a known size. One
block (the usual case) needs one pass over the texts. For more, rows are numbered in a written copy, each block is
scanned on its own, and its hits are joined by the rows' numbers: the result does not depend on the blocks.

Defined cases: null or wordless texts have 0 words and no hits; null or wordless items never occur; equal items
occur together and each counts; items without an id hit words like others, but are neither counted nor named, since
they have no id to name; repeated documents, and such without a key, are judged row by row; keys may be of any
type; an empty benchmark hits nothing; other columns of the tables are not looked at. Spans are those of all items
together and are cut out once, so that no text arises by cutting that was not there.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from vaultspark.llm._common import LOWER, drop_written, lean, text_steps, window_hashes, word_hashes, word_spans, written

#: 0-9, a-z and every byte of non-ASCII characters.
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True

#: Words in a window of a test item.
WIDTH = 10
#: Windows in one broadcast block (about 100 bytes each).
BLOCK_WINDOWS = 500_000

def _normal(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    return b" ".join(low[a:b].tobytes() for a, b in zip(starts, ends))


_WINDOWS = pa.schema([("h", pa.int64()), ("k", pa.int32()), ("gram", pa.binary()), ("item", pa.string())])


def _windows(width: int):
    """(hash, words, normalised text, item) of each window of (item_id, text) rows."""

    def over(batches):
        for batch in batches:
            names = batch.column(0).cast(pa.string()).to_pylist()
            for first, offs, raw in text_steps(batch, batch.schema.names[1]):
                low = LOWER[raw]
                starts, ends, counts = word_spans(offs, low, IS_WORD)
                words, at, rows = word_hashes(low, starts, ends), 0, []
                for d, n in enumerate(counts.tolist()):
                    k = min(width, n)
                    for i, h in enumerate(window_hashes(words[at : at + n], k).view(np.int64).tolist() if n else ()):
                        rows.append((h, k, _normal(low, starts[at + i : at + i + k], ends[at + i : at + i + k]), names[first + d]))
                    at += n
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _WINDOWS)], schema=_WINDOWS)

    return over


class _Grams:
    """One block of windows, made ready for lookups."""

    def __init__(self, windows):
        """windows: (hash, words, text, item) rows."""
        self.by_text: dict[bytes, list[str]] = {}
        hashes: dict[int, set[int]] = {}
        for h, k, text, item in windows:
            self.by_text.setdefault(text, []).append(item)
            hashes.setdefault(k, set()).add(h & 0xFFFFFFFFFFFFFFFF)
        self.sorted = {k: np.sort(np.fromiter(v, np.uint64, len(v))) for k, v in hashes.items()}
        self.bits = {}
        for k, v in self.sorted.items():
            size = 1 << max(16, int(len(v) * 16 - 1).bit_length())
            self.bits[k] = np.zeros(size, bool)
            self.bits[k][v & np.uint64(size - 1)] = True

    def candidates(self, words: np.ndarray, k: int) -> np.ndarray:
        h = window_hashes(words, k)
        if len(h) == 0:
            return np.zeros(0, np.int64)
        at = np.flatnonzero(self.bits[k][h & np.uint64(len(self.bits[k]) - 1)])
        near = np.searchsorted(self.sorted[k], h[at])
        near[near == len(self.sorted[k])] = 0
        return at[self.sorted[k][near] == h[at]]


def _hits(grams: _Grams, batch: pa.RecordBatch, text: str):
    """Yields (row, words, spans, items) of each row of a batch, with the rows' own word spans."""
    for first, offs, raw in text_steps(batch, text):
        low = LOWER[raw]
        starts, ends, counts = word_spans(offs, low, IS_WORD)
        words = word_hashes(low, starts, ends)
        stop = np.cumsum(counts)
        hits: dict[int, tuple[list, set]] = {}
        for k in grams.sorted:
            for i in grams.candidates(words, k):
                d = int(np.searchsorted(stop, i, "right"))
                if i + k > stop[d]:
                    continue  # reaches into the next document
                items = grams.by_text.get(_normal(low, starts[i : i + k], ends[i : i + k]))
                if items:
                    spans, found = hits.setdefault(d, ([], set()))
                    base = int(stop[d] - counts[d])
                    spans.append((int(i) - base, int(i) - base + k))
                    found.update(x for x in items if x is not None)
        for d in range(len(counts)):
            spans, found = hits.get(d, ((), ()))
            yield first + d, int(counts[d]), merge_spans(spans), sorted(found)


def _scan(shared, only_hits: bool):
    """Over (key, text) batches: key, n_words, flat spans and items of each row (with hits)."""

    def over(batches):
        for batch in batches:
            rows = [r for r in _hits(shared.value, batch, batch.schema.names[1]) if r[2] or not only_hits]
            keys = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
            cols = [pa.array([r[1] for r in rows], pa.int64()), pa.array([[x for s in r[2] for x in s] for r in rows], pa.list_(pa.int64())), pa.array([r[3] for r in rows], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([keys, *cols], ["row_key", "n_words", "spans", "items"])

    return over


def merge_spans(spans) -> list[tuple[int, int]]:
    """Half-open word spans as disjoint ones in order."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _shared_blocks(docs: DataFrame, benchmark: DataFrame, width: int, block_windows: int, item_id: str, item_text: str):
    """(number of blocks, a generator of their broadcasts); at most one block is on the driver."""
    spark = docs.sparkSession
    items = benchmark.select(item_id, item_text)
    table = items.mapInArrow(lean(_windows(width)), "h long, k int, gram binary, item string").distinct()
    blocks = max(1, -(-table.count() // block_windows))
    if blocks > 1:
        table = written(table.withColumn("block", F.pmod(F.xxhash64("gram", "item"), F.lit(blocks))), "windows")

    def generate():
        for i in range(blocks):
            some = table.filter(F.col("block") == i) if blocks > 1 else table
            rows = some.select("h", "k", "gram", "item").toArrow()
            yield spark.sparkContext.broadcast(_Grams(zip(*(c.to_pylist() for c in rows.columns))))
        if blocks > 1:
            drop_written(table)

    return blocks, generate()


def _scanned(key_type, only_hits: bool, rows: DataFrame, shared) -> DataFrame:
    out = StructType([StructField("row_key", key_type), StructField("n_words", LongType()), StructField("spans", ArrayType(LongType())), StructField("items", ArrayType(StringType()))])
    return rows.mapInArrow(lean(_scan(shared, only_hits)), out)


def _by_row(rows: DataFrame, blocks) -> DataFrame:
    """(row, s, i): of each row with hits its spans (unmerged, flat) and items over all blocks."""
    parts = [_scanned(LongType(), True, rows, shared) for shared in blocks]
    more = parts[0]
    for part in parts[1:]:
        more = more.unionByName(part)
    return more.groupBy(F.col("row_key").alias("row")).agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("i"))


def _numbered(df: DataFrame) -> DataFrame:
    """df's rows as one struct column `own`, with the number `row`, written."""
    return written(df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("own")).withColumn("row", F.monotonically_increasing_id()), "numbered")


_merged = F.udf(lambda flat: [x for s in merge_spans(zip(flat[::2], flat[1::2])) for x in s] if flat else [], ArrayType(LongType()))


def scan(docs: DataFrame, benchmark: DataFrame, *, width: int = WIDTH, block_windows: int = BLOCK_WINDOWS, key: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document row: its key, n_words, spans (flat starts and ends of hit words) and items (ids with windows in it)."""
    key_type = docs.schema[key].dataType
    n, blocks = _shared_blocks(docs, benchmark, width, block_windows, item_id, item_text)
    if n == 1:
        return _scanned(key_type, False, docs.select(key, text), next(blocks)).withColumnRenamed("row_key", key)
    rows = _numbered(docs.select(F.col(key).alias("k"), F.col(text).alias("t")))
    hits = written(_by_row(rows.select("row", "own.t"), blocks), "hits")
    none = docs.sparkSession.sparkContext.broadcast(_Grams([]))
    counted = _scanned(LongType(), False, rows.select("row", "own.t"), none).select(F.col("row_key").alias("row"), "n_words")
    found = counted.join(hits.drop("n_words"), "row", "left").join(rows.select("row", F.col("own.k").alias("k")), "row")
    return found.select(
        F.col("k").alias(key),
        "n_words",
        _merged("s").alias("spans"),
        F.coalesce("i", F.array().cast("array<string>")).alias("items"),
    )


def remove_spans(text: str | None, spans: list[int]) -> str | None:
    """The text without the hit words (flat word spans) and what lies between the words of a span."""
    if not text or not spans:
        return text
    raw = text.encode()
    arr = np.frombuffer(raw, np.uint8)
    starts, ends, _ = word_spans(np.array([0, len(arr)]), LOWER[arr], IS_WORD)
    out, at = [], 0
    for a, b in zip(spans[::2], spans[1::2]):
        out.append(raw[at : starts[a]])
        at = int(ends[b - 1])
    return b"".join([*out, raw[at:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, mode: str = "documents", width: int = WIDTH, block_windows: int = BLOCK_WINDOWS, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without contaminated documents (mode "documents") or without the hit spans (mode "spans").

    Row by row, in one pass over the texts where one block of windows suffices; all columns are kept."""
    if mode not in ("documents", "spans"):
        raise ValueError("mode is 'documents' or 'spans'")
    n, blocks = _shared_blocks(docs, benchmark, width, block_windows, item_id, item_text)
    if n == 1:
        return docs.mapInArrow(lean(_remover(next(blocks), docs.columns.index(text), mode)), docs.schema)
    rows = _numbered(docs)
    own = F.col("own").getField(text)
    hits = written(_by_row(rows.select("row", own.alias("t")), blocks), "hits")
    if mode == "documents":
        return rows.join(hits.select("row"), "row", "left_anti").select("own.*")
    cut = F.udf(lambda t, flat: remove_spans(t, [x for s in merge_spans(zip(flat[::2], flat[1::2])) for x in s] if flat else []), "string")
    clean = cut(own, "s")
    return rows.join(hits.select("row", "s"), "row", "left").select(*(clean.alias(c) if c == text else F.col("own").getField(c).alias(c) for c in docs.columns))


def _remover(shared, at: int, mode: str):
    def over(batches):
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(at)], ["t"])
            hit = {i: [x for s in spans for x in s] for i, _, spans, _ in _hits(shared.value, texts, "t") if spans}
            if not hit:
                yield batch
            elif mode == "documents":
                yield batch.filter(pa.array([i not in hit for i in range(len(batch))]))
            else:
                field = batch.schema.field(at)
                new = pa.array([remove_spans(t, hit.get(i, [])) for i, t in enumerate(batch.column(at).to_pylist())], field.type)
                yield batch.set_column(at, field, new)

    return over


def digest(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """The contract's columns: counts, and the SHA-256 of the ids of items with occurring windows."""
    lengths = F.transform(F.sequence(F.lit(1), F.greatest(F.size("spans"), F.lit(1))), lambda i: F.when(i % 2 == 0, F.get("spans", i - 1) - F.get("spans", i - 2)).otherwise(F.lit(0)))
    n_hit = F.when(F.size("spans") == 0, F.lit(0).cast("long")).otherwise(F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0))))
    return scanned.select(key, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()

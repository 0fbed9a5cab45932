"""N-gram Jaccard self-join by vertical partitioning, and the groups of linked documents.

A document's set holds the fingerprints of its distinct k-word shingles. Two documents link when
100 * |A & B| >= percent * |A | B|. The plan:

1. Documents with equal sets are one class (key: a 64-bit sum over the set, and its size). Each class also has a
   1,024-bit parity map; the maps of two sets differ in at most |A ^ B| bits, which rules out most pairs at once.
2. All n-grams get one global order: by a sketch of how many documents hold them (rare ones first), then by
   fingerprint. The order only decides what is cheap, never what is found.
3. Linked classes share one of their first n - ceil(percent * n / 100) + 1 n-grams, and at the first that they share,
   enough n-grams must follow in both. Those prefixes are dealt by n-gram and streamed in order. An n-gram of up to
   `FEW` classes gives the pairs that can link; in a larger one, classes are linked to one central class of like size,
   so a group of m classes gives at most m candidates and not all its pairs.
4. Candidates are verified vertically: the global n-gram order is cut into `FRAGMENTS` fragments of about equally many
   n-grams, the overlap of a pair is counted in each fragment on its own, and the parts are summed per pair. (Prefixes
   find the candidates; vertical counting decides on them.)
5. Verified links give components. Only pairs whose classes still lie in different components can change them:
   those of larger n-gram groups that share a prefix n-gram, have like sizes and pass the parity maps are verified the same way. Large
   n-gram groups are dealt in blocks (`BLOCK` classes each), so no group meets in one task.
6. Components are found by repeated minimum labels with pointer jumping over the links of classes.

No candidate is dropped by a cap. Fingerprints are 64 bits of mixed bytes, with no structure that texts could hit; a
chance equality could only miscount an overlap by one, and two classes are only taken for one if the sums over their sets
and their sizes agree by chance.

Defined cases: null and wordless texts have empty sets and link with nothing; a text with fewer than k words is one
shingle; keys are whole numbers (others are refused); repeated rows share their class; rows without a key have no component (null) and keep_one keeps them; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultspark.llm._common import LOWER, drop_written, lean, mix, remove_path, text_steps, window_hashes, word_hashes, word_spans, work_folder, written

#: Everything but the ASCII space, tab, line feed, vertical tab, form feed and carriage return.
IS_WORD = np.ones(256, bool)
IS_WORD[[32, 9, 10, 11, 12, 13]] = False

FRAGMENTS = 4
#: The frequency sketch has a counter for each GRAMS_PER_COUNTER n-grams, between 2 ** 16 and 2 ** 24, summed in SLICES parts.
GRAMS_PER_COUNTER, SKETCH_BITS, SLICES = 32, (16, 24), 64
#: Classes of an n-gram whose pairs are listed one by one.
FEW = 4
MAP_WORDS = 16
BLOCK = 20_000
HOT_SHARE = 1000
#: Rows of one n-gram that the streaming step holds at once.
CARRY = 500_000

_U = np.uint64
_MAPS = [f"m{i}" for i in range(MAP_WORDS)]


def document_sets(batch: pa.RecordBatch, column: str, k: int):
    """Yields (row, sorted distinct fingerprints) of each row of a batch."""
    for first, offs, raw in text_steps(batch, column):
        low = LOWER[raw]
        starts, ends, counts = word_spans(offs, low, IS_WORD)
        words = word_hashes(low, starts, ends)
        grams = window_hashes(words, k)
        at = 0
        for d, n in enumerate(counts.tolist()):
            if n >= k:
                yield first + d, np.unique(grams[at : at + n - k + 1])
            elif n:
                yield first + d, window_hashes(words[at : at + n], n)
            else:
                yield first + d, np.zeros(0, _U)
            at += n


def set_key(grams: np.ndarray) -> int:
    """A 64-bit sum over a set, as a signed number; 0 for the empty set."""
    if len(grams) == 0:
        return 0
    with np.errstate(over="ignore"):
        total = np.add.reduce(mix(grams ^ _U(0xD6E8FEB86659FD93))) + _U(len(grams))
    return int(mix(np.array([total], _U)).view(np.int64)[0])


def parity_map(grams: np.ndarray) -> np.ndarray:
    odd = np.bincount((grams & _U(64 * MAP_WORDS - 1)).astype(np.int64), minlength=64 * MAP_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _classes(key: str, text: str, k: int):
    def over(batches):
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index(key))
            sets, sizes, maps = [], [], []
            for _, grams in document_sets(batch, text, k):
                sets.append(set_key(grams))
                sizes.append(len(grams))
                maps.append(parity_map(grams))
            table = np.array(maps, np.int64).reshape(-1, MAP_WORDS)
            yield pa.RecordBatch.from_arrays([keys.cast(pa.int64()), pa.array(sets, pa.int64()), pa.array(sizes, pa.int64()), *(pa.array(table[:, i]) for i in range(MAP_WORDS))], ["key", "c", "n", *_MAPS])

    return over


class _Sketch:
    """Counters of one task, and their packed slices."""

    def __init__(self, bits: int):
        self.bits = bits
        self.counts = np.zeros(1 << bits, np.int32)

    def add(self, hashes: np.ndarray) -> None:
        np.add.at(self.counts, (hashes >> _U(64 - self.bits)).astype(np.int64), np.int32(1))

    def rows(self):
        """Slices with anything in them; a task's counters stop at 255."""
        few = np.minimum(self.counts, 255).astype(np.uint8).reshape(SLICES, -1)
        for i in np.flatnonzero(few.any(1)):
            yield int(i), zlib.compress(few[i].tobytes(), 1)


_SLICE = pa.schema([("slice", pa.int32()), ("packed", pa.binary())])


def _slices(sketch: _Sketch) -> pa.RecordBatch:
    rows = list(sketch.rows())
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema=_SLICE)


def _sum_slices(bits: int):
    def over(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(zlib.decompress(packed.as_py()), np.uint8)
                if i in sums:
                    sums[i] += part
                else:
                    sums[i] = part.astype(np.uint64)
        for i, total in sums.items():  # levels: a step for each eighth of a doubling
            level = np.minimum(255, np.round(8 * np.log2(1 + total.astype(float)))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(level.tobytes(), 1)], pa.binary())], schema=_SLICE)

    return over


def _levels(partial: DataFrame, bits: int) -> np.ndarray:
    """The summed sketch as levels of 0 to 255: 2 ** bits bytes on the driver, whatever the input."""
    levels = np.zeros((SLICES, (1 << bits) // SLICES), np.uint8)
    for row in partial.repartition(SLICES, "slice").mapInArrow(lean(_sum_slices(bits)), "slice int, packed binary").collect():
        levels[row["slice"]] = np.frombuffer(zlib.decompress(bytes(row["packed"])), np.uint8)
    return levels.reshape(-1)


def order_of(grams: np.ndarray, levels: np.ndarray, bits: int) -> np.ndarray:
    """The places of n-grams in the global order, as numbers: by level, then by fingerprint."""
    lv = levels[(grams >> _U(64 - bits)).astype(np.int64)]
    return (lv.astype(_U) << _U(56)) | (grams >> _U(8))


def fragment_cuts(levels: np.ndarray, parts: int = FRAGMENTS) -> np.ndarray:
    """Places that cut the global order into parts of about equally many n-grams."""
    counters = np.bincount(levels, minlength=256)
    held = np.cumsum(counters * (2.0 ** (np.arange(256) / 8) - 1))
    if held[-1] == 0:
        return np.zeros(parts - 1, _U)
    at = held[-1] * np.arange(1, parts) / parts
    level = np.searchsorted(held, at)
    before = np.where(level > 0, held[level - 1], 0)
    inner = (at - before) / np.maximum(held[level] - before, 1e-9)
    return (level.astype(_U) << _U(56)) | (np.minimum(inner, 1 - 1e-9) * 2.0**56).astype(_U)


def _gram_sketch(text: str, k: int, bits: int):
    def over(batches):
        sketch = _Sketch(bits)
        for batch in batches:
            for _, grams in document_sets(batch, text, k):
                sketch.add(grams)
        yield _slices(sketch)

    return over


def _id_sketch(bits: int):
    def over(batches):
        sketch = _Sketch(bits)
        for batch in batches:
            sketch.add(mix(np.asarray(batch.column(0).cast(pa.int64()).fill_null(0)).view(_U)))
        yield _slices(sketch)

    return over


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


_PREFIX = "g long, c long, n long, p int, w int"


def _prefixes(text: str, k: int, percent: int, bits: int, levels):
    def over(batches):
        level, seen = levels.value, set()
        for batch in batches:
            out_g, out_c, out_n, out_p, out_w = [], [], [], [], []
            for _, grams in document_sets(batch, text, k):
                n = len(grams)
                if not n:
                    continue
                c = set_key(grams)
                if c in seen:  # copies in one task give their prefix once
                    continue
                if len(seen) >= 1_000_000:
                    seen.clear()
                seen.add(c)
                lv = level[(grams >> _U(64 - bits)).astype(np.int64)]
                p = prefix_length(n, percent)
                out_g.append(grams[np.argsort(lv, kind="stable")[:p]])  # grams are sorted already: ties by fingerprint
                out_p.append(np.arange(p, dtype=np.int32))
                out_c.append(np.full(p, c))
                out_n.append(np.full(p, n))
                out_w.append(np.full(p, int(lv.mean(dtype=np.float64) * 1000), np.int32))
            if out_g:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_g).view(np.int64)), pa.array(np.concatenate(out_c)), pa.array(np.concatenate(out_n)), pa.array(np.concatenate(out_p)), pa.array(np.concatenate(out_w))], ["g", "c", "n", "p", "w"])

    return over


#: kind 0: a class in an n-gram of many (g, c, n, its place p as d, 0); kind 1: a candidate (c, n), (d, m).
_STAR = pa.schema([("kind", pa.int32()), ("g", pa.int64()), ("c", pa.int64()), ("n", pa.int64()), ("d", pa.int64()), ("m", pa.int64())])


def can_follow(n, p, m, q, percent: int):
    """Whether sets of n and m n-grams can link if the first that they share is at places p and q."""
    like = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
    return like & (np.minimum(n - p, m - q) * (100 + percent) >= percent * (n + m))


def _stars(percent: int):
    """Over prefixes sorted by (g, n, c): candidates, and the classes of n-grams that more than FEW share."""

    def pairs(i, j, g, c, n, p):
        ok = can_follow(n[i], p[i], n[j], p[j], percent)
        i, j = i[ok], j[ok]
        return np.ones(len(i), np.int32), g[i], c[i], n[i], c[j], n[j]

    def star(a, b, g, c, n, p, w, out):
        out.append((np.zeros(b - a, np.int32), g[a:b], c[a:b], n[a:b], p[a:b].astype(np.int64), np.zeros(b - a, np.int64)))
        lo = a
        while lo < b:
            hi = a + int(np.searchsorted(n[a:b], n[lo] * 100 // percent, "right"))
            hub = lo + int(np.argmax(w[lo:hi]))
            others = np.delete(np.arange(lo, hi), hub - lo)
            if lo > a:
                others = np.append(others, lo - 1)
            out.append(pairs(others, np.full(len(others), hub), g, c, n, p))
            lo = hi

    large: set[int] = set()  # the n-gram whose group goes on in parts

    def over(batches):
        rest = None
        for batch in batches:
            cols = [np.asarray(batch.column(i)) for i in range(5)]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols)]
            left: list = []
            yield from work(cols, left, False)
            rest = left[0] if left else None
        if rest is not None:
            yield from work(rest, [], True)

    def work(cols, left, last):
        if not len(cols[0]):
            return
        g, c, n = cols[:3]
        same = np.zeros(len(g), bool)
        same[1:] = (g[1:] == g[:-1]) & (c[1:] == c[:-1]) & (n[1:] == n[:-1])
        g, c, n, p, w = (x[~same] for x in cols)
        edges = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        ends = np.append(edges[1:], len(g))
        if not last:
            if ends[-1] - edges[-1] < CARRY:
                left.append([x[edges[-1] :] for x in (g, c, n, p, w)])
                edges, ends = edges[:-1], ends[:-1]
            else:  # a very large group goes on in parts; its last class ties them together
                left.append([x[-1:] for x in (g, c, n, p, w)])
                large.clear()
                large.add(int(g[-1]))
        sizes = ends - edges
        if large:
            sizes = np.where((g[edges] == next(iter(large))) & (sizes > 1), FEW + sizes, sizes)
        found = []
        for size in range(2, FEW + 1):
            a = edges[sizes == size]
            for i in range(size):
                for j in range(i + 1, size):
                    found.append(pairs(a + i, a + j, g, c, n, p))
        for i in np.flatnonzero(sizes > FEW):
            star(int(edges[i]), int(ends[i]), g, c, n, p, w, found)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), f.type) for x, f in zip(zip(*found), _STAR)], schema=_STAR)

    return over


def _fragments(key: str, text: str, k: int, bits: int, wanted, levels):
    def over(batches):
        ids, level = wanted.value, levels.value
        ends = fragment_cuts(level)
        for batch in batches:
            keys = np.asarray(batch.column(batch.schema.get_field_index(key)).cast(pa.int64()).fill_null(0))
            some = ids[(mix(keys.view(_U)) >> _U(64 - bits)).astype(np.int64)] > 0
            if not some.any():
                continue
            batch = batch.filter(pa.array(some))
            cs, ns, fs, blobs, seen = [], [], [], [], set()
            for _, grams in document_sets(batch, text, k):
                c = set_key(grams)
                if not len(grams) or c in seen:
                    continue
                seen.add(c)
                part = np.searchsorted(ends, order_of(grams, level, bits), "right")
                for f in range(FRAGMENTS):
                    cs.append(c)
                    ns.append(len(grams))
                    fs.append(f)
                    blobs.append(grams[part == f].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cs, pa.int64()), pa.array(ns, pa.int64()), pa.array(fs, pa.int32()), pa.array(blobs, pa.binary())], ["c", "n", "f", "grams"])

    return over


def _overlaps(batches):
    for batch in batches:
        a, b = batch.column(batch.schema.get_field_index("ga")), batch.column(batch.schema.get_field_index("gb"))
        counts = []
        for x, y in zip(a, b):
            x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            counts.append(int(np.count_nonzero(y[at] == x)) if len(y) else 0)
        keep = [batch.column(batch.schema.get_field_index(n)) for n in ("a", "na", "b", "nb")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(counts, pa.int64())], ["a", "na", "b", "nb", "part"])


def _like_size(na, nb, percent: int) -> Column:
    return (F.lit(100) * F.least(na, nb)) >= F.lit(percent) * F.greatest(na, nb)


class _Join:
    """The steps of one join, with what they share."""

    def __init__(self, docs: DataFrame, key: str, text: str, k: int, percent: int):
        if docs.schema[key].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
            raise TypeError(f"keys are whole numbers, not {docs.schema[key].dataType.simpleString()}")
        self.docs, self.key, self.text, self.k, self.percent, self.bits = docs.select(key, text), key, text, k, percent, SKETCH_BITS[0]
        self.spark: SparkSession = docs.sparkSession

    def share(self, value):
        return self.spark.sparkContext.broadcast(value)

    def members(self) -> DataFrame:
        """One row per document: key, class (c, n) and the parity map."""
        maps = ", ".join(f"{m} long" for m in _MAPS)
        out = written(self.docs.mapInArrow(lean(_classes(self.key, self.text, self.k)), f"key long, c long, n long, {maps}"), "members")
        grams = out.agg(F.sum("n").alias("n")).first()["n"] or 0
        self.bits = min(SKETCH_BITS[1], max(SKETCH_BITS[0], (grams // GRAMS_PER_COUNTER).bit_length()))
        return out

    def stars(self) -> DataFrame:
        counted = self.docs.mapInArrow(lean(_gram_sketch(self.text, self.k, self.bits)), "slice int, packed binary")
        self.levels = levels = self.share(_levels(counted, self.bits))
        prefixes = self.docs.mapInArrow(lean(_prefixes(self.text, self.k, self.percent, self.bits, levels)), _PREFIX)
        dealt = prefixes.repartition("g").sortWithinPartitions("g", "n", "c")
        out = written(dealt.mapInArrow(lean(_stars(self.percent)), "kind int, g long, c long, n long, d long, m long"), "stars")
        return out

    def passing(self, pairs: DataFrame, classes: DataFrame) -> DataFrame:
        """Pairs (a, na, b, nb) whose parity maps don't rule them out."""
        one = classes.select(F.col("c").alias("a"), F.col("n").alias("na"), *(F.col(m).alias(f"x{m}") for m in _MAPS))
        two = classes.select(F.col("c").alias("b"), F.col("n").alias("nb"), *_MAPS)
        both = pairs.join(one, ["a", "na"]).join(two, ["b", "nb"])
        return both.filter(self.may_link([(f"x{m}", m) for m in _MAPS])).select("a", "na", "b", "nb")

    def may_link(self, columns) -> Column:
        bits = sum((F.bit_count(F.col(x).bitwiseXOR(F.col(y))).cast("long") for x, y in columns), F.lit(0).cast("long"))
        # |A ^ B| = |A| + |B| - 2 |A & B|, and the overlap of a link is percent * (|A| + |B|) / (100 + percent) at least
        return bits * (100 + self.percent) <= (F.col("na") + F.col("nb")) * (100 - self.percent)

    def verified(self, pairs: DataFrame, reps: DataFrame) -> DataFrame:
        """Those of the pairs that link; each overlap is counted by fragment and summed."""
        needed = pairs.select(F.col("a").alias("c"), F.col("na").alias("n")).union(pairs.select("b", "nb")).distinct()
        keys = needed.join(reps, ["c", "n"]).select("key")
        wanted = self.share(_levels(keys.mapInArrow(lean(_id_sketch(self.bits)), "slice int, packed binary"), self.bits))
        parts = self.docs.mapInArrow(lean(_fragments(self.key, self.text, self.k, self.bits, wanted, self.levels)), "c long, n long, f int, grams binary")
        parts = written(parts.dropDuplicates(["c", "n", "f"]), "fragments")  # copies in several tasks give several rows
        wanted.unpersist()
        dealt = pairs.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))))
        one = parts.select(F.col("c").alias("a"), F.col("n").alias("na"), "f", F.col("grams").alias("ga"))
        two = parts.select(F.col("c").alias("b"), F.col("n").alias("nb"), "f", F.col("grams").alias("gb"))
        counted = dealt.join(one, ["a", "na", "f"]).join(two, ["b", "nb", "f"]).mapInArrow(lean(_overlaps), "a long, na long, b long, nb long, part long")
        inter = F.col("inter")
        summed = counted.groupBy("a", "na", "b", "nb").agg(F.sum("part").alias("inter"))
        links = written(summed.filter(inter * 100 >= F.lit(self.percent) * (F.col("na") + F.col("nb") - inter)).select("a", "na", "b", "nb"), "links")
        drop_written(parts)
        return links


def _cross_pairs(percent: int):
    """Over rows sorted by (g, i, j, n): pairs of different components whose sizes and maps allow a link."""
    names = ["g", "i", "j", "own", "c", "n", "p", "label"]

    def pairs(cols, maps):
        g, i, j, own, c, n, p, label = cols
        out = []
        for x in range(len(c)):
            hi = int(np.searchsorted(n, n[x] * 100 // percent, "right"))
            ys = np.arange(x + 1, hi)
            ys = ys[label[ys] != label[x]]
            if i[0] != j[0]:
                ys = ys[own[ys] != own[x]]
            ys = ys[can_follow(n[x], p[x], n[ys], p[ys], percent)]
            if not len(ys):
                continue
            differ = np.bitwise_count(maps[ys] ^ maps[x]).sum(1, dtype=np.int64)
            ys = ys[differ * (100 + percent) <= (n[ys] + n[x]) * (100 - percent)]
            if len(ys):
                out.append((np.full(len(ys), c[x]), np.full(len(ys), n[x]), c[ys], n[ys]))
        return out

    def over(batches):
        rest = None
        for batch in batches:
            cols = [np.asarray(batch.column(batch.schema.get_field_index(x))) for x in names]
            maps = np.stack([np.asarray(batch.column(batch.schema.get_field_index(m))) for m in _MAPS], 1)
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest[0], cols)]
                maps = np.concatenate([rest[1], maps])
            rest = yield from step(cols, maps, False)
        if rest is not None:
            yield from step(*rest, True)

    def step(cols, maps, last):
        new = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])
        edges = np.flatnonzero(np.append(True, new)) if len(cols[0]) else np.zeros(0, np.int64)
        ends = np.append(edges[1:], len(cols[0]))
        left = None
        if not last and len(edges):
            left = [x[edges[-1] :] for x in cols], maps[edges[-1] :]
            edges, ends = edges[:-1], ends[:-1]
        out = []
        for a, b in zip(edges, ends):
            if b - a > 1:
                out += pairs([x[a:b] for x in cols], maps[a:b])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["a", "na", "b", "nb"])
        return left

    return over


def _ordered(pairs: DataFrame) -> DataFrame:
    """Pairs with their two classes in one order, each pair once."""
    swap = (F.col("a") > F.col("b")) | ((F.col("a") == F.col("b")) & (F.col("na") > F.col("nb")))
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return pairs.select(pick("a", "b").alias("a"), pick("na", "nb").alias("na"), pick("b", "a").alias("b"), pick("nb", "na").alias("nb")).distinct()


def components(links: DataFrame, name: str = "labels") -> DataFrame:
    """(v, label): of each linked node the smallest node that it reaches. links has columns x and y.

    Each round, a node takes the smallest label among its neighbours and then its label's label; every round is
    written to the work folder, and the rounds of a path shrink like its logarithm."""
    spark = links.sparkSession
    both = written(links.select("x", "y").union(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), f"{name}-links")
    path = work_folder(spark, name)
    both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("label")).select(F.col("x").alias("v"), "label").write.parquet(f"{path}/0")
    n = 0
    while True:
        labels = spark.read.schema("v long, label long").parquet(f"{path}/{n}")
        other = labels.select(F.col("v").alias("y"), F.col("label").alias("l"))
        near = both.join(other, "y").groupBy("x").agg(F.min("l").alias("l"))
        step = labels.join(near.withColumnRenamed("x", "v"), "v").select("v", F.least("label", "l").alias("label"), (F.col("l") < F.col("label")).alias("moved"))
        jump = step.select(F.col("v").alias("label"), F.col("label").alias("l2"))
        # a label's own row says where that label leads by now
        nxt = step.join(jump, "label").select("v", F.least("label", "l2").alias("label"), (F.col("moved") | (F.col("l2") < F.col("label"))).alias("moved"))
        n += 1
        nxt.write.parquet(f"{path}/{n}")
        done = spark.read.schema("v long, label long, moved boolean").parquet(f"{path}/{n}")
        if not done.filter("moved").limit(1).count():
            return done.select("v", "label")
        remove_path(spark, f"{path}/{n - 1}")


def near_groups(docs: DataFrame, *, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document row: key, n_shingles and component_id (the smallest key that it reaches by links, or its own)."""
    join = _Join(docs, key, text, k, percent)
    members = join.members()
    classes = members.filter("n > 0 AND key IS NOT NULL").groupBy("c", "n").agg(F.min("key").alias("key"), *(F.first(m).alias(m) for m in _MAPS))
    classes = written(classes, "classes")
    reps = classes.select("c", "n", "key")
    stars = join.stars()

    found = stars.filter("kind = 1").select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("d").alias("b"), F.col("m").alias("nb"))
    first = join.verified(written(join.passing(_ordered(found), classes), "candidates"), reps)
    keyed = lambda links: links.join(reps.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("key").alias("x")), ["a", "na"]).join(reps.select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("key").alias("y")), ["b", "nb"]).select("x", "y")
    labels = components(keyed(first), "labels-1")

    # what may still join two components: n-grams whose classes lie in more than one
    held = stars.filter("kind = 0").groupBy("g", "c", "n").agg(F.min("d").alias("p"))
    labelled = classes.join(labels.withColumnRenamed("v", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    held = held.join(labelled.select("c", "n", "label"), ["c", "n"])
    mixed = held.groupBy("g").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("size")).filter("lo < hi")
    mixed = written(mixed.select("g", "size", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "mixed")
    # n-grams of more than one in HOT_SHARE rows are HOT_SHARE at most: their rows stay where they are
    least = (mixed.agg(F.sum("size").alias("n")).first()["n"] or 0) // HOT_SHARE
    hot, others = F.broadcast(mixed.filter(F.col("size") > least).drop("size")), mixed.filter(F.col("size") <= least).drop("size")
    open_ = held.join(hot, "g").unionByName(held.join(others, "g")).join(classes.select("c", "n", *_MAPS), ["c", "n"])
    own = F.pmod(F.xxhash64("c", "n"), F.col("blocks")).cast("int")
    dealt = open_.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    dealt = dealt.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "n", "c")
    rest = dealt.select("g", "i", "j", "own", "c", "n", "p", "label", *_MAPS).mapInArrow(lean(_cross_pairs(percent)), "a long, na long, b long, nb long")
    rest = written(_ordered(rest), "rest")
    drop_written(stars)
    if rest.limit(1).count():
        second = join.verified(rest, reps)
        labels = components(keyed(first.unionByName(second)), "labels-2")

    final = classes.select("c", "n", "key").join(labels.withColumnRenamed("v", "key"), "key", "left").select("c", "n", F.coalesce("label", "key").alias("label"))
    out = members.select("key", "c", "n").join(final, ["c", "n"], "left")
    label = F.when(F.col("key").isNotNull(), F.coalesce("label", "key"))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), label.alias("component_id"))


def keep_one(docs: DataFrame, *, key: str = "doc_id", **options) -> DataFrame:
    """docs with one document of each near-duplicate group: that with the smallest key. Rows with equal key and text count as one."""
    groups = near_groups(docs, key=key, **options)
    # texts are shuffled once: by key, to the one row of each key that stays; only rows of repeated keys are compared after that
    kept = groups.filter(F.col(key).eqNullSafe(F.col("component_id"))).groupBy(F.col(key).alias("kept_")).agg((F.count(F.lit(1)) > 1).alias("repeated_"))
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own_"), F.col(key).alias("key_"))
    found = own.join(kept, F.col("key_").eqNullSafe(F.col("kept_")))
    single, several = found.filter(~F.col("repeated_")), found.filter("repeated_")
    several = several.withColumn("text_", F.col("own_").getField(options.get("text", "text"))).dropDuplicates(["key_", "text_"])
    return single.select("own_.*").unionByName(several.select("own_.*"))

"""Runs of words that repeat with a period, found by block convolution, and texts without the repeats.

A run is a stretch of words with smallest period q (words q apart are equal), at least max(least, 2 q) long, that no
neighbouring word extends. At each dyadic scale b = 2, 4, 8, ... the words are cut into blocks of b; for a block, the
squared differences between it and each window of b words that follows at a distance of 2b - 1 to 4b - 2 (from 1 on
at b = 2) are summed by one convolution, an integer number-theoretic transform. Where the sum is zero the block occurs
again, and the distance d is the seed of a run: it is extended to both sides as far as words d apart are equal. Each
run holds such a block at the scale whose distances include its period, since the part of a run that has a copy q
words on is at least 2b - 1 words long, so it holds a whole block (for least >= 5; smaller ones are refused). Distances are taken in ascending order, so a stretch is first met with its smallest period.

Sums are taken modulo a prime: zero is always found, and what is zero by chance ends in a stretch too short, because
the extension compares words. Two kinds of blocks are not transformed, because they can't give a new run: those with a
pair of neighbouring words that doesn't occur again at any of the scale's distances, and those whose whole window lies
in a run with a period of at most b (every distance found there is a multiple of that run's period).

Words are numbered by a dictionary, so equality is exact. Steps of about a megabyte of text are worked on at once with
numpy, whatever texts they consist of; a longer text is a step of its own. Nothing is shuffled.

Defined cases: null and empty texts have no words and no runs; a text without runs collapses to its words joined by
one space; repeated rows get equal results; an empty table gives no rows; result columns take the place of columns
with such names, other columns are kept.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultspark.llm._common import crc32_text, lean, replaced, text_steps

#: A prime with roots of unity of all orders up to 2**26, and a generator of its units.
PRIME, GENERATOR = 469762049, 3
#: Numbers that are transformed together.
STEP_NUMBERS = 1 << 20
#: Words of the shortest run.
LEAST = 12

_roots_of: dict[tuple[int, bool], list[np.ndarray]] = {}


def _roots(size: int, inverse: bool) -> list[np.ndarray]:
    """The roots of unity of each stage of a transform."""
    key = size, inverse
    if key not in _roots_of:
        stages, half = [], size // 2
        while half:
            base = pow(GENERATOR, (PRIME - 1) // (2 * half), PRIME)
            if inverse:
                base = pow(base, PRIME - 2, PRIME)
            w = np.ones(1, np.uint64)
            while len(w) < half:  # powers, twice as many each time
                w = np.concatenate([w, w * np.uint64(pow(base, len(w), PRIME)) % np.uint64(PRIME)])
            stages.append(w[:half])
            half //= 2
        if len(_roots_of) > 64:
            _roots_of.clear()
        _roots_of[key] = stages
    return _roots_of[key]


def ntt(rows: np.ndarray, inverse: bool = False) -> np.ndarray:
    """The number-theoretic transform of each row (a power of two long, values below PRIME), in natural order."""
    m, size = rows.shape
    p = np.uint64(PRIME)
    x = rows.astype(np.uint64).reshape(m, size, 1)
    for w in _roots(size, inverse):  # decimation in frequency; finished outputs move to the last axis
        half = len(w)
        a, b = x[:, :half], x[:, half:]
        total = a + b
        total -= p * (total >= p)
        rest = (a + (p - b)) * w[None, :, None] % p
        x = np.concatenate([total, rest], 2)
    out = x.reshape(m, size)
    if inverse:
        out = out * np.uint64(pow(size, PRIME - 2, PRIME)) % p
    return out


def zero_mismatches(words: np.ndarray, starts: np.ndarray, width: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, distance) of the blocks of a width whose squared differences to the words at a distance sum to zero.

    words: numbers below 2**31; those beyond the end count as 0."""
    reach = width + high - low
    size = 1 << (reach - 1).bit_length()
    p = np.uint64(PRIME)
    found_at, found_d = [], []
    padded = np.concatenate([words, np.zeros(size + high, np.int64)]) % PRIME
    for lo in range(0, len(starts), max(1, STEP_NUMBERS // size)):
        at = starts[lo : lo + max(1, STEP_NUMBERS // size), None]
        block = padded[at + np.arange(width)].astype(np.uint64)
        window = padded[at + low + np.arange(reach)].astype(np.uint64)
        left, right = np.zeros((len(at), size), np.uint64), np.zeros((len(at), size), np.uint64)
        left[:, (-np.arange(width)) % size] = block  # reversed: the product of transforms is the correlation
        right[:, :reach] = window
        products = ntt(ntt(left) * ntt(right) % p, inverse=True)[:, : high - low + 1]
        squares = np.concatenate([np.zeros((len(at), 1), np.uint64), np.cumsum(window * window % p, 1)], 1)
        sums = ((block * block % p).sum(1)[:, None] + squares[:, width:] - squares[:, :-width]) % p
        row, shift = np.nonzero(sums == 2 * products % p)
        found_at.append(at[row, 0])
        found_d.append(shift + low)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_at]), np.concatenate([none, *found_d])


class _Runs:
    """The runs of a step's words; the words of several texts follow each other, each numbered within its text."""

    def __init__(self, words: np.ndarray, bounds: np.ndarray, least: int):
        self.words, self.bounds, self.least = words, bounds, least
        self.text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        self.start, self.end, self.period = (np.zeros(0, np.int64) for _ in range(3))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of all pairs of neighbouring words, ascending (pair, then place); those that come again; their keys."""
        n = len(self.words)
        sizes = np.maximum.reduceat(self.words, self.bounds[:-1]) + 1
        apart = self.words + np.repeat(np.cumsum(sizes) - sizes, np.diff(self.bounds))  # no number is in two texts
        pair = apart[:-1] * np.int64(n) + apart[1:]
        order = np.argsort(pair, kind="stable")
        change = np.diff(pair[order]) != 0
        key = np.concatenate([[0], np.cumsum(change)]) * np.int64(8 * n + 64) + order  # far enough apart to add distances
        again = np.zeros(n - 1, bool)
        again[1:], again[:-1] = ~change, again[:-1] | ~change
        return key, order[again], key[again]

    def extend(self, seeds: np.ndarray, d: int) -> None:
        """Adds the runs that have words d apart equal around the seeds (ascending), unless they are known."""
        lo, hi = int(self.bounds[self.text[seeds[0]]]), int(self.bounds[self.text[seeds[-1]] + 1])
        w, t = self.words[lo:hi], self.text[lo:hi]
        differ = np.flatnonzero((w[:-d] != w[d:]) | (t[:-d] != t[d:]))
        at = np.searchsorted(differ, seeds - lo)
        start = np.where(at > 0, np.append(differ, 0)[at - 1] + 1, 0) + lo
        end = np.append(differ, hi - lo - d)[at] + d + lo
        fits = end - start >= max(self.least, 2 * d)
        start, first = np.unique(start[fits], return_index=True)
        end = end[fits][first]
        # a stretch that is known already has a smaller period
        span = len(self.words) + 1
        new = ~np.isin(start * span + end, self.start * span + self.end)
        self.start = np.concatenate([self.start, start[new]])
        self.end = np.concatenate([self.end, end[new]])
        self.period = np.concatenate([self.period, np.full(int(new.sum()), d)])

    def within(self, starts: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
        """Whether stretches of 3 * width - 1 words or more lie in a known run with a period of at most width.

        Such runs overlap in less than 2 * width words, so none holds another one and the last that begins decides."""
        long = np.flatnonzero((self.period <= width) & (self.end - self.start >= 3 * width - 1))
        if not len(long):
            return np.zeros(len(starts), bool)
        long = long[np.argsort(self.start[long])]
        at = np.searchsorted(self.start[long], starts, "right") - 1
        return (at >= 0) & (self.end[long][at] >= ends)

    def find(self) -> None:
        n, longest = len(self.words), int(np.diff(self.bounds).max(initial=0))
        if longest < self.least:
            return
        key, places, keys = self.pairs()
        width = 2
        while width == 2 or 2 * width - 1 <= longest // 2:
            low, high = (1, 6) if width == 2 else (2 * width - 1, 4 * width - 2)
            then = np.append(key, np.iinfo(np.int64).max)[np.searchsorted(key, keys + low)]
            near = np.zeros(n, np.int64)
            near[places[then <= keys + high]] = 1
            total = np.concatenate([[0], np.cumsum(near)])
            starts = np.arange(0, n - width - low + 1, width)
            starts = starts[(total[starts + width - 1] - total[starts] == width - 1) & (self.text[starts] == self.text[starts + width + low - 1])]
            starts = starts[~self.within(starts, starts + width + high, width)]
            seeds, d = zero_mismatches(self.words, starts, width, low, high)
            whole = seeds + d + width <= self.bounds[self.text[seeds] + 1]
            if width > 2:
                whole &= ~self.within(seeds, seeds + d + width, width)
            seeds, d = seeds[whole], d[whole]
            order = np.lexsort((seeds, d))
            seeds, d = seeds[order], d[order]
            for a, b in zip(cuts := np.flatnonzero(np.diff(d, prepend=-1)), [*cuts[1:], len(d)]):
                self.extend(seeds[a:b], int(d[a]))
            width *= 2


def _numbered(words: list) -> np.ndarray:
    """Each word's number in the order of first occurrence."""
    known: dict = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def runs_of(texts: list[list], least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The runs of lists of words: list, start, length and period, in the order of list, start and period."""
    if least < 5:
        raise ValueError("runs are at least five words long")
    long = [i for i, words in enumerate(texts) if len(words) >= least]
    if not long:
        return (np.zeros(0, np.int64),) * 4
    bounds = np.concatenate([[0], np.cumsum([len(texts[i]) for i in long])])
    found = _Runs(np.concatenate([_numbered(texts[i]) for i in long]), bounds, least)
    found.find()
    order = np.lexsort((found.period, found.start))
    start, end, period = found.start[order], found.end[order], found.period[order]
    text = found.text[start]
    return np.array(long)[text], start - bounds[text], end - start, period


def collapsed(words: list, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> list:
    """The words that no run holds after its first `period` words."""
    if not len(start):
        return words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return [*compress(words, (np.cumsum(change[:-1]) == 0).tolist())]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
#: What `find_runs` adds.
ADDED = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _find(kept: int, text: str, least: int):
    names = ("n_words", "runs", "collapsed")

    def over(batches):
        for batch in batches:
            for first, offs, raw in text_steps(batch, text):
                texts = [raw[a:b].tobytes().split() for a, b in zip(offs[:-1], offs[1:])]  # bytes are split at just the six white space characters
                of, start, length, period = runs_of(texts, least)
                bounds = np.searchsorted(of, np.arange(len(texts) + 1))
                left = [b" ".join(collapsed(words, start[a:b], length[a:b], period[a:b])) for words, a, b in zip(texts, bounds[:-1], bounds[1:])]
                found = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], fields=list(_RUN)))
                columns = [*batch.slice(first, len(texts)).columns[:kept], pa.array([*map(len, texts)], pa.int64()), found, pa.array(left, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([*list(batch.schema)[:kept], *(pa.field(x, c.type) for x, c in zip(names, columns[kept:]))]))

    return over


def find_runs(docs: DataFrame, *, text: str = "text", least: int = LEAST) -> DataFrame:
    """docs with n_words, runs (start, length and period in words) and the collapsed text, in place of the text."""
    names = ("n_words", "runs", "collapsed")
    kept = replaced(docs, text, *names)
    columns = [F.col(f"`{c}`") for c in kept.columns]
    types = docs.sparkSession.createDataFrame([], ADDED).schema.fields
    schema = docs.select(*columns, *(F.lit(None).cast(f.dataType).alias(f.name) for f in types)).schema
    return docs.select(*columns, F.col(f"`{text}`")).mapInArrow(lean(_find(len(columns), text, least)), schema)


def with_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with a repeat planted into every tenth text (by the key's CRC-32): from a word on, its next p words again and again."""
    h = F.coalesce(crc32_text(key), F.lit(1))
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    words = F.when(h % 10 == 0, F.regexp_extract_all(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0)))
    g, n = F.floor(h / 10), F.size("_words")
    cut = docs.select(*rest, text, words.alias("_words"), g.alias("_g")).withColumn("_a", F.when(n > 0, F.col("_g") % n).cast("int"))
    left = n - F.col("_a")
    p = (1 + F.floor(left / (3 + F.col("_g") % 8))).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice("_words", F.col("_a") + 1, p), F.ceil(left / p).cast("int"))), F.lit(1), left)
    planted = F.array_join(F.concat(F.slice("_words", F.lit(1), F.col("_a")), again), " ")
    return cut.select(*rest, F.when(n > 0, planted).otherwise(F.col(text)).alias(text))


def digest(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: key, n_runs, the longest run (ties: smallest start, then period) and SHA-256 of the runs and of the collapsed text."""
    found = find_runs(docs.select(key, text), text=text)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    told = found.select(key, F.size("runs").cast("long").alias("n_runs"), best.alias("_best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    start, length, period = -F.col("_best.start"), F.col("_best.length"), -F.col("_best.period")
    exponent = F.expr("(1000 * _best.length) div (-_best.period)")
    return told.select(key, "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")

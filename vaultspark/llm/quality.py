"""Document quality by co-training of a text view and a metadata view.

Two logistic classifiers look at different things: the text view at the words and the wording of a text, the page
view at its language, source, size and layout (lines, how long they are, how they end, which repeat, links). Both start
from labelled documents. In each round each view ranks a pool of unlabelled documents and hands its most confident ones,
`GIVEN` of the pool, to the other view as pseudo-labels: good and bad ones in the proportion of the labels, each weighted by how
sure the view's calibrated probability is, so that a view that knows little teaches little. At the end each view is
calibrated on labelled documents that it was not fitted on, and a third small logistic model combines the two
calibrated views.

Toxicity is a target of its own, since a few words make a long good text toxic. Both views are fitted to it on the
labelled documents alone; each view's cut is the lowest one at which it would reject few clean documents, and many
more toxic ones, among labels that its score did not learn from (four folds). A document goes if either view says so.

Fitting takes bounded samples, whose bounds are parameters: `sample` labelled and `pool` unlabelled documents, by
the smallest hashes of their keys. Their features (hash sets of words, not texts) come to the driver. Scoring takes
all documents, whole texts, in one pass without a shuffle.

Defined cases: null and empty texts have no words and get the score of such texts; null languages, sources and sizes
are values of their own; labels that are null or of unknown documents count for nothing; several labels of a document
count as their worst; with labels of one kind only, every document gets that kind's rate, and with fewer than
`LEAST_TOXIC` toxic labels that a view finds, it calls nothing toxic; an empty table gives no
rows; columns of the names of results are replaced, others not looked at. A document is good if its label says quality and not toxic.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultspark.llm._common import LOWER, lean, lowest, replaced, text_steps, window_hashes, word_hashes, word_spans

SAMPLE, POOL = 6000, 3000
#: Rounds of exchange, and the share of the pool that a view hands over in each.
ROUNDS, GIVEN = 3, 0.1
#: Words that the text view may look at, and the documents that a word must be in.
WORDS, LEAST_DOCS = 400, 4
BINS = 8
#: Documents are accepted from this combined score on: in doubt, a document stays.
THRESHOLD = 0.35
#: Share of clean documents that a toxicity view may reject, toxic ones to each of those, and the least toxic ones found.
CLEAN_LOST, TOXIC_EACH, LEAST_TOXIC = 0.005, 4, 5
FOLDS = 4

IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True
_KINDS = np.zeros(256, np.uint8)  # 1 upper case, 2 digit, 3 punctuation, 4 beyond ASCII, 5 line end
_KINDS[65:91], _KINDS[48:58], _KINDS[128:], _KINDS[10] = 1, 2, 4, 5
_KINDS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 3
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#$%&*|<>{}\\^~=@_!")] = True

SHAPES = ("words", "distinct", "word_bytes", "upper", "digits", "punctuation", "foreign", "symbols", "top_word", "repeats")
LAYOUT = ("lines", "line_bytes", "longest_line", "ended_lines", "short_lines", "repeated_lines", "links", "bytes_of_a_char")
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?:\"')")] = True


def _layout(raw: np.ndarray, words: int) -> tuple:
    """LAYOUT of one text but the last: of its lines that aren't empty."""
    edges = np.flatnonzero(raw == 10)
    starts, ends = np.append(0, edges + 1), np.append(edges, len(raw))
    some = ends > starts
    starts, ends = starts[some], ends[some]
    if not len(starts):
        return (0.0,) * 7
    n, lengths = len(starts), ends - starts
    at = np.flatnonzero(raw == 47)  # "://"
    links = np.count_nonzero((raw[at[1:] - 2] == 58) & (at[1:] - at[:-1] == 1)) if len(at) > 1 else 0
    distinct = len(np.unique(word_hashes(raw, starts, ends)))
    return np.log1p(n), np.log1p(lengths.mean()), np.log1p(lengths.max()), _ENDS[raw[ends - 1]].mean(), (lengths < 40).mean(), 1 - distinct / n, links / max(1, words)


def text_features(batch: pa.RecordBatch, text: str, size: str):
    """Yields (row, shape, layout, distinct word hashes) of each text."""
    chars = batch.column(batch.schema.get_field_index(size)).to_pylist()
    for first, offs, raw in text_steps(batch, text):
        low = LOWER[raw]
        starts, ends, counts = word_spans(offs, low, IS_WORD)
        words = word_hashes(low, starts, ends)
        three = window_hashes(words, 3)
        kinds, symbols = _KINDS[raw], _SYMBOL[raw]
        lengths = ends - starts
        at = 0
        for d, n in enumerate(counts.tolist()):
            a, b = int(offs[d]), int(offs[d + 1])
            bytes_ = max(1, b - a)
            by = np.bincount(kinds[a:b], minlength=6)
            seen, times = np.unique(words[at : at + n], return_counts=True)
            m = max(1, n)
            triples = n - 2
            shape = (
                np.log1p(n), len(seen) / m, lengths[at : at + n].sum() / m, by[1] / bytes_, by[2] / bytes_, by[3] / bytes_, by[4] / bytes_,
                symbols[a:b].sum() / m, times.max() / m if n else 0.0, 1 - len(np.unique(three[at : at + triples])) / triples if triples > 0 else 0.0,
            )
            said = chars[first + d]
            yield first + d, shape, (*_layout(raw[a:b], n), (b - a) / said if said and said > 0 else 0.0), seen
            at += n


def meta_features(lang, source, size) -> list[int]:
    """Ids of the metadata that hold: language, source, size in doublings."""
    code = lambda what, v, n: zlib.crc32(f"{what}={v}".encode()) % n
    return [code("lang", lang, 32), 32 + code("source", source, 128), 160 + (0 if size is None else min(31, 1 + int(max(0, size)).bit_length()))]


META_SIZE = 192


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1.0, steps: int = 250) -> np.ndarray:
    """Weights (the last one the intercept) of a logistic model; accelerated gradient descent from zero."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float32)
    total = weight.sum()
    top = 0.25 * float((weight[:, None] * x * x).sum() / total) + l2 / total
    w = v = np.zeros(x.shape[1], np.float32)
    for t in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        grad = x.T @ (weight * (p - y)) / total
        grad[:-1] += l2 / total * v[:-1]
        new = v - grad / top
        v = new + t / (t + 3) * (new - w)
        w = new
    return w


def logits(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def calibration(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slope and intercept of a sigmoid over scores; targets are smoothed by the counts."""
    good, bad = y.sum(), len(y) - y.sum()
    soft = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    scale = max(1e-6, float(np.std(z)))
    a = b = 0.0
    for _ in range(50):  # Newton's method in two variables
        p = 1 / (1 + np.exp(-np.clip(a * z / scale + b, -30, 30)))
        g, h = p - soft, np.maximum(p * (1 - p), 1e-6)
        x = z / scale
        ga, gb = (g * x).sum() + 1e-3 * a, g.sum()
        haa, hab, hbb = (h * x * x).sum() + 1e-3, (h * x).sum(), h.sum() + 1e-9
        det = haa * hbb - hab * hab
        if det < 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-8:
            break
    return np.array([a / scale, b])


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Bins:
    """Numbers as one-hot bins, cut at the quantiles of what is fitted on."""

    def __init__(self, values: np.ndarray):
        self.edges = [np.unique(np.quantile(values[:, i], np.arange(1, BINS) / BINS)) for i in range(values.shape[1])]
        self.size = sum(len(e) + 1 for e in self.edges)

    def fill(self, x: np.ndarray, base: int, values: np.ndarray) -> None:
        for i, e in enumerate(self.edges):
            x[np.arange(len(values)), base + np.searchsorted(e, values[:, i], "right")] = 1
            base += len(e) + 1


class TextView:
    """What the text view looks at: bins of shapes and chosen words."""

    def __init__(self, shapes: np.ndarray, words: list[np.ndarray], y: np.ndarray):
        self.bins = Bins(shapes)
        flat = np.concatenate(words) if words else np.zeros(0, np.uint64)
        of = np.repeat(y, [len(w) for w in words])
        seen, where = np.unique(flat, return_inverse=True)
        n1, n = np.bincount(where, of, len(seen)), np.bincount(where, minlength=len(seen)).astype(float)
        rate = y.mean()
        z = (n1 - n * rate) / np.sqrt(n * rate * (1 - rate) + 1e-9)
        ok = np.flatnonzero(n >= LEAST_DOCS)
        pick = ok[np.argsort(-np.abs(z[ok]), kind="stable")[:WORDS]]
        self.words = np.sort(seen[pick])
        self.size = self.bins.size + len(self.words)

    def rows(self, shapes: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(shapes), self.size), np.float32)
        self.bins.fill(x, 0, shapes)
        base = self.bins.size
        if len(self.words):
            for r, w in enumerate(words):
                at = np.searchsorted(self.words, w)
                at[at == len(self.words)] = 0
                x[r, base + at[self.words[at] == w]] = 1
        return x


def meta_rows(metas) -> np.ndarray:
    x = np.zeros((len(metas), META_SIZE), np.float32)
    for r, m in enumerate(metas):
        x[r, m] = 1
    return x


class PageView:
    """What the page view looks at: ids of the metadata and bins of the layout."""

    def __init__(self, layouts: np.ndarray):
        self.bins = Bins(layouts)

    def rows(self, metas, layouts: np.ndarray) -> np.ndarray:
        x = np.hstack([meta_rows(metas), np.zeros((len(metas), self.bins.size), np.float32)])
        self.bins.fill(x, META_SIZE, layouts)
        return x


def _table(rows, width: int) -> np.ndarray:
    return np.asarray(rows, float).reshape(-1, width)


class CoTraining:
    """Two views fitted together; predict() gives both calibrated views and their combination."""

    def __init__(self, shapes, layouts, words, metas, y, pool_shapes, pool_layouts, pool_words, pool_metas, rounds: int = ROUNDS, share: float = GIVEN):
        """y holds 0 and 1 of the labelled rows; every fourth of them calibrates and isn't fitted on."""
        y = np.asarray(y, np.float32)
        self.rate = float(y.mean()) if len(y) else 0.5
        self.exchanged = [0, 0]
        self.single = len(y) < 40 or not 0 < self.rate < 1
        if self.single:
            return
        shapes, layouts = _table(shapes, len(SHAPES)), _table(layouts, len(LAYOUT))
        held = np.arange(len(y)) % 4 == 3
        fit = np.flatnonzero(~held)
        self.view, self.page = TextView(shapes[fit], [words[i] for i in fit], y[fit]), PageView(layouts[fit])
        x = self._views(shapes, layouts, words, metas)
        u = self._views(pool_shapes, pool_layouts, pool_words, pool_metas)
        given: list[dict[int, tuple[float, float]]] = [{}, {}]  # of each view: pool rows, what they are and how sure that is
        for turn in range(rounds + 1):
            self.w, self.cal = [], []
            for v in (0, 1):
                rows = list(given[v])
                told = np.array([given[v][r] for r in rows], np.float32).reshape(-1, 2)
                both = np.vstack([x[v][fit], u[v][rows]])
                weight = np.concatenate([np.ones(len(fit), np.float32), told[:, 1] / 2])
                self.w.append(fit_logistic(both, np.concatenate([y[fit], told[:, 0]]), weight))
                self.cal.append(calibration(logits(x[v][held], self.w[v]), y[held]))
            if turn == rounds or not len(u[0]):
                break
            for v in (0, 1):  # what one view is surest of, the other learns
                p = sigmoid(self.cal[v][0] * logits(u[v], self.w[v]) + self.cal[v][1])
                free = np.array([r for r in np.argsort(p, kind="stable") if r not in given[1 - v]], np.int64)
                most = min(len(free), max(2, int(share * len(p))))
                good = round(most * self.rate)
                for rows, target in ((free[len(free) - good :], 1.0), (free[: most - good], 0.0)):
                    given[1 - v].update((int(r), (target, abs(2 * float(p[r]) - 1))) for r in rows)
            self.exchanged = [len(g) for g in given]
        z = np.stack([self.cal[v][0] * logits(x[v][held], self.w[v]) + self.cal[v][1] for v in (0, 1)], 1)
        self.top = fit_logistic(np.clip(z, -8, 8).astype(np.float32), y[held], np.ones(held.sum(), np.float32), l2=0.1, steps=400)

    def _views(self, shapes, layouts, words, metas) -> list[np.ndarray]:
        return [self.view.rows(_table(shapes, len(SHAPES)), words), self.page.rows(metas, _table(layouts, len(LAYOUT)))]

    def predict(self, shapes, layouts, words, metas):
        if self.single:
            one = np.full(len(metas), self.rate)
            return one, one, one
        z = [self.cal[v][0] * logits(x, self.w[v]) + self.cal[v][1] for v, x in enumerate(self._views(shapes, layouts, words, metas))]
        return sigmoid(z[0]), sigmoid(z[1]), sigmoid(logits(np.clip(np.stack(z, 1), -8, 8), self.top))


class Toxicity:
    """The same two views with toxicity as their target, each with a cut of its own; the text view looks at words only."""

    def __init__(self, words, metas, toxic, clean):
        """toxic: 0 and 1 of each row; clean: the rows that shall stay."""
        y, clean = np.asarray(toxic, np.float32), np.asarray(clean, bool)
        self.none = y.sum() < LEAST_TOXIC or y.sum() == len(y)
        if self.none:
            return
        every, fold = np.arange(len(y)), np.arange(len(y)) % FOLDS
        apart = np.zeros((2, len(y)))  # scores of rows by views that weren't fitted on them
        for k in range(FOLDS):
            self._fit(words, metas, y, every[fold != k])
            for v, z in enumerate(self._scores([words[i] for i in every[fold == k]], [metas[i] for i in every[fold == k]])):
                apart[v, fold == k] = z
        self.cuts = [self._cut(z, y > 0, clean) for z in apart]
        self._fit(words, metas, y, every)

    def _fit(self, words, metas, y, rows):
        some = [words[i] for i in rows]
        self.view = TextView(np.zeros((len(rows), 0)), some, y[rows])
        one = np.ones(len(rows), np.float32)
        self.w = [fit_logistic(x, y[rows], one) for x in (self.view.rows(np.zeros((len(rows), 0)), some), meta_rows([metas[i] for i in rows]))]

    def _scores(self, words, metas):
        return [logits(self.view.rows(np.zeros((len(words), 0)), words), self.w[0]), logits(meta_rows(metas), self.w[1])]

    @staticmethod
    def _cut(z: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> float:
        """The lowest score from which documents are toxic; infinite if no score tells them."""
        order = np.argsort(-z, kind="stable")
        last = np.append(np.diff(z[order]) != 0, True)  # equal scores are on one side
        found, lost = np.cumsum(toxic[order]), np.cumsum(clean[order])
        ok = np.flatnonzero(last & (lost <= CLEAN_LOST * clean.sum()) & (found >= TOXIC_EACH * lost) & (found >= LEAST_TOXIC))
        if not len(ok):
            return np.inf
        at = ok[np.argmax(found[ok])]  # what lies below holds no toxic document more
        return float((z[order[at]] + z[order[at + 1]]) / 2) if at + 1 < len(z) else float(z[order[at]])

    def predict(self, words, metas) -> tuple[np.ndarray, np.ndarray]:
        """(probability that a document is toxic, the larger one of the views; whether it is rejected)."""
        if self.none:
            return np.zeros(len(metas)), np.zeros(len(metas), bool)
        z = np.stack(self._scores(words, metas))
        return sigmoid(z.max(0)).astype(float), (z >= np.array(self.cuts)[:, None]).any(0)


def _sampled(docs: DataFrame, labels: DataFrame, key: str, sample: int, pool: int) -> tuple[DataFrame, DataFrame]:
    """(key, y, toxic) of the labelled sample and (key) of the pool: bounded tables."""
    good = F.when((F.col("quality").isNotNull()) & (F.col("toxic").isNotNull()), ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int"))
    y = labels.groupBy(key).agg(F.min(good).alias("y"), F.max((F.col("toxic") != 0).cast("int")).alias("toxic")).filter("y IS NOT NULL OR toxic IS NOT NULL")
    known = y.join(docs.select(key).distinct(), key)
    chosen = lowest(known, F.xxhash64(key), sample, labels.count())
    some = docs.select(key).filter(F.col(key).isNotNull()).join(labels.select(key), key, "left_anti").distinct()
    return chosen, lowest(some, F.xxhash64(key, F.lit(7)), pool, docs.count())


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", size: str = "n_chars", sample: int = SAMPLE, pool: int = POOL) -> CoTraining:
    """Fits both views to both targets. labels: key, quality, toxic."""
    chosen, some = _sampled(docs, labels, key, sample, pool)
    want = F.broadcast(chosen.unionByName(some.select("*", *[F.lit(None).cast("int").alias(n) for n in ("y", "toxic")])))  # sample + pool rows at most
    rows = docs.select(key, text, lang, source, size).join(want, key)

    def over(batches):
        for batch in batches:
            cols = {n: batch.column(batch.schema.get_field_index(n)).to_pylist() for n in (key, lang, source, size, "y", "toxic")}
            out = [(cols[key][i], cols["y"][i], cols["toxic"][i], list(shape), list(layout), words.view(np.int64).tolist(), meta_features(cols[lang][i], cols[source][i], cols[size][i])) for i, shape, layout, words in text_features(batch, text, size)]
            kinds = [batch.schema.field(key).type, pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 7, kinds)], ["k", "y", "toxic", "shape", "layout", "words", "meta"])

    kind = docs.schema[key].dataType.simpleString()
    got = rows.mapInArrow(lean(over), f"k {kind}, y int, toxic int, shape array<double>, layout array<double>, words array<bigint>, meta array<int>").toArrow().to_pylist()
    got.sort(key=lambda r: (zlib.crc32(str(r["k"]).encode()), str(r["k"]), r["words"]))
    part = [[r for r in got if r["y"] is not None], [r for r in got if r["y"] is None and r["toxic"] is None], [r for r in got if r["toxic"] is not None]]
    arrays = [([r["shape"] for r in p], [r["layout"] for r in p], [np.array(r["words"], np.int64).view(np.uint64) for r in p], [r["meta"] for r in p]) for p in part]
    model = CoTraining(*arrays[0], [r["y"] for r in part[0]], *arrays[1])
    model.toxicity = Toxicity(*arrays[2][2:], [r["toxic"] for r in part[2]], [r["y"] == 1 for r in part[2]])
    return model


def score(docs: DataFrame, model: CoTraining, *, text: str = "text", lang: str = "lang", source: str = "source", size: str = "n_chars", threshold: float = THRESHOLD) -> DataFrame:
    """docs with text_score, meta_score, quality_score (probabilities of a good document), toxic_score and accepted."""
    docs = replaced(docs, "text_score", "meta_score", "quality_score", "toxic_score", "accepted")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    schema = docs.withColumns({"text_score": F.lit(0.0), "meta_score": F.lit(0.0), "quality_score": F.lit(0.0), "toxic_score": F.lit(0.0), "accepted": F.lit(True)}).schema

    def over(batches):
        fitted = shared.value
        for batch in batches:
            shapes, layouts, words = [], [], []
            one, two, both, toxic, rejected = [], [], [], [], []
            metas = [meta_features(*v) for v in zip(*(batch.column(names.index(n)).to_pylist() for n in (lang, source, size)))]
            done = 0
            for i, shape, layout, seen in text_features(batch, text, size):
                shapes.append(shape)
                layouts.append(layout)
                words.append(seen)
                if len(shapes) == 500 or i == len(batch) - 1:
                    for out, p in zip((one, two, both, toxic, rejected), (*fitted.predict(shapes, layouts, words, metas[done : i + 1]), *fitted.toxicity.predict(words, metas[done : i + 1]))):
                        out.append(p)
                    done, shapes, layouts, words = i + 1, [], [], []
            if not one:
                continue
            total = np.concatenate(both).astype(float)
            more = [pa.array(np.concatenate(one).astype(float)), pa.array(np.concatenate(two).astype(float)), pa.array(total), pa.array(np.concatenate(toxic)), pa.array((total >= threshold) & ~np.concatenate(rejected))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*names, "text_score", "meta_score", "quality_score", "toxic_score", "accepted"])

    return docs.mapInArrow(lean(over), schema)

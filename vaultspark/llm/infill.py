"""Fill-in-middle transformation: texts are cut at token ranks through an indexable skip list and put together anew.

A text is cut into n tokens (a run of other characters with the white space before it; white space at the end is a
token too). Two ranks between 0 and n part it into prefix, middle and suffix. Where a rank lies in the text is found
in a skip list over its tokens: the bottom lane has a link for each token, each lane above joins the links between
nodes that reach it, and every link carries two widths, the units (tokens) and the code points that it passes. A seek
starts in the top lane and descends, and takes each link whose units still fit below the rank; the code points that it
has passed are the cut. A node's height is fixed by a hash of its number, so a quarter of the nodes of a lane reach the
next one and a seek takes about 4 log4 n links.

The lanes are built and walked in Python tasks; texts are cut, joined and compared by Spark's functions. Nothing is
shuffled. Forms: `plain` is the text itself; `psm` is <P>prefix<S>suffix<M>middle; `spm` is <S>suffix<P>prefix<M>middle.
Texts that hold a marker are plain, and so a marker stands once in each other output and the text can be restored.

Defined cases: null and empty texts are plain with no tokens; cuts may coincide or lie at an end (parts are then
empty); a null key makes a form and cuts that are those of the key's text `null`; repeated rows get equal results; an
empty table gives no rows; result columns take the place of columns with such names, other columns are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultspark.llm._common import lean, mix, replaced, text_steps

#: White space that divides tokens.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that begin a code point.
_BEGINS = (np.arange(256) & 0xC0) != 0x80
#: Heights of the first nodes of a skip list; more are computed when a text has more tokens.
_HEIGHTS = np.zeros(0, np.int64)
#: One node in so many of a lane (as a power of two) reaches the next lane.
LANE_BITS = 2

MARKS = ("<P>", "<S>", "<M>")
#: Percentages of texts that are transformed, and of those that lead with the suffix.
RATE, SUFFIX_FIRST = 50, 80


def heights(n: int) -> np.ndarray:
    """The heights of nodes 0 to n - 1: how often LANE_BITS zero bits begin a hash of the number."""
    global _HEIGHTS
    if n > len(_HEIGHTS):
        h = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1 << 62)
        zeros = np.log2((h & (~h + np.uint64(1))).astype(np.float64)).astype(np.int64)
        _HEIGHTS = zeros // LANE_BITS
    return _HEIGHTS[:n]


class SkipList:
    """Tokens by rank: `seek(rank)` gives the code points before it."""

    def __init__(self, widths: np.ndarray):
        """widths: the code points of each token."""
        self.n = len(widths)
        ends = np.concatenate([[0], np.cumsum(widths, dtype=np.int64)])
        # node i stands behind token i - 1; node 0 is the head and reaches every lane
        nodes, tall = np.arange(self.n + 1), heights(self.n + 1)
        self.lanes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # nodes, and the widths of their links in units and code points
        level = 0
        while len(nodes) > 1:
            self.lanes.append((nodes, np.diff(nodes), np.diff(ends[nodes])))
            level += 1
            nodes = np.concatenate([nodes[:1], nodes[1:][tall[nodes[1:]] >= level]])

    def seek(self, rank: int) -> int:
        """The code points of the first `rank` tokens."""
        node = units = points = 0
        for nodes, unit_widths, point_widths in reversed(self.lanes):
            link = int(np.searchsorted(nodes, node))  # the node's place in this lane
            while link < len(unit_widths) and units + unit_widths[link] <= rank:
                units += int(unit_widths[link])
                points += int(point_widths[link])
                link += 1
            node = int(nodes[link])
        return points


def token_widths(offs: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of joined texts the code points of every token, and the bounds of each text's tokens among them."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    space = _SPACE[raw]
    last = np.zeros(len(raw), bool)
    last[offs[1:][np.diff(offs) > 0] - 1] = True
    follows = np.append(space[1:], True)
    end = np.flatnonzero((~space & follows) | last) + 1  # where tokens end, in bytes
    points = np.concatenate([[0], np.cumsum(_BEGINS[raw])])
    return np.diff(points[end], prepend=0), np.searchsorted(end, offs, "right")


_CUTS = pa.struct([("n", pa.int64()), ("first", pa.int64()), ("second", pa.int64())])


def _cut(kept: int, text: str, out: str):
    def over(batches):
        for batch in batches:
            h1, h2 = (batch.column(kept + 1 + i).fill_null(0).to_numpy() for i in (0, 1))
            rows = []
            for first, offs, raw in text_steps(batch, text):
                widths, bounds = token_widths(offs, raw)
                for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist()), first):
                    n = b - a
                    low, high = sorted((int(h1[i]) % (n + 1), int(h2[i]) % (n + 1)))
                    line = SkipList(widths[a:b])
                    rows.append((n, line.seek(low), line.seek(high)))
            cuts = pa.array([dict(zip(("n", "first", "second"), r)) for r in rows], _CUTS)
            yield pa.RecordBatch.from_arrays([*batch.columns[: kept + 1], cuts], schema=pa.schema([*list(batch.schema)[: kept + 1], pa.field(out, _CUTS)]))

    return over


def cut(docs: DataFrame, first: Column, second: Column, *, text: str = "text", out: str = "cuts") -> DataFrame:
    """docs with cuts: n tokens, and the code points before the smaller and the larger of two ranks (numbers modulo n + 1)."""
    kept = replaced(docs, text, out)
    columns = [F.col(f"`{c}`") for c in kept.columns]
    n = len(columns)
    given = docs.select(*columns, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(text), first.cast("long").alias("_h1"), second.cast("long").alias("_h2"))
    schema = given.select(*given.columns[: n + 1], F.struct(*(F.lit(0).cast("long").alias(c) for c in ("n", "first", "second"))).alias(out)).schema
    return given.mapInArrow(lean(_cut(n, text, out)), schema)


def transform(docs: DataFrame, *, key: str = "doc_id", text: str = "text", seed: int = 42, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """docs with n, form, prefix_chars, middle_chars (null if plain) and output; key and seed decide form and cuts."""
    taken = ("n", "form", "prefix_chars", "middle_chars", "output")
    base = replaced(docs, *taken)
    h = [F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null"))).cast("binary"), 256), 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    found = cut(base, h[0], h[1], text=text, out="_cuts")
    t, n, a, b = F.col(f"`{text}`"), F.col("_cuts.n"), F.col("_cuts.first"), F.col("_cuts.second")
    plain = (n == 0) | t.contains(MARKS[0]) | t.contains(MARKS[1]) | t.contains(MARKS[2]) | (h[2] % 100 >= rate)
    form = F.when(plain, "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm")
    at = found.select(*(F.col(f"`{c}`") for c in found.columns), form.alias("form"))
    part = lambda start, size: F.substring(t, (start + 1).cast("int"), size.cast("int"))
    prefix, middle, suffix = part(F.lit(0), a), part(a, b - a), part(b, F.length(t))
    p, s, m = map(F.lit, MARKS)
    output = F.when(F.col("form") == "plain", t).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    told = lambda value: F.when(F.col("form") != "plain", value)
    return at.select(*(F.col(f"`{c}`") for c in base.columns), n.alias("n"), "form", told(a).alias("prefix_chars"), told(b - a).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text of an output and its form, from nothing else."""
    p, s, m = map(F.lit, MARKS)
    middle, rest = F.split_part(output, m, F.lit(2)), F.split_part(output, m, F.lit(1))
    psm = F.concat(F.split_part(F.split_part(rest, s, F.lit(1)), p, F.lit(2)), middle, F.split_part(rest, s, F.lit(2)))
    spm = F.concat(F.split_part(rest, p, F.lit(2)), middle, F.split_part(F.split_part(rest, p, F.lit(1)), s, F.lit(2)))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def digest(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: key, n, form, prefix_chars, middle_chars, and SHA-256 of the output and of the text restored from it."""
    out = transform(docs.select(key, text), key=key, text=text)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select(key, "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))

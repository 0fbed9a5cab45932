"""Byte-level BPE as a reduction over a balanced tree: encode halves, join neighbours at their boundary.

The encodings of byte strings form a monoid under `join(encode(x), encode(y)) == encode(x + y)`. A join re-encodes a
window of tokens on both sides of the boundary, and the window grows (twice the tokens on the side that isn't stable)
until the tokens outside can't change. When that is so is decided, not guessed: a sequence of tokens is the encoding
of its bytes if and only if each two neighbours are the encoding of theirs. (Up to the first merge that crosses a
boundary of the sequence, everything between boundaries merges as it would alone, in the same order; that first merge
would also happen between the two neighbours alone.) The window's inner neighbours agree since it is an encoding, and
the outer ones did before; so only the neighbours at the window's two ends are compared. A boundary whose neighbours
agree already needs no window.

Matches of the pattern are encoded apart, so a text's ids are its matches' ids in a row. A match that is a token as a
whole is that token. Each Python worker keeps the ids of matches, of pairs of tokens and of small tree nodes that it has seen (at most `MEMO` each).
Decoding looks up blocks of ids and concatenates them up a tree.

Defined cases: null and empty texts have no ids and decode to empty bytes; a long match without white space takes
n log n steps; repeated rows are encoded each; an empty table gives no rows; result columns (`ids`, `decoded`) take
the place of columns with such names, other columns are kept. Ids that aren't in the vocabulary raise an error.
"""

from __future__ import annotations

import base64
import heapq
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultspark.llm._common import held, lean, replaced
from vaultspark.llm.tokens import runs

#: Matches, and boundaries of two tokens, that one worker remembers.
MEMO = 500_000
#: Bytes of windows that are merged in a plain list; longer ones are merged with a heap.
SHORT_BYTES = 64
#: Above all ranks.
NONE = 1 << 62
#: Bytes of the largest tree nodes whose ids a worker remembers.
NODE_BYTES = 8
#: Ids that are looked up together before the tree begins.
LEAF_IDS = 1024


class TreeEncoder:
    """Ids of texts by the ranks of byte strings."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.whole: dict[str, bytes] = {}
        self.pairs: dict[tuple[int, int], tuple[int, ...]] = {}
        self.nodes = self._leaves()

    def merged(self, raw: bytes) -> list[int]:
        """The encoding of a window's bytes: the lowest rank merges first, the leftmost of equal ones."""
        ranks, n = self.ranks, len(raw)
        if n <= SHORT_BYTES:
            parts = [raw[i : i + 1] for i in range(n)]
            best = [ranks.get(raw[i : i + 2], NONE) for i in range(n - 1)]  # the rank of each part with the next one
            while best and (r := min(best)) < NONE:
                i = best.index(r)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del best[i]
                if i:
                    best[i - 1] = ranks.get(parts[i - 1] + parts[i], NONE)
                if i < len(best):
                    best[i] = ranks.get(parts[i] + parts[i + 1], NONE)
            return [ranks[x] for x in parts]
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]  # neighbouring parts; a part is named by where it begins
        live = [True] * n

        def rank(a: int):
            b = after[a]
            return ranks.get(raw[a : after[b]]) if b < n else None

        heap = [(r, a, a + 2) for a in range(n - 1) if (r := ranks.get(raw[a : a + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, a, stop = heapq.heappop(heap)
            if not live[a] or after[a] >= n or after[after[a]] != stop:
                continue  # one of the two has changed
            b = after[a]
            live[b], after[a] = False, stop
            if stop < n:
                before[stop] = a
            for p in (before[a], a):
                if p >= 0 and (r := rank(p)) is not None:
                    heapq.heappush(heap, (r, p, after[after[p]]))
        out, a = [], 0
        while a < n:
            out.append(ranks[raw[a : after[a]]])
            a = after[a]
        return out

    def pair(self, a: int, b: int) -> tuple[int, ...]:
        """The encoding of two tokens' bytes; (a, b) if both stand beside each other as they are."""
        out = self.pairs.get((a, b))
        if out is None:
            if len(self.pairs) > MEMO:
                self.pairs.clear()
            out = self.pairs[a, b] = tuple(self.merged(self.bytes_of[a] + self.bytes_of[b]))
        return out

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of two encodings in a row."""
        if not left or not right:
            return left + right
        ends = left[-1], right[0]
        if (self.pairs.get(ends) or self.pair(*ends)) == ends:
            return left + right
        i = j = 1
        while True:
            if i == j == 1:
                window = [*self.pair(*ends)]
            else:
                window = self.merged(b"".join(map(self.bytes_of.__getitem__, left[-i:] + right[:j])))
            lasts = i >= len(left) or self.pair(left[-i - 1], window[0]) == (left[-i - 1], window[0])
            firsts = j >= len(right) or self.pair(window[-1], right[j]) == (window[-1], right[j])
            if lasts and firsts:
                return left[:-i] + window + right[j:]
            i, j = i if lasts else min(len(left), 2 * i), j if firsts else min(len(right), 2 * j)

    def encode_match(self, raw: bytes) -> list[int]:
        """The encoding of one match of the pattern."""
        if (whole := self.ranks.get(raw)) is not None:
            return [whole]
        return self._halves(raw)

    def _halves(self, raw: bytes) -> list[int]:
        if (out := self.nodes.get(raw)) is not None:
            return out
        half = 1 << (len(raw) - 1).bit_length() - 1  # the largest power of two below: runs of one letter stay aligned
        out = self.join(self._halves(raw[:half]), self._halves(raw[half:]))
        if len(raw) <= NODE_BYTES:
            if len(self.nodes) > MEMO:
                self.nodes = self._leaves()
            self.nodes[raw] = out
        return out

    def _leaves(self) -> dict[bytes, list[int]]:
        return {b: [i] for b, i in self.ranks.items() if len(b) == 1}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.whole) > MEMO:
            self.whole.clear()
        whole, out = self.whole, []
        for text in texts:
            matches = self.find(text)
            try:
                out.append(b"".join(map(whole.__getitem__, matches)))
            except KeyError:
                for m in set(matches).difference(whole):
                    ids = self.encode_match(m.encode())
                    whole[m] = struct.pack(f"<{len(ids)}I", *ids)
                out.append(b"".join(map(whole.__getitem__, matches)))
        return out

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ids, concatenated up a tree whose leaves are blocks of ids."""
        get = self.bytes_of.__getitem__
        level = [b"".join(map(get, ids[a : a + LEAF_IDS])) for a in range(0, len(ids), LEAF_IDS)]
        while len(level) > 1:
            level = [b"".join(level[a : a + 2]) for a in range(0, len(level), 2)]
        return level[0] if level else b""


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file with a line for each token: its bytes in base64, and its rank."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


def encoder(path: str, pattern: str) -> TreeEncoder:
    """The worker's own encoder of a rank file."""
    return held(("ranks", path, pattern), lambda: TreeEncoder(read_ranks(path), pattern))


def _rows_out(batch: pa.RecordBatch, kept: int, schema: pa.Schema, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns[:kept], values], schema=pa.schema([*list(batch.schema)[:kept], schema.field(0)]))


def encode(docs: DataFrame, path: str, pattern: str, *, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with the ids of their texts in place of the texts, as an array of integers."""
    kept = replaced(docs, text, out)
    n, field = len(kept.columns), pa.schema([(out, pa.list_(pa.int32()))])

    def over(batches):
        tree = encoder(path, pattern)
        for batch in batches:
            for first, texts in runs(batch.column(n).to_pylist()):
                ids = tree.encode(texts)
                offsets = np.cumsum([0, *(len(x) // 4 for x in ids)])
                values = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32()))
                yield _rows_out(batch.slice(first, len(texts)), n, field, values)

    columns = [F.col(f"`{c}`") for c in kept.columns]
    schema = docs.select(*columns, F.array(F.lit(0)).alias(out)).schema
    return docs.select(*columns, F.col(f"`{text}`")).mapInArrow(lean(over, True), schema)


def decode(docs: DataFrame, path: str, *, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with the bytes of their ids added, as a binary column; null ids count as none."""
    kept = replaced(docs, out)
    at = [c.lower() for c in kept.columns].index(ids.lower())
    n, field = len(kept.columns), pa.schema([(out, pa.binary())])

    def over(batches):
        tree = encoder(path, "")
        for batch in batches:
            lists = batch.column(at)
            flat, stops = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().fill_null(0).to_numpy())
            starts = np.append(0, stops)
            lo = 0
            while lo < len(lists):  # about a quarter of a million ids in a step
                hi = max(lo + 1, int(np.searchsorted(stops, (stops[lo - 1] if lo else 0) + (1 << 18), "right")))
                yield _rows_out(batch.slice(lo, hi - lo), n, field, pa.array([tree.decode(flat[a:b].tolist()) for a, b in zip(starts[lo:hi], stops[lo:hi])], pa.binary()))
                lo = hi

    schema = docs.select(*(F.col(f"`{c}`") for c in kept.columns), F.lit(b"").alias(out)).schema
    return kept.mapInArrow(lean(over, True), schema)


def digest(docs: DataFrame, path: str, pattern: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: key, n_tokens, and SHA-256 of the decimal ids joined by a space and of the decoded bytes."""
    both = decode(encode(docs.select(key, text), path, pattern, text=text), path)
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select(key, F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

"""Sum-of-squares online packing of documents into token sequences.

A document's full windows of `capacity` tokens are sequences of their own; what remains is one item. A level array
holds how many windows are filled to each level below the capacity. An item of s tokens goes where the sum of the
squared counts grows least: into a window of level l (its count falls, that of l + s rises, unless l + s is full) or
into a new one. Ties go to the fullest window. Windows of one level are taken in the order they came to it.

Each task packs the documents of its own input split; nothing is shuffled. When a split ends, the windows still open
are closed as they are, the fullest first: what each still lacks is cut from the pieces of the emptiest ones, which
are given up for that one after the other. So the pieces that move are no more tokens than the open windows lack, all
others stay in the windows that the level array chose, whatever the splits, and nothing is padded. What doesn't fill a
window in the end is cut at powers of two. Sequence ids hold the split's number in their upper bits.

Defined cases: null and empty texts are the end token alone; a long text spreads over many sequences; an empty table
gives no pieces; repeated rows are packed each; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from vaultspark.llm._common import lean
from vaultspark.llm.tokens import runs, tokenizer

CAPACITY = 2048

_OUT = "row_key long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
_SCHEMA = pa.schema([*((n, pa.int64()) for n in ("row_key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")), ("ids", pa.binary())])


class SumOfSquares:
    """Online packing into windows of a capacity by the growth of the sum of squared level counts."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, np.int64)
        self.open: dict[int, deque] = {}

    def level_for(self, size: int) -> int:
        """The level whose window takes an item of this size; 0: a new window."""
        c, cap = self.counts, self.capacity
        levels = np.flatnonzero(c[1 : cap - size + 1]) + 1
        # a count n that falls to n - 1 changes the sum by 1 - 2n, one that rises to n + 1 by 2n + 1; level full counts nothing
        rise = 2 * c[levels + size] + 1
        rise[levels + size == cap] = 0
        growth = 1 - 2 * c[levels] + rise
        new = 2 * c[size] + 1 if size < cap else 0
        if len(levels) == 0:
            return 0
        best = int(growth.min())
        return int(levels[np.flatnonzero(growth == best)[-1]]) if best <= new else 0

    def place(self, pieces: list, size: int):
        """Adds pieces that stay together; returns the window (all its pieces) that they filled, or None."""
        level = self.level_for(size)
        if level:
            line = self.open[level]
            window = line.popleft()
            self.counts[level] -= 1
        else:
            window = []
        window += pieces
        level += size
        if level == self.capacity:
            return window
        self.counts[level] += 1
        self.open.setdefault(level, deque()).append(window)
        return None

    def drain(self) -> list[tuple[int, list]]:
        """The open windows with their levels, the fullest first; none is open then."""
        windows = [(level, window) for level in sorted(self.open, reverse=True) for window in self.open[level]]
        self.open.clear()
        self.counts[:] = 0
        return windows

    def finish(self, size_of, cut):
        """Yields what the open windows become: full ones, and at most one of each power of two below the capacity.

        size_of(piece) is a piece's size; cut(piece, n) parts it after n of them."""
        windows = deque(self.drain())
        filler: deque = deque()

        def filled(window: list, need: int) -> list:
            while need and (filler or windows):
                if not filler:
                    filler.extend(windows.pop()[1])
                piece = filler.popleft()
                if size_of(piece) > need:
                    piece, rest = cut(piece, need)
                    filler.appendleft(rest)
                window.append(piece)
                need -= size_of(piece)
            return window

        while windows:
            level, window = windows.popleft()
            if sum(map(size_of, filler)) + sum(n for n, _ in windows) < self.capacity - level:
                filler.extendleft(reversed(window))  # all that is left doesn't fill a window
                filler.extend(piece for _, more in windows for piece in more)
                break
            yield filled(window, self.capacity - level)
        windows.clear()
        left = sum(map(size_of, filler))
        while left:
            most = min(self.capacity, 1 << left.bit_length() - 1)
            yield filled([], most)
            left -= most


def _size(piece) -> int:
    return len(piece[2]) // 4


def _cut(piece, n: int):
    key, start, ids, total = piece
    return (key, start, ids[: 4 * n], total), (key, start + n, ids[4 * n :], total)


class _Pieces:
    """Rows of the result, and the sequences they lie in."""

    def __init__(self, split: int):
        self.next = split << 33
        self.rows: list[tuple] = []

    def sequence(self, pieces) -> None:
        """One sequence of (key, start, ids, doc_tokens) pieces."""
        at = 0
        for key, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((key, start, n, zlib.crc32(ids), total, self.next, at, ids))
            at += n
        self.next += 1

    def batch(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows)) or [()] * len(_SCHEMA)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SCHEMA)], schema=_SCHEMA)


def _pack(path: str, kind: str, end_id: int, capacity: int, keep_ids: bool):
    end = int(end_id).to_bytes(4, "little")

    def over(batches):
        out = _Pieces(TaskContext.get().partitionId())
        levels = SumOfSquares(capacity)
        encode = tokenizer(path, kind).encode
        full = 4 * capacity
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for first, texts in runs(batch.column(1).to_pylist()):
                for i, ids in enumerate(encode(texts)):
                    ids += end
                    total, key = len(ids) // 4, keys[first + i]
                    cut = len(ids) // full * full
                    for a in range(0, cut, full):
                        out.sequence([(key, a // 4, ids[a : a + full], total)])
                    if cut < len(ids):
                        piece = (key, cut // 4, ids[cut:], total)
                        if done := levels.place([piece], _size(piece)):
                            out.sequence(done)
                yield trimmed(out.batch())
        for sequence in levels.finish(_size, _cut):
            out.sequence(sequence)
        yield trimmed(out.batch())

    def trimmed(batch):
        return batch if keep_ids else batch.select(_SCHEMA.names[:-1])

    return over


def pack(docs: DataFrame, path: str, *, kind: str = "byte", end_id: int = 1, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset and (keep_ids) the ids' bytes."""
    out = _OUT if keep_ids else _OUT.removesuffix(", ids binary")
    return docs.select(key, text).mapInArrow(lean(_pack(path, kind, end_id, capacity, keep_ids), True), out).withColumnRenamed("row_key", key)

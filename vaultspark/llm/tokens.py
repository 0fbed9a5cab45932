"""Tokenising whole texts with the tokenizers library, a piece of text at a time.

Both tokenizers here never join a run of letters, digits or marks with what stands beside it (but for one leading
space), so equal runs have equal ids wherever they stand. Each Python worker keeps the ids of runs that it has seen
(at most `MEMO`) in a hash table of numpy arrays, looks up the runs of many texts in one step, and asks the library
for new ones only, many at once. Runs are looked up by a 64-bit hash and then compared byte by byte with the run that
the ids are of; a run whose hash is another one's is asked for each time. Runs of more than `LONG` bytes aren't kept.

Where byte classes can't tell runs apart (apostrophes, other scripts, marks beyond ASCII, odd white space), a text is
cut by patterns instead, or goes to the library as it is. Ids come as the bytes of little-endian unsigned 32-bit
integers.
"""

from __future__ import annotations

import os
import re

import numpy as np

from vaultspark.llm._common import held, word_hashes

#: Pieces that one worker remembers.
MEMO = 1_000_000
#: Runs that the library is asked for at once; its answers are large.
ASKED = 8192
#: Bytes of the longest runs that are kept.
LONG = 128

# White space for Python only (U+001C to U+001F), for which texts go to the library whole.
_ODD = re.compile("[\x1c-\x1f]")
# Beyond Latin letters, lower-casing is left to the library.
_NOT_LATIN = re.compile("[^\x00-ɏ]")
# Two marks in a row could be one piece.
_MARKS = re.compile(r"(?:[^\w\s]|_){2}|'")

# What keeps a text from the byte classes: U+001C to U+001F, apostrophes, "<", and all but Latin letters beyond ASCII,
# which are the UTF-8 pairs C3 80 to C9 8F without C3 97, C3 B7 and C4 B0 (U+0130, whose lower case ends in a mark).
_SLOW = np.zeros(256, bool)
_SLOW[[0x1C, 0x1D, 0x1E, 0x1F, ord("'"), ord("<"), 0xC2]] = _SLOW[0xCA:] = True


def _slow(texts: list[bytes]) -> np.ndarray:
    """Whether each text has anything that byte classes can't cut."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    if not len(raw):
        return np.zeros(len(texts), bool)
    bad = _SLOW[raw]
    lead = np.flatnonzero((raw[:-1] == 0xC3) | (raw[:-1] == 0xC4) | (raw[:-1] == 0xC9))
    after = raw[lead + 1]
    bad[lead[np.select([raw[lead] == 0xC3, raw[lead] == 0xC4], [(after == 0x97) | (after == 0xB7), after == 0xB0], after >= 0x90)]] = True
    return np.diff(np.searchsorted(np.flatnonzero(bad), offs)) > 0


# Classes of bytes: 0 white space, 1 letters (and all beyond ASCII), 2 digits, 3 marks.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[32, 9, 10, 11, 12, 13]] = 0
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = 1
_CLASS[48:58] = 2

_FINE = re.compile(r" ?[^\s.,]+| ?[.,]|\s+(?!\S)|\s")
_COARSE = re.compile(r" ?\S+|\s+(?!\S)|\s")


class PieceTokenizer:
    """Ids of texts. kind "word": white space divides and is dropped, case is folded; kind "byte": a space may lead a piece."""

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.kind = kind
        self.memo: dict[str, bytes] = {}
        self._reset(1 << 16)

    # the table of runs: open addressing, linear probing

    def _reset(self, size: int) -> None:
        self.keys = np.zeros(size, np.uint64)  # 0: free; hashes of 0 are taken as 1
        self.slots = np.zeros(size, np.int32)
        self.known, self.used = 0, 0
        self.at, self.n = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.pool = np.zeros(1 << 14, np.uint32)
        # the bytes of each run: the length, the first and the last eight, and all of those of more than sixteen
        self.bytes = np.zeros((1 << 12, 3), np.uint64)
        self.rest: dict[int, bytes] = {}

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the runs with these hashes; -1 for new ones."""
        mask = np.uint64(len(self.keys) - 1)
        out = np.full(len(h), -1, np.int64)
        left, place = np.arange(len(h)), (h & mask).astype(np.int64)
        while len(left):
            k = self.keys[place]
            hit = k == h[left]
            out[left[hit]] = self.slots[place[hit]]
            go = ~hit & (k != 0)
            left, place = left[go], (place[go] + 1) & int(mask)
        return out

    def _insert(self, h: np.ndarray, numbers: np.ndarray) -> None:
        """Adds distinct new hashes."""
        mask = len(self.keys) - 1
        left, place = np.arange(len(h)), (h & np.uint64(mask)).astype(np.int64)
        while len(left):
            free = self.keys[place] == 0
            _, first = np.unique(place[free], return_index=True)  # one newcomer for each free place
            take = np.flatnonzero(free)[first]
            self.keys[place[take]] = h[left[take]]
            self.slots[place[take]] = numbers[left[take]]
            stay = np.ones(len(left), bool)
            stay[take] = False
            left, place = left[stay], (place[stay] + 1) & mask

    def _learn(self, h: np.ndarray, marks: np.ndarray, runs_: list[bytes], kept: bool = True) -> np.ndarray:
        """Numbers of new runs with distinct hashes, their ids stored; those that aren't kept are overwritten by the next ones."""
        if kept:
            while 2 * (self.known + len(h)) > len(self.keys):
                keys, slots = self.keys, self.slots
                self.keys, self.slots = np.zeros(2 * len(keys), np.uint64), np.zeros(2 * len(keys), np.int32)
                old = np.flatnonzero(keys)
                self._insert(keys[old], slots[old])
        texts = [x.decode() for x in runs_]
        ids = [x for lo in range(0, len(texts), ASKED) for x in [e.ids for e in self.library.encode_batch_fast(texts[lo : lo + ASKED], add_special_tokens=False)]]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(n.sum()))
        first, last = self.known, self.known + len(runs_)
        while last > len(self.at):
            self.at, self.n, self.bytes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.n, self.bytes))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(flat)] = flat
        self.at[first:last], self.n[first:last] = self.used + np.cumsum(n) - n, n
        numbers = np.arange(first, last)
        if kept:
            self._insert(h, numbers)
            self.bytes[first:last] = marks
            self.rest.update((first + i, x) for i, x in enumerate(runs_) if len(x) > 16)
            self.known, self.used = last, self.used + len(flat)
        return numbers

    @staticmethod
    def _marks(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of each run its length, its first and its last eight bytes: all of a run of up to sixteen."""
        padded = np.concatenate([np.zeros(8, np.uint8), raw, np.zeros(8, np.uint8)])
        eight = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (len(raw) + 9, 8), (1, 1))
        n = ends - starts
        head = np.ascontiguousarray(eight[starts + 8]).view("<u8")[:, 0]
        tail = np.ascontiguousarray(eight[ends]).view("<u8")[:, 0]  # the padding moves everything by eight
        cut = (8 * (8 - np.minimum(n, 8))).astype(np.uint64)
        return np.stack([n.astype(np.uint64), (head << cut) >> cut, (tail >> cut) << cut], 1)

    def _same(self, number: np.ndarray, marks: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether runs are byte by byte those of the numbers."""
        same = (self.bytes[number] == marks).all(1)
        for i in np.flatnonzero(same & (marks[:, 0] > 16)).tolist():
            same[i] = self.rest[int(number[i])] == raw[starts[i] : ends[i]].tobytes()
        return same

    def _runs(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs of joined texts."""
        kind = _CLASS[raw]
        cut = np.empty(len(raw) + 1, bool)
        cut[0] = cut[-1] = True
        cut[1:-1] = kind[1:] != kind[:-1]
        cut[offs] = True
        if self.kind == "byte":
            edge = np.zeros(len(raw) + 1, bool)
            edge[offs] = True
            # the last white space before a run stands alone, or leads the run if it is a space
            last = np.flatnonzero((kind[:-1] == 0) & (kind[1:] != 0) & ~edge[1:-1])
            cut[last] = True
            cut[last[raw[last] == 32] + 1] = False
        at = np.flatnonzero(cut)
        starts, ends = at[:-1], at[1:]
        if self.kind == "word":
            keep = kind[starts] != 0
            starts, ends = starts[keep], ends[keep]
        return starts, ends

    def _fast(self, texts: list[bytes]) -> list[bytes]:
        """Ids of texts that byte classes can cut."""
        raw = np.frombuffer(b"".join(texts), np.uint8)
        if not len(raw):
            return [b""] * len(texts)
        offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        starts, ends = self._runs(raw, offs)
        h = np.maximum(word_hashes(raw, starts, ends), np.uint64(1))
        marks = self._marks(raw, starts, ends)
        if self.known > MEMO:
            self._reset(1 << 16)
        number = np.full(len(h), -1, np.int64)
        kept = np.flatnonzero(ends - starts <= LONG)
        number[kept] = self._find(h[kept])
        new = kept[number[kept] < 0]
        as_bytes = lambda at: [raw[a:b].tobytes() for a, b in zip(starts[at].tolist(), ends[at].tolist())]
        if len(new):
            hashes, first = np.unique(h[new], return_index=True)
            where = new[first]
            self._learn(hashes, marks[where], as_bytes(where))
            number[new] = self._find(h[new])
        number[kept[~self._same(number[kept], marks[kept], raw, starts[kept], ends[kept])]] = -1
        alone = np.flatnonzero(number < 0)
        if len(alone):
            number[alone] = self._learn(h[alone], marks[alone], as_bytes(alone), kept=False)
        n = self.n[number]
        stop = np.cumsum(n)
        flat = self.pool[np.arange(stop[-1] if len(stop) else 0) + np.repeat(self.at[number] - (stop - n), n)]
        bounds = np.concatenate([[0], stop])[np.searchsorted(starts, offs)].tolist()
        return [flat[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]

    def direct(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, text: str) -> list[str] | None:
        """What a text is tokenised by, or None for the text as a whole."""
        if _ODD.search(text):
            return None
        if self.kind == "word":
            if not _NOT_LATIN.search(text) and "İ" not in text:
                if not _MARKS.search(text):
                    text = text.replace(".", " . ").replace(",", " , ")
                text = text.lower()
            return text.split()
        if "<" in text:  # special tokens are found before pieces are
            return _COARSE.findall(text) if "<|" not in text else None
        return (_COARSE if _MARKS.search(text) else _FINE).findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        raw = [t.encode() for t in texts]
        fast = (~_slow(raw)).tolist()
        some = iter(self._fast([t.lower().encode() if self.kind == "word" else r for t, r, f in zip(texts, raw, fast) if f]))
        slow = iter(self._by_pieces([t for t, f in zip(texts, fast) if not f]))
        return [next(some) if f else next(slow) for f in fast]

    def _by_pieces(self, texts: list[str]) -> list[bytes]:
        memo = self.memo
        if len(memo) > MEMO // 8:
            memo.clear()
        split = [self.pieces(t) for t in texts]
        new = set().union(*(p for p in split if p is not None)).difference(memo)
        if new:
            asked = list(new)
            memo.update(zip(asked, self.direct(asked)))
        get = memo.__getitem__
        out = [b"".join(map(get, p)) if p is not None else None for p in split]
        whole = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(whole, self.direct([texts[i] for i in whole]) if whole else ()):
            out[i] = ids
        return out


def tokenizer(path: str, kind: str) -> PieceTokenizer:
    """The worker's own tokenizer of a file; its memory of pieces lasts over batches and tasks."""
    return held(("tokenizer", path, kind), lambda: PieceTokenizer(path, kind))


def runs(texts: list, size: int = 1_000_000):
    """Yields (first, texts) of runs of about `size` characters; None becomes the empty text."""
    lo = 0
    while lo < len(texts):
        hi, n = lo, 0
        while hi < len(texts) and (hi == lo or n + len(texts[hi] or "") <= size):
            n += len(texts[hi] or "")
            hi += 1
        yield lo, [t or "" for t in texts[lo:hi]]
        lo = hi

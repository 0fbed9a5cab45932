"""Token-id files in Simple-8b word-aligned coding.

A file is a row of blocks. Each block is, in little-endian order:

    8 bytes   magic "S8BLOCK1"
    8 x u64   documents, ids, words, bytes of keys, first id's number in the file, block's bytes, mask, CRC-32 of what follows
    keys      zigzag varints of the differences of the documents' keys, padded to 8 bytes
    counts    u32 per document, padded to 8 bytes
    starts    u32 per document: its first id's place in the block (the per-block offsets)
    words     u64: Simple-8b words; the selector in the upper 4 bits
    8 bytes   "\\nS8BEND\\n" after each block, which does not occur within one: all that follows the head is stored
              under an exclusive or with the mask (a byte, 0 unless that is needed)

Selector s of 1 to 14 packs WIDTHS[s] = (ids, bits): 60 ids of 1 bit up to 1 id of 60 bits; selector 0 is the escape:
its word holds how many of the following words are raw 64-bit values. Selector 15 is a run: a value of 28 bits that repeats up to 2**32 - 1 times.

Documents are dealt in ranges of (key, hash of the text, row number) and sorted by these, so that rows of one key, or
without one, are dealt over several files, too. There are as many files as the texts have `FILE_BYTES`. They are
written through Spark's text writer, whose rows can be any bytes: so files get committed like any other output and
lie wherever Spark can write. They are read through its text source, a block a row, so that a large file is split, and
each block is decoded with numpy.

Defined cases: null and empty texts are the end id alone; rows of equal keys keep one order (by hash and row number);
an empty table gives no blocks; missing keys come first and stay missing; keys are whole numbers; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultspark.llm._common import lean, work_folder
from vaultspark.llm.tokens import runs, tokenizer

MAGIC = b"S8BLOCK1"
END = "\nS8BEND\n"
#: Ids and bits of a word by selector; fixed values of the coding.
WIDTHS = ((0, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE, RUN = 0, 15
#: Ids in a block, about, and bytes of texts in a file, about.
BLOCK_IDS = 1 << 18
FILE_BYTES = 64 << 20
#: What stands for a missing key.
NO_KEY = -(1 << 63)
#: Shortest run of equal ids that becomes a run word.
RUN_LEAST = 64

_U = np.uint64
#: Bits of each value below 65,536 (1 for 0).
_BITS = np.maximum(1, np.frexp(np.arange(65536))[1]).astype(np.uint8)


def encode_words(ids: np.ndarray) -> np.ndarray:
    """Simple-8b words of unsigned 64-bit values."""
    ids = np.ascontiguousarray(ids, _U)
    n = len(ids)
    if n == 0:
        return np.zeros(0, _U)
    # where a word may start, and how many values its best selector takes: the most whose values all fit
    take = np.zeros(n, np.uint8)
    bits_of = _BITS[np.minimum(ids, _U(65535)).astype(np.uint16)]
    if (big := np.flatnonzero(ids > _U(65535))).size:
        bits_of[big] = np.array([20, 30, 60, 64], np.uint8)[np.searchsorted(np.array([1 << 20, 1 << 30, 1 << 60], _U), ids[big], "right")]
    for s in range(14, 0, -1):
        count, bits = WIDTHS[s]
        if count > n:
            continue
        over = bits_of > bits
        if count == 1:
            take[~over] = s
            continue
        sums = np.concatenate([np.zeros(1, np.int32), np.cumsum(over, dtype=np.int32)])
        fits = sums[count:] == sums[:-count]
        if not fits.any():
            break  # a selector of more and narrower values can't fit either
        take[: n - count + 1][fits] = s
    runs_at = _long_runs(ids)
    step = np.array([1, *(w[0] for w in WIDTHS[1:])], np.uint8)[take].tobytes()
    places, i, nxt = [], 0, 0
    marks = [*runs_at, (n, n)]
    while i < n:
        while marks[nxt][0] < i:
            nxt += 1
        stop, resume = marks[nxt]
        add = places.append
        while i < stop:
            add(i)
            i += step[i]
        if i == stop and stop < n:  # else a word has overtaken the run's start
            add(-stop - 1)
            i = resume
            nxt += 1
        elif i > stop and stop < n:
            nxt += 1
    at = np.array(places, np.int64)
    words = np.zeros(len(at), _U)
    is_run = at < 0
    pos = np.where(is_run, -at - 1, at)
    sel = np.where(is_run, RUN, take[pos])
    for s in range(1, 15):
        rows = np.flatnonzero(sel == s)
        if not len(rows):
            continue
        count, bits = WIDTHS[s]
        w = np.full(len(rows), _U(s) << _U(60))
        p = pos[rows]
        for j in range(count):
            w |= ids[p + j] << _U(bits * j)
        words[rows] = w
    if is_run.any():
        ends = dict(runs_at)
        for r in np.flatnonzero(is_run):
            words[r] = (_U(RUN) << _U(60)) | (_U(ends[int(pos[r])] - int(pos[r])) << _U(28)) | ids[pos[r]]
    raw = np.flatnonzero((sel == 0) & ~is_run)
    if len(raw):  # each raw value gets an escape word of its own before it
        out = np.insert(words, raw, _U(1))
        out[raw + np.arange(len(raw)) + 1] = ids[pos[raw]]
        return out
    return words


def _long_runs(ids: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    ends = np.append(edges[1:], len(ids))
    long = np.flatnonzero((ends - edges >= RUN_LEAST) & (ids[edges] < _U(1) << _U(28)))
    return [(int(edges[i]), int(ends[i])) for i in long]


def decode_words(words: np.ndarray) -> np.ndarray:
    """The values of Simple-8b words."""
    sel = (words >> _U(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    i_esc = np.flatnonzero(sel == ESCAPE)
    skip = -1
    escapes = []
    for i in i_esc.tolist():
        if i <= skip:
            continue
        skip = i + int(words[i])
        raw[i + 1 : skip + 1] = True
        escapes.append(i)
    count = np.array([0, *(w[0] for w in WIDTHS[1:]), 0], np.int64)[sel]
    run = (sel == RUN) & ~raw
    count[run] = ((words[run] >> _U(28)) & _U(0xFFFFFFFF)).astype(np.int64)
    count[raw] = 1
    count[escapes] = 0
    first = np.cumsum(count) - count
    out = np.empty(int(count.sum()), _U)
    for s in range(1, 15):
        rows = np.flatnonzero((sel == s) & ~raw)
        if not len(rows):
            continue
        c, bits = WIDTHS[s]
        w, f = words[rows], first[rows]
        mask = _U((1 << bits) - 1)
        for j in range(c):
            out[f + j] = (w >> _U(bits * j)) & mask
    out[first[raw]] = words[raw]
    for r in np.flatnonzero(run):
        out[first[r] : first[r] + count[r]] = words[r] & _U((1 << 28) - 1)
    return out


def _varints(values: list[int]) -> bytes:
    out = bytearray()
    for v in values:
        v = v << 1 if v >= 0 else (-v << 1) - 1
        while v > 127:
            out.append(v & 127 | 128)
            v >>= 7
        out.append(v)
    return bytes(out)


def _from_varints(data: bytes, n: int) -> list[int]:
    out, at = [], 0
    for _ in range(n):
        v = shift = 0
        while True:
            b = data[at]
            at += 1
            v |= (b & 127) << shift
            shift += 7
            if b < 128:
                break
        out.append((v >> 1) ^ -(v & 1))
    return out


def _padded(b: bytes) -> bytes:
    return b + bytes(-len(b) % 8)


def encode_block(keys: list[int], ids: list[bytes], first: int) -> bytes:
    """One block of documents; ids as bytes of little-endian unsigned 32-bit integers."""
    counts = np.array([len(x) // 4 for x in ids], "<u4")
    words = encode_words(np.frombuffer(b"".join(ids), "<u4"))
    deltas = [k - p for k, p in zip(keys, [0, *keys[:-1]])]
    names = _padded(_varints(deltas))
    starts = (np.cumsum(counts, dtype=np.int64) - counts).astype("<u4")
    body = np.frombuffer(names + _padded(counts.tobytes()) + _padded(starts.tobytes()) + words.astype("<u8").tobytes(), np.uint8)
    for mask in range(256):
        stored = (body ^ np.uint8(mask)).tobytes() if mask else body.tobytes()
        head = np.array([len(keys), counts.sum(dtype=np.int64), len(words), len(names), first, 72 + len(stored), mask, zlib.crc32(stored)], "<u8")
        block = MAGIC + head.tobytes() + stored
        if END.encode() not in block + END.encode()[:-1]:
            return block
    raise ValueError("every mask leaves the end of a block within it")


def decode_block(data: memoryview):
    """(keys, ids of the file before the block, counts, starts in the block, ids) of one block."""
    if bytes(data[:8]) != MAGIC or len(data) < 72:
        raise ValueError("not a block")
    docs, n, words, names, first, size, mask, crc = np.frombuffer(data[8:72], "<u8").tolist()
    body = data[72:]
    if len(data) != size or zlib.crc32(body) != crc:
        raise ValueError("a block is damaged")
    if mask:
        body = memoryview((np.frombuffer(body, np.uint8) ^ np.uint8(mask)).tobytes())
    keys = list(accumulate(_from_varints(bytes(body[:names]), docs)))  # a difference may need 65 bits
    p = names
    counts = np.frombuffer(body[p : p + 4 * docs], "<u4")
    p += -(-4 * docs // 8) * 8
    starts = np.frombuffer(body[p : p + 4 * docs], "<u4")
    p += -(-4 * docs // 8) * 8
    ids = decode_words(np.frombuffer(body[p : p + 8 * words], "<u8"))
    if len(ids) != n:
        raise ValueError(f"a block has {len(ids)} ids, not {n}")
    return keys, first, counts, starts, ids


def decode_blocks(data: bytes):
    """Yields decode_block() of each block of a whole file."""
    *blocks, last = bytes(data).split(END.encode())
    if last:
        raise ValueError("a file that goes on after its last block")
    for block in blocks:
        yield decode_block(memoryview(block))


def _writer(path: str, kind: str, end_id: int):
    end = int(end_id).to_bytes(4, "little")

    def over(batches):
        encode = tokenizer(path, kind).encode
        keys, ids, size, first = [], [], 0, 0
        for batch in batches:
            names = batch.column(0).to_pylist()
            for lo, texts in runs(batch.column(1).to_pylist()):
                for i, x in enumerate(encode(texts)):
                    keys.append(NO_KEY if names[lo + i] is None else names[lo + i])
                    ids.append(x + end)
                    size += len(ids[-1]) // 4
                    if size >= BLOCK_IDS:
                        yield pa.RecordBatch.from_arrays([pa.array([encode_block(keys, ids, first)], pa.binary())], ["value"])
                        first += size
                        keys, ids, size = [], [], 0
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array([encode_block(keys, ids, first)], pa.binary())], ["value"])

    return over


def write_tokens(docs: DataFrame, folder: str, path: str, *, kind: str = "word", end_id: int = 2, key: str = "doc_id", text: str = "text", file_bytes: int = FILE_BYTES) -> None:
    """Writes a folder of token files; the order of their names is the order of the keys."""
    total = docs.agg(F.sum(F.octet_length(text).cast("long") + 8).alias("n")).first()["n"] or 0
    n = max(1, -(-total // file_bytes))
    # copies of one row are equal in key and text: the row's number deals them, too
    order = [F.col("key"), F.xxhash64("text").alias("hash"), F.col("row")]
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).withColumn("row", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("key", "text")
    blocks = dealt.mapInArrow(lean(_writer(path, kind, end_id), True), "value binary")
    blocks.select(F.expr("CAST(value AS STRING)").alias("value")).write.option("lineSep", END).text(folder)


def _blocks(spark: SparkSession, folder: str) -> DataFrame:
    """(file, block) of all blocks of a folder."""
    lines = spark.read.option("lineSep", END).option("pathGlobFilter", "part-*").text(folder)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("block"))


def _reader(with_ids: bool):
    def over(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys, first, counts, starts, ids = decode_block(memoryview(content.as_buffer()))
                flat = ids.astype("<u4")
                cuts = [(int(a), int(a) + int(c)) for a, c in zip(starts, counts)]
                cols = [pa.array([name] * len(keys)), pa.array([None if k == NO_KEY else k for k in keys], pa.int64()), pa.array(starts.astype(np.int64) + first), pa.array(counts.astype(np.int64)), pa.array([zlib.crc32(flat[a:b].tobytes()) for a, b in cuts], pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(starts, len(flat)).astype(np.int32)), pa.array(flat.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(cols, ["file", "row_key", "at", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    return over


def read_tokens(spark: SparkSession, folder: str, *, with_ids: bool = False) -> DataFrame:
    """Per document of a folder: file, row_key, at (ids before it in its file), n_tokens, ids_crc32 and, if asked for, ids."""
    out = "file string, row_key long, at long, n_tokens long, ids_crc32 long" + ", ids array<bigint>" * with_ids
    return _blocks(spark, folder).mapInArrow(lean(_reader(with_ids)), out)


def _block_ids(batches):
    for batch in batches:
        heads = [np.frombuffer(memoryview(x.as_buffer())[16:24], "<u8")[0] for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(heads, pa.int64())], ["file", "n"])


def file_starts(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """(file, ids in all files before it), from the blocks' heads: one row per file comes to the driver."""
    heads = _blocks(spark, folder).select("file", F.substring("block", 1, 72).alias("head"))
    out, at = [], 0
    rows = heads.mapInArrow(_block_ids, "file string, n long").groupBy("file").agg(F.sum("n").alias("n")).collect()
    for row in sorted(rows, key=lambda r: int(r["file"].rpartition("/part-")[2].split("-")[0])):
        out.append((row["file"], at))
        at += row["n"]
    return out


def tokens_digest(docs: DataFrame, path: str, *, kind: str = "word", end_id: int = 2, key: str = "doc_id", text: str = "text", folder: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the files and reads them back: key, start over all files, n_tokens and ids_crc32 per document."""
    spark = docs.sparkSession
    folder = folder or work_folder(spark, "tokens")
    write_tokens(docs, folder, path, kind=kind, end_id=end_id, key=key, text=text, file_bytes=file_bytes)
    starts = spark.createDataFrame(file_starts(spark, folder), "file string, before long")
    # as many rows as files: the size of this broadcast is that of a listing
    read = read_tokens(spark, folder).join(F.broadcast(starts), "file")
    return read.select(F.col("row_key").alias(key), (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


__all__ = ["decode_block", "decode_blocks", "decode_words", "encode_block", "encode_words", "file_starts", "read_tokens", "tokens_digest", "write_tokens"]

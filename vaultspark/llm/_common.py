"""Shared pieces of the training-data operators: the work folder and word hashing over UTF-8 buffers."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z on UTF-8 bytes; bytes of other letters stay as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)

#: Bytes of text that one vectorised step takes at once, unless one document is longer.
STEP_BYTES = 1 << 20


#: The work folder of each application.
_folders: dict[str, str] = {}


def work_folder(spark: SparkSession, name: str) -> str:
    """A new path in a folder of the application under spark.checkpoint.dir, which driver and executors share.

    The folder goes when the application ends. Where the setting is empty, a temporary folder serves a single machine;
    on a cluster that is an error, since executors could not read what others wrote."""
    context = spark.sparkContext
    app = context.applicationId
    if app not in _folders:
        base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not base:
            if context.master != "local" and not context.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            own = tempfile.mkdtemp(prefix="vaultspark-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            base = f"file://{own}"
        folder = context._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/vaultspark-{app}")
        files = folder.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)
        _folders[app] = folder.toString()
    return f"{_folders[app]}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the work folder, read again: lineage ends there, and lost executors take nothing along."""
    spark = df.sparkSession
    path = work_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._work_path = path
    return out


def drop_written(df: DataFrame) -> None:
    """Frees the files of a written() table that nothing reads any more."""
    remove_path(df.sparkSession, df._work_path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Deletes a work path through its own file system."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def input_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    # whole texts go to Python in batches of rows: fewer rows bound the memory of a batch of long texts
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def text_steps(batch: pa.RecordBatch, column: str, step: int = STEP_BYTES):
    """Yields (first row, offsets, bytes) of runs of rows with about `step` bytes; null counts as empty."""
    col = batch.column(batch.schema.get_field_index(column))
    if col.null_count:
        col = col.fill_null("")
    if len(col) == 0:
        return
    col = col.cast(pa.large_binary()) if not pa.types.is_large_string(col.type) else col
    offs = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    raw = np.frombuffer(col.buffers()[2] or b"", np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + step, "right")) - 1)
        hi = min(hi, len(col))
        yield lo, offs[lo : hi + 1] - offs[lo], raw[offs[lo] : offs[hi]]
        lo = hi


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (public constants of a well-known mixer)."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


def word_spans(offs: np.ndarray, low: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words, and the number of words of each document; words end where documents do."""
    n = len(low)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs) - 1, np.int64)
    m = is_word[low]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = m[:-1]
    starts = np.flatnonzero(m & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = m[1:]
    ends = np.flatnonzero(m & (~after | edge[1:])) + 1
    at = np.searchsorted(starts, offs)
    return starts, ends, np.diff(at)


def _at_place(code: np.ndarray) -> np.ndarray:
    """A random-looking 64-bit value of each (place in a word, byte), coded as 256 * place + byte."""
    return mix((code.astype(_U) + _U(1)) * _BASE)


#: Those values for the first places of a word; beyond them they are computed.
PLACES = 64
_PLACE_TABLE = _at_place(np.arange(256 * PLACES))


def _byte_sums(low: np.ndarray, starts: np.ndarray, lengths: np.ndarray, place: np.ndarray | int = 0) -> np.ndarray:
    """Sums of the values of each span's bytes, whose first byte stands at a place of its word."""
    first = np.cumsum(lengths) - lengths
    small = np.int32 if place < 1 << 20 and len(low) < 1 << 30 else np.int64  # a step has 2**21 bytes, a place is shifted by 8
    count = np.arange(int(lengths.sum()), dtype=small)
    code = count - np.repeat((first - place).astype(small), lengths)
    code <<= 8
    count += np.repeat((starts - first).astype(small), lengths)
    code |= low[count]
    if code.max(initial=0) < len(_PLACE_TABLE):
        values = _PLACE_TABLE[code]
    else:
        far = code >= len(_PLACE_TABLE)
        values = _PLACE_TABLE[np.where(far, 0, code)]
        values[far] = _at_place(code[far])
    return np.add.reduceat(values, first)


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, the same wherever it stands: mixed values of its bytes by place, summed and mixed.

    Every (place, byte) has a value of its own, so no pattern of a word's letters makes two words' sums equal."""
    n = len(starts)
    sums = np.zeros(n, _U)
    lengths = ends - starts
    stops, lo = np.cumsum(lengths), 0
    while lo < n:  # about STEP_BYTES of words at a time
        hi = max(lo + 1, int(np.searchsorted(stops, (stops[lo - 1] if lo else 0) + 2 * STEP_BYTES, "right")))
        if lengths[lo] > 2 * STEP_BYTES:  # one huge word, in parts
            for a in range(0, int(lengths[lo]), STEP_BYTES):
                sums[lo : lo + 1] += _byte_sums(low, starts[lo : lo + 1] + a, np.minimum(STEP_BYTES, lengths[lo : lo + 1] - a), a)
            lo += 1
            continue
        sums[lo:hi] = _byte_sums(low, starts[lo:hi], lengths[lo:hi])
        lo = hi
    return mix(sums + lengths.astype(_U) * _BASE)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, whichever document they lie in."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    h = np.full(n, _U(k), _U)
    for j in range(k):
        h ^= h >> _U(32)
        h *= _BASE
        h += words[j : j + n]
    return mix(h)


def replaced(df: DataFrame, *names: str) -> DataFrame:
    """df without columns of these names (in any case): the results that take their names replace them."""
    taken = {n.lower() for n in names}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in taken))


def out_batch(schema: pa.Schema, **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for f, c in ((f, cols[f.name]) for f in schema)], schema=schema)


def lowest(df: DataFrame, hashed, n: int, rows: int) -> DataFrame:
    """The n rows of df with the smallest hashes (a column, ties by df's first column); rows: about how many df has.

    Only hashes below a bound, twice as many as are taken, leave the tasks; the bound grows until enough lie below it."""
    share = 2 * n / max(1, rows)
    while share < 1:
        some = df.filter(hashed <= F.lit(int(share * 2.0**64) - (1 << 63)))
        if some.count() >= n:
            return some.orderBy(hashed, df.columns[0]).limit(n)
        share *= 16
    return df.orderBy(hashed, df.columns[0]).limit(n)


def crc32_text(col):
    """Unsigned CRC-32 of the decimal text of an integer column."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


# What a Python worker keeps over tasks: one thing at a time, so that stages don't add up in a reused worker.
_held: dict = {}


def held(token, build):
    """The worker's own `build()` of a token; whatever it held of another token is dropped."""
    if token not in _held:
        _held.clear()
        _held[token] = build()
    return _held[token]


def _trim() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps its free memory
        pass


def lean(over, keeps: bool = False):
    """A mapInArrow function that gives free memory back when its task ends and (unless it keeps a token) drops what the worker held."""

    @functools.wraps(over)
    def run(batches):
        if not keeps:
            _held.clear()
        try:
            yield from over(batches)
        finally:
            _trim()

    return run

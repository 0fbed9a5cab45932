"""Zstandard WARC archives: one frame per record, and a dictionary in a leading skippable frame.

Writing. The first row with each payload (by the smallest key) is a response record; all other rows with an equal
payload of at least `revisit_least` bytes are revisit records of the identical-payload-digest profile. Rows are numbered
and described once, without their payloads, in a written table. Only payloads of responses are shuffled, by digest, and
copies within a task are dropped before that; revisits take no payload along. Archives are written
through Spark's text writer, whose rows can be any bytes; what it puts after each row is an empty skippable frame, so
a file is a valid Zstandard stream from its first byte to its last.

Reading. A file's leading skippable frame (magic 0x184D2A5D) holds the dictionary, itself a frame or a raw
dictionary. Then each frame is decoded to one record: version line, header fields, Content-Length against the block,
record id, payload digest and length. A file that breaks a rule is an error, or (errors="skip") its record is given
with `problem` set.

Defined cases: null payloads are empty; equal keys are records of their own (the response is one of the smallest key:
that with the smallest url, and of rows equal in these the first one), so each such payload has exactly one response; records without a key are responses; null urls have no target; an empty table gives archives without records; the dictionary
is learned from a bounded sample and is left out where there is too little to learn from; other columns of the table
are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultspark.llm._common import lean, work_folder, written

#: Fixed values of the formats: skippable frames, ordinary frames and dictionaries, little-endian.
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
DICTIONARY_FRAME = 0x184D2A5D
FRAME_MAGIC, DICTIONARY_MAGIC = b"\x28\xb5\x2f\xfd", b"\x37\xa4\x30\xec"
#: An empty skippable frame: what stands after each row of the text writer.
ROW_END = "P*M\x18\x00\x00\x00\x00"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: The dictionary's size and the sample that it is learned from.
DICTIONARY_BYTES, SAMPLE_PAGES, SAMPLE_BYTES = 32_768, 300, 16_384
LEVEL = 3
#: Bytes of payloads in a file, about.
FILE_BYTES = 32 << 20
#: A payload is hot if more than one in HOT_SHARE rows has it: so there are at most HOT_SHARE hot payloads.
HOT_SHARE = 1000
#: Digests that a task remembers to drop its copies of payloads.
REMEMBERED = 1_000_000

_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


class WarcError(ValueError):
    """An archive that breaks a rule of its format."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'vaultspark:{key}')}>"


def encode_record(kind: str, key, url: str | None, payload: bytes, payload_digest: str, payload_bytes: int, refers_to=None) -> bytes:
    """One WARC/1.1 record; key and refers_to are those of rows, percent-encoded in headers, whatever their type."""
    block = payload if kind == "response" else b""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(key)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{payload_digest}",
        f"X-Payload-Length: {payload_bytes}",
        f"X-Row-Key: {quote(str(key), safe=':')}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(block)}",
    ]
    if key is None:
        head = [h for h in head if not h.startswith("X-Row-Key")]
    if url:
        clean = "".join(f"%{b:02X}" if b < 33 or b == 127 else chr(b) for b in url.encode()) if any(c < "!" or c == "\x7f" for c in url) else None
        head.append("WARC-Target-URI: " + (clean.encode("latin-1").decode("utf-8") if clean is not None else url))
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Key: {quote(str(refers_to), safe=':')}"]
    return "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"


def _unquoted(key: str | None) -> str | None:
    return None if key is None else unquote(key)


def decode_record(data: bytes) -> dict:
    """A record's fields, checked: version, required headers, lengths, digest, the end of the block."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise WarcError("a record without end of headers")
    lines = data[:end].decode("utf-8", "strict").split("\r\n")
    if lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError(f"not a WARC version: {lines[0][:40]!r}")
    head: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip(" \t"):
            raise WarcError(f"not a header field: {line[:40]!r}")
        head[name.strip(" \t").lower()] = value.strip(" \t")  # other white space is part of a value
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in head:
            raise WarcError(f"a record without {name}")
    if not head["content-length"].isdigit():
        raise WarcError("Content-Length is not a number")
    size = int(head["content-length"])
    block, tail = data[end + 4 : end + 4 + size], data[end + 4 + size :]
    if len(block) != size or tail != b"\r\n\r\n":
        raise WarcError(f"Content-Length {size} against {len(data) - end - 8} bytes")
    kind = head["warc-type"]
    said = head.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response":
        found = digest(block)
        if said and said != found:
            raise WarcError(f"payload digest {found}, not {said}")
        if int(head.get("x-payload-length", size)) != size:
            raise WarcError("payload length differs from its header")
        said = found
    elif kind == "revisit":
        if size or not said or "warc-refers-to" not in head:
            raise WarcError("a revisit record needs a digest, a reference and an empty block")
        block = None
    return {"kind": kind, "id": head["warc-record-id"], "url": head.get("warc-target-uri"), "digest": said, "length": int(head.get("x-payload-length", size)), "key": _unquoted(head.get("x-row-key")), "refers_to": _unquoted(head.get("x-refers-to-key")), "payload": block}


def dictionary_frame(dictionary: bytes) -> bytes:
    """The leading skippable frame, its dictionary compressed."""
    packed = zstandard.ZstdCompressor(level=19, write_content_size=True).compress(dictionary)
    return struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed


def read_archive(data: memoryview):
    """Yields (byte offset, record bytes or WarcError) of each frame of a file."""
    at, tool = 0, None
    while at < len(data):
        if len(data) - at < 8:
            yield at, WarcError(f"{len(data) - at} bytes after the last frame")
            return
        magic, size = struct.unpack_from("<II", data, at)
        if magic in SKIPPABLE:
            if at + 8 + size > len(data):
                yield at, WarcError("a skippable frame reaches beyond the file")
                return
            if magic == DICTIONARY_FRAME:
                if at:
                    yield at, WarcError("a dictionary that does not lead the file")
                    return
                inner = bytes(data[8 : 8 + size])
                if inner[:4] == FRAME_MAGIC:
                    inner = zstandard.ZstdDecompressor().decompress(inner, max_output_size=1 << 27)
                elif inner[:4] != DICTIONARY_MAGIC:
                    yield at, WarcError("not a dictionary")
                    return
                tool = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(inner))
            at += 8 + size
            continue
        if bytes(data[at : at + 4]) != FRAME_MAGIC:
            yield at, WarcError(f"no frame at byte {at}")
            return
        tool = tool or zstandard.ZstdDecompressor()
        one = tool.decompressobj()
        try:
            out, pos = [], at
            while not one.eof and pos < len(data):
                step = data[pos : pos + (1 << 16)]
                out.append(one.decompress(step))
                pos += len(step)
            if not one.eof:
                raise WarcError("a frame reaches beyond the file")
        except (zstandard.ZstdError, WarcError) as error:
            yield at, error if isinstance(error, WarcError) else WarcError(str(error))
            return
        start, at = at, pos - len(one.unused_data)
        yield start, b"".join(out)


def learned_dictionary(pages: DataFrame, payload: str) -> bytes:
    """A dictionary of a bounded sample: SAMPLE_PAGES payloads by hash, SAMPLE_BYTES of each."""
    # the smallest hashes first, without payloads: what tasks send to the driver stays small
    hashed = pages.filter(F.col(payload).isNotNull()).select(F.xxhash64(payload).alias("h"), F.substring(payload, 1, SAMPLE_BYTES).alias("t"))
    lowest = [r["h"] for r in hashed.select("h").distinct().orderBy("h").limit(SAMPLE_PAGES).collect()]
    if not lowest:
        return b""
    rows = hashed.filter(F.col("h") <= lowest[-1]).groupBy("h").agg(F.min("t").alias("t")).orderBy("h").collect()
    samples = list(dict.fromkeys(r["t"].encode() for r in rows if r["t"]))
    if len(samples) < 16 or sum(map(len, samples)) < 4 * DICTIONARY_BYTES:
        return b""
    return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()


def described(pages: DataFrame, *, key: str, url: str, payload: str) -> DataFrame:
    """(row, row_key, url, sha1, n) of each row, written: its number, and its payload's digest and bytes."""
    raw = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).alias("row_key"), F.col(url).alias("url"), F.unhex(F.sha1(raw)).alias("sha1"), F.length(raw).cast("long").alias("n"))
    return written(rows.withColumn("row", F.monotonically_increasing_id()), "rows")


def _distinct_in_task(batches):
    """Over (sha1, payload): rows without the copies that the task has seen already."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for sha1 in batch.column(0).to_pylist():
            keep.append(sha1 not in seen)
            if keep[-1] and len(seen) < REMEMBERED:
                seen.add(sha1)
        yield batch.filter(pa.array(keep, pa.bool_()))


def planned(pages: DataFrame, rows: DataFrame, *, payload: str, revisit_least: int, files: int) -> DataFrame:
    """Records to write: row_key, url, payload (null for revisits), sha1, n (payload bytes) and refers_to.

    rows: the table of described()."""
    told = (F.col("n") >= revisit_least) & F.col("row_key").isNotNull()
    tie = F.struct("row_key", F.coalesce("url", F.lit("")).alias("u"), "row")
    firsts = rows.filter(told).groupBy("sha1").agg(F.min(F.struct(tie.alias("tie"), "url", "n")).alias("f"), F.count(F.lit(1)).alias("m"))
    firsts = written(firsts.select("sha1", F.col("f.tie.row_key").alias("row_key"), F.col("f.url").alias("url"), F.col("f.n").alias("n"), F.col("f.tie.row").alias("row"), "m"), "firsts")

    # responses: each payload once
    raw = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    payloads = pages.select(F.unhex(F.sha1(raw)).alias("sha1"), raw.alias("payload")).mapInArrow(lean(_distinct_in_task), "sha1 binary, payload binary")
    payloads = payloads.repartition(files, "sha1").dropDuplicates(["sha1"])
    none = F.lit(None).cast(rows.schema["row_key"].dataType)
    responses = firsts.repartition(files, "sha1").join(payloads, "sha1").select("row_key", "url", "payload", "sha1", "n", none.alias("refers_to"))

    # revisits: rows of copied payloads but the first, without payloads; hot payloads are few and their rows stay where they are
    copied = firsts.filter("m > 1").select("sha1", F.col("row_key").alias("refers_to"), F.col("row").alias("first"), "m")
    least = rows.count() // HOT_SHARE
    hot = F.broadcast(copied.filter(F.col("m") > least).drop("m"))
    rest = copied.filter(F.col("m") <= least).drop("m")
    revisits = [rows.filter(told).join(side, "sha1").filter(F.col("row") != F.col("first")) for side in (hot, rest)]
    revisits = [r.select("row_key", "url", F.lit(None).cast("binary").alias("payload"), "sha1", "n", "refers_to") for r in revisits]

    # rows that are responses whatever their payload, dealt by their places
    plain = pages.select(F.col(pages.columns[0]).alias("row_key"), F.col(pages.columns[1]).alias("url"), raw.alias("payload"))
    plain = plain.withColumn("sha1", F.unhex(F.sha1("payload"))).withColumn("n", F.length("payload").cast("long")).filter(~told)
    return responses.unionByName(revisits[0]).unionByName(revisits[1]).unionByName(plain.withColumn("refers_to", none))


def _writer(dictionary: bytes, level: int):
    def over(batches):
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        tool = zstandard.ZstdCompressor(level=level, dict_data=data, write_content_size=True, write_checksum=True)
        first = True
        for batch in batches:
            out = [dictionary_frame(dictionary)] if first and dictionary else []
            first = False
            for key, url, payload, sha1, n, refers_to in zip(*(c if i == 2 else c.to_pylist() for i, c in enumerate(batch.columns))):
                kind = "response" if refers_to is None else "revisit"
                block = payload.as_buffer().to_pybytes() if kind == "response" else b""
                name = base64.b32encode(sha1).decode()
                out.append(tool.compress(encode_record(kind, key, url, block, name, n, refers_to)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    return over


def write_archives(pages: DataFrame, folder: str, *, key: str = "page_id", url: str = "url", payload: str = "html", revisit_least: int = 0, level: int = LEVEL, file_bytes: int = FILE_BYTES) -> None:
    """Writes a folder of .warc.zst content (files named part-*)."""
    pages = pages.select(key, url, payload)
    dictionary = learned_dictionary(pages, payload)
    rows = described(pages, key=key, url=url, payload=payload)
    total = rows.agg(F.sum("n").alias("n")).first()["n"] or 0
    records = planned(pages, rows, payload=payload, revisit_least=revisit_least, files=max(1, -(-total // file_bytes)))
    frames = records.mapInArrow(lean(_writer(dictionary, level)), "value binary")
    frames.select(F.expr("CAST(value AS STRING)").alias("value")).write.option("lineSep", ROW_END).text(folder)


_READ = "file string, at long, kind string, id string, url string, digest string, length long, key string, refers_to string, payload binary, problem string"


def _reader(with_payload: bool, strict: bool):
    names = ["kind", "id", "url", "digest", "length", "key", "refers_to", "payload"]
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def batch_of(rows):
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.int64(), *types, pa.string()])], ["file", "at", *names, "problem"])

    def over(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, size = [], 0
                for at, data in read_archive(memoryview(content.as_buffer())):
                    try:
                        if isinstance(data, WarcError):
                            raise data
                        found = decode_record(data)
                    except (WarcError, UnicodeDecodeError) as error:
                        if strict:
                            raise WarcError(f"{name}, byte {at}: {error}") from error
                        rows.append((name, at, *[None] * 8, str(error)))
                        continue
                    if not with_payload:
                        found["payload"] = None
                    rows.append((name, at, *(found[n] for n in names), None))
                    size += len(data)
                    if size > 8 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return over


def read_archives(spark: SparkSession, folder: str, *, with_payload: bool = True, errors: str = "raise", glob: str = "part-*") -> DataFrame:
    """One row per record of all archives of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "content")
    return files.mapInArrow(_reader(with_payload, errors == "raise"), _READ)


def archives_digest(pages: DataFrame, *, key: str = "page_id", folder: str | None = None, **options) -> DataFrame:
    """Writes the archives and reads them back: key, payload_bytes, payload_digest, record_type and refers_to."""
    folder = folder or work_folder(pages.sparkSession, "warc")
    write_archives(pages, folder, key=key, **options)
    read = read_archives(pages.sparkSession, folder, with_payload=False)
    kind = pages.schema[key].dataType
    return read.select(F.col("key").cast(kind).alias(key), F.col("length").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.col("refers_to").cast(kind).alias("refers_to"))

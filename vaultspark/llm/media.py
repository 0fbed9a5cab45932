"""Media columns: signature sniffing with Aho-Corasick, format validators, and carving of embedded media.

An Aho-Corasick automaton finds the magic bytes of all known formats, and the marks that end some of them, in one pass
over a blob. Each hit goes to its format's validator, which walks the format's own structure (chunks, segments, boxes,
sub-blocks, frames) and says how long the medium is, or that it is none. What a walk has learned about a place is kept
for the blob, so that no place is walked twice by hits of one format. `sniff` gives the medium a blob starts with, and
so corrects declared types; `carve` gives every valid medium inside, outermost first, at any depth.

Texts are stored as media, too: `store_samples` makes an 8-bit mono PCM WAV of a text's UTF-8 bytes, padded with
zeros to a positive multiple of `UNIT` bytes. The stored bytes are written as a binary column that is declared to be
text, and read back; `correct_types` finds what they are and what lies within, the outermost medium is cut out where it
was carved, and `wave_feature` computes a digest of energies of its samples.

Defined cases: null texts are empty and take one unit of zeros; null and empty blobs have no type; a blob of an
unknown type keeps its declared type, with valid false; nested media are carved with their depth; equal blobs give
equal rows; an empty table gives none; columns of the names of results are replaced, others are carried along. A FLAC
stream's last frame ends at the first byte from which its checksum agrees (within the frame sizes that its head gives).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left, bisect_right

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultspark.llm._common import lean, replaced, written

UNIT = 64
RATE = 8000

#: Magic bytes and where in the medium they stand; fixed values of the formats.
SIGNATURES = (
    ("image/png", b"\x89PNG\r\n\x1a\n", 0),
    ("image/jpeg", b"\xff\xd8\xff", 0),
    ("image/gif", b"GIF87a", 0),
    ("image/gif", b"GIF89a", 0),
    ("image/bmp", b"BM", 0),
    ("audio/wav", b"WAVE", 8),
    ("image/webp", b"WEBP", 8),
    ("audio/flac", b"fLaC", 0),
    ("application/ogg", b"OggS\x00", 0),
    ("video/mp4", b"ftyp", 4),
    ("application/pdf", b"%PDF-", 0),
    ("application/zip", b"PK\x03\x04", 0),
    ("application/gzip", b"\x1f\x8b\x08", 0),
)
#: Marks that validators look for; fixed values of the formats.
PDF_END, PDF_START, ZIP_END = b"%%EOF", b"startxref", b"PK\x05\x06"


class Blob:
    """A blob's bytes, the places of all marks and what its validators have learned."""

    def __init__(self, data: bytes, places: dict[bytes, list[int]]):
        self.data, self.places = data, places
        self.known: dict[str, dict] = {}
        self._zips: dict[int, list[int]] | None = None

    def memo(self, name: str) -> dict:
        return self.known.setdefault(name, {})

    def chain(self, name: str, p, step, fold=None):
        """Follows step(p) -> (next place, None) or (None, result), and keeps the result for every place on the way.

        fold(place, result) makes the result of a place from that of the next one."""
        memo, way, found = self.memo(name), [], None
        while p is not None and p not in memo:
            way.append(p)
            p, found = step(p)
        if p is not None:
            found = memo[p]
        for q in reversed(way):
            found = fold(q, found) if fold else found
            memo[q] = found
        return found

    def zips(self) -> dict[int, list[int]]:
        """The ends of ZIP archives by where they say that their archive starts."""
        if self._zips is None:
            self._zips, b = {}, self.data
            for end in self.places.get(ZIP_END, ()):
                if end + 22 > len(b):
                    continue
                size, start, note = struct.unpack_from("<IIH", b, end + 12)
                at = end - size - start
                if at >= 0 and (size == 0 or b[at + start : at + start + 4] == b"PK\x01\x02") and end + 22 + note <= len(b):
                    self._zips.setdefault(at, []).append(end + 22 + note)
        return self._zips


def _riff(blob: Blob, at: int, form: bytes, needed: bytes) -> int | None:
    b = blob.data
    if b[at : at + 4] != b"RIFF" or b[at + 8 : at + 12] != form:
        return None
    size = struct.unpack_from("<I", b, at + 4)[0] + 8
    if at + size > len(b) or size < 20:
        return None

    def step(p):
        """Chunks up to the needed one; the result is its end."""
        if p + 8 > len(b):
            return None, None
        n = struct.unpack_from("<I", b, p + 4)[0]
        if b[p : p + 4].startswith(needed):
            return None, p + 8 + n
        return p + 8 + n + (n & 1), None

    end = blob.chain(f"riff {form}", at + 12, step)
    return size if end and end <= at + size else None


def _wav(blob, at):
    return _riff(blob, at, b"WAVE", b"data")


def _webp(blob, at):
    return _riff(blob, at, b"WEBP", b"VP8")


def _png(blob, at):
    b = blob.data
    if b[at + 8 : at + 16] != b"\0\0\0\x0dIHDR":
        return None

    def step(p):
        if p + 12 > len(b):
            return None, None
        n, name = struct.unpack_from(">I", b, p)[0], b[p + 4 : p + 8]
        if p + 12 + n > len(b) or struct.unpack_from(">I", b, p + 8 + n)[0] != zlib.crc32(memoryview(b)[p + 4 : p + 8 + n]):
            return None, None
        return (None, p + 12 + n) if name == b"IEND" else (p + 12 + n, None)

    end = blob.chain("png", at + 8, step)
    return end - at if end else None


def _jpeg(blob, at):
    b = blob.data

    def step(state):
        p, frame = state
        while b[p : p + 2] == b"\xff\xff":
            p += 1
        if p + 2 > len(b) or b[p] != 0xFF:
            return None, None
        code = b[p + 1]
        if code == 0xD9:
            return None, p + 2 if frame else None
        n = struct.unpack_from(">H", b, p + 2)[0] if p + 4 <= len(b) else 0
        if n < 2 or p + 2 + n > len(b):
            return None, None
        frame |= 0xC0 <= code <= 0xCF and code not in (0xC4, 0xC8, 0xCC)
        p += 2 + n
        while code == 0xDA:  # what is coded: up to a mark that is none of its own
            p = b.find(b"\xff", p)
            if p < 0 or p + 1 >= len(b):
                return None, None
            if b[p + 1] and not 0xD0 <= b[p + 1] <= 0xD7:
                break
            p += 2
        return (p, frame), None

    end = blob.chain("jpeg", (at + 2, False), step)
    return end - at if end else None


def _gif(blob, at):
    b = blob.data
    if at + 13 > len(b):
        return None

    def blocks(p):
        return blob.chain("gif blocks", p, lambda q: (q + b[q] + 1, None) if q < len(b) and b[q] else (None, q + 1))

    def step(p):
        if p >= len(b):
            return None, None
        if b[p] == 0x3B:
            return None, p + 1
        if b[p] == 0x21:
            return blocks(p + 2), None
        if b[p] == 0x2C and p + 10 <= len(b):
            table = 3 << (b[p + 9] & 7) + 1 if b[p + 9] & 0x80 else 0
            return blocks(p + 10 + table + 1), None
        return None, None

    end = blob.chain("gif", at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 0x80 else 0), step)
    return end - at if end else None


def _bmp(blob, at):
    b = blob.data
    if at + 54 > len(b):
        return None
    size, _, start, header, width, height, planes, bits, packed = struct.unpack_from("<IIIIiiHHI", b, at + 2)
    if header not in (40, 52, 56, 108, 124) or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or width <= 0 or height == 0:
        return None
    row = (width * bits + 31) // 32 * 4
    if at + size > len(b) or start < 14 + header or start > size or packed == 0 and start + row * abs(height) > size:
        return None
    return size


def _crc_table(poly: int, bits: int) -> list[int]:
    out, top = [], 1 << bits - 1
    for i in range(256):
        c = i << bits - 8
        for _ in range(8):
            c = (c << 1 ^ poly if c & top else c << 1) & (1 << bits) - 1
        out.append(c)
    return out


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
#: Samples of a FLAC block by its code, and the bytes that follow the coded number for some codes; fixed values of the format.
_FLAC_BLOCKS = {1: 192, **{i: 576 << i - 2 for i in range(2, 6)}, **{i: 256 << i - 8 for i in range(8, 16)}}
_FLAC_MORE = {6: 1, 7: 2}, {12: 1, 13: 2, 14: 2}


def _flac_frame(b: bytes, p: int):
    """(coded number, samples or None for those of the stream, bytes of the header) of a frame's header, or None."""
    if p + 6 > len(b) or b[p] != 0xFF or b[p + 1] & 0xFC != 0xF8 or b[p + 2] & 15 == 15 or not b[p + 2] >> 4 or b[p + 3] & 1:
        return None
    lead = b[p + 4]
    more = 0 if lead < 0x80 else 8 - (~lead & 0xFF).bit_length() - 1
    if lead >= 0x80 and (more < 1 or more > 6):
        return None
    number = lead if not more else lead & (1 << 6 - more) - 1 if more < 6 else 0
    q = p + 5
    for _ in range(more):
        if q >= len(b) or b[q] & 0xC0 != 0x80:
            return None
        number = number << 6 | b[q] & 0x3F
        q += 1
    size, rate = (_FLAC_MORE[0].get(b[p + 2] >> 4, 0), _FLAC_MORE[1].get(b[p + 2] & 15, 0))
    samples = int.from_bytes(b[q : q + size], "big") + 1 if size else _FLAC_BLOCKS.get(b[p + 2] >> 4)
    q += size + rate
    if q >= len(b):
        return None
    crc = 0
    for x in b[p:q]:
        crc = _CRC8[crc ^ x]
    return (number, samples, q + 1 - p) if crc == b[q] else None


def _flac(blob, at):
    """Metadata blocks, then frames: each by its checked header and number, the last one by its checksum."""
    b = blob.data
    p, first = at + 4, True
    while True:
        if p + 4 > len(b):
            return None
        last, kind, n = b[p] >> 7, b[p] & 127, int.from_bytes(b[p + 1 : p + 4], "big")
        if first and (kind != 0 or n != 34) or p + 4 + n > len(b):
            return None
        if first:
            block = int.from_bytes(b[p + 6 : p + 8], "big")
            least, most = int.from_bytes(b[p + 8 : p + 11], "big"), int.from_bytes(b[p + 11 : p + 14], "big")
            total = int.from_bytes(b[p + 17 : p + 22], "big") & (1 << 36) - 1
        first = False
        p += 4 + n
        if last:
            break
    variable = p + 1 < len(b) and b[p + 1] & 1
    key = (p, block, least, most, total)
    memo = blob.memo("flac")
    if key not in memo:
        memo[key] = _flac_end(b, p, variable, block, least, most, total)
    return memo[key] - at if memo[key] else None


def _flac_end(b, p, variable, block, least, most, total):
    done = frames = 0
    while True:
        head = _flac_frame(b, p)
        if head is None or head[0] != (done if variable else frames):
            return None
        done += head[1] or block
        frames += 1
        q = None if total and done >= total else b.find(b"\xff", p + max(head[2] + 2, least))
        while q is not None and q >= 0:
            after = _flac_frame(b, q)
            if after and after[0] == (done if variable else frames):
                break
            q = b.find(b"\xff", q + 1)
        if q is None or q < 0:
            break
        p = q
    crc, stop = 0, min(len(b), p + most) if most else len(b)
    for i in range(p, stop):  # a frame with its checksum has the checksum 0
        crc = crc << 8 & 0xFFFF ^ _CRC16[crc >> 8 ^ b[i]]
        if crc == 0 and i + 1 - p >= max(least, head[2] + 3):
            return i + 1
    return None


def _ogg(blob, at):
    b = blob.data

    def step(p):
        n = b[p + 26] if p + 27 <= len(b) else 0
        size = 27 + n + sum(b[p + 27 : p + 27 + n])
        if b[p : p + 5] != b"OggS\0" or p + 27 + n > len(b) or p + size > len(b):
            return None, None
        q = p + size
        if b[p + 5] & 4 or b[q : q + 5] != b"OggS\0" or b[q + 14 : q + 18] != b[p + 14 : p + 18]:
            return None, q
        return q, None

    end = blob.chain("ogg", at, step)
    return end - at if end else None


def _mp4(blob, at):
    b = blob.data

    def box(p):
        """The place after a box, or None."""
        if p + 8 > len(b):
            return None
        n = struct.unpack_from(">I", b, p)[0]
        if n == 1 and p + 16 <= len(b):
            n = struct.unpack_from(">Q", b, p + 8)[0]
        return p + n if n >= 8 and p + n <= len(b) and b[p + 4 : p + 8].isalnum() else None

    def step(p):
        """Boxes after the first; the result is their end and whether any has content."""
        q = box(p) if b[p + 4 : p + 8] != b"ftyp" else None
        return (None, (p, False)) if q is None else (q, None)

    p = box(at)
    if p is None:
        return None
    end, has = blob.chain("mp4", p, step, lambda q, found: (found[0], found[1] or q < found[0] and b[q + 4 : q + 8] in (b"moov", b"mdat", b"moof")))
    return end - at if has else None


def _pdf(blob, at):
    ends, starts = blob.places.get(PDF_END, ()), blob.places.get(PDF_START, ())
    i = bisect_left(ends, at)
    if i == len(ends):
        return None
    j = bisect_left(starts, at)
    return ends[i] + 5 - at if j < len(starts) and starts[j] < ends[i] else None


def _zip(blob, at):
    ends = blob.zips().get(at, ())
    i = bisect_right(ends, at)
    return ends[i] - at if i < len(ends) else None


def _gzip(blob, at):
    b = memoryview(blob.data)
    tool = zlib.decompressobj(31)
    try:
        p = at
        while p < len(b) and not tool.eof:
            tool.decompress(b[p : p + 65536], 1 << 20)
            while tool.unconsumed_tail and not tool.eof:
                tool.decompress(tool.unconsumed_tail, 1 << 20)
            p += 65536
    except zlib.error:
        return None
    return min(p, len(b)) - len(tool.unused_data) - at if tool.eof else None


VALIDATORS = {
    "image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif, "image/bmp": _bmp, "audio/wav": _wav, "image/webp": _webp, "audio/flac": _flac,
    "application/ogg": _ogg, "video/mp4": _mp4, "application/pdf": _pdf, "application/zip": _zip, "application/gzip": _gzip,
}


class Sniffer:
    """The automaton of all signatures and marks, and what it finds in blobs."""

    def __init__(self):
        # The automaton works on strings: bytes are read as Latin-1, one character each.
        self.auto = ahocorasick.Automaton()
        for kind, magic, place in SIGNATURES:
            self._add(magic, (kind, len(magic), place))
        for mark in (PDF_END, PDF_START, ZIP_END):
            self._add(mark, (mark, len(mark), 0))
        self.auto.make_automaton()
        self.reach = max(len(magic) + place for _, magic, place in SIGNATURES)

    def _add(self, word: bytes, what) -> None:
        name = word.decode("latin-1")
        self.auto.add_word(name, (*self.auto.get(name, ()), what))

    def search(self, data: bytes) -> tuple[list[tuple[int, str]], Blob]:
        """(start, type) of all signatures, by place, and the blob with the places of its marks."""
        found, places = set(), {}
        for end, kinds in self.auto.iter(data.decode("latin-1")):
            for kind, n, place in kinds:
                start = end + 1 - n - place
                if isinstance(kind, bytes):
                    places.setdefault(kind, []).append(start)
                elif start >= 0:
                    found.add((start, kind))
        return sorted(found), Blob(data, places)

    def _valid(self, data: bytes):
        """(start, type, length) of every valid medium."""
        hits, blob = self.search(data)
        for start, kind in hits:
            if n := VALIDATORS[kind](blob, start):
                yield start, kind, n

    def sniff(self, data: bytes) -> tuple[str | None, int]:
        """(type, length) of the valid medium at the start, else (None, 0)."""
        if not self.search(data[: self.reach])[0]:  # a signature of the start ends there
            return None, 0
        return next(((kind, n) for start, kind, n in self._valid(data) if start == 0), (None, 0))

    def carve(self, data: bytes) -> list[tuple[str, int, int, int]]:
        """(type, start, length, depth) of every valid medium, outermost first; what a medium holds is a level deeper.

        What reaches beyond the medium in which it starts is left out."""
        out, ends = [], []
        for start, kind, n in self._valid(data):
            while ends and start >= ends[-1]:
                ends.pop()
            if ends and start + n > ends[-1]:
                continue
            out.append((kind, start, n, len(ends)))
            ends.append(start + n)
        return out


def store_samples(raw: bytes, rate: int = RATE) -> bytes:
    """An 8-bit mono PCM WAV whose samples are the bytes, padded with zeros to a positive multiple of UNIT."""
    n = max(UNIT, -(-len(raw) // UNIT) * UNIT)
    head = b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", n)
    return head + raw + bytes(n - len(raw))


def samples_of(blob: bytes) -> bytes:
    """The samples of a valid 8-bit mono PCM WAV."""
    p = 12
    while p + 8 <= len(blob):
        name, n = blob[p : p + 4], struct.unpack_from("<I", blob, p + 4)[0]
        if name == b"fmt " and struct.unpack_from("<HH", blob, p + 8) != (1, 1) or name == b"fmt " and struct.unpack_from("<H", blob, p + 22)[0] != 8:
            raise ValueError("not 8-bit mono PCM")
        if name == b"data":
            return blob[p + 8 : p + 8 + n]
        p += 8 + n + (n & 1)
    raise ValueError("a WAV without data")


def wave_feature(samples: bytes, bins: int = 8) -> str:
    """Mean absolute deviations from the middle in `bins` equal parts, as hexadecimal bytes."""
    x = np.abs(np.frombuffer(samples, np.uint8).astype(np.int16) - 128)
    cuts = np.arange(bins + 1) * len(x) // bins
    sums = np.add.reduceat(x, cuts[:-1], dtype=np.int64)
    return bytes((sums // np.diff(cuts)).astype(np.uint8)).hex()


_sniffers: list[Sniffer] = []


def _sniffer() -> Sniffer:
    if not _sniffers:
        _sniffers.append(Sniffer())
    return _sniffers[0]


_RESULTS = ("media_type", "valid", "type_corrected", "carved")
_CARVED = "array<struct<type:string,start:bigint,length:bigint,depth:int>>"


def correct_types(media: DataFrame, *, blob: str = "media", declared: str = "declared") -> DataFrame:
    """media with media_type (what the bytes say, else what was declared), valid, type_corrected and carved (type, start, length, depth)."""
    kept = replaced(media, *_RESULTS)
    item = pa.struct([("type", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("depth", pa.int32())])
    names = kept.columns

    def over(batches):
        tool = _sniffer()
        for batch in batches:
            types, valid, changed, carved = [], [], [], []
            for b, said in zip(batch.column(names.index(blob)), batch.column(names.index(declared)).to_pylist()):
                pieces = tool.carve(b.as_py() or b"")
                kind = pieces[0][0] if pieces and pieces[0][1] == 0 else None
                types.append(kind or said)
                valid.append(kind is not None)
                changed.append(kind is not None and kind != said)
                carved.append([dict(zip(("type", "start", "length", "depth"), c)) for c in pieces])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(types, pa.string()), pa.array(valid), pa.array(changed), pa.array(carved, pa.list_(item))], [*names, *_RESULTS])

    plain = kept.limit(0).withColumns({n: F.lit(None).cast(k) for n, k in zip(_RESULTS, ("string", "boolean", "boolean", _CARVED))})
    return kept.mapInArrow(lean(over), plain.schema)


def store_texts(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row_key, n_bytes, declared, media): each text as a medium in a binary column, declared to be text, written and read back.

    The column is built by the JVM: a WAV's head, the text's bytes and the padding."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    n = F.octet_length(raw).cast("long")
    size = F.greatest(F.lit(UNIT), F.ceil(n / UNIT) * UNIT).cast("int")
    rows = docs.select(F.col(key).alias("row_key"), n.alias("n_bytes"), raw.alias("raw"), size.alias("size"))

    def little(col):
        h = F.lpad(F.hex(col.cast("long")), 8, "0")
        return F.unhex(F.concat(*(F.substring(h, p, 2) for p in (7, 5, 3, 1))))

    fmt = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data"
    zeros = F.repeat(F.lit("\0"), (F.col("size") - F.col("n_bytes")).cast("int")).cast("binary")
    media = F.concat(F.lit(b"RIFF"), little(F.col("size") + 36), F.lit(fmt), little(F.col("size")), F.col("raw"), zeros)
    return written(rows.select("row_key", "n_bytes", F.lit("text/plain").alias("declared"), media.alias("media")), "media")


_FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _features(batches):
    """Over (row_key, n_bytes, media, media_type, type_corrected, start, length, embedded): features of the carved WAV's samples."""
    for batch in batches:
        out = []
        blobs, kinds, starts, sizes = (batch.column(i) for i in (2, 3, 5, 6))
        for cell, kind, start, size in zip(blobs, kinds.to_pylist(), starts.to_pylist(), sizes.to_pylist()):
            data = cell.as_py()
            if kind != "audio/wav" or start != 0 or size != len(data):
                raise ValueError(f"stored as audio/wav of {len(data)} bytes, read back as {kind} of {size} bytes from {start}")
            s = samples_of(data[start : start + size])
            out.append((len(s), hashlib.sha256(s).hexdigest(), zlib.crc32(s[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), wave_feature(s)))
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = [x.split()[0] for x in _FEATURES.split(", ")]
        keep = [batch.column(i) for i in (0, 1, 3, 4, 7)]
        yield pa.RecordBatch.from_arrays([*keep, *(pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 6, types))], ["row_key", "n_bytes", "media_type", "type_corrected", "embedded", *names])


def media_digest(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document, from the stored bytes: sizes, digests, the feature, the corrected type and how many media its samples hold."""
    found = correct_types(store_texts(docs, key=key, text=text))
    outer = F.get("carved", F.lit(0))
    rows = found.select("row_key", "n_bytes", "media", "media_type", "type_corrected", outer["start"].alias("start"), outer["length"].alias("length"), (F.size("carved") - 1).cast("long").alias("embedded"))
    kind = docs.schema[key].dataType.simpleString()
    out = f"row_key {kind}, n_bytes long, media_type string, type_corrected boolean, embedded long, {_FEATURES}"
    return rows.mapInArrow(lean(_features), out).withColumnRenamed("row_key", key)

"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text is built for each language. A text is parsed greedily against each automaton
into longest matches (phrases); the language that needs the fewest phrases, normalised by the logarithm of the size
of its labelled text, wins. Letters are lower-cased; every run of other characters is one separator.

Letters of the Latin blocks are one symbol each; letters of all other scripts are the bytes of their UTF-8 form, so
that every script is told exactly with few symbols. Each language has a table of its own over the symbols of its sample.

Labelled text is a bounded sample, and its bounds are parameters: at most `sample_texts` different texts of each
language, `sample_chars` characters of each of them, `train_symbols` altogether. All languages are learned; their tables
together have at most `table_bytes`, and their samples `sample_total` characters, so that many languages get shorter
samples each. The automata are built by each Python worker from the broadcast sample. Parsing takes whole texts, many
at a time: texts are cut into lanes of `lane` symbols, the automata move over all lanes in step, and a phrase also
ends where its lane does, in every language alike.

Defined cases: null, empty and letterless texts are `und` with score 0; ties go to the first language in
alphabetical order; no labelled text at all makes every text `und`; repeated rows get equal answers; columns of the
names of results are replaced.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from vaultspark.llm._common import crc32_text, held, lean, replaced

#: Different texts, characters of each and symbols in all that a language is learned from; characters of all samples.
SAMPLE_TEXTS = 100
SAMPLE_CHARS = 400
TRAIN_SYMBOLS = 30_000
SAMPLE_TOTAL = 64_000_000
#: Bytes of the tables of all languages.
TABLE_BYTES = 512 << 20
#: Symbols of a lane.
LANE = 256
#: Symbols: 0 padding, 1 separator, 2 a Latin letter that no sample has; then Latin letters and the bytes 128 to 255.
FIRST = 3
#: The first letter that is told by its UTF-8 bytes, and its mark.
LATIN_END, WIDE = 0x250, 0xFFFF
#: Hashes that are looked at for each one that is taken.
OVERSAMPLE = 8

UNKNOWN = "und"

def suffix_automaton(text: np.ndarray, symbols: int) -> np.ndarray:
    """Transitions (state, symbol) -> state of the suffix automaton of a symbol sequence; -1: none. State 0 is the start."""
    size = 2 * len(text) + 2
    nxt = np.full((size, symbols), -1, np.int32)
    link, length = [-1] * size, [0] * size
    rows: list[dict[int, int]] = [{}]
    last, count = 0, 1
    for c in text.tolist():
        cur = count
        count += 1
        rows.append({})
        length[cur] = length[last] + 1
        p = last
        while p != -1 and c not in rows[p]:
            rows[p][c] = cur
            p = link[p]
        if p == -1:
            link[cur] = 0
        else:
            q = rows[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = count
                count += 1
                rows.append(dict(rows[q]))
                length[twin] = length[p] + 1
                link[twin] = link[q]
                while p != -1 and rows[p].get(c) == q:
                    rows[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    for i, row in enumerate(rows):
        if row:
            nxt[i, list(row)] = list(row.values())
    return nxt[:count]


def parse_table(nxt: np.ndarray) -> np.ndarray:
    """(state, symbol) -> 2 * next state + 1 if a phrase begins with the symbol. Symbol 0 stays put.

    One more state than the automaton has, the last, is where parsing starts and where a symbol that the sample lacks
    leads: such a symbol is a phrase of its own, and whatever follows begins another."""
    fresh = len(nxt)
    begin = np.where(nxt[0] >= 0, nxt[0], fresh) * 2 + 1
    table = np.vstack([np.where(nxt >= 0, nxt * 2, begin[None, :]), begin[None, :]]).astype(np.int32)
    table[:, 0] = np.arange(fresh + 1, dtype=np.int32) * 2
    return table


class Parser:
    """The automata of all languages, each with a table of transitions."""

    def __init__(self, samples: dict[str, list[str]], train_symbols: int = TRAIN_SYMBOLS, table_bytes: int = TABLE_BYTES, lane: int = LANE):
        self.langs, self.lane = sorted(samples), lane
        joined = {k: "\n".join(v).lower() for k, v in samples.items()}
        self.codes = np.ones(0x110000, np.uint16)
        for plane in range(0, 0x33000, 0x1000):  # all letters lie below
            self.codes[plane : plane + 0x1000] = [(2 if c < LATIN_END else WIDE) if chr(c).isalpha() else 1 for c in range(plane, plane + 0x1000)]
        latin = sorted({c for t in joined.values() for c in set(t) if ord(c) < LATIN_END and c.isalpha()})
        for i, c in enumerate(latin):
            self.codes[ord(c)] = FIRST + i
        self.high = FIRST + len(latin) - 128  # what a byte from 128 on adds up to
        self.tables, self.local, self.norm = [], [], []
        for lang in self.langs:
            text = self.symbols(joined[lang])[0]
            width = FIRST + len(np.unique(text))
            text = text[: max(1, min(train_symbols, table_bytes // (8 * width * len(self.langs))))]
            seen = np.unique(text[text > 2])
            local = np.full(self.high + 256, 2, np.int32)
            local[:2] = 0, 1
            local[seen] = FIRST + np.arange(len(seen))
            table = parse_table(suffix_automaton(local[text], FIRST + len(seen)))
            self.tables.append(table)
            self.local.append(local)
            self.norm.append(np.log2(max(2, len(text))))

    def symbols(self, text: str, starts=()) -> tuple[np.ndarray, np.ndarray]:
        """Symbols with runs of separators made one (never over a start), and their places in the text."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        s = self.codes[points]
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != 1) | (s[:-1] != 1)
        keep[[i for i in starts if i < len(s)]] = True
        at = np.flatnonzero(keep)
        s = s[at]
        wide = s == WIDE
        if wide.any():  # such letters become their UTF-8 bytes
            c = points[at]
            size = np.where(wide, 2 + (c > 0x7FF) + (c > 0xFFFF), 1)
            first = np.cumsum(size) - size
            part = np.arange(int(size.sum())) - np.repeat(first, size)
            c, n, s = np.repeat(c, size), np.repeat(size, size), np.repeat(s, size)
            byte = np.where(part == 0, (0xF0F << 8 - n & 0xFF) | c >> (6 * (n - 1)).astype(np.uint32), 0x80 | c >> (6 * (n - 1 - part)).astype(np.uint32) & 0x3F)
            s = np.where(s == WIDE, byte + self.high, s)
            at = np.repeat(at, size)
        return s.astype(np.uint16), at

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases (text, language) and symbols (text) of each text; 0 symbols for texts without letters."""
        lowered = [t.lower() for t in texts]
        ends = np.cumsum([len(t) for t in lowered])
        s, at = self.symbols("".join(lowered), [0, *ends.tolist()])
        owner_ends = np.searchsorted(at, ends)
        counts = np.diff(owner_ends, prepend=0)
        lanes = -(-counts // self.lane)
        total = int(lanes.sum())
        if total == 0:
            return np.zeros((len(texts), len(self.langs)), np.int64), np.zeros(len(texts), np.int64)
        first = np.cumsum(lanes) - lanes
        begin = owner_ends - counts
        flat = np.zeros(total * self.lane, np.uint16)
        flat[np.arange(len(s)) + np.repeat(first * self.lane - begin, counts)] = s
        steps = np.ascontiguousarray(flat.reshape(total, self.lane).T)
        letters = np.add.reduceat(np.append((s > 1).astype(np.int64), 0), np.minimum(begin, len(s)))
        letters[counts == 0] = 0
        found = np.empty((len(texts), len(self.langs)), np.int64)
        for j, (table, local) in enumerate(zip(self.tables, self.local)):
            width, flat_table = table.shape[1], table.reshape(-1)
            state = np.full(total, 2 * (len(table) - 1), np.int32)
            n = np.zeros(total, np.int32)
            for step in steps:
                state = flat_table[(state >> 1) * width + local[step]]
                n += state & 1
            sums = np.add.reduceat(np.append(n, 0), first)
            sums[lanes == 0] = 0
            found[:, j] = sums
        return found, np.where(letters > 0, counts, 0)

    def predict(self, texts: list[str]):
        found, sizes = self.phrases(texts)
        langs, scores = [], []
        bits = found * np.array(self.norm)[None, :] if self.langs else found
        for i in range(len(texts)):
            if sizes[i] == 0 or not self.langs:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            j = int(np.argmin(bits[i]))
            # how many standard deviations of phrase counts the next language is behind, as a probability
            rest = np.delete(bits[i], j)
            n1, n2 = bits[i][j] / self.norm[j], (float(rest.min()) if len(rest) else np.inf) / self.norm[j]
            z = min(20.0, (n2 - n1) / np.sqrt(n1 + n2)) if np.isfinite(n2) else 20.0
            langs.append(self.langs[j])
            scores.append(float(1 / (1 + np.exp(-1.7 * z))))
        return langs, scores, found.tolist()


def labelled_sample(docs: DataFrame, *, text: str = "text", lang: str = "lang", sample_texts: int = SAMPLE_TEXTS, sample_chars: int = SAMPLE_CHARS, sample_total: int = SAMPLE_TOTAL) -> dict[str, list[str]]:
    """Labelled texts by language: of each language those with the smallest hashes, each text once.

    Only hashes below a bound of their language leave the tasks: about OVERSAMPLE for each text that is taken. A bound
    grows until enough different texts lie below it. A row for each language and the sample's own windows come to the driver."""
    has = docs.filter(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("lang"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    rows = {r["lang"]: r["n"] for r in has.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not rows:
        return {}
    spark, each = docs.sparkSession, max(1, min(sample_texts, sample_total // (len(rows) * sample_chars)))
    share = {k: min(1.0, OVERSAMPLE * each / n) for k, n in rows.items()}
    last: dict[str, int] = {}
    while todo := [k for k in rows if k not in last]:
        bounds = spark.createDataFrame([(k, min((1 << 63) - 1, int(share[k] * 2.0**64) - (1 << 63))) for k in todo], "lang string, bound long")
        below = has.select("lang", "h").join(F.broadcast(bounds), "lang").filter(F.col("h") <= F.col("bound")).select("lang", "h").distinct()
        hashes: dict[str, list[int]] = {k: [] for k in todo}
        for r in below.collect():
            hashes[r["lang"]].append(r["h"])
        for k, found in hashes.items():
            if len(found) >= each or share[k] >= 1:
                last[k] = sorted(found)[:each][-1]
            share[k] = min(1.0, 16 * share[k])
    # a window of each text, at a place that depends on its hash: the bound on the characters of a labelled row
    at = F.pmod(F.col("h"), F.greatest(F.length("t") - sample_chars, F.lit(1))).cast("int") + 1
    few = has.join(F.broadcast(spark.createDataFrame(list(last.items()), "lang string, last long")), "lang").filter(F.col("h") <= F.col("last"))
    few = few.groupBy("lang", "h").agg(F.min(F.substring(F.col("t"), at, F.lit(sample_chars))).alias("t"))
    out: dict[str, list[str]] = {}
    for row in few.orderBy("lang", "h").collect():
        out.setdefault(row["lang"], []).append(row["t"])
    return out


def identify(docs: DataFrame, samples: dict[str, list[str]], *, text: str = "text", train_symbols: int = TRAIN_SYMBOLS, table_bytes: int = TABLE_BYTES, lane: int = LANE) -> DataFrame:
    """docs with lang_pred, score and phrases (by language, in alphabetical order)."""
    docs = replaced(docs, "lang_pred", "score", "phrases")
    shared = docs.sparkSession.sparkContext.broadcast(samples)
    token = hashlib.sha256(json.dumps([samples, train_symbols, table_bytes, lane], sort_keys=True).encode()).hexdigest()
    names = docs.columns

    def over(batches):
        parser = held(("langid", token), lambda: Parser(shared.value, train_symbols, table_bytes, lane))
        for batch in batches:
            texts = batch.column(names.index(text)).to_pylist()
            langs, scores, found, lo = [], [], [], 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") <= 1_500_000):
                    size += len(texts[hi] or "")
                    hi += 1
                a, b, c = parser.predict([t or "" for t in texts[lo:hi]])
                langs += a
                scores += b
                found += c
                lo = hi
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(found, pa.list_(pa.int64()))], [*names, "lang_pred", "score", "phrases"])

    more = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("phrases", ArrayType(LongType()))]
    return docs.mapInArrow(lean(over, True), StructType([*docs.schema.fields, *more]))


def held_out(key: str = "doc_id"):
    """Documents that nothing is learned from: a third, by the CRC-32 of the key as text."""
    return F.pmod(crc32_text(key), F.lit(3)) == 1


def identify_digest(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The key, held_out, lang_pred and score of each row, learned from the rows that aren't held out."""
    samples = labelled_sample(docs.filter(~held_out(key)), text=text, lang=lang)
    return identify(docs.select(key, text), samples, text=text).select(key, held_out(key).alias("held_out"), "lang_pred", "score")

"""Text functions that SQL lacks, as Arrow-batched UDFs, and their plain Python forms."""

from __future__ import annotations

import hashlib
import html
import math
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

#: Sizes of chunks: what small blocks are merged up to, and where long ones are cut; fixed values.
MERGE_CHARS, SPLIT_CHARS = 900, 1400
HASH_DIM = 384


def identity(value: str | None) -> str:
    """NFC, case-folded, white space collapsed."""
    return " ".join(unicodedata.normalize("NFC", value or "").casefold().split())


@F.pandas_udf(StringType())
def normalize_identity(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else identity(v))


def fold(value: str | None) -> str:
    """ASCII letters, digits and single hyphens; accents dropped."""
    plain = unicodedata.normalize("NFKD", value or "").encode("ascii", "ignore").decode().lower()
    return re.sub(r"[^a-z0-9]+", "-", plain).strip("-")


@F.pandas_udf(StringType())
def slug(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else fold(v))


def _fenced(text: str) -> tuple[list[str], str] | None:
    """Lines between a first line `---` and the next such line, and what follows; None without both."""
    lines = text.splitlines(keepends=True)
    fences = [i for i, line in enumerate(lines) if line.rstrip() == "---"][:2]
    if len(fences) < 2 or fences[0] != 0:
        return None
    return [line.rstrip("\r\n") for line in lines[1 : fences[1]]], "".join(lines[fences[1] + 1 :])


#: An entry of an inline list: quoted (it may hold commas) or bare.
_ENTRY = re.compile(r"""\s*("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^,]*?)\s*(?:,|$)""")


def _bare(value: str) -> str:
    """A value without its quotes, or without a comment that a space and a number sign begin."""
    value = value.strip()
    if value[:1] == '"' and value[-1:] == '"' and len(value) > 1:
        return re.sub(r"\\(.)", r"\1", value[1:-1])
    if value[:1] == "'" and value[-1:] == "'" and len(value) > 1:
        return value[1:-1].replace("''", "'")
    return re.split(r"\s#", value, maxsplit=1)[0].rstrip().strip("\"'")


def _inline(value: str) -> list[str]:
    """The entries of a list in brackets; commas within quotes divide nothing."""
    return [x for x in (_bare(m[1]) for m in _ENTRY.finditer(value[1:-1])) if x]


_FIELD, _ITEM = re.compile(r"([^\s:#-][^:]*):\s*(.*)"), re.compile(r"\s*-\s+(.*)")


def split_front_matter(text: str) -> tuple[dict, str]:
    """Front matter as a flat dict (texts, and lists in either form), and the rest. Fields without a value are left out."""
    found = _fenced(text)
    if found is None:
        return {}, text
    fields: list[tuple[str, str, list[str]]] = []  # name, what stands beside it, items below
    for line in found[0]:
        if m := _FIELD.fullmatch(line):
            fields.append((m[1].strip(), m[2].strip(), []))
        elif fields and (m := _ITEM.fullmatch(line)):
            fields[-1][2].append(_bare(m[1]))
    meta = {}
    for name, beside, items in fields:
        if beside[:1] + beside[-1:] == "[]":
            meta[name] = _inline(beside)
        elif value := _bare(beside) if beside else items:
            meta[name] = value
    return meta, found[1].lstrip("\n")


def set_keys(text: str, updates: dict[str, str]) -> str:
    """The text with keys of its front matter replaced or added; without front matter, unchanged."""
    found = _fenced(text)
    if found is None:
        return text
    names = [m[1].strip() if (m := _FIELD.fullmatch(line)) else None for line in found[0]]
    head = [f"{n}: {updates[n]}" if n in updates else line for n, line in zip(names, found[0])]
    head += [f"{k}: {v}" for k, v in updates.items() if k not in names]
    return "\n".join(["---", *head, "---", found[1]])


def chunks(body: str, merge: int = MERGE_CHARS, split: int = SPLIT_CHARS) -> list[dict]:
    """Blocks under their headings, small ones merged and long ones cut between words."""
    blocks, heading = [], ""
    for part in re.split(r"\n\s*\n|(?m:^(?=#{1,6} ))", body or ""):
        part = part.strip()
        if not part:
            continue
        first, _, rest = part.partition("\n")
        if m := re.match(r"#{1,6} +(.*)", first):
            heading, part = m[1].strip(), rest.strip()
            if not part:
                continue
        blocks.append((heading, part))
    out: list[dict] = []
    for head, part in blocks:
        while len(part) > split:
            at = part.rfind(" ", 1, split)
            at = at if at > 0 else split
            out.append({"heading": head, "text": part[:at].strip()})
            part = part[at:].strip()
        if out and out[-1]["heading"] == head and len(out[-1]["text"]) + len(part) + 2 <= merge:
            out[-1]["text"] += "\n\n" + part
        elif part:
            out.append({"heading": head, "text": part})
    return [{"ordinal": i, **c} for i, c in enumerate(out)]


@F.pandas_udf(ArrayType(StructType([StructField("ordinal", IntegerType()), StructField("heading", StringType()), StructField("text", StringType())])))
def chunk_text(s: pd.Series) -> pd.Series:
    return s.map(lambda v: chunks(v or ""))


def hash_vector(text: str, dim: int = HASH_DIM) -> np.ndarray:
    """Signed feature hashing of words by SHA-256, of unit length."""
    v = np.zeros(dim)
    for w in re.findall(r"\w+", (text or "").lower()):
        h = hashlib.sha256(w.encode()).digest()
        v[int.from_bytes(h[:4], "big") % dim] += 1 if h[4] & 1 else -1
    n = math.sqrt(float(v @ v))
    return v / n if n else v


@F.pandas_udf(ArrayType(DoubleType()))
def hash_embedding(s: pd.Series) -> pd.Series:
    return s.map(lambda t: hash_vector(t).tolist())


#: What of a page isn't text, and the elements that stand on lines of their own.
_UNSEEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript)\b.*?(?:</\1\s*>|\Z)", re.I | re.S)
_BLOCK = re.compile(r"</?(?:p|br|div|li|ul|ol|tr|table|section|article|header|footer|nav|h[1-6]|title|head|body)\b[^>]*>", re.I)
_TAG = re.compile(r"</?[a-z][^>]*>|<[!?][^>]*>", re.I)


def html_to_text(raw: str | None) -> dict:
    """Title and visible text of a page: what isn't seen goes, blocks become lines, other tags go, entities are resolved."""
    around = re.split(r"(?i)</?title\b[^>]*>", raw or "", maxsplit=2)
    text = html.unescape(_TAG.sub("", _BLOCK.sub("\n", _UNSEEN.sub("", raw or ""))))
    lines = [" ".join(line.split()) for line in text.split("\n")]
    body = re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()
    return {"title": html.unescape(around[1]).strip() if len(around) == 3 else "", "body": body}


@F.pandas_udf(StructType([StructField("title", StringType()), StructField("body", StringType())]))
def extract_html(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([html_to_text(v) for v in s], columns=["title", "body"])


def decoded(raw: bytes) -> str:
    """UTF-8, with or without a mark, else Latin-1."""
    for name in ("utf-8-sig", "utf-8"):
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    return raw.decode("latin-1")


def markdown_table(rows: list[list]) -> str:
    """A Markdown table under the first row that isn't blank. Where rows are of several widths, the header is blank or
    nothing follows it, a fenced block of the cells; nothing for blank rows alone."""
    cells = [["" if c is None else " ".join(str(c).split()).replace("|", "\\|") for c in r] for r in rows]
    cells = [r for r in cells if any(r)]
    lines = [" | ".join(r) for r in cells]
    if not lines:
        return ""
    if len(cells) == 1 or len({len(r) for r in cells}) > 1:
        return "\n".join(["```table-unparsed", *lines, "```"])
    lines.insert(1, " | ".join(["---"] * len(cells[0])))
    return "\n".join(f"| {line} |" for line in lines)

"""Files as rows: a handler for each extension, run on executors over the binaryFile source.

Handlers take bytes and give (title, body, meta) or raise Quarantine with a reason. Office files are read from their
XML with the standard library; formats that need libraries which aren't there are quarantined, not dropped.
"""

from __future__ import annotations

import csv
import io
import json
import re
import xml.etree.ElementTree as ET
import stat
import zipfile
import zlib
from email import policy
from email.parser import BytesParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultspark.functions.text import decoded, html_to_text, markdown_table, split_front_matter

#: Limits of archives: members, bytes of one, bytes of all, and how deep archives nest.
MAX_MEMBERS, MAX_MEMBER_BYTES, MAX_TOTAL_BYTES, MAX_DEPTH = 500, 200 << 20, 500 << 20, 3
#: Characters that must be left of a text without its headings and fences.
LEAST_CHARS = 40

OUT = "path string, member string, handler string, title string, body string, meta string, sha256 string, status string, reason string"
_COLS = [c.split()[0] for c in OUT.split(", ")]


class Quarantine(Exception):
    """A file that can't become a note, and why."""


def dense_enough(body: str) -> bool:
    return len(re.sub(r"(?ms)^#+ .*?$|```.*?```", "", body).strip()) >= LEAST_CHARS


def _text(raw: bytes):
    return "", decoded(raw), {}


def _csv(raw: bytes):
    return "", markdown_table(list(csv.reader(io.StringIO(decoded(raw))))), {}


def _html(raw: bytes):
    found = html_to_text(decoded(raw))
    return found["title"], found["body"], {}


def _email(raw: bytes):
    m = BytesParser(policy=policy.default).parsebytes(raw)
    part = m.get_body(preferencelist=("plain", "html"))
    body = part.get_content() if part is not None else ""
    if part is not None and part.get_content_subtype() == "html":
        body = html_to_text(body)["body"]
    refs = str(m.get("References", "")).split()
    own = str(m.get("Message-ID", "")).strip()
    meta = {"from": str(m.get("From", "")), "sent": str(m.get("Date", "")), "conversation_id": refs[0] if refs else str(m.get("In-Reply-To", "") or own).strip(), "attachments": [a.get_filename() for a in m.iter_attachments()]}
    return str(m.get("Subject", "")), body.strip(), meta


def _xml_texts(raw: bytes, name: str, paragraph: str, run: str) -> list[str]:
    root = ET.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read(name))
    return ["".join(t.text or "" for t in p.iter(run)) for p in root.iter(paragraph)]


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _docx(raw: bytes):
    return "", "\n\n".join(t for t in _xml_texts(raw, "word/document.xml", _W + "p", _W + "t") if t.strip()), {}


def _numbered(names, pattern):
    found = [(re.fullmatch(pattern, n), n) for n in names]
    return [n for _, n in sorted((int(m[1]), n) for m, n in found if m)]


def _pptx(raw: bytes):
    names = _numbered(zipfile.ZipFile(io.BytesIO(raw)).namelist(), r"ppt/slides/slide(\d+)\.xml")
    return "", "\n\n".join(f"## Slide {i}\n\n" + "\n".join(t for t in _xml_texts(raw, n, _A + "p", _A + "t") if t.strip()) for i, n in enumerate(names, 1)), {"slides": len(names)}


def _xlsx(raw: bytes):
    z = zipfile.ZipFile(io.BytesIO(raw))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter(_S + "t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(_S + "si")]
    out = []
    for n in _numbered(z.namelist(), r"xl/worksheets/sheet(\d+)\.xml"):
        rows = []
        for row in ET.fromstring(z.read(n)).iter(_S + "row"):
            cells = []
            for c in row.iter(_S + "c"):
                v, inline = c.find(_S + "v"), c.find(f"{_S}is")
                text = "" if v is None else v.text or ""
                cells.append(shared[int(text)] if c.get("t") == "s" and text else "".join(t.text or "" for t in inline.iter(_S + "t")) if inline is not None else text)
            rows.append(cells)
        out.append(markdown_table(rows))
    return "", "\n\n".join(out), {"sheets": len(out)}


def _missing(what: str):
    def handler(raw: bytes):
        raise Quarantine(f"no {what} reader is installed")

    return handler


HANDLERS = {
    **dict.fromkeys(("txt", "md", "markdown", "log"), ("text", _text)),
    "csv": ("text", _csv),
    **dict.fromkeys(("html", "htm"), ("html", _html)),
    "eml": ("email", _email),
    "docx": ("docx", _docx),
    "pptx": ("pptx", _pptx),
    "xlsx": ("xlsx", _xlsx),
    "pdf": ("pdf", _missing("PDF")),
    **dict.fromkeys(("png", "jpg", "jpeg", "gif", "tif", "tiff", "webp"), ("image", _missing("image text"))),
}


def expand(path: str, raw: bytes, depth: int = 0):
    """Yields (member, bytes or Quarantine): the file itself, or the members of an archive, nested ones too."""
    if not path.lower().endswith(".zip"):
        yield path, raw
        return
    if depth >= MAX_DEPTH:
        yield path, Quarantine("archives nest too deep")
        return
    try:
        z = zipfile.ZipFile(io.BytesIO(raw))
        infos = [i for i in z.infolist() if not i.is_dir()]
    except zipfile.BadZipFile:
        yield path, Quarantine("not a ZIP archive")
        return
    if len(infos) > MAX_MEMBERS or sum(i.file_size for i in infos) > MAX_TOTAL_BYTES:
        yield path, Quarantine("the archive is too large")
        return
    left = MAX_TOTAL_BYTES
    for i in infos:
        name = f"{path}!{i.filename}"
        if fault := _unsafe(i):
            yield name, Quarantine(fault)
            continue
        try:
            data = _unpacked(z, i, min(MAX_MEMBER_BYTES, left))
        except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError) as error:
            yield name, Quarantine(str(error))
            continue
        if data is None:
            yield name, Quarantine("the member is too large")
            continue
        left -= len(data)
        yield from expand(name, data, depth + 1)


def _unsafe(member: zipfile.ZipInfo) -> str | None:
    """What is wrong with a member's name or kind: it must be a plain file below the archive."""
    parts = member.filename.replace("\\", "/").split("/")
    if not member.filename.strip():
        return "the member has no name"
    if not parts[0] or ".." in parts or re.fullmatch("[A-Za-z]:.*", parts[0]):
        return "the member's path leaves the archive"
    kind = stat.S_IFMT(member.external_attr >> 16) if member.create_system == 3 else 0
    return "the member is not a plain file" if kind not in (0, stat.S_IFREG) else None


def _unpacked(z: zipfile.ZipFile, member: zipfile.ZipInfo, most: int) -> bytes | None:
    """A member's bytes, unpacked in steps; None beyond `most`, whatever size it declares."""
    out = bytearray()
    with z.open(member) as f:
        while step := f.read(min(1 << 20, most + 1 - len(out))):
            out += step
            if len(out) > most:
                return None
    return bytes(out)


def rows_of(path: str, raw: bytes, handlers: dict | None = None):
    """The rows of one file: one for each member, processed or quarantined. handlers: name and function by extension."""
    import hashlib

    handlers = HANDLERS if handlers is None else handlers

    for member, data in expand(path, raw):
        ext = member.rsplit(".", 1)[-1].lower() if "." in member else ""
        name, handler = handlers.get(ext, ("", None))
        row = dict.fromkeys(_COLS) | {"path": path, "member": member, "handler": name, "status": "quarantined"}
        try:
            if isinstance(data, Quarantine):
                raise data
            row["sha256"] = hashlib.sha256(data).hexdigest()
            if handler is None:
                raise Quarantine(f"no handler for .{ext}")
            title, body, meta = handler(data)
            if not dense_enough(body):
                raise Quarantine("too little text")
            row |= {"title": title, "body": body, "meta": json.dumps(meta, sort_keys=True), "status": "processed"}
        except Quarantine as q:
            row["reason"] = str(q)
        except Exception as error:  # one broken file must not end the others
            row["reason"] = f"{type(error).__name__}: {error}"
        yield row


def ingest(spark: SparkSession, folder: str, known: DataFrame | None = None) -> DataFrame:
    """One row per file or archive member of a folder. known (column sha256) marks content that came before as duplicate."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")

    def over(batches):
        for pdf in batches:
            for path, raw in zip(pdf["path"], pdf["content"]):
                yield pd.DataFrame(list(rows_of(path, bytes(raw))), columns=_COLS)

    rows = files.mapInPandas(over, OUT)
    if known is not None:
        seen = known.select("sha256").distinct().withColumn("seen", F.lit(True))
        rows = rows.join(seen, "sha256", "left").withColumn("status", F.when(F.col("seen") & (F.col("status") == "processed"), "duplicate").otherwise(F.col("status"))).drop("seen").select(_COLS)
    return rows


def _aliases(meta: dict, zone: str) -> list[str]:
    """Other names of a note: a list in the front matter of a note of the brain; what isn't a list names nothing."""
    found = meta.get("aliases") if zone == "brain" else None
    return [a for a in found if a.strip()] if isinstance(found, list) else []


NOTE = "id string, title string, type string, classification string, zone string, path string, created string, updated string, meta map<string,string>, body string, sha256 string, content_hash string, aliases array<string>"


def vault_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Notes of a folder of Markdown files; files without front matter and generated ones are left out."""
    texts = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(folder, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    root = folder.rstrip("/").removeprefix("file://")
    rel = F.regexp_replace("path", "^.*?" + re.escape(root) + "/", "")
    taken = texts.withColumn("path", rel).filter(~F.col("path").rlike(r"(^|/)\.|^inbox/|^overlay/|^raw/originals/|(^|/)backlinks\.md$"))

    def over(batches):
        import hashlib

        names = [f.split(" ", 1)[0] for f in NOTE.split(", ")]
        for pdf in batches:
            rows = []
            for text, path in zip(pdf["value"], pdf["path"]):
                meta, body = split_front_matter(text)
                if not meta:
                    continue
                zone = path.split("/", 1)[0]
                flat = {k: ", ".join(v) if isinstance(v, list) else str(v) for k, v in meta.items()}
                stem = path.rsplit("/", 1)[-1][:-3]
                rows.append((flat.get("id") or stem, flat.get("title", ""), flat.get("type") or ("source" if zone == "raw" else "note"), flat.get("classification"), zone, path, flat.get("created", ""), flat.get("updated", ""), flat, body, hashlib.sha256(body.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), _aliases(meta, zone)))
            yield pd.DataFrame(rows, columns=names)

    return taken.mapInPandas(over, NOTE)


def read_ledger(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines; broken ones are dropped, or (strict) end the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)

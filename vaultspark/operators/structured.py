"""Structured reads over notes: filters, point-in-time views, line search, classification and lint.

A notes DataFrame has the columns id, title, type, classification, zone, path, created, updated, document_date,
effective_date, superseded_date, is_latest_version, superseded_by and body; dates are ISO texts and compare as such.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Classifications from the most open to the most closed; missing and unknown ones count as the last.
TIERS = ("Public", "Internal", "Confidential", "Restricted", "MNPI")
#: Columns that filters and orders may name.
FILTERS = ("id", "type", "zone", "classification", "title", "path", "created", "updated")
MAX_PATTERN = 200
#: Short words of questions (English and Portuguese) that a search over lines leaves out; fixed values.
STOP = (
    "the", "a", "an", "of", "to", "is", "are", "was", "were", "what", "which", "who", "and", "or", "for", "on", "in", "about",
    "que", "qual", "quais", "foi", "sobre", "ele", "ela", "com", "para", "uma", "dos", "das", "no", "na", "em", "se", "de", "do", "da",
)


def tier_rank(c: str | Column) -> Column:
    c = F.trim(F.col(c) if isinstance(c, str) else c)
    out = F.lit(len(TIERS) - 1)
    for i, t in reversed(list(enumerate(TIERS))):
        out = F.when(c == t, i).otherwise(out)
    return out


def canonical_tier(c: str) -> Column:
    """The right spelling of a known tier in the wrong case; null for right ones and unknown ones."""
    text = F.trim(F.col(c))
    out = F.lit(None).cast("string")
    for t in TIERS:
        out = F.when((F.lower(text) == t.lower()) & (text != t), t).otherwise(out)
    return out


def clamp(asked: str | None, ceiling: str) -> str:
    """The more open of two tiers by rank; a tier that isn't known gives the most open one."""
    if asked not in TIERS or ceiling not in TIERS:
        return TIERS[0]
    return TIERS[min(TIERS.index(asked), TIERS.index(ceiling))]


def valid_date() -> Column:
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    return F.coalesce(blank("effective_date"), blank("document_date"), F.col("created"))


def is_live() -> Column:
    return ~F.col("is_latest_version").eqNullSafe("false")


def valid_at(date: str) -> Column:
    gone = F.coalesce("superseded_date", F.lit(""))
    return (valid_date() <= date) & ((gone == "") | (gone > date))


def bases_query(notes: DataFrame, filters: dict | None = None, *, k: int = 50, order_by: str = "updated", latest_only: bool = False, as_of: str | None = None) -> DataFrame:
    """Exact filters over allowed columns (others are ignored), newest first, cut at k."""
    out = notes
    for name, value in (filters or {}).items():
        if name in FILTERS:
            out = out.filter(F.col(name) == value)
    if latest_only:
        out = out.filter(is_live())
    if as_of:
        out = out.filter(valid_at(as_of))
    order = order_by if order_by in FILTERS else "updated"
    return out.orderBy(F.col(order).desc(), F.col("id").asc()).limit(k) if k > 0 else out.limit(0)


def get(notes: DataFrame, note_id: str) -> DataFrame:
    return notes.filter(F.col("id") == note_id)


def recent(notes: DataFrame, limit: int = 20) -> DataFrame:
    return notes.orderBy(F.col("updated").desc(), F.col("id").asc()).limit(limit)


def terms_of(pattern: str) -> list[str]:
    return [t for t in dict.fromkeys(re.split(r"\W+", pattern.lower())) if len(t) > 2 and t not in STOP]


def grep(notes: DataFrame, pattern: str, *, k: int = 20, ignore_case: bool = True, regex: bool = False) -> DataFrame:
    """(id, match_count, terms_matched, first_line): matching lines of a pattern, a literal, or any word of a question."""
    if len(pattern) > MAX_PATTERN:
        raise ValueError(f"a pattern has at most {MAX_PATTERN} characters")
    words = [] if regex else terms_of(pattern)
    many = not regex and len(pattern.split()) > 1 and bool(words)
    patterns = [pattern] if regex else [re.escape(w) for w in words] if many else [re.escape(pattern)]
    flag = "(?i)" if ignore_case or many else ""
    lines = notes.select("id", F.posexplode(F.split("body", "\n")).alias("n", "line"))
    hits = [F.col("line").rlike(flag + p) for p in patterns]
    any_hit = hits[0]
    for h in hits[1:]:
        any_hit = any_hit | h
    found = lines.filter(any_hit).groupBy("id").agg(F.count(F.lit(1)).alias("match_count"), *[F.max(h.cast("int")).alias(f"t{i}") for i, h in enumerate(hits)], F.min_by("line", "n").alias("first_line"))
    total = sum((F.col(f"t{i}") for i in range(len(hits))), F.lit(0)).cast("long")
    return found.select("id", "match_count", total.alias("terms_matched"), "first_line").orderBy(F.desc("terms_matched"), F.desc("match_count"), "id").limit(k)


def freshness(notes: DataFrame, newest_hit: str, max_tier: str) -> DataFrame:
    """How many visible notes are newer than a hit's date, and the newest of all."""
    d = valid_date()
    return notes.filter((tier_rank("classification") <= TIERS.index(max_tier)) & d.rlike(r"^\d{4}-\d{2}-\d{2}$") & (d > newest_hit)).agg(F.count(F.lit(1)).alias("newer"), F.max(d).alias("newest"))


def unclassified(notes: DataFrame, k: int = 50) -> DataFrame:
    return notes.filter(F.col("classification").isNull() | ~F.trim("classification").isin(*TIERS)).orderBy("id").limit(k)


def egress(rows: DataFrame, max_tier: str) -> tuple[DataFrame, DataFrame]:
    """(what a cap lets through, a row of counts). It comes after any cut at k: a capped caller may get fewer rows."""
    cap = TIERS.index(max_tier) if max_tier in TIERS else 0
    rank = tier_rank("classification")
    unlabelled = F.col("classification").isNull() | ~F.trim("classification").isin(*TIERS)
    report = rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(rank <= cap).alias("surfaced"), F.count_if(rank > cap).alias("withheld"), F.count_if((rank > cap) & unlabelled).alias("withheld_unlabelled"), F.count_if(canonical_tier("classification").isNotNull()).alias("wrong_case"))
    return rows.filter(rank <= cap), report


def snippet(c: str, n: int = 160) -> Column:
    flat = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n), F.lit("…"))).otherwise(flat)


def supersession_chain(notes: DataFrame, ids: DataFrame, hops: int = 8) -> DataFrame:
    """(start_id, at_id, hop): successors of ids (column id) over at most `hops` links; cycles end at what was seen."""
    links = notes.filter(F.col("superseded_by").isNotNull()).select(F.col("id").alias("from_id"), F.col("superseded_by").alias("to_id"))
    at = ids.select(F.col("id").alias("start_id"), F.col("id").alias("at_id"), F.array("id").alias("seen"))
    out = None
    for hop in range(1, hops + 1):
        at = at.join(links, at.at_id == links.from_id).filter(~F.array_contains("seen", F.col("to_id"))).select("start_id", F.col("to_id").alias("at_id"), F.concat("seen", F.array("to_id")).alias("seen"))
        row = at.select("start_id", "at_id", F.lit(hop).alias("hop"))
        out = row if out is None else out.unionByName(row)
    return out


def chain_heads(notes: DataFrame, ids: DataFrame, hops: int = 8) -> DataFrame:
    return supersession_chain(notes, ids, hops).groupBy("start_id").agg(F.max_by("at_id", "hop").alias("head_id"), F.max("hop").alias("hops"))


def link_targets(body: str | Column) -> Column:
    """Targets of [[links]] in a text, each once, in order; headings and names are cut off."""
    text = F.col(body) if isinstance(body, str) else body
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[\[([^\]\n|#]+)[^\]\n]*\]\]"), F.lit(1)), lambda x: F.trim(x)))


def link_graph(notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges src, dst; unresolved src, target): ids first, then lower-cased ids, stems and titles, then unique normal names."""
    wanted = notes.select(F.col("id").alias("src"), F.explode(link_targets("body")).alias("target"))
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))
    exact = notes.select(F.col("id").alias("target"), F.col("id").alias("by_id"))
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.md)?$", 1)
    names = notes.select("id", F.explode(F.array(F.lower("id"), F.lower(stem), F.lower("title"))).alias("name")).filter("name <> ''").groupBy("name").agg(F.min("id").alias("by_name"))
    loose = notes.select("id", norm(F.col("title")).alias("key")).filter("key <> ''").groupBy("key").agg(F.min("id").alias("by_key"), F.countDistinct("id").alias("owners")).filter("owners = 1").drop("owners")
    found = wanted.join(exact, "target", "left").join(names, F.lower("target") == F.col("name"), "left").join(loose, norm(F.col("target")) == F.col("key"), "left")
    resolved = found.select("src", "target", F.coalesce("by_id", "by_name", "by_key").alias("dst"))
    return resolved.filter(F.col("dst").isNotNull() & (F.col("dst") != F.col("src"))).select("src", "dst").distinct(), resolved.filter("dst IS NULL").select("src", "target").distinct()


def name_of(text: Column) -> Column:
    """A title, an alias or a question as a name: lower case, single spaces."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def has_alias(name: str, notes: DataFrame) -> Column:
    """Whether a note of the brain has a name among its aliases (a column of arrays; without it none has)."""
    if "aliases" not in notes.columns:
        return F.lit(False)
    return F.coalesce((F.col("zone") == "brain") & F.exists("aliases", lambda a: name_of(a) == name), F.lit(False))


def name_owners(notes: DataFrame, *, most: int = 16) -> DataFrame:
    """(name, id, by_alias, owners, place): who owns each name by title or alias, an alias being the stronger claim.

    Live owners come first, then the brain, new dates and small ids; places beyond `most` are left out, owners are of all."""
    aliases = F.when(F.col("zone") == "brain", F.coalesce("aliases", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    names = F.concat(F.array(F.struct(name_of(F.coalesce("title", F.lit(""))).alias("name"), F.lit(0).alias("by_alias"))), F.transform(aliases, lambda a: F.struct(name_of(a).alias("name"), F.lit(1).alias("by_alias"))))
    rows = notes.select("id", "zone", is_live().alias("live"), F.try_to_date(valid_date()).alias("d"), F.explode(names).alias("n")).filter("n.name <> ''")
    own = rows.groupBy("n.name", "id").agg(F.max("n.by_alias").alias("by_alias"), F.first("live").alias("live"), F.first("zone").alias("zone"), F.first("d").alias("d"))
    w = Window.partitionBy("name")
    order = w.orderBy(F.desc("live"), (F.col("zone") == "brain").desc(), F.col("d").desc_nulls_last(), "id")
    out = own.withColumns({"owners": F.count(F.lit(1)).over(w), "place": F.row_number().over(order).cast("long")})
    return out.filter(F.col("place") <= most).select("name", "id", "by_alias", "owners", "place")

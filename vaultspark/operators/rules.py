"""Conventions of notes as rows of a table, and keys by their prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: rule, zone (null: all), kind, field, argument. Kinds: required; one_of (values joined by |); date (ISO); boolean;
#: before (argument: a later field); needs (a value, or any if none is given before =, needs another field);
#: other (differs from another field); unique (among live values, without regard to case).
RULES = "rule string, zone string, kind string, field string, argument string"
TIERS, BRAIN_TYPES = "Public|Internal|Confidential|Restricted|MNPI", "note|index|moc|source-derived|person|company|project|meeting|decision|concept|daily"


def note_rules() -> list[tuple]:
    """The usual conventions."""
    required = [("missing " + f, zone, "required", f, None) for zone, fields in (("brain", ("id", "title", "type", "classification", "created", "updated")), ("raw", ("id", "type", "classification", "captured", "origin", "immutable"))) for f in fields]
    return [
        *required,
        ("unknown tier", None, "one_of", "classification", TIERS),
        ("unknown type", "brain", "one_of", "type", BRAIN_TYPES),
        ("unknown type", "raw", "one_of", "type", "source"),
        *((f"{f} is no date", None, "date", f, None) for f in ("document_date", "effective_date", "superseded_date")),
        ("is_latest_version is no boolean", None, "boolean", "is_latest_version", None),
        ("retired without successor", None, "needs", "is_latest_version", "false=superseded_by"),
        ("superseded_date without successor", None, "needs", "superseded_date", "=superseded_by"),
        ("supersedes itself", None, "other", "superseded_by", "id"),
        ("superseded before it was created", None, "before", "created", "superseded_date"),
        ("title of several notes", "brain", "unique", "title", None),
    ]


def lint(notes: DataFrame, rules: list[tuple] | None = None, *, key: str = "id") -> DataFrame:
    """(rule, key, field, value): what breaks a rule. Fields that notes don't have count as empty.

    Notes are unpivoted once, into a row for each field with the other field that a rule may ask for, and joined with
    the rules by field; uniqueness is told by a count over (field, value), pre-aggregated before it is joined."""
    spark = notes.sparkSession
    rules = note_rules() if rules is None else rules
    table = F.broadcast(spark.createDataFrame(rules, RULES))  # one row a rule
    fields = sorted({r[3] for r in rules})
    column = lambda f: F.coalesce(F.trim(F.col(f"`{f}`").cast("string")), F.lit("")) if f in notes.columns else F.lit("")
    others = sorted({r[4].rpartition("=")[2] for r in rules if r[2] in ("before", "needs", "other")})
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), column(f).alias("value")) for f in fields])
    rest = F.map_from_arrays(F.array(*map(F.lit, others)), F.array(*map(column, others))) if others else F.create_map().cast("map<string,string>")
    rows = notes.select(F.col(f"`{key}`").alias("key_"), F.col("zone").alias("zone_"), rest.alias("others"), F.explode(pairs).alias("p")).select("key_", "zone_", "others", "p.*")
    met = rows.join(table, "field").filter(F.col("zone").isNull() | (F.col("zone") == F.col("zone_")))
    value, other = F.col("value"), F.element_at("others", F.regexp_extract(F.coalesce("argument", F.lit("")), "[^=]*$", 0))
    given, iso = value != "", r"^\d{4}-\d{2}-\d{2}$"
    asked = F.regexp_extract(F.coalesce("argument", F.lit("")), "^(.*)=", 1)
    kind = lambda k: F.col("kind") == k
    broken = (
        F.when(kind("required"), ~given)
        .when(kind("one_of"), given & ~F.array_contains(F.split("argument", r"\|"), value))
        .when(kind("date"), given & ~value.rlike(iso))
        .when(kind("boolean"), given & ~F.lower(value).isin("true", "false"))
        .when(kind("before"), value.rlike(iso) & other.rlike(iso) & (value > other))
        .when(kind("needs"), given & ((asked == "") | (F.lower(value) == asked)) & (other == ""))
        .when(kind("other"), given & (value == other))
    )
    found = met.filter(broken).select("rule", F.col("key_").alias(key), "field", "value")
    named = met.filter(kind("unique") & given).select("rule", F.col("key_").alias(key), "field", "value", F.lower("value").alias("low"))
    twice = named.groupBy("rule", "field", "low").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return found.unionByName(named.join(twice, ["rule", "field", "low"]).select(found.columns))


def resolve_prefixes(asked: DataFrame, keys: DataFrame, *, prefix: str = "prefix", key: str = "key") -> DataFrame:
    """(prefix, status, key, owners) of each distinct prefix: exact, found, ambiguous or absent.

    Keys are counted by their beginnings of the asked lengths before anything is joined, so a prefix that many keys
    share is one row; the lengths, one for each letter of the longest prefix at most, come to the driver."""
    wanted = asked.select(F.col(prefix).alias("prefix")).filter(F.length("prefix") > 0).distinct()
    lengths = [r["n"] for r in wanted.select(F.length("prefix").alias("n")).distinct().orderBy("n").collect()]
    names = keys.select(F.col(key).alias("key")).dropna().distinct()
    begins = names.select("key", F.explode(F.array(*[F.lit(n) for n in lengths] or [F.lit(0)])).alias("n")).filter(F.length("key") >= F.col("n")).select("key", F.expr("substring(key, 1, n)").alias("prefix"))
    known = begins.groupBy("prefix").agg(F.count(F.lit(1)).alias("owners"), F.min("key").alias("first"), F.bool_or(F.col("key") == F.col("prefix")).alias("exact"))
    both = wanted.join(known, "prefix", "left")
    owners = F.coalesce("owners", F.lit(0)).cast("long")
    status = F.when(F.col("exact"), "exact").when(owners == 1, "found").when(owners > 1, "ambiguous").otherwise("absent")
    resolved = F.when(F.col("exact"), F.col("prefix")).when(owners == 1, F.col("first"))
    return both.select("prefix", status.alias("status"), resolved.alias("key"), owners.alias("owners"))

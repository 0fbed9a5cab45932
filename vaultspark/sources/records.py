"""Query-log records: a permissive read that keeps broken lines, and typed rules that name the first fault of each."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values that must match: modes of a query, what became of reranking, tiers.
MODES = ("hybrid-search", "search", "dossier")
RERANK_MODES = ("disabled", "requested_not_applied", "applied")
TIERS = ("Public", "Internal", "Confidential", "Restricted", "MNPI")

WHOLE, NUMBER, TEXT, TRUTH, OBJECT, LIST = "BIGINT", "BIGINT|DOUBLE|DECIMAL.*", "STRING", "BOOLEAN", "OBJECT.*", "ARRAY.*"


class Rule(NamedTuple):
    """A field of a record: the type that its value has in the JSON, and a test that the value passes."""

    problem: str
    field: str
    kind: str
    test: Callable[[Column], Column] | None = None
    optional: bool = False


def query_log_rules(version: int = 1) -> list[Rule]:
    """The rules of a query-log record, in the order in which faults are named."""
    return [
        Rule("unsupported record version", "version", WHOLE, lambda v: v.cast("long") == version),
        Rule("missing query", "query", TEXT),
        Rule("unsupported mode", "mode", TEXT, lambda v: v.isin(*MODES)),
        Rule("invalid k", "k", WHOLE, lambda v: v.cast("long") >= 0),
        Rule("invalid rrf_k", "rrf_k", WHOLE, lambda v: v.cast("long") > 0),
        Rule("missing vault fingerprint", "vault_fingerprint", TEXT, lambda v: F.trim(v) != ""),
        Rule("invalid top list", "top", LIST),
        Rule("invalid latency", "latency_ms", NUMBER),
        Rule("invalid rerank metadata", "rerank", OBJECT),
        Rule("invalid rerank metadata", "rerank.requested", TRUTH),
        Rule("invalid rerank mode", "rerank_mode", TEXT, lambda v: v.isin(*RERANK_MODES), True),
        Rule("invalid max tier", "max_tier", TEXT, lambda v: v.isin(*TIERS), True),
        Rule("invalid candidate digest", "candidate_digest", OBJECT),
    ]


def kind_of(value: Column) -> Column:
    """The JSON type of a variant; null where there is none."""
    return F.schema_of_variant(value)


def fault(parsed: Column, rule: Rule) -> Column:
    """Whether a record breaks a rule. JSON's null counts as a value of another type."""
    value = F.try_variant_get(parsed, f"$.{rule.field}", "variant")
    good = F.coalesce(kind_of(value).rlike(f"^({rule.kind})$"), F.lit(False))
    if rule.test is not None:
        good &= F.coalesce(rule.test(F.try_variant_get(parsed, f"$.{rule.field}", "string")), F.lit(False))
    return value.isNotNull() & ~good if rule.optional else ~good


def top_fault(parsed: Column) -> Column:
    """The fault of the list of results: ids are texts and different, ranks are whole from one on, scores are numbers."""
    items = F.try_variant_get(parsed, "$.top", "array<variant>")
    has = lambda item, name, kind: F.coalesce(kind_of(F.try_variant_get(item, f"$.{name}", "variant")).rlike(f"^({kind})$"), F.lit(False))
    score = lambda item: ~F.coalesce(kind_of(F.try_variant_get(item, "$.pre_rerank_score", "variant")).rlike(f"^({NUMBER}|VOID)$"), F.lit(True))
    rank = lambda item: ~(has(item, "final_rank", WHOLE) & F.coalesce(F.try_variant_get(item, "$.final_rank", "long") >= 1, F.lit(False)))
    ids = F.transform(items, lambda item: F.try_variant_get(item, "$.id", "string"))
    return (
        F.when(F.exists(items, lambda item: ~has(item, "id", TEXT)), "invalid top result")
        .when(F.exists(items, score), "invalid top score")
        .when(F.exists(items, rank), "invalid top rank")
        .when(F.size(F.array_distinct(ids)) < F.size(ids), "duplicate top id")
    )


def validated(lines: DataFrame, *, rules: list[Rule] | None = None, line: str = "value", strict: bool = False) -> DataFrame:
    """lines with `record` (a variant, null where the line is no JSON) and `problem` (null for good records).

    Every line is kept. strict: the first bad record that a task meets raises an error with its line."""
    rules = query_log_rules() if rules is None else rules
    rows = lines.withColumn("record", F.try_parse_json(F.col(line)))
    record = F.col("record")
    problem = F.when(F.trim(F.coalesce(F.col(line), F.lit(""))) == "", "empty line").when(record.isNull(), "malformed JSON").when(~kind_of(record).rlike("^OBJECT"), "not an object")
    for rule in rules:
        problem = problem.when(fault(record, rule), rule.problem)
    problem = problem.otherwise(top_fault(record))
    rows = rows.withColumn("problem", problem)
    if strict:
        told = F.concat(F.col("problem"), F.lit(": "), F.coalesce(F.substring(line, 1, 200), F.lit("")))
        rows = rows.withColumn("problem", F.when(F.col("problem").isNotNull(), F.raise_error(told).cast("string")))
    return rows


def read_log(spark, path: str, *, strict: bool = False) -> DataFrame:
    """The records of JSON-lines files with their problems; empty lines are left out."""
    lines = spark.read.text(path).filter(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("file"))
    return validated(lines, strict=strict)

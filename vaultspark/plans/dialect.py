"""One statement of a query for two engines: Spark SQL plans it, DuckDB checks it.

A plan is a function of a dialect that returns SQL. The dialect writes what the engines spell differently.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vaultspark.operators.base import stored
from vaultspark.operators.lexical import index_of

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Spark:
    name = "spark"

    def lit(self, pattern: str) -> str:
        """A string literal taken as it stands (patterns)."""
        return "r'" + pattern.replace("'", "\\'") + "'" if "'" not in pattern else "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def unnest(self, array: str, alias: str) -> str:
        return f"LATERAL explode({array}) AS {alias}"

    def unnest_outer(self, array: str, alias: str) -> str:
        return f"LATERAL explode_outer({array}) AS {alias}"

    def extract_all(self, text: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({text}, {self.lit(pattern)}, {group})"

    def extract(self, text: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({text}, {self.lit(pattern)}, {group})"

    def replace_all(self, text: str, pattern: str, to: str) -> str:
        return f"regexp_replace({text}, {self.lit(pattern)}, {self.lit(to)})"

    def matches(self, text: str, pattern: str) -> str:
        return f"({text} RLIKE {self.lit(pattern)})"

    def sha(self, text: str) -> str:
        return f"sha2({text}, 256)"

    def split(self, text: str, sep: str) -> str:
        return f"split({text}, {self.lit(sep)})"

    def lines(self, text: str) -> str:
        return f"split({text}, '\\n')"

    def size(self, array: str) -> str:
        return f"CAST(size({array}) AS BIGINT)"

    def distinct(self, array: str) -> str:
        return f"array_distinct({array})"

    def sort(self, array: str) -> str:
        return f"array_sort({array})"

    def join(self, array: str, sep: str) -> str:
        return f"array_join({array}, '{sep}')"

    def collect(self, value: str) -> str:
        return f"collect_list({value})"

    def collect_sorted(self, value: str) -> str:
        return f"array_sort(collect_list({value}))"

    def collect_set_sorted(self, value: str) -> str:
        return f"array_sort(collect_set({value}))"

    def transform(self, array: str, var: str, body: str) -> str:
        return f"transform({array}, {var} -> {body})"

    def filter(self, array: str, var: str, body: str) -> str:
        return f"filter({array}, {var} -> {body})"

    def slice(self, array: str, start: str, length: str) -> str:
        return f"slice({array}, {start}, {length})"

    def at(self, array: str, i: str) -> str:
        """Element by 1-based place; null beyond the end."""
        return f"get({array}, CAST({i} AS INT) - 1)"

    def seq(self, a: str, b: str) -> str:
        """Whole numbers from a to b; empty if b is smaller."""
        return f"CASE WHEN {b} >= {a} THEN sequence(CAST({a} AS INT), CAST({b} AS INT)) ELSE CAST(array() AS array<int>) END"

    def days(self, later: str, earlier: str) -> str:
        return f"CAST(datediff({later}, {earlier}) AS BIGINT)"

    def percentile(self, x: str, q: str) -> str:
        return f"percentile({x}, {q})"

    def isum(self, x: str) -> str:
        return f"CAST(sum({x}) AS BIGINT)"

    def octets(self, text: str) -> str:
        return f"CAST(octet_length({text}) AS BIGINT)"

    def try_date(self, text: str) -> str:
        return f"try_to_date({text}, 'yyyy-MM-dd')"

    def json_int(self, text: str, key: str) -> str:
        return f"CAST(get_json_object({text}, '$.{key}') AS BIGINT)"

    def dot(self, a: str, b: str) -> str:
        return f"aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), CAST(0 AS DOUBLE), (s, v) -> s + v)"

    def hex_mod(self, hexa: str, k: int) -> str:
        """The remainder of the first 8 digits of a hexadecimal text."""
        return f"CAST(conv(substr({hexa}, 1, 8), 16, 10) AS BIGINT) % {k}"

    def string(self, x: str) -> str:
        return f"CAST({x} AS STRING)"

    def date(self, ts: str) -> str:
        return f"CAST({ts} AS DATE)"

    def contains(self, text: str, part: str) -> str:
        return f"contains({text}, {part})"

    def starts(self, text: str, part: str) -> str:
        return f"startswith({text}, {part})"

    def exists(self, array: str, var: str, body: str) -> str:
        return f"exists({array}, {var} -> {body})"

    def epoch(self, ts: str) -> str:
        return f"unix_micros(CAST({ts} AS TIMESTAMP))"

    def intersect(self, a: str, b: str) -> str:
        return f"array_intersect({a}, {b})"

    def bool_or(self, x: str) -> str:
        return f"bool_or({x})"

    def instr(self, text: str, part: str) -> str:
        return f"CAST(instr({text}, {part}) AS BIGINT)"


class Duck(Spark):
    name = "duckdb"

    def lit(self, pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    def unnest(self, array: str, alias: str) -> str:
        return f"unnest({array}) AS {alias}"

    def replace_all(self, text: str, pattern: str, to: str) -> str:
        return f"regexp_replace({text}, {self.lit(pattern)}, {self.lit(to.replace('$1', chr(92) + '1'))}, 'g')"

    def matches(self, text: str, pattern: str) -> str:
        return f"regexp_matches({text}, {self.lit(pattern)})"

    def sha(self, text: str) -> str:
        return f"sha256({text})"

    def split(self, text: str, sep: str) -> str:
        return f"string_split_regex({text}, {self.lit(sep)})"

    def lines(self, text: str) -> str:
        return f"string_split({text}, chr(10))"

    def size(self, array: str) -> str:
        return f"CAST(len({array}) AS BIGINT)"

    def distinct(self, array: str) -> str:
        return f"list_distinct({array})"

    def sort(self, array: str) -> str:
        return f"list_sort({array})"

    def join(self, array: str, sep: str) -> str:
        return f"array_to_string({array}, '{sep}')"

    def collect(self, value: str) -> str:
        return f"list({value})"

    def collect_sorted(self, value: str) -> str:
        return f"list_sort(list({value}))"

    def collect_set_sorted(self, value: str) -> str:
        return f"list_sort(list(DISTINCT {value}))"

    def transform(self, array: str, var: str, body: str) -> str:
        return f"list_transform({array}, lambda {var}: {body})"

    def filter(self, array: str, var: str, body: str) -> str:
        return f"list_filter({array}, lambda {var}: {body})"

    def slice(self, array: str, start: str, length: str) -> str:
        return f"({array})[({start}):({start}) + ({length}) - 1]"

    def at(self, array: str, i: str) -> str:
        return f"({array})[{i}]"

    def seq(self, a: str, b: str) -> str:
        return f"generate_series(CAST({a} AS BIGINT), CAST({b} AS BIGINT))"

    def days(self, later: str, earlier: str) -> str:
        return f"date_diff('day', {earlier}, {later})"

    def percentile(self, x: str, q: str) -> str:
        return f"quantile_cont({x}, {q})"

    def octets(self, text: str) -> str:
        return f"CAST(strlen({text}) AS BIGINT)"

    def try_date(self, text: str) -> str:
        return f"TRY_CAST({text} AS DATE)"

    def json_int(self, text: str, key: str) -> str:
        return f"CAST(regexp_extract({text}, '\"{key}\": *(-?[0-9]+)', 1) AS BIGINT)"

    def dot(self, a: str, b: str) -> str:
        return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"

    def hex_mod(self, hexa: str, k: int) -> str:
        return f"CAST(('0x' || substr({hexa}, 1, 8)) AS BIGINT) % {k}"

    def string(self, x: str) -> str:
        return f"CAST({x} AS VARCHAR)"

    def contains(self, text: str, part: str) -> str:
        return f"contains({text}, {part})"

    def starts(self, text: str, part: str) -> str:
        return f"starts_with({text}, {part})"

    def exists(self, array: str, var: str, body: str) -> str:
        return f"(len(list_filter({array}, lambda {var}: {body})) > 0)"

    def epoch(self, ts: str) -> str:
        return f"epoch_us({ts})"

    def intersect(self, a: str, b: str) -> str:
        return f"list_intersect({a}, {b})"

    def instr(self, text: str, part: str) -> str:
        return f"CAST(instr({text}, {part}) AS BIGINT)"


SPARK, DUCK = Spark(), Duck()

#: Tokens: runs of letters, digits and underscores of the lower-cased text.
TOKEN = r"[\p{L}\p{N}_]+"


def tokens(q: Spark, text: str) -> str:
    return q.extract_all(f"lower({text})", TOKEN)


def token_rows(q: Spark, table: str, text: str, columns: str, name: str, where: str = "true") -> str:
    """Spark: columns of a table and its tokens as `name`; a generator of one row keeps them from being computed again at each use."""
    return f"(SELECT {columns}, {name} FROM {table}, {q.unnest(f'array({tokens(q, text)})', f'tokens_({name})')} WHERE {where})"


def _derived_edges(spark: SparkSession, path: str) -> DataFrame:
    spark.read.parquet(path).createOrReplaceTempView("documents")
    return spark.sql(f"WITH {_links} SELECT src, dst FROM edge")


def notes(q: Spark) -> str:
    """Documents as notes of a vault: the same derived columns in both engines."""
    base = "DATE '2024-01-01'"
    day = lambda n: f"{q.string(f'({base} + CAST({n} AS INT))')}"
    return f"""notes AS (SELECT doc_id, 'n' || {q.string('doc_id')} AS id,
  {q.replace_all("trim(substr(text, 1, 40))", r"[^\p{L}\p{N}]+", " ")} AS title,
  CASE doc_id % 5 WHEN 0 THEN 'decision' WHEN 1 THEN 'meeting' WHEN 2 THEN 'project' WHEN 3 THEN 'person' ELSE 'note' END AS type,
  CASE doc_id % 7 WHEN 0 THEN 'Public' WHEN 1 THEN 'Internal' WHEN 2 THEN 'Confidential' WHEN 3 THEN 'Restricted' WHEN 4 THEN 'MNPI' WHEN 5 THEN ' internal ' ELSE NULL END AS classification,
  CASE WHEN doc_id % 2 = 0 THEN 'raw' ELSE 'brain' END AS zone,
  (CASE WHEN doc_id % 2 = 0 THEN 'raw/' ELSE 'brain/' END) || source || '/n' || {q.string('doc_id')} || '.md' AS path,
  {day('doc_id % 365')} AS created, {day('doc_id % 365 + doc_id % 11')} AS updated,
  CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 17 = 0 THEN 'unknown' ELSE {day('doc_id % 300')} END AS document_date,
  CASE WHEN doc_id % 4 = 0 THEN {day('doc_id % 200')} ELSE '' END AS effective_date,
  CASE WHEN doc_id % 10 = 3 THEN {day('doc_id % 365 + 30')} ELSE '' END AS superseded_date,
  CASE WHEN doc_id % 10 = 3 THEN 'false' WHEN doc_id % 10 = 4 THEN 'true' ELSE NULL END AS is_latest_version,
  CASE WHEN doc_id % 10 = 3 THEN 'n' || {q.string('doc_id + (CASE WHEN doc_id % 20 = 3 THEN 10 ELSE 1 END)')} ELSE NULL END AS superseded_by,
  lang, source, n_chars, text AS body FROM documents)"""


#: Rank of a classification; unknown and missing ones count as the highest.
def tier_rank(column: str) -> str:
    return f"CASE trim({column}) WHEN 'Public' THEN 0 WHEN 'Internal' THEN 1 WHEN 'Confidential' THEN 2 WHEN 'Restricted' THEN 3 ELSE 4 END"


VALID_DATE = "coalesce(nullif(effective_date, ''), nullif(document_date, ''), created)"


def views(spark: SparkSession, sf_dir: str, sql: str = "") -> None:
    """The tables as views: those that a statement names, or all."""
    for t in TABLES:
        if not sql or re.search(rf"\b{t}\b", sql):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    derived_views(spark, sf_dir, sql)


def derived_views(spark: SparkSession, sf_dir: str, sql: str) -> None:
    """What a statement reads that is derived from the documents and kept: their links, and their lexical index."""
    path = f"{sf_dir}/documents.parquet"
    if "stored_edge" in sql:
        stored(spark, path, "edges", lambda: _derived_edges(spark, path)).createOrReplaceTempView("stored_edge")
    if "lexical_" in sql:
        index = index_of(spark, path)
        for part in ("postings", "maxima"):
            index.table(part).createOrReplaceTempView(f"lexical_{part}")
        spark.createDataFrame([(float(index.docs), index.avgdl)], "n double, avgdl double").createOrReplaceTempView("lexical_stat")


def edges(q: Spark) -> str:
    """Links between notes: documents hold no links, so each note links to those that its number leads to."""
    return "edge AS (SELECT src, dst FROM stored_edge)" if q.name == "spark" else _links


_links = """links AS (SELECT doc_id AS src, (doc_id * 7 + 3) % n AS dst FROM documents, (SELECT count(*) AS n FROM documents) c WHERE doc_id % 3 <> 1
  UNION ALL SELECT doc_id, (doc_id * 5 + 11) % n FROM documents, (SELECT count(*) AS n FROM documents) c WHERE doc_id % 4 = 0
  UNION ALL SELECT doc_id, doc_id - doc_id % 25 FROM documents WHERE doc_id % 5 = 2),
edge AS (SELECT DISTINCT src, dst FROM links WHERE src <> dst)"""


class Plans:
    """A module's queries and their checks."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracle: dict[str, str] = {}

    def add(self, name: str, build: Callable[[Spark], str], doc: str = "") -> None:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            statement = build(SPARK)
            views(spark, sf_dir, statement)
            return spark.sql(statement)

        run.__name__, run.__doc__ = name, doc or build.__doc__
        self.queries[name] = run
        self.oracle[name] = build(DUCK)

    def sql(self, build: Callable[[Spark], str]):
        """Decorator: a plan under its function's name."""
        self.add(build.__name__, build)
        return build

    def frame(self, oracle: Callable[[Spark], str] | None = None):
        """Decorator: a query written with DataFrames, and the SQL that checks it."""

        def take(run):
            self.queries[run.__name__] = run
            if oracle:
                self.oracle[run.__name__] = oracle(DUCK)
            return run

        return take

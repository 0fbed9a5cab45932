"""The opN queries and the pipeline, by name; each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultspark.llm import bpe_tree, decontaminate, infill, jaccard, langid, media, packing, periods, quality, shards, token_files, urlfilter, warc
from vaultspark.llm._common import input_table, work_folder


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_digest(input_table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archives_digest(input_table(spark, sf_dir, "pages", "page_id", "url", "html"))


#: The contract's rules, in its order.
URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labelled page is good if its label is of quality and not toxic."""
    good = ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")
    outcomes = input_table(spark, sf_dir, "labels", "doc_id", "quality", "toxic").select(F.col("doc_id").alias("page_id"), good.alias("good"))
    return urlfilter.judge(input_table(spark, sf_dir, "pages", "page_id", "url"), outcomes, URL_RULES).drop("upper")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = input_table(spark, sf_dir, "documents", "doc_id", "text")
    return decontaminate.digest(decontaminate.scan(docs, input_table(spark, sf_dir, "benchmark", "item_id", "text")))


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.tokens_digest(input_table(spark, sf_dir, "documents", "doc_id", "text"), _vocabulary("word_bpe_49k.json"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(input_table(spark, sf_dir, "documents", "doc_id", "text"), _vocabulary("byte_bpe_50k.json"), keep_ids=False)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = input_table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source", "n_chars")
    model = quality.train(docs, input_table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))
    return quality.score(docs, model).select("doc_id", "text_score", "meta_score", "quality_score", "accepted")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in six lots, are compacted, and are read back through the last manifest. Nobody reads older versions."""
    docs = input_table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source", "n_chars")
    table = shards.ShardTable(spark, work_folder(spark, "shards"), target_bytes=32 << 20, retain_seconds=0)
    table.append(docs.withColumn("lot", F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(6))), "lot")
    schema = docs.withColumn("lot", F.lit(0).cast("long")).schema
    table.compact(schema)
    text = F.coalesce(F.col("text"), F.lit(""))
    return table.read(schema).select("doc_id", "lang", "source", "n_chars", F.octet_length(text).cast("long").alias("text_bytes"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_groups(input_table(spark, sf_dir, "documents", "doc_id", "text"), k=4, percent=85)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(input_table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_tree.digest(input_table(spark, sf_dir, "documents", "doc_id", "text"), _vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digest(input_table(spark, sf_dir, "documents", "doc_id", "text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth text gets a repeat first, as the contract says; then runs are searched in all."""
    return periods.digest(periods.with_repeats(input_table(spark, sf_dir, "documents", "doc_id", "text")))


def queries() -> dict:
    return {n: f for n, f in globals().items() if n.startswith("op") and n[2].isdigit()}


_HOSTS = """
pg AS (SELECT page_id, CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN '' ELSE substr(url, position('://' IN url) + 3) END AS rest FROM pages),
pages_split AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM pg),
named AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS bare FROM pages_split),
cut AS (SELECT *, string_split(bare, '.') AS parts FROM named),
told AS (SELECT *, len(parts) < 2 OR regexp_matches(bare, '^[0-9.]+$') OR starts_with(bare, '[') AS whole,
  CASE WHEN array_to_string(parts[-2:], '.') IN ({long}) THEN 2 ELSE 1 END AS depth FROM cut),
site AS (SELECT page_id, host, path, CASE WHEN whole THEN bare ELSE array_to_string(parts[-depth:], '.') END AS suffix,
  CASE WHEN whole THEN bare ELSE array_to_string(parts[-(least(depth + 1, len(parts))):], '.') END AS domain FROM told)"""

_STRENGTH = """{name} AS (SELECT CASE WHEN N <= 0 OR G < 2 THEN 1.0 WHEN v <= 0 OR below <= 0 OR rho <= 0 THEN 1000.0 ELSE greatest(1.0, least(1000.0, 1 / rho - 1)) END AS k FROM (
  SELECT *, CASE WHEN below > 0 THEN (Q - S * S / N - v * (G - 1)) / below ELSE 0 END AS rho FROM (
  SELECT *, CASE WHEN N > 0 THEN v * (N - N2 / N - (G - 1)) ELSE 0 END AS below FROM (
  SELECT *, CASE WHEN N > 0 THEN (S / N) * (1 - S / N) ELSE 0 END AS v FROM (
  SELECT coalesce(sum(n), 0)::DOUBLE AS N, coalesce(sum(s), 0)::DOUBLE AS S, count(*)::DOUBLE AS G, coalesce(sum(n * n), 0)::DOUBLE AS N2, coalesce(sum(s * s / n::DOUBLE), 0)::DOUBLE AS Q FROM {of})))))"""


def _op3_sql() -> str:
    long = ", ".join(f"'{x}'" for x in urlfilter.LONG_SUFFIXES)
    order = sorted(URL_RULES, key=lambda r: (-len(r[1]), -len(r[1].partition("/")[0])))
    rule = verdict = ""
    for says, text in order:
        name, slash, rest = text.partition("/")
        fits = f"(s.host = '{name}' OR ends_with(s.host, '.{name}')) AND starts_with(s.path, '{slash}{rest}')"
        rule += f" WHEN {fits} THEN '{text}'"
        verdict += f" WHEN {fits} THEN '{says}'"
    k = ",\n".join(_STRENGTH.format(name=f"k_{of}", of=of) for of in ("suffixes", "domains", "hosts"))
    return f"""WITH {_HOSTS.format(long=long)},
good AS (SELECT s.host, s.suffix, s.domain, (l.quality = 1 AND l.toxic = 0)::INT AS good FROM site s JOIN labels l ON l.doc_id = s.page_id WHERE (l.quality = 1 AND l.toxic = 0) IS NOT NULL),
hosts AS (SELECT host, suffix, domain, count(*) AS n, sum(good) AS s FROM good GROUP BY ALL),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(s) AS s FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(s) AS s FROM hosts GROUP BY ALL),
total AS (SELECT (coalesce(sum(s), 0) + 1) / (coalesce(sum(n), 0) + 2)::DOUBLE AS m0 FROM hosts),
{k},
by_suffix AS (SELECT suffix, (s + k * m0) / (n + k) AS ms FROM suffixes, total, k_suffixes),
by_domain AS (SELECT domain, (s + k * ms) / (n + k) AS md FROM domains JOIN by_suffix USING (suffix), k_domains),
seen AS (SELECT DISTINCT host, suffix, domain FROM site),
post AS (SELECT host, coalesce(h.s, 0) + k * p AS a, coalesce(h.n, 0) - coalesce(h.s, 0) + k * (1 - p) AS b FROM (
  SELECT seen.host, k, coalesce(md, ms, m0) AS p FROM seen LEFT JOIN by_domain USING (domain) LEFT JOIN by_suffix USING (suffix), total, k_hosts) x LEFT JOIN hosts h USING (host)),
bound AS (SELECT host, a / (a + b) + {urlfilter.Z} * sqrt(a / (a + b) * (b / (a + b)) / (a + b + 1)) AS upper FROM post)
SELECT s.page_id, s.host, s.path, CASE{rule} ELSE NULL END AS rule, CASE{verdict} WHEN b.upper < {urlfilter.FLOOR} THEN 'block' ELSE 'allow' END AS verdict
FROM site s LEFT JOIN bound b ON b.host = s.host"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_url_filter": _op3_sql(),
        "op8_sharding": "SELECT doc_id, lang, source, n_chars, strlen(coalesce(text, ''))::BIGINT AS text_bytes, sha256(coalesce(text, '')) AS text_sha256 FROM documents",
    }

"""Queries that write: merges of a table, rebuilds in batches, and arrivals that pass the stages of an ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from vaultspark.operators import rules
from vaultspark.operators.base import work_dir
from vaultspark.plans.dialect import SPARK, Plans, notes, tokens, views
from vaultspark.sources import records
from vaultspark.sources.bucketed import BucketedTable, Rebuild
from vaultspark.streaming import admission, ledger

P = Plans()

#: Two states of a vault: at first it lacks one source; later French notes have moved, German ones were revised, Spanish ones are gone.
_BEFORE = "lower(source) <> 'src0' OR source IS NULL"
_PATH = "concat(coalesce(source, 'none'), '/', doc_id)"


def _sync_sql(q) -> str:
    return f"""WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') AS t, coalesce(source, 'none') || '/' || doc_id AS p FROM documents),
old AS (SELECT p AS path, sha256(t) AS h FROM d WHERE {_BEFORE}),
new AS (SELECT CASE WHEN lang = 'fr' THEN 'moved/' || p ELSE p END AS path, doc_id, CASE WHEN lang = 'de' THEN t || ' (revised)' ELSE t END AS t FROM d WHERE lang IS DISTINCT FROM 'es'),
hashed AS (SELECT *, sha256(t) AS h FROM new),
gone AS (SELECT h, row_number() OVER (PARTITION BY h ORDER BY path) AS r FROM old WHERE path NOT IN (SELECT path FROM new)),
came AS (SELECT path, h, row_number() OVER (PARTITION BY h ORDER BY path) AS r FROM hashed WHERE path NOT IN (SELECT path FROM old)),
moved AS (SELECT c.path FROM came c JOIN gone g ON g.h = c.h AND g.r = c.r)
SELECT n.path, n.doc_id, n.h AS content_hash, CAST(len({tokens(q, 't')}) AS BIGINT) AS n_words, CASE WHEN o.path IS NOT NULL OR n.path IN (SELECT path FROM moved) THEN 1 ELSE 2 END AS derived_in
FROM hashed n LEFT JOIN old o ON o.path = n.path AND o.h = n.h"""


@P.frame(_sync_sql)
def vault_sync_merge(spark, sf_dir):
    """SK2: a table merged with the next state of its vault; what was derived stays for notes that are as they were or only moved."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", F.coalesce("text", F.lit("")).alias("t"), F.expr(_PATH).alias("path"))
    state = lambda rows, text: rows.select("path", "doc_id", F.sha2(text, 256).alias("content_hash"), text.alias("body"))

    def derive(made):
        words = F.regexp_extract_all(F.lower("body"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
        return lambda rows: rows.withColumns({"n_words": F.size(words).cast("long"), "derived_in": F.lit(made)})

    table = BucketedTable(spark, work_dir(spark, "sync"), buckets=32)
    table.create(derive(1)(state(d.filter(_BEFORE), F.col("t"))))
    later = d.filter(~F.col("lang").eqNullSafe(F.lit("es"))).withColumn("path", F.when(F.col("lang") == "fr", F.concat(F.lit("moved/"), "path")).otherwise(F.col("path")))
    table.sync(state(later, F.when(F.col("lang") == "de", F.concat("t", F.lit(" (revised)"))).otherwise(F.col("t"))), derive(2))
    return table.read().select("path", "doc_id", "content_hash", "n_words", "derived_in")


@P.frame(lambda q: f"SELECT doc_id, sha256(t) AS content_hash, CAST(len({tokens(q, 't')}) AS BIGINT) AS n_words FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) x")
def resumable_rebuild(spark, sf_dir):
    """SK1: a rebuild in batches whose first run has time for two of them only; the second run computes the rest."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("t")).withColumn("content_hash", F.sha2("t", 256))
    words = F.regexp_extract_all(F.lower("t"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    job = Rebuild(spark, work_dir(spark, "rebuild"))
    compute = lambda rows: rows.select("doc_id", "content_hash", F.size(words).cast("long").alias("n_words"))
    n = max(1, -(-d.count() // 5))
    for most in (2, None):
        job.run(d, compute, key="doc_id", digest="content_hash", per_batch=n, most=most, model="words", schema=1)
    return job.read()


def _admission_sql(q) -> str:
    """Each user is a content; failures before the first success count, and every third one quarantines."""
    return """WITH e AS (SELECT event_id, user_id, ts, event_type, CASE WHEN value > 150 THEN 'quarantined:file_too_large' WHEN event_type = 'signup' THEN 'skipped:operational_artifact:signup' END AS before,
CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) = 0 THEN 'quarantined:no_handler_for_extension' WHEN value < 2 THEN 'quarantined:too_little_text' END AS after FROM events),
p AS (SELECT *, before IS NULL AND after IS NULL AS tried FROM e),
f AS (SELECT *, min(CASE WHEN tried AND event_type <> 'error' THEN (ts, event_id) END) OVER (PARTITION BY user_id) AS done FROM p),
k AS (SELECT *, count(*) FILTER (WHERE tried AND event_type = 'error' AND (done IS NULL OR (ts, event_id) < done)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM f),
v AS (SELECT event_id, CASE WHEN before IS NOT NULL THEN before WHEN (ts, event_id) > done THEN 'duplicates:same_content' WHEN after IS NOT NULL THEN after WHEN event_type <> 'error' THEN 'processed:'
  WHEN n % 3 = 0 THEN 'quarantined:repeated_ingest_failure' ELSE 'skipped:processing_error:error (attempt ' || (n % 3) || '/3)' END AS said FROM k)
SELECT event_id, split_part(said, ':', 1) AS bucket, substr(said, position(':' IN said) + 1) AS reason FROM v"""


@P.frame(_admission_sql)
def admission_drain(spark, sf_dir):
    """SC4, OR10: events as attempts to ingest the content of their user; state by content, stages in their order."""
    e = ledger.events_stream(spark, f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    facts = e.select(F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("content"), F.unix_micros("ts").alias("us"), F.lit(None).cast("string").alias("claimed_by"), F.col("value").alias("size"), F.lit("file").alias("kind"), F.lit("ok").alias("anchor"), F.lit(False).alias("released"), F.when(F.col("event_type") == "signup", "signup").alias("declared"), F.when(k > 0, "md").alias("extension"), F.lit(None).cast("string").alias("problem"), F.col("value").alias("words"), F.lit(2).alias("need_words"), F.lit("ok").alias("tier_verdict"), F.when(F.col("event_type") == "error", "error:error").otherwise("ok").alias("outcome"))
    before, after = admission.standard_stages(max_bytes=150, extensions=("md",))
    arrivals = facts.select("id", "content", "us", admission.verdict(before).alias("before"), admission.verdict(after).alias("after"), "outcome")
    folder = work_dir(spark, "admission")
    admission.drain(arrivals, folder)
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/out").select(F.col("id").cast("long").alias("event_id"), "bucket", "reason")


# records, conventions and prefixes


@P.frame(lambda q: """WITH e AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events), v AS (SELECT event_id, CASE WHEN event_type = 'error' AND value < 20 THEN 'malformed JSON' WHEN value > 180 THEN 'unsupported record version' WHEN event_type = 'signup' THEN 'unsupported mode'
WHEN floor(value) = 0 THEN 'invalid rrf_k' WHEN value BETWEEN 100 AND 110 THEN 'missing vault fingerprint' WHEN event_type = 'error' AND value > 90 THEN 'invalid top list' WHEN value BETWEEN 60 AND 62 THEN 'invalid latency' WHEN k = 7 AND event_type = 'click' THEN 'invalid rerank metadata'
WHEN k = 3 AND event_type = 'view' THEN 'invalid max tier' WHEN k = 0 THEN 'invalid top rank' WHEN k = 1 THEN 'duplicate top id' END AS problem FROM e) SELECT event_id, problem FROM v WHERE problem IS NOT NULL""")
def query_log_records(spark, sf_dir):
    """SC14, OR5: events written as query-log lines, some of them broken in each way, and the first fault of each bad line."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    value, kind = F.col("value"), F.col("event_type")
    mode = F.when(kind == "view", "hybrid-search").when(kind == "click", "search").when(kind == "signup", "lookup").otherwise("dossier")
    item = lambda name, rank: F.concat(F.lit('{"id":"'), name, F.lit('","final_rank":'), rank.cast("string"), F.lit("}"))
    top = F.concat(F.lit("["), item(F.lit("a"), k), F.lit(","), item(F.when(k == 1, "a").otherwise("b"), k + 1), F.lit("]"))
    parts = [
        F.concat(F.lit('"version":'), F.when(value > 180, "2").otherwise("1")),
        F.lit('"query":"what"'),
        F.concat(F.lit('"mode":"'), mode, F.lit('"')),
        F.concat(F.lit('"k":'), k.cast("string")),
        F.concat(F.lit('"rrf_k":'), F.floor(value).cast("string")),
        F.when(~value.between(100, 110), F.lit('"vault_fingerprint":"f"')),
        F.concat(F.lit('"top":'), F.when((kind == "error") & (value > 90), "{}").otherwise(top)),
        F.concat(F.lit('"latency_ms":'), F.when(value.between(60, 62), '"slow"').otherwise(value.cast("string"))),
        F.concat(F.lit('"rerank":'), F.when((k == 7) & (kind == "click"), '{"requested":"no"}').otherwise('{"requested":false}')),
        F.when((k == 3) & (kind == "view"), F.lit('"max_tier":"internal"')),
        F.lit('"candidate_digest":{}'),
    ]
    line = F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ","), F.when((kind == "error") & (value < 20), "").otherwise("}"))
    return records.validated(e.select("event_id", line.alias("value"))).filter("problem IS NOT NULL").select("event_id", "problem")


@P.frame(lambda q: f"""WITH {notes(q)}, n AS (SELECT *, coalesce(trim(title), '') AS t, coalesce(trim(classification), '') AS c FROM notes), v AS (
SELECT 'missing title' AS rule, id FROM n WHERE zone = 'brain' AND t = '' UNION ALL SELECT 'missing classification', id FROM n WHERE c = ''
UNION ALL SELECT r, id FROM n, (VALUES ('missing captured'), ('missing origin'), ('missing immutable')) AS x(r) WHERE zone = 'raw'
UNION ALL SELECT 'unknown tier', id FROM n WHERE c NOT IN ('', 'Public', 'Internal', 'Confidential', 'Restricted', 'MNPI') UNION ALL SELECT 'unknown type', id FROM n WHERE zone = 'raw'
UNION ALL SELECT 'document_date is no date', id FROM n WHERE document_date = 'unknown' UNION ALL SELECT 'superseded before it was created', id FROM n WHERE superseded_date <> '' AND created > superseded_date
UNION ALL SELECT 'title of several notes', id FROM n WHERE zone = 'brain' AND t <> '' AND lower(t) IN (SELECT lower(t) FROM n WHERE zone = 'brain' AND t <> '' GROUP BY lower(t) HAVING count(*) > 1))
SELECT rule, count(*) AS n, min(id) AS first_id FROM v GROUP BY rule""")
def note_rules(spark, sf_dir):
    """OR6: all conventions of notes in one pass over the unpivoted notes."""
    statement = f"WITH {notes(SPARK)} SELECT * FROM notes"
    views(spark, sf_dir, statement)
    return rules.lint(spark.sql(statement)).groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@P.frame(lambda q: """WITH k AS (SELECT DISTINCT sha256(coalesce(text, '')) AS key FROM documents), a AS (SELECT DISTINCT substr(sha256(coalesce(text, '')), 1, CAST(1 + octet_length(encode(coalesce(text, ''))) % 20 AS BIGINT)) AS prefix FROM documents UNION SELECT sha256(coalesce(source, '')) FROM documents UNION SELECT key FROM k WHERE key LIKE '0%'),
j AS (SELECT a.prefix, k.key FROM a LEFT JOIN k ON starts_with(k.key, a.prefix)) SELECT prefix, CASE WHEN bool_or(key = prefix) THEN 'exact' WHEN count(key) = 1 THEN 'found' WHEN count(key) > 1 THEN 'ambiguous' ELSE 'absent' END AS status, CASE WHEN bool_or(key = prefix) THEN prefix WHEN count(key) = 1 THEN min(key) END AS key, count(key) AS owners FROM j GROUP BY prefix""")
def prefix_resolution(spark, sf_dir):
    """OR7: content hashes by beginnings of one to twenty letters, whole ones, and ones that no content has."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.coalesce("text", F.lit("")).alias("t"), F.coalesce("source", F.lit("")).alias("source"))
    keys = d.select(F.sha2("t", 256).alias("key"), (1 + F.octet_length("t") % 20).alias("n"), F.sha2("source", 256).alias("other"))
    asked = keys.select(F.explode(F.array(F.expr("substring(key, 1, n)"), "other", F.when(F.col("key").startswith("0"), F.col("key")))).alias("prefix")).dropna()
    return rules.resolve_prefixes(asked, keys)


QUERIES, ORACLE = P.queries, P.oracle

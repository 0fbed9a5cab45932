"""Structured reads over notes: filters, point-in-time views, tiers, lint, and the joins and set operations."""

from __future__ import annotations

from vaultspark.plans.dialect import TOKEN, VALID_DATE, Plans, edges, notes, tier_rank, token_rows, tokens

P = Plans()


def _tiers(names="'Public','Internal','Confidential','Restricted','MNPI'"):
    return names


@P.sql
def bases_query(q):
    """FP1: exact filters over allowed columns, latest only, point in time, ordered and cut."""
    return f"WITH {notes(q)} SELECT id, title, type, zone, updated FROM notes WHERE type = 'decision' AND zone = 'raw' AND is_latest_version IS DISTINCT FROM 'false' ORDER BY updated DESC, id ASC LIMIT 25"


@P.sql
def bases_query_latest(q):
    """FP2: rows that aren't retired, null-safe."""
    return f"WITH {notes(q)} SELECT id, is_latest_version FROM notes WHERE is_latest_version IS DISTINCT FROM 'false'"


@P.sql
def bases_query_as_of(q):
    """FP3: rows valid at a date; dates compare as text."""
    return f"WITH {notes(q)} SELECT id, {VALID_DATE} AS valid_date FROM notes WHERE {VALID_DATE} <= '2024-06-30' AND (coalesce(superseded_date, '') = '' OR superseded_date > '2024-06-30')"


@P.sql
def get_by_id(q):
    """FP4: a point lookup."""
    return f"WITH {notes(q)} SELECT id, title, type, classification, zone, path, created, updated, document_date, effective_date, superseded_date, is_latest_version, superseded_by FROM notes WHERE id = 'n42'"


@P.sql
def recent(q):
    """FP5: the newest rows."""
    return f"WITH {notes(q)} SELECT id, updated, path FROM notes ORDER BY updated DESC, id ASC LIMIT 20"


@P.sql
def grep_regex(q):
    """FP6: lines that match a pattern."""
    return f"WITH {notes(q)} SELECT id, count(*) AS match_count FROM notes, {q.unnest(q.lines('body'), 't(l)')} WHERE {q.matches('l', '(?i)licen[sc]e|copyright')} GROUP BY id"


@P.sql
def unclassified_notes(q):
    """FP7: missing or unknown tiers."""
    return f"WITH {notes(q)} SELECT id, classification FROM notes WHERE classification IS NULL OR trim(classification) NOT IN ({_tiers()})"


@P.sql
def classification_rank(q):
    """FP8: the rank of each tier; unknown ones rank highest."""
    return f"WITH {notes(q)} SELECT id, {tier_rank('classification')} AS tier_rank FROM notes"


@P.sql
def egress_report(q):
    """FP9: what a cap lets through, and why the rest is withheld."""
    r = tier_rank("classification")
    known = f"trim(classification) IN ({_tiers()})"
    return f"""WITH {notes(q)} SELECT count(*) AS total, {q.isum(f'CASE WHEN {r} <= 2 THEN 1 ELSE 0 END')} AS surfaced, {q.isum(f'CASE WHEN {r} > 2 THEN 1 ELSE 0 END')} AS withheld,
{q.isum(f'CASE WHEN classification IS NULL OR NOT {known} THEN 1 ELSE 0 END')} AS withheld_unlabelled, {q.isum(f"CASE WHEN NOT {known} AND lower(trim(classification)) IN ('public','internal','confidential','restricted','mnpi') THEN 1 ELSE 0 END")} AS wrong_case FROM notes"""


@P.sql
def tier_clamp(q):
    """FP10: the lower of two tiers by rank."""
    return f"WITH {notes(q)} SELECT id, least({tier_rank('classification')}, 2) AS allowed_rank FROM notes"


@P.sql
def wrong_case_tiers(q):
    """FP11: known tiers in the wrong case, with the right one."""
    fix = "CASE lower(trim(classification)) WHEN 'public' THEN 'Public' WHEN 'internal' THEN 'Internal' WHEN 'confidential' THEN 'Confidential' WHEN 'restricted' THEN 'Restricted' WHEN 'mnpi' THEN 'MNPI' END"
    return f"WITH {notes(q)} SELECT id, {fix} AS canonical FROM notes WHERE trim(classification) NOT IN ({_tiers()}) AND {fix} IS NOT NULL"


@P.sql
def freshness_probe(q):
    """FP12: how many visible rows are newer than the newest hit, and the newest date."""
    return f"WITH {notes(q)} SELECT count(*) AS newer, max({VALID_DATE}) AS newest FROM notes WHERE {tier_rank('classification')} <= 2 AND {q.matches(VALID_DATE, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$')} AND {VALID_DATE} > '2024-09-01'"


#: What speaks of a decision (English and Portuguese); fixed values.
DECIDED = (
    r"decided(?:\s+on)?\s+\d|decided:\s|decision\s+(?:was\s+)?taken|we\s+(?:have\s+)?decided|formally\s+approved|approved\s+on\s+\d|"
    r"signed\s+off\s+on|sign-off\s+given|foi\s+decidido|decidiu-se|decis[aã]o\s+tomada|aprovado\s+em\s+\d"
)


@P.sql
def decision_capture_scan(q):
    """FP13: recent live notes that speak of decisions and aren't ones, with the phrase and 80 characters before and 120 after it.

    The tables' texts hold no such phrase: every fifth body ends in one."""
    end = "CASE doc_id % 20 WHEN 1 THEN ' so we have decided: go' WHEN 6 THEN ' It was Approved on 3 May.' WHEN 11 THEN ' undecided: no' ELSE '' END"
    phrase = q.extract("lower(text)", f"(?:^|[^a-z])({DECIDED})", 1)
    return f"""WITH {notes(q)}, b AS (SELECT id, created, doc_id, body || {end} AS text FROM notes WHERE type <> 'decision' AND created >= '2024-12-20' AND is_latest_version IS DISTINCT FROM 'false'),
f AS (SELECT *, {phrase} AS phrase FROM b), s AS (SELECT *, {q.instr('lower(text)', 'phrase')} AS pos FROM f WHERE phrase <> '')
SELECT id, created, phrase, trim({q.replace_all("substr(text, CAST(greatest(pos - 80, 1) AS INT), CAST(pos - greatest(pos - 80, 1) + length(phrase) + 120 AS INT))", "[ \\t\\r\\n]+", " ")}) AS snippet FROM s ORDER BY created DESC, id LIMIT 10"""


@P.sql
def boilerplate_ids(q):
    """FP14: ids of generated notes, by patterns."""
    return f"WITH {notes(q)}, named AS (SELECT id, CASE WHEN doc_id % 9 = 0 THEN 'daily-' || created WHEN doc_id % 9 = 1 THEN 'graph-health-alert-' || id WHEN doc_id % 9 = 2 THEN 'audit-' || id || '-writes' WHEN doc_id % 9 = 3 THEN id || '-transcript' ELSE id END AS slug FROM notes) SELECT id, slug FROM named WHERE slug LIKE 'daily-%' OR slug LIKE 'graph-health-alert-%' OR slug LIKE 'audit-%-writes' OR slug LIKE '%-transcript'"


@P.sql
def link_coverage_exclusion(q):
    """FP15: the first reason that takes a note out of link coverage."""
    return f"""WITH {notes(q)} SELECT id, CASE WHEN {q.contains('path', "'/src3/'")} THEN 'quarantined' WHEN zone = 'raw' AND type = 'note' THEN 'non_knowledge_zone' WHEN source = 'src5' THEN 'generated_map'
WHEN is_latest_version = 'false' THEN 'superseded' WHEN type = 'person' THEN 'operational_artifact' WHEN doc_id % 13 = 0 THEN 'emitter_output' END AS exclusion FROM notes"""


@P.sql
def promote_scan(q):
    """FP16: sources that may be promoted."""
    return f"WITH {notes(q)} SELECT id, title, created FROM notes WHERE zone = 'raw' ORDER BY created, id LIMIT 50"


@P.sql
def snippet_projection(q):
    """FP17: the first 160 characters with white space collapsed."""
    flat = f"trim({q.replace_all('body', '[ \\t\\n\\r]+', ' ')})"
    return f"WITH {notes(q)}, flat AS (SELECT id, {flat} AS f FROM notes) SELECT id, CASE WHEN length(f) > 160 THEN substr(f, 1, 160) || '…' ELSE f END AS snippet FROM flat"


@P.sql
def language_cap_policy(q):
    """FP18: at most three languages with a share of two hundredths and three notes; others stay labelled."""
    return """WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), s AS (SELECT lang, n, round(n / CAST(sum(n) OVER () AS DOUBLE), 4) AS share, row_number() OVER (ORDER BY n DESC, lang) AS r FROM n)
SELECT lang, n, share, (share >= 2e-2 AND n >= 3 AND r <= 3) AS selected FROM s"""


# joins and set operations


@P.sql
def representative_chunks(q):
    """JN2: each conversation with its first turn only."""
    return "SELECT c.conv_id, c.role, c.text, s.turns FROM conversations c JOIN (SELECT conv_id, min(turn) AS first_turn, count(*) AS turns FROM conversations GROUP BY conv_id) s ON s.conv_id = c.conv_id AND c.turn = s.first_turn"


@P.sql
def chunk_note_map(q):
    """JN3: vectors joined to their notes."""
    return f"WITH {notes(q)} SELECT e.vec_id, n.id, n.zone, e.label FROM embeddings e JOIN notes n ON n.doc_id = e.vec_id"


@P.sql
def identity_owners(q):
    """Towards JN4 (alias_owners has aliases): owners of a name by title, every sixth doubled as an alias."""
    return f"""WITH {notes(q)}, named AS (SELECT lower(title) AS name, id, 1 AS alias FROM notes WHERE doc_id % 6 = 0 UNION ALL SELECT lower(title), id, 0 FROM notes)
SELECT name, id, max(alias) AS by_alias FROM named WHERE name <> '' GROUP BY name, id"""


@P.sql
def identity_collisions(q):
    """JN4: names with several owners."""
    return f"WITH {notes(q)} SELECT lower(title) AS name, count(DISTINCT id) AS owners, min(id) AS first_owner FROM notes WHERE title <> '' GROUP BY lower(title) HAVING count(DISTINCT id) > 1"


@P.sql
def candidate_hydration(q):
    """JN5: candidate rows by a semi join."""
    return f"WITH {notes(q)} SELECT id, title, classification, path FROM notes WHERE doc_id IN (SELECT vec_id FROM embeddings WHERE label = 3)"


@P.sql
def link_target_resolution(q):
    """JN8: a target is an id, else a title, else a normalised name that one note owns."""
    norm = lambda x: f"trim({q.replace_all(f'lower({x})', '[^a-z0-9]+', ' ')})"
    return f"""WITH {notes(q)}, wanted AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN id WHEN doc_id % 4 = 1 THEN lower(title) WHEN doc_id % 4 = 2 THEN {norm('title')} ELSE 'no such note' END AS target FROM notes),
by_title AS (SELECT lower(title) AS name, min(doc_id) AS owner FROM notes WHERE title <> '' GROUP BY lower(title)),
by_norm AS (SELECT {norm('title')} AS name, min(doc_id) AS owner FROM notes GROUP BY 1 HAVING count(*) = 1)
SELECT w.doc_id, w.target, coalesce(i.doc_id, t.owner, m.owner) AS resolved FROM wanted w LEFT JOIN notes i ON i.id = w.target LEFT JOIN by_title t ON t.name = w.target LEFT JOIN by_norm m ON m.name = w.target AND w.target <> ''"""


@P.sql
def unreferenced_sources(q):
    """JN9: sources that no link leads to."""
    return f"WITH {notes(q)}, {edges(q)} SELECT n.id FROM notes n WHERE n.zone = 'raw' AND NOT EXISTS (SELECT 1 FROM edge e WHERE e.dst = n.doc_id)"


@P.sql
def filename_twins(q):
    """JN11: dated names that another name repeats without its date, where tiers differ."""
    return f"""WITH {notes(q)}, named AS (SELECT doc_id, classification, CASE WHEN doc_id % 2 = 0 THEN created || '-topic-' || {q.string('doc_id')} ELSE 'topic-' || {q.string('doc_id - 1')} END AS slug FROM notes)
SELECT a.doc_id AS dated, b.doc_id AS plain FROM named a JOIN named b ON {q.replace_all('a.slug', '^[0-9]{4}-[0-9]{2}-[0-9]{2}-', '')} = b.slug AND a.slug <> b.slug WHERE {tier_rank('a.classification')} <> {tier_rank('b.classification')}"""


@P.sql
def verdict_corrections(q):
    """JN12: verdicts with their corrections, and how many agree."""
    return f"""WITH verdict AS (SELECT doc_id, lang AS said FROM documents), fix AS (SELECT doc_id, CASE WHEN quality = 0 THEN 'junk' ELSE NULL END AS corrected FROM labels)
SELECT v.said, count(*) AS verdicts, count(f.doc_id) AS reviewed, count(f.corrected) AS corrected, {q.isum('CASE WHEN f.doc_id IS NULL THEN 1 ELSE 0 END')} AS excluded FROM verdict v LEFT JOIN fix f ON f.doc_id = v.doc_id GROUP BY v.said"""


@P.sql
def ledger_claim_status(q):
    """JN13: each claim's status against the ledger: no row, collision, no digest, mismatch or joined."""
    sha = q.sha("text")
    return f"""WITH ledger AS (SELECT 'p' || {q.string('doc_id % 300')} AS pid, CASE WHEN doc_id % 8 = 0 THEN NULL ELSE {sha} END AS digest, source AS category FROM documents WHERE doc_id % 2 = 0),
claim AS (SELECT 'p' || {q.string('doc_id')} AS pid, {sha} AS sha FROM documents),
g AS (SELECT pid, count(*) AS n, count(DISTINCT digest) AS d, count(DISTINCT category) AS c, max(digest) AS digest FROM ledger GROUP BY pid)
SELECT c.pid, CASE WHEN g.pid IS NULL THEN 'no-ledger-row' WHEN g.d > 1 OR g.c > 1 OR g.n > 1 THEN 'collision' WHEN g.digest IS NULL THEN 'no-digest' WHEN g.digest <> c.sha THEN 'digest-mismatch' ELSE 'joined' END AS status FROM claim c LEFT JOIN g ON g.pid = c.pid"""


@P.sql
def run_pairing(q):
    """JN14: two runs joined where both were judged."""
    return "SELECT a.doc_id, a.quality AS current_grade, b.toxic AS new_grade FROM labels a JOIN labels b ON a.doc_id = b.doc_id WHERE a.quality IS NOT NULL AND b.toxic IS NOT NULL"


@P.sql
def dossier_tensions(q):
    """JN15: live notes of the same language that are newer than a decision: a range join, as running totals over dates."""
    return f"""WITH {notes(q)}, v AS (SELECT id, type, lang, {VALID_DATE} AS d, CASE WHEN type <> 'decision' AND is_latest_version IS DISTINCT FROM 'false' THEN 1 ELSE 0 END AS live FROM notes),
day AS (SELECT lang, d, {q.isum('live')} AS n, min(CASE WHEN live = 1 THEN id END) AS first_id, max(CASE WHEN live = 1 THEN d END) AS newest FROM v WHERE d <> '' GROUP BY lang, d),
later AS (SELECT lang, d, sum(n) OVER w AS newer, min(first_id) OVER w AS first_id, max(newest) OVER w AS newest FROM day WINDOW w AS (PARTITION BY lang ORDER BY d DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT x.id AS decision_id, CAST(l.newer AS BIGINT) AS newer, l.first_id, l.newest FROM v x JOIN later l ON l.lang = x.lang AND l.d = x.d WHERE x.type = 'decision' AND l.newer > 0"""


@P.sql
def variant_union(q):
    """JN16: variants of a query, each identity once, in the order of first appearance, four at most."""
    return f"""WITH {notes(q)}, v AS (SELECT doc_id, lower(trim(title)) AS name FROM notes), u AS (SELECT name, min(doc_id) AS first_at FROM v WHERE name <> '' GROUP BY name)
SELECT name, CAST(row_number() OVER (ORDER BY first_at) AS BIGINT) AS place FROM u ORDER BY first_at LIMIT 4"""


def shingle_rows(q, table: str, key: str, text: str, w: int, where: str = "true") -> str:
    """(key, s): the distinct w-word shingles of a text column.

    Spark makes them 64-bit hashes, distinct within the row: nothing is shuffled, and no text leaves a row."""
    if q.name == "spark":
        return f"(SELECT {key}, s FROM (SELECT {key}, {shingle_hashes(q, 't', w)} AS g FROM {token_rows(q, table, text, key, 't', where)} x) y, {q.unnest('g', 'u(s)')})"
    words = q.transform(q.seq("1", f"{q.size('t')} - {w - 1}"), "i", f"array_to_string({q.slice('t', 'i', str(w))}, ' ')")
    return f"(SELECT DISTINCT {key}, s FROM (SELECT {key}, {tokens(q, text)} AS t FROM {table} WHERE {where}) x, {q.unnest(words, 'u(s)')})"


def shingle_hashes(q, words: str, w: int) -> str:
    """Spark: the distinct hashes of a word array's w-word shingles."""
    return q.distinct(q.transform(q.seq("1", f"{q.size(words)} - {w - 1}"), "i", f"xxhash64({q.slice(words, 'i', str(w))})"))


@P.sql
def shingle_difference(q):
    """JN17: shingles of a block that its row lacks; a shared one is a hit."""
    a = shingle_rows(q, "benchmark", "item_id", "text", 5)
    b = shingle_rows(q, "documents", "doc_id", "text", 5)
    return f"WITH a AS {a}, b AS (SELECT DISTINCT s FROM {b} y) SELECT a.item_id, count(*) AS shingles, count(b.s) AS shared, count(*) - count(b.s) AS own FROM a LEFT JOIN b ON a.s = b.s GROUP BY a.item_id"


@P.sql
def as_of_join(q):
    """JN18: each order with its customer's latest event before it."""
    if q.name == "spark":
        return """WITH o AS (SELECT o_orderkey, o_custkey % 150 AS u, o_orderdate AS ts FROM orders), both AS (SELECT u, ts, o_orderkey, CAST(NULL AS BIGINT) AS event_id, 1 AS side FROM o UNION ALL SELECT user_id % 150, ts - INTERVAL 27 YEARS, NULL, event_id, 0 FROM events),
w AS (SELECT *, last_value(event_id) IGNORE NULLS OVER (PARTITION BY u ORDER BY ts, side, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prev FROM both) SELECT o_orderkey, prev AS event_id FROM w WHERE side = 1"""
    return """WITH o AS (SELECT o_orderkey, o_custkey % 150 AS u, o_orderdate AS ts FROM orders), e AS (SELECT user_id % 150 AS u, ts - INTERVAL 27 YEARS AS ts, event_id FROM events),
g AS (SELECT u, ts, max(event_id) AS event_id FROM e GROUP BY u, ts) SELECT o.o_orderkey, g.event_id FROM o ASOF LEFT JOIN g ON o.u = g.u AND o.ts >= g.ts"""


@P.sql
def interval_join(q):
    """JN18: events within six hours after another of the same user, joined over the hours as buckets."""
    return f"""WITH e AS (SELECT event_id, user_id, event_type, {q.epoch('ts')} AS us FROM events), b AS (SELECT *, CAST(floor(us / 216e8) AS BIGINT) AS bucket FROM e),
l AS (SELECT event_id, user_id, us, bucket + d AS bucket FROM b, {q.unnest(q.seq('0', '1'), 't(d)')} WHERE event_type = 'purchase')
SELECT l.event_id, count(*) AS followers FROM l JOIN b ON b.user_id = l.user_id AND b.bucket = l.bucket AND b.us > l.us AND b.us <= l.us + 21600000000 GROUP BY l.event_id"""


@P.sql
def full_outer_sets(q):
    """JN18: a full outer join of two key sets."""
    return "SELECT coalesce(c.o_custkey, u.user_id) AS k, c.n AS orders, u.n AS events FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) c FULL OUTER JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) u ON c.o_custkey = u.user_id"


@P.sql
def set_operations(q):
    """JN18: union, intersection and difference of key sets."""
    return """SELECT 'union' AS op, count(*) AS n FROM (SELECT o_custkey FROM orders UNION SELECT user_id FROM events) a UNION ALL
SELECT 'intersect', count(*) FROM (SELECT o_custkey FROM orders INTERSECT SELECT user_id FROM events) b UNION ALL SELECT 'except', count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT user_id FROM events) c"""


@P.sql
def grouping_sets(q):
    """Totals over several groupings at once."""
    return "SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) + 2 * grouping(l_linestatus) AS BIGINT) AS level, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())"


@P.sql
def rollup_totals(q):
    return "SELECT r_name, n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)"


@P.sql
def cube_totals(q):
    return "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)"


@P.sql
def pricing_summary(q):
    return "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus"


@P.sql
def top_per_group(q):
    return "SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) x WHERE r <= 3"


@P.sql
def chunk_scalars(q):
    """SC9, SC11: rows of a table as Markdown."""
    return f"SELECT r_regionkey, '| ' || {q.string('r_regionkey')} || ' | ' || r_name || ' |' AS md FROM region"


@P.sql
def vault_scan_filters(q):
    """SC1: paths that a scan takes."""
    return f"WITH {notes(q)} SELECT path FROM notes WHERE path LIKE '%.md' AND path NOT LIKE 'inbox/%' AND path NOT LIKE 'overlay/%' AND NOT {q.contains('path', "'/src7/'")} ORDER BY path"


@P.sql
def note_hashes(q):
    """SC2: content hashes and the fallback id."""
    return f"WITH {notes(q)} SELECT coalesce(nullif(id, ''), path) AS id, {q.sha('body')} AS sha256, {q.sha("title || chr(10) || body")} AS content_hash FROM notes"


@P.sql
def handler_dispatch(q):
    """SC5: handlers by extension."""
    return f"""WITH f AS (SELECT page_id, lower({q.extract('url', r'\.([A-Za-z0-9]+)(?:[?#].*)?$', 1)}) AS ext FROM pages) SELECT page_id, CASE WHEN ext = 'html' THEN 'html' WHEN ext IN ('pdf') THEN 'pdf' WHEN ext IN ('txt', 'md', 'csv') THEN 'text' ELSE 'web' END AS handler FROM f"""


@P.sql
def html_extract(q):
    """SC6: title and text of a page without scripts, styles and tags (the form that both engines share)."""
    body = "html"
    for p, to in ((r"(?s)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>", " "), (r"(?s)<!--.*?-->", " "), (r"(?i)</?(p|br|div|h[1-6]|li|ul|article|nav|footer|title|head|body)[^>]*>", "\n"), (r"<[^>]*>", ""), (r"[ \t]+", " "), (r"\n{3,}", "\n\n")):
        to_sql = {"\n": "chr(10)", "\n\n": "chr(10) || chr(10)"}.get(to)
        body = (f"regexp_replace({body}, {q.lit(p)}, {to_sql}" + (", 'g')" if q.name == "duckdb" else ")")) if to_sql else q.replace_all(body, p, to)
    return f"SELECT page_id, {q.extract('html', '(?s)<title>(.*?)</title>', 1)} AS title, trim({body}) AS body FROM pages"


@P.sql
def transcript_ingest(q):
    """SC12: conversations as one transcript each."""
    turns = q.collect_sorted("lpad(" + q.string("turn") + ", 6, '0') || ' ' || role || ': ' || text")
    return f"SELECT conv_id, count(*) AS turns, {q.sha(q.join(turns, '|'))} AS digest FROM conversations GROUP BY conv_id"


@P.sql
def health_history(q):
    """SC15: live and rotated segments together, the last record of each run."""
    return f"""WITH h AS (SELECT event_id % 400 AS run_id, event_id AS seq, ts, value, 'live' AS seg FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id % 400, event_id, ts, value, 'rotated' FROM events WHERE event_id % 2 = 1 AND ts >= TIMESTAMP '2024-01-16 00:00:00')
SELECT run_id, seq, seg, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS r FROM h) x WHERE r = 1"""


@P.sql
def vault_diff_sync(q):
    """SK2: a full outer reconcile by path into added, updated, unchanged, deleted and rebased."""
    sha = q.sha("text")
    return f"""WITH old AS (SELECT source || '/' || {q.string('doc_id')} AS path, {sha} AS h FROM documents WHERE doc_id % 10 <> 1),
new AS (SELECT CASE WHEN doc_id % 10 = 2 THEN 'moved/' ELSE '' END || source || '/' || {q.string('doc_id')} AS path, CASE WHEN doc_id % 10 = 4 THEN {q.sha("text || 'x'")} ELSE {sha} END AS h FROM documents WHERE doc_id % 10 <> 3),
j AS (SELECT o.path AS op, n.path AS np, o.h AS oh, n.h AS nh FROM old o FULL OUTER JOIN new n ON o.path = n.path),
gone AS (SELECT op, oh, row_number() OVER (PARTITION BY oh ORDER BY op) AS r FROM j WHERE np IS NULL), came AS (SELECT np, nh, row_number() OVER (PARTITION BY nh ORDER BY np) AS r FROM j WHERE op IS NULL),
moved AS (SELECT gone.op, came.np FROM gone JOIN came ON gone.oh = came.nh AND gone.r = came.r)
SELECT coalesce(j.np, j.op) AS path, CASE WHEN j.op IS NOT NULL AND j.np IS NOT NULL THEN CASE WHEN j.oh = j.nh THEN 'unchanged' ELSE 'updated' END WHEN j.op IS NULL THEN CASE WHEN m1.np IS NOT NULL THEN 'rebased' ELSE 'added' END ELSE 'deleted' END AS action
FROM j LEFT JOIN moved m1 ON m1.np = j.np LEFT JOIN moved m2 ON m2.op = j.op WHERE NOT (j.np IS NULL AND m2.op IS NOT NULL)"""


@P.sql
def vault_fingerprint(q):
    """SK3: one digest of all paths and hashes: of 4,096 buckets of paths each, and then of the buckets in order."""
    pairs = q.join(q.collect_sorted("p"), "|")
    return f"""WITH {notes(q)}, p AS (SELECT substr({q.sha('path')}, 1, 3) AS bucket, path || ':' || {q.sha('body')} AS p FROM notes), d AS (SELECT bucket, count(*) AS n, {q.sha(pairs)} AS h FROM p GROUP BY bucket)
SELECT {q.isum('n')} AS notes, {q.sha(q.join(q.collect_sorted("bucket || h"), '|'))} AS fingerprint FROM d"""


@P.sql
def supersede_transition(q):
    """SK5: both sides of a supersession."""
    return f"""WITH {notes(q)}, s AS (SELECT id AS old_id, superseded_by AS new_id FROM notes WHERE superseded_by IS NOT NULL)
SELECT n.id, CASE WHEN a.old_id IS NOT NULL THEN 'false' ELSE coalesce(n.is_latest_version, 'true') END AS is_latest_version, a.new_id AS superseded_by, b.old_id AS previous_version FROM notes n LEFT JOIN s a ON a.old_id = n.id LEFT JOIN (SELECT new_id, min(old_id) AS old_id FROM s GROUP BY new_id) b ON b.new_id = n.id"""


@P.sql
def month_retention(q):
    """SK9: months before the cutoff are dropped whole."""
    return f"SELECT substr({q.string(q.date('o_orderdate'))}, 1, 7) AS month, count(*) AS n, substr({q.string(q.date('o_orderdate'))}, 1, 7) < '1998-05' AS expired FROM orders GROUP BY substr({q.string(q.date('o_orderdate'))}, 1, 7)"


@P.sql
def tier_projection(q):
    """SK10: rows copied under a cap, and counts of the rest."""
    r = tier_rank("classification")
    return f"WITH {notes(q)} SELECT zone, {q.isum(f'CASE WHEN {r} <= 1 THEN 1 ELSE 0 END')} AS copied, {q.isum(f'CASE WHEN {r} > 1 THEN 1 ELSE 0 END')} AS excluded, {q.isum('CASE WHEN classification IS NULL THEN 1 ELSE 0 END')} AS unlabelled FROM notes GROUP BY zone"


@P.sql
def backlinks(q):
    """SK11: the distinct sources of each target, in order."""
    return f"WITH {edges(q)} SELECT dst, count(DISTINCT src) AS sources, {q.join(q.transform(q.collect_set_sorted('src'), 'x', q.string('x')), ',')} AS backlinks FROM edge GROUP BY dst"


@P.sql
def token_counts(q):
    """Terms and their document frequencies."""
    return f"SELECT t AS term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM documents, {q.unnest(tokens(q, 'text'), 'u(t)')} GROUP BY t"


QUERIES, ORACLE = P.queries, P.oracle
__all__ = ["ORACLE", "QUERIES", "TOKEN", "shingle_rows"]

"""Ranked retrieval, duplicates and versions, links between notes, and scalar functions."""

from __future__ import annotations

from vaultspark.api import TEMPORAL
from vaultspark.operators.lexical import bucket_of
from vaultspark.plans.dialect import TOKEN, VALID_DATE, Plans, edges, notes, tier_rank, token_rows, tokens
from vaultspark.plans.structured import shingle_hashes, shingle_rows

P = Plans()

#: BM25 as published; reciprocal ranks are fused over this constant.
K1, B, FUSE = 1.2, 0.75, 3
#: The query of the examples: words of the corpus.
QUERY = ("the", "and", "der", "les")


# ranking


def bm25(q, terms=QUERY) -> str:
    """bm25 (doc_id, score): the Robertson-Sparck Jones idf and saturated term frequencies."""
    asked = ", ".join(f"'{t}'" for t in terms)
    if q.name == "spark":  # the asked terms' postings and document counts of the stored index
        mine = f"bucket IN ({', '.join(sorted({str(bucket_of(t)) for t in terms}))}) AND term IN ({asked})"
        return f"""tf AS (SELECT key AS doc_id, term AS t, CAST(tf AS BIGINT) AS tf, dl FROM lexical_postings WHERE {mine}), df AS (SELECT term AS t, sum(n) AS df FROM lexical_maxima WHERE {mine} GROUP BY term), stat AS (SELECT n, avgdl FROM lexical_stat),
bm25 AS (SELECT tf.doc_id, round(sum(ln(1 + (n - df + 5e-1) / (df + 5e-1)) * tf * {K1 + 1:.1f} / (tf + {K1} * (1 - {B} + {B} * dl / avgdl))), 6) AS score FROM tf JOIN df ON df.t = tf.t, stat GROUP BY tf.doc_id)"""
    return f"""tok AS (SELECT doc_id, t FROM documents, {q.unnest(tokens(q, 'text'), 'u(t)')}),
dl AS (SELECT doc_id, count(*) AS dl FROM tok GROUP BY doc_id), stat AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS avgdl FROM dl),
tf AS (SELECT doc_id, t, count(*) AS tf FROM tok WHERE t IN ({asked}) GROUP BY doc_id, t), df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
bm25 AS (SELECT tf.doc_id, round(sum(ln(1 + (n - df + 5e-1) / (df + 5e-1)) * tf * {K1 + 1:.1f} / (tf + {K1} * (1 - {B} + {B} * dl / avgdl))), 6) AS score FROM tf JOIN df ON df.t = tf.t JOIN dl ON dl.doc_id = tf.doc_id, stat GROUP BY tf.doc_id)"""


def dense(q, vec: int = 0) -> str:
    """knn (doc_id, score): cosines of all vectors to one."""
    return f"knn AS (SELECT e.vec_id AS doc_id, round({q.dot('e.embedding', 'z.embedding')} / sqrt({q.dot('e.embedding', 'e.embedding')} * {q.dot('z.embedding', 'z.embedding')}), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = {vec}) z)"


def legs(q, n: int = 80) -> str:
    """leg (leg, doc_id, rank, score): the first n of each leg."""
    return f"""{bm25(q)}, {dense(q)}, leg AS (SELECT * FROM (SELECT 'lexical' AS leg, doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, score FROM bm25) a WHERE rank <= {n}
UNION ALL SELECT * FROM (SELECT 'dense' AS leg, doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, score FROM knn) b WHERE rank <= {n})"""


def fused(q) -> str:
    """fused (doc_id, rrf, lexical_rank, dense_rank, sim)."""
    return f"""{legs(q)}, fused AS (SELECT doc_id, sum(1e0 / ({FUSE} + rank)) AS rrf, max(CASE WHEN leg = 'lexical' THEN rank END) AS lexical_rank, max(CASE WHEN leg = 'dense' THEN rank END) AS dense_rank, max(CASE WHEN leg = 'dense' THEN score END) AS sim FROM leg GROUP BY doc_id)"""


def recency(q, date: str, weight: str = "25e-2", half: int = 180) -> str:
    """The recency prior of a date text: one for undated and future notes, and 1 - weight for the very old."""
    d = q.try_date(date)
    age = q.days("DATE '2025-01-01'", d)
    return f"CASE WHEN {d} IS NULL OR {age} < 0 THEN 1e0 ELSE 1 - {weight} * (1 - power(5e-1, {age} / {half}e0)) END"


@P.sql
def bm25_lexical(q):
    """WN4"""
    return f"WITH {bm25(q)} SELECT doc_id, score FROM bm25"


@P.sql
def dense_knn(q):
    """WN5"""
    return f"WITH {dense(q)} SELECT doc_id, score FROM knn ORDER BY score DESC, doc_id LIMIT 20"


@P.sql
def rrf_fusion(q):
    """WN2, WN3, WN18: both legs fused by reciprocal rank, with the source of each hit."""
    return f"WITH {fused(q)} SELECT doc_id, round(rrf, 6) AS score, CASE WHEN lexical_rank IS NOT NULL AND dense_rank IS NOT NULL THEN 'both' WHEN lexical_rank IS NOT NULL THEN 'lexical' ELSE 'semantic' END AS source FROM fused"


@P.sql
def hybrid_search(q):
    """WN1: legs, fusion, recency, the cut, and then the tier cap. Zone weights are neutral unless set (zone_prior)."""
    return f"""WITH {notes(q)}, {fused(q)}, prior AS (SELECT f.*, n.id, n.classification, f.rrf * {recency(q, VALID_DATE)} AS s FROM fused f JOIN notes n ON n.doc_id = f.doc_id),
cut AS (SELECT id, classification, round(s, 6) AS score FROM prior ORDER BY round(s, 6) DESC, doc_id LIMIT 40) SELECT id, score FROM cut WHERE {tier_rank('classification')} <= 2"""


@P.sql
def exact_identity_leg(q):
    """Towards WN6 (alias_owners has aliases, too): owners of a title, live ones first, then zone, date and id."""
    return f"""WITH {notes(q)}, o AS (SELECT lower(title) AS name, id, CASE WHEN is_latest_version = 'false' THEN 1 ELSE 0 END AS retired, CASE WHEN zone = 'brain' THEN 0 ELSE 1 END AS z, {VALID_DATE} AS d FROM notes WHERE title <> '')
SELECT name, id, CAST(r AS BIGINT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY retired, z, d DESC, id) AS r FROM o) x WHERE r <= 16"""


@P.sql
def title_phrase_eligible(q):
    """WN7: whether a query of a title's first two words is long enough to match it as a phrase."""
    return f"""WITH {notes(q)}, t AS (SELECT doc_id, {tokens(q, 'title')} AS w FROM notes), p AS (SELECT t.doc_id, t.w, {q.slice('t.w', '1', '2')} AS ask FROM t) SELECT doc_id, {q.size('w')} AS words, {q.size('ask')} >= 2 AND {q.size('ask')} < {q.size('w')} AND {q.size('ask')} / CAST({q.size('w')} AS DOUBLE) >= 6e-1 AS eligible FROM p"""


@P.sql
def zone_prior(q):
    """WN8: zone weights act on dense-only hits."""
    return f"WITH {notes(q)}, {fused(q)} SELECT f.doc_id, round(f.rrf * CASE WHEN f.lexical_rank IS NULL THEN CASE n.zone WHEN 'brain' THEN 3e0 ELSE 1e0 END ELSE 1e0 END, 6) AS score FROM fused f JOIN notes n ON n.doc_id = f.doc_id"


@P.sql
def recency_prior(q):
    """WN9, WN10: both settings of the recency prior."""
    return f"WITH {notes(q)} SELECT id, round({recency(q, VALID_DATE)}, 6) AS factor, round({recency(q, VALID_DATE, '5e-1', 90)}, 6) AS factor_temporal FROM notes"


@P.sql
def temporal_intent(q):
    """WN10: texts that ask for what is recent."""
    edge = r"[^\p{L}\p{N}_]"
    return f"SELECT conv_id, turn, {q.matches('lower(text)', f'(^|{edge})({TEMPORAL})({edge}|$)')} AS temporal FROM conversations"


@P.sql
def duplicate_family_collapse(q):
    """Towards WN11 (operators.search.family_canonicals follows version chains; vault_search runs it): hits with equal bodies fold to one note at the best rank."""
    return f"""WITH {notes(q)}, {legs(q)}, fam AS (SELECT doc_id, {q.sha('body')} AS h, zone, type, {tier_rank('classification')} AS tr, {q.octets('body')} AS size, path, is_latest_version FROM notes),
f AS (SELECT l.leg, l.rank, l.doc_id, CASE WHEN f.size >= 1024 THEN f.h || f.zone || f.type || {q.string('f.tr')} ELSE {q.string('l.doc_id')} END AS family, f.is_latest_version, f.path FROM leg l JOIN fam f ON f.doc_id = l.doc_id)
SELECT leg, family, CAST(min(rank) AS BIGINT) AS rank, count(*) AS members, min(CASE WHEN is_latest_version = 'false' THEN '1' ELSE '0' END || lpad({q.string('length(path)')}, 4, '0') || lpad({q.string('doc_id')}, 12, '0')) AS canonical FROM f GROUP BY leg, family"""


@P.sql
def identity_pin(q):
    """WN13: a name with one owner is pinned to the first place."""
    return f"""WITH {notes(q)}, {fused(q)}, o AS (SELECT lower(title) AS name, min(doc_id) AS doc_id FROM notes GROUP BY lower(title) HAVING count(*) = 1), pin AS (SELECT min(o.doc_id) AS doc_id FROM o JOIN fused f ON f.doc_id = o.doc_id)
SELECT f.doc_id, CAST(row_number() OVER (ORDER BY CASE WHEN f.doc_id = p.doc_id THEN 0 ELSE 1 END, round(f.rrf, 9) DESC, f.doc_id) AS BIGINT) AS place FROM fused f, pin p"""


@P.sql
def collision_slots(q):
    """WN14: owners of one name keep the group's places and fill them in their own order."""
    return f"""WITH {fused(q)}, r AS (SELECT doc_id, CAST(row_number() OVER (ORDER BY round(rrf, 9) DESC, doc_id) AS BIGINT) AS place, CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS owner FROM fused), s AS (SELECT place, row_number() OVER (ORDER BY place) AS k FROM r WHERE owner = 1), o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC) AS k FROM r WHERE owner = 1)
SELECT doc_id, place FROM r WHERE owner = 0 UNION ALL SELECT o.doc_id, s.place FROM o JOIN s ON s.k = o.k"""


@P.sql
def rerank_noop(q):
    """WN15: without a model the head keeps its order; passages are cut at 2,000 characters."""
    return f"WITH {fused(q)}, r AS (SELECT doc_id, row_number() OVER (ORDER BY round(rrf, 9) DESC, doc_id) AS place FROM fused) SELECT r.doc_id, CAST(r.place AS BIGINT) AS place, CAST(length(substr(d.text, 1, 2000)) AS BIGINT) AS passage FROM r JOIN documents d ON d.doc_id = r.doc_id WHERE r.place <= 20"


@P.sql
def evidence_labels(q):
    """WN16, WN17: the strongest evidence of each hit for a note's title as the query, and whether a new note would repeat it.

    A title, then most of a title in one piece, then the phrase in the text, then a near vector. Only a title that one note owns exists."""
    words = lambda x: f"CAST({q.size(tokens(q, x))} AS DOUBLE)"
    spaced = lambda x: f"(' ' || lower({x}) || ' ')"
    return f"""WITH {notes(q)}, {fused(q)}, ask AS (SELECT lower(trim(title)) AS ask FROM notes WHERE doc_id = 2), own AS (SELECT count(*) AS owners FROM notes n, ask WHERE lower(trim(n.title)) = ask.ask),
hit AS (SELECT doc_id FROM fused UNION SELECT n.doc_id FROM notes n, ask WHERE lower(trim(n.title)) = ask.ask OR {q.contains(spaced('n.title'), spaced('ask.ask'))}),
e AS (SELECT h.doc_id, CASE WHEN lower(trim(n.title)) = a.ask THEN 'exact_title_match' WHEN {words('a.ask')} >= 2 AND {words('a.ask')} < {words('n.title')} AND {words('a.ask')} / {words('n.title')} >= 6e-1 AND {q.contains(spaced('n.title'), spaced('a.ask'))} THEN 'title_phrase_match'
WHEN {q.contains(spaced(q.replace_all('n.body', '[^0-9A-Za-z]+', ' ')), spaced('a.ask'))} THEN 'keyword_exact' WHEN f.dense_rank <= 3 AND f.sim >= 8e-1 THEN 'high_vector_match' ELSE 'weak_semantic' END AS evidence
FROM hit h JOIN notes n ON n.doc_id = h.doc_id LEFT JOIN fused f ON f.doc_id = h.doc_id, ask a)
SELECT e.doc_id, e.evidence, CASE e.evidence WHEN 'exact_title_match' THEN CASE WHEN o.owners = 1 THEN 'exists' ELSE 'probable' END WHEN 'weak_semantic' THEN 'unknown' ELSE 'probable' END AS create_safety FROM e, own o"""


@P.sql
def fanout_rrf(q):
    """WN16, WN19: variants of a query fused over 60."""
    one = "SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM {}"
    return f"""WITH {bm25(q)}, {dense(q)}, k2 AS (SELECT e.vec_id AS doc_id, round({q.dot('e.embedding', 'z.embedding')}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) z),
v AS ({one.format('bm25')} UNION ALL {one.format('knn')} UNION ALL {one.format('k2')}) SELECT doc_id, round(sum(1e0 / (60 + r)), 6) AS score FROM v WHERE r <= 50 GROUP BY doc_id"""


@P.sql
def multi_hop_fusion(q):
    """Towards WN20 (gated_multi_hop has the gate and the walk): flat and neighbours' results fused with weights of one and one half."""
    return f"""WITH {fused(q)}, {edges(q)}, flat AS (SELECT doc_id, row_number() OVER (ORDER BY round(rrf, 9) DESC, doc_id) AS r FROM fused), seed AS (SELECT doc_id FROM flat WHERE r <= 5), hop AS (SELECT e.dst AS doc_id, count(*) AS n FROM edge e JOIN seed s ON s.doc_id = e.src GROUP BY e.dst),
g AS (SELECT doc_id, row_number() OVER (ORDER BY n DESC, doc_id) AS r FROM hop) SELECT doc_id, round(sum(w / (60 + r)), 6) AS score FROM (SELECT doc_id, r, 1e0 AS w FROM flat WHERE r <= 40 UNION ALL SELECT doc_id, r, 5e-1 FROM g) u GROUP BY doc_id"""


@P.sql
def dossier(q):
    """WN21: decisions and sources among the live hits, capped."""
    return f"""WITH {notes(q)}, {fused(q)}, h AS (SELECT n.id, n.doc_id, n.type, f.rrf, n.is_latest_version FROM fused f JOIN notes n ON n.doc_id = f.doc_id), r AS (SELECT id, CASE WHEN type = 'decision' THEN 'decision' ELSE 'source' END AS part, row_number() OVER (PARTITION BY CASE WHEN type = 'decision' THEN 1 ELSE 0 END ORDER BY round(rrf, 9) DESC, doc_id) AS place FROM h WHERE is_latest_version IS DISTINCT FROM 'false')
SELECT id, part, CAST(place AS BIGINT) AS place FROM r WHERE (part = 'decision' AND place <= 5) OR (part = 'source' AND place <= 10)"""


@P.sql
def revisit_sample(q):
    """WN22: old and well linked notes."""
    return f"WITH {notes(q)}, {edges(q)}, deg AS (SELECT dst, count(*) AS n FROM edge GROUP BY dst), s AS (SELECT n.id, {q.days("DATE '2025-01-01'", q.try_date('n.created'))} * (coalesce(d.n, 0) + 1) AS score FROM notes n LEFT JOIN deg d ON d.dst = n.doc_id) SELECT id, score FROM s ORDER BY score DESC, id LIMIT 20"


@P.sql
def search_explain(q):
    """WN23: each hit's ranks and what each leg gave."""
    return f"WITH {fused(q)} SELECT doc_id, CAST(lexical_rank AS BIGINT) AS lexical_rank, CAST(dense_rank AS BIGINT) AS dense_rank, round(coalesce(1e0 / ({FUSE} + lexical_rank), 0), 6) AS lexical_part, round(coalesce(1e0 / ({FUSE} + dense_rank), 0), 6) AS dense_part, round(rrf, 6) AS total FROM fused"


@P.sql
def exploration_samples(q):
    """WN24: one in eight, by hash."""
    return f"WITH h AS (SELECT doc_id, {q.sha('source || ' + q.string('doc_id'))} AS h FROM documents) SELECT doc_id FROM h WHERE {q.hex_mod('h', 8)} = 0"


# links


@P.sql
def wikilink_parse(q):
    """GR1: targets of links in texts, each once (texts with links made from titles)."""
    body = "'see [[' || title || ']] and [[' || id || '|name]] or [[' || id || '#part]] ' || body"
    target = q.sort(q.distinct(q.transform(q.extract_all("b", r"\[\[([^\]\n|#]+)[^\]\n]*\]\]", 1), "x", "trim(x)")))
    return f"WITH {notes(q)}, w AS (SELECT doc_id, {body} AS b FROM notes) SELECT doc_id, {q.join(target, ';')} AS targets, {q.size(target)} AS n FROM w"


@P.sql
def link_graph(q):
    """GR2: resolved edges without loops, and unresolved ones."""
    return f"WITH {edges(q)} SELECT e.src, e.dst, d.doc_id IS NOT NULL AS resolved FROM edge e LEFT JOIN documents d ON d.doc_id = e.dst"


def hops(q, depth: int = 3) -> str:
    out = f"{edges(q)}, both_ways AS (SELECT src AS a, dst AS b FROM edge UNION SELECT dst, src FROM edge), h0 AS (SELECT doc_id AS v, 0 AS hop FROM documents WHERE doc_id IN (1, 2))"
    for i in range(1, depth + 1):
        out += f", h{i} AS (SELECT v, min(hop) AS hop FROM (SELECT v, hop FROM h{i - 1} UNION ALL SELECT w.b, h.hop + 1 FROM h{i - 1} h JOIN both_ways w ON w.a = h.v) x GROUP BY v)"
    return out


@P.sql
def wikilink_bfs(q):
    """GR3: hop distances from seeds, up to three."""
    return f"WITH {hops(q)} SELECT v, hop FROM h3 WHERE hop > 0"


def ppr(q, rounds: int = 8) -> str:
    """p<rounds> (v, p): personalised ranks after some rounds; dangling mass goes to the seeds."""
    out = f"{edges(q)}, both_ways AS (SELECT src AS a, dst AS b FROM edge UNION SELECT dst, src FROM edge), deg AS (SELECT a, CAST(count(*) AS DOUBLE) AS n FROM both_ways GROUP BY a), seed AS (SELECT doc_id AS v FROM documents WHERE doc_id IN (1, 2)), p0 AS (SELECT v, 5e-1 AS p FROM seed)"
    for i in range(1, rounds + 1):
        last = f"p{i - 1}"
        out += f""", p{i} AS (SELECT v, sum(p) AS p FROM (SELECT w.b AS v, 85e-2 * x.p / d.n AS p FROM {last} x JOIN both_ways w ON w.a = x.v JOIN deg d ON d.a = x.v
UNION ALL SELECT s.v, (15e-2 + 85e-2 * m.lost) / 2 FROM seed s, (SELECT coalesce(sum(CASE WHEN d.n IS NULL THEN x.p END), 0) AS lost FROM {last} x LEFT JOIN deg d ON d.a = x.v) m) y GROUP BY v)"""
    return out


@P.sql
def personalized_pagerank(q):
    """GR4: a few rounds as one plan (operators.graph has the loop with its tolerance)."""
    return f"WITH {ppr(q, 3)} SELECT v, round(p, 6) AS p FROM p3 WHERE round(p, 6) > 0"


@P.sql
def graph_expand(q):
    """GR5: neighbours of the seeds by rank after three rounds, then hop 1 (graph_expand_converged has both loops)."""
    both = ppr(q, 3)
    return f"WITH {both}, near AS (SELECT DISTINCT w.b AS v FROM both_ways w JOIN seed s ON s.v = w.a) SELECT p.v, round(p.p, 6) AS score, CASE WHEN n.v IS NULL THEN 99 ELSE 1 END AS hop FROM p3 p LEFT JOIN near n ON n.v = p.v WHERE p.v NOT IN (1, 2) ORDER BY round(p.p, 6) DESC, hop, p.v LIMIT 25"


@P.sql
def graph_hygiene(q):
    """GR7: orphans, links and dangling targets by zone."""
    return f"WITH {notes(q)}, {edges(q)}, t AS (SELECT src AS v FROM edge UNION SELECT dst FROM edge) SELECT n.zone, count(*) AS notes, count(CASE WHEN t.v IS NULL THEN 1 END) AS orphans FROM notes n LEFT JOIN t ON t.v = n.doc_id GROUP BY n.zone"


@P.sql
def entity_mentions(q):
    """GR9: texts that name entities of a lexicon as whole words; two different ones fire."""
    return f"""WITH {notes(q)}, lex AS (SELECT DISTINCT lower({q.extract('title', r'([\p{L}]{5,})', 1)}) AS surface FROM notes WHERE type = 'person'), w AS (SELECT DISTINCT doc_id, t FROM documents, {q.unnest(tokens(q, 'text'), 'u(t)')})
SELECT w.doc_id, count(*) AS entities, count(*) >= 2 AS fires FROM w JOIN lex ON lex.surface = w.t WHERE lex.surface <> '' GROUP BY w.doc_id"""


@P.sql
def bridge_boost(q):
    """GR11: shared neighbours of linked notes, three at most, and a recency boost."""
    return f"""WITH {notes(q)}, {edges(q)}, near AS (SELECT src, {q.collect('dst')} AS d FROM edge GROUP BY src)
SELECT e.src, e.dst, round(5e-2 * least(coalesce({q.size(q.intersect('a.d', 'b.d'))}, 0), 3) + greatest(0e0, 1e-1 * (1 - {q.days("DATE '2025-01-01'", q.try_date('n.updated'))} / 730e0)), 6) AS boost FROM edge e JOIN notes n ON n.doc_id = e.src JOIN near a ON a.src = e.src LEFT JOIN near b ON b.src = e.dst"""


@P.sql
def artifact_validation(q):
    """GR13: nodes beyond the degree cap."""
    return f"WITH {edges(q)} SELECT src, count(*) AS degree FROM edge GROUP BY src HAVING count(*) > 2"


@P.sql
def link_report(q):
    """GR15: the best linked notes."""
    return f"WITH {edges(q)}, d AS (SELECT v, count(*) AS degree FROM (SELECT src AS v FROM edge UNION ALL SELECT dst FROM edge) x GROUP BY v) SELECT v, degree FROM d ORDER BY degree DESC, v LIMIT 20"


# duplicates and versions


@P.sql
def cosine_similarity(q):
    """DD2: cosines to one vector; zero for zero norms."""
    n = f"sqrt({q.dot('a.embedding', 'a.embedding')} * {q.dot('b.embedding', 'b.embedding')})"
    return f"SELECT a.vec_id, round(CASE WHEN {n} = 0 THEN 0 ELSE {q.dot('a.embedding', 'b.embedding')} / {n} END, 6) AS cos FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 3) b"


@P.sql
def token_stream(q):
    """DD3"""
    return f"SELECT doc_id, {q.size(tokens(q, 'text'))} AS tokens, {q.sha(q.join(tokens(q, 'text'), ' '))} AS digest FROM documents"


@P.sql
def five_gram_shingles(q):
    """DD4"""
    if q.name == "spark":
        return f"SELECT doc_id, CAST(size(g) AS BIGINT) AS shingles FROM (SELECT doc_id, {shingle_hashes(q, 't', 5)} AS g FROM {token_rows(q, 'documents', 'text', 'doc_id', 't')} x) y WHERE size(g) > 0"
    return f"WITH s AS {shingle_rows(q, 'documents', 'doc_id', 'text', 5)} SELECT doc_id, count(*) AS shingles FROM s GROUP BY doc_id"


@P.sql
def benchmark_jaccard(q):
    """DD5: Jaccard similarities of benchmark items to documents that share a shingle with them."""
    a, b = shingle_rows(q, "benchmark", "item_id", "text", 5), shingle_rows(q, "documents", "doc_id", "text", 5)
    return f"WITH a AS {a}, b AS {b}, na AS (SELECT item_id, count(*) AS n FROM a GROUP BY item_id), nb AS (SELECT doc_id, count(*) AS n FROM b GROUP BY doc_id), i AS (SELECT a.item_id, b.doc_id, count(*) AS n FROM a JOIN b ON a.s = b.s GROUP BY a.item_id, b.doc_id) SELECT i.item_id, i.doc_id, i.n AS shared, round(i.n / CAST(na.n + nb.n - i.n AS DOUBLE), 6) AS jaccard FROM i JOIN na ON na.item_id = i.item_id JOIN nb ON nb.doc_id = i.doc_id"


@P.sql
def tier_guard(q):
    """DD7: arrivals that share shingles with items of a higher tier take over that tier."""
    a, b = shingle_rows(q, "benchmark", "item_id", "text", 5), shingle_rows(q, "documents", "doc_id", "text", 5)
    return f"WITH {notes(q)}, a AS {a}, b AS {b}, m AS (SELECT b.doc_id, max(4 - a.item_id % 5) AS guard FROM a JOIN b ON a.s = b.s GROUP BY b.doc_id) SELECT n.doc_id, {tier_rank('n.classification')} AS own, m.guard, greatest({tier_rank('n.classification')}, m.guard) AS raised FROM notes n JOIN m ON m.doc_id = n.doc_id"


def family(q) -> str:
    return f"fam AS (SELECT p_partkey, '2024-01-01-' || lower(p_brand) || '-v' || {q.string('p_size')} AS slug FROM part), key AS (SELECT p_partkey, slug, {q.replace_all(q.replace_all('slug', '-v[0-9]{1,3}$', ''), '^[0-9]{4}-[0-9]{2}-[0-9]{2}-', '')} AS family, CAST({q.extract('slug', '-v([0-9]{1,3})$', 1)} AS INT) AS v FROM fam)"


@P.sql
def version_family_key(q):
    """DD8"""
    return f"WITH {family(q)} SELECT p_partkey, family, v FROM key"


@P.sql
def auto_version_chains(q):
    """DD9: successors within families whose versions are all different."""
    return f"WITH {family(q)}, ok AS (SELECT family, p_partkey % 50 AS shard FROM key GROUP BY family, p_partkey % 50 HAVING count(*) = count(DISTINCT v)) SELECT k.p_partkey, lead(k.p_partkey) OVER (PARTITION BY k.family, k.p_partkey % 50 ORDER BY k.v, k.p_partkey) AS successor FROM key k JOIN ok ON ok.family = k.family AND ok.shard = k.p_partkey % 50"


@P.sql
def family_stem(q):
    """DD10: names without extension, copy marks, dates and version marks."""
    x = "lower(name)"
    for p in (r"\.[a-z0-9]{1,5}$", r" *\(?copy( [0-9]+)?\)?$", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[-_ ]*", r"[-_ ]+(v[0-9]+|final|draft)$"):
        x = q.replace_all(x, p, "")
    return f"WITH n AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '2024-05-01-' || p_name || ' (copy 2).docx' WHEN 1 THEN p_name || '-v3.pdf' WHEN 2 THEN p_name || ' final.txt' ELSE p_name END AS name FROM part) SELECT p_partkey, CASE WHEN length(trim({x})) >= 4 THEN trim({x}) END AS stem FROM n"


@P.sql
def version_link_verdict(q):
    """Towards DD11 (version_link_candidates runs the operator): what to do with consecutive orders of a customer as versions."""
    return f"WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice, lag(o_orderkey) OVER w AS before, lag(o_orderdate) OVER w AS d0, lag(o_totalprice) OVER w AS p0 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) SELECT o_orderkey, before, CASE WHEN o_orderdate <= d0 THEN 'not_newer' WHEN o_totalprice > p0 AND o_totalprice < p0 * 2 THEN 'propose' WHEN o_totalprice < p0 / 2 THEN 'ambiguous' ELSE 'none' END AS verdict FROM o WHERE before IS NOT NULL"


@P.sql
def version_link_generation(q):
    """Towards DD12 (version_link_candidates runs the operator): pairs within a block, twenty-five partners at most."""
    return "WITH b AS (SELECT o_orderkey, o_custkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) SELECT a.o_orderkey AS old_key, c.o_orderkey AS new_key FROM b a JOIN b c ON a.o_custkey = c.o_custkey AND c.r > a.r AND c.r <= a.r + 25"


@P.sql
def similarity_text(q):
    """DD13: texts without quoted lines and signatures, collapsed, lower-cased and cut."""
    kept = q.filter(q.lines("text"), "l", f"NOT {q.starts('l', chr(39) + '>' + chr(39))} AND NOT {q.matches('l', '^(On .* wrote:|-- *|From: )')}")
    flat = f"lower(trim({q.replace_all(q.join(kept, ' '), '[ \\t\\r\\n]+', ' ')}))"
    return f"SELECT conv_id, turn, substr({flat}, 1, 20000) AS t FROM conversations"


@P.sql
def evidence_keys(q):
    """DD14"""
    return f"SELECT conv_id, turn, {q.sha("role || '|' || " + q.string('conv_id') + " || '|' || " + q.sha('text'))} AS unit_key, {q.sha("role || '|' || " + q.string('conv_id'))} AS lineage_key FROM conversations"


@P.sql
def ingest_duplicates(q):
    """DD15: arrivals whose content is known, unless its extraction failed before."""
    return f"WITH k AS (SELECT {q.sha('text')} AS h, min(doc_id) AS first_doc, max(CASE WHEN length(text) < 40 THEN 1 ELSE 0 END) AS failed FROM documents GROUP BY {q.sha('text')}) SELECT d.doc_id, CASE WHEN d.doc_id = k.first_doc THEN 'new' WHEN k.failed = 1 THEN 'retry' ELSE 'duplicate' END AS status FROM documents d JOIN k ON k.h = {q.sha('d.text')}"


@P.sql
def overlap_contamination(q):
    """DD16: documents that share a five-word shingle with the benchmark."""
    a, b = shingle_rows(q, "benchmark", "item_id", "text", 5), shingle_rows(q, "documents", "doc_id", "text", 5)
    return f"WITH a AS (SELECT DISTINCT s FROM {a} x), b AS {b} SELECT b.doc_id, count(*) AS shared FROM b JOIN a ON a.s = b.s GROUP BY b.doc_id"


@P.sql
def display_duplicates(q):
    """DD19: members of groups that are equal after white space is collapsed."""
    h = q.sha(f"trim({q.replace_all('text', '[ \\t\\n\\r]+', ' ')})")
    return f"WITH h AS (SELECT doc_id, {h} AS h FROM documents) SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS first_doc, count(*) OVER (PARTITION BY h) AS members FROM h"


# scalars


@P.sql
def normalize_identity(q):
    """SF1: lower case and collapsed white space (functions.text has the exact form)."""
    return f"WITH {notes(q)} SELECT id, trim({q.replace_all('lower(title)', '[ \\t\\n\\r]+', ' ')}) AS identity FROM notes"


@P.sql
def phrase_tokens(q):
    """SF2"""
    return f"WITH {notes(q)} SELECT id, {q.join(q.extract_all('lower(path)', r'[\p{L}\p{N}_]+(?:[-/][\p{L}\p{N}_]+)*'), ' ')} AS phrases FROM notes"


@P.sql
def identifier_shaped(q):
    """SF3: words of benchmark texts and page addresses that look like identifiers: long, or with a digit or a joint."""
    words = f"SELECT word FROM benchmark, {q.unnest(q.split('text', ' '), 'u(word)')}"
    return f"SELECT DISTINCT word, length({q.replace_all('word', r'[^\p{L}\p{N}]', '')}) >= 8 OR {q.matches('word', r'[\p{Nd}]')} OR {q.matches('word', '[-_/]')} AS shaped FROM ({words} UNION ALL SELECT url FROM pages) w WHERE word <> ''"


@P.sql
def link_target_normalize(q):
    """SF4"""
    return f"WITH {notes(q)} SELECT id, {q.replace_all(q.replace_all('lower(title)', '[^a-z0-9]+', '-'), '^-+|-+$', '')} AS target FROM notes"


@P.sql
def accent_fold_slug(q):
    """SF5: common accents folded by a table."""
    t = "translate(lower(title), 'àáâäãåçèéêëìíîïñòóôöõùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')"
    return f"WITH {notes(q)} SELECT id, {q.replace_all(q.replace_all(t, '[^a-z0-9]+', '-'), '^-+|-+$', '')} AS slug FROM notes"


@P.sql
def autolink_unique(q):
    """SF6: words that only one project owns, and the texts that hold them."""
    return f"""WITH {notes(q)}, c AS (SELECT lower({q.extract('title', r'([\p{L}]{6,})', 1)}) AS name, min(id) AS id FROM notes WHERE type = 'project' GROUP BY 1 HAVING count(*) = 1), w AS (SELECT DISTINCT doc_id, t FROM documents, {q.unnest(tokens(q, 'text'), 'u(t)')}) SELECT w.doc_id, c.id FROM w JOIN c ON c.name = w.t WHERE c.name <> ''"""


@P.sql
def contextual_prefix(q):
    """SF8"""
    return f"WITH {notes(q)} SELECT id, CASE lang WHEN 'de' THEN 'Aus ' WHEN 'fr' THEN 'De ' WHEN 'es' THEN 'De ' ELSE 'From ' END || title || ' (' || zone || '): ' AS prefix FROM notes"


#: Classes of secrets; fixed values.
SECRETS = (
    ("private-key-block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("aws-access-key", r"\bAKIA[0-9A-Z]{16}\b"),
    ("slack-token", r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b"),
    ("bearer-ish-key", r"\b(?:sk|ghp|gho|glpat)[-_][A-Za-z0-9_-]{20,}\b"),
    ("kv-secret", r"(?im)^\s*(?:api[_-]?key|secret|password|access[_-]?token)\s*[:=]\s*\S{8,}"),
)


@P.sql
def secret_scrub(q):
    """SF10: the classes of secrets in a text, and the text without them (texts of two tables, some with secrets put before them)."""
    put = "CASE doc_id % 6 WHEN 0 THEN 'AKIA' || substr(upper(sha), 1, 16) || ' ' WHEN 1 THEN 'api_key: ' || sha || ' ' WHEN 2 THEN 'xoxb-' || sha || ' ' WHEN 3 THEN 'ghp_' || sha || ' ' WHEN 4 THEN '-----BEGIN RSA PRIVATE KEY----- ' ELSE '' END || text"
    names = " || ".join(f"CASE WHEN {q.matches('t', p)} THEN '{n} ' ELSE '' END" for n, p in SECRETS)
    clean = "t"
    for _, p in SECRETS:
        clean = q.replace_all(clean, p, "[redacted:secret]")
    return f"WITH s AS (SELECT doc_id, text, {q.sha(q.string('doc_id'))} AS sha FROM documents), x AS (SELECT doc_id, {put} AS t FROM s) SELECT doc_id, {names} AS findings, {q.sha(clean)} AS scrubbed FROM x"


@P.sql
def density_gate(q):
    """SF11: texts with too little left after headings and fences."""
    return f"SELECT doc_id, length(trim({q.replace_all('text', r'(?m)^#+ .*$|```[^`]*```', '')})) < 40 AS quarantined FROM documents"


@P.sql
def body_normal_hash(q):
    """SF12: right-trimmed lines, hash and size."""
    norm = f"trim({q.replace_all('text', r'[ \t]+(\n|$)', '$1')})"
    return f"SELECT doc_id, {q.sha(norm)} AS h, {q.octets(norm)} AS size FROM documents"


@P.sql
def valid_date_coalesce(q):
    """SF13: the first date given; malformed ones sort oldest."""
    return f"WITH {notes(q)} SELECT id, {VALID_DATE} AS d, coalesce({q.string(q.try_date(VALID_DATE))}, '0000-00-00') AS sort_key FROM notes"


@P.sql
def filename_date(q):
    """SF14: the first real date in a name, not before 1990 and not in the future."""
    e = q.extract("name", r"([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)
    return f"WITH n AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'report-' || {q.string(q.date('o_orderdate'))} WHEN 1 THEN 'x 1989-02-03 y' WHEN 2 THEN '2024-13-40' ELSE 'none' END AS name FROM orders) SELECT o_orderkey, {q.string(f'CASE WHEN {q.try_date(e)} BETWEEN DATE ' + chr(39) + '1990-01-01' + chr(39) + ' AND DATE ' + chr(39) + '2026-01-01' + chr(39) + f' THEN {q.try_date(e)} END')} AS d FROM n"


@P.sql
def bitemporal_normalize(q):
    """SF15: truth words, and ids out of links."""
    return f"WITH {notes(q)} SELECT id, CASE WHEN lower(coalesce(is_latest_version, '')) IN ('true', 'yes') THEN 'true' WHEN lower(coalesce(is_latest_version, '')) IN ('false', 'no') THEN 'false' ELSE '' END AS latest, {q.extract("'[[' || coalesce(superseded_by, '') || '|name]]'", r'\[\[([^\]|]*)', 1)} AS successor FROM notes"


@P.sql
def safe_slug(q):
    """SF16: names that may be files."""
    return f"WITH {notes(q)} SELECT id, {q.matches('title', r'^[\p{L}\p{N} _.-]+$')} AND NOT {q.contains('title', chr(39) + '..' + chr(39))} AND {q.octets('title')} <= 180 AS safe FROM notes"


@P.sql
def vector_norms(q):
    """SF19: dimensions and norms of stored vectors."""
    return f"SELECT vec_id, {q.size('embedding')} AS dim, round(sqrt({q.dot('embedding', 'embedding')}), 6) AS norm FROM embeddings"


@P.sql
def priority_assignment(q):
    """SF22: P0, P1 or P2 by roster, ask, deadline and blocking."""
    return "SELECT event_id, CASE WHEN event_type = 'view' THEN NULL WHEN (user_id < 20 AND (event_type = 'purchase' OR value < 10)) OR value < 2 OR event_type = 'error' THEN 'P0' WHEN event_type = 'purchase' THEN 'P1' ELSE 'P2' END AS chip FROM events"


@P.sql
def text_signals(q):
    """SF23: facts of a message above its quotes."""
    return f"SELECT conv_id, turn, {q.contains('text', chr(39) + '?' + chr(39))} AS asks, {q.matches('text', '[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}:[0-9]{2}')} AS dated, {q.size(q.filter(q.lines('text'), 'l', q.starts('l', chr(39) + '>' + chr(39))))} AS quoted_lines, CAST(length(text) AS BIGINT) AS chars FROM conversations"


@P.sql
def suffix_window(q):
    """SF24: the head and the tail of a text, with a mark if it was longer."""
    return "SELECT doc_id, substr(text, 1, 200) AS head, right(text, 200) AS tail, length(text) > 400 AS truncated FROM documents"


QUERIES, ORACLE = P.queries, P.oracle
__all__ = ["ORACLE", "QUERIES", "TOKEN"]

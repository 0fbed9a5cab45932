"""Every query with a DuckDB twin gives the same rows as it, in any order, at the smallest size."""

import decimal
import glob
import hashlib
import itertools
import math
import os
import re
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from vaultspark import registry
from vaultspark.functions import text

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 5)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return v


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple(map(str, r)))


@pytest.fixture(scope="session")
def duck(data):
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, duck, data, name):
    df = QUERIES[name](spark, data)
    got = rows_of(df.collect(), df.columns)
    found = duck.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(found.columns)
    assert got == rows_of(found.fetchall(), found.columns)


@pytest.mark.parametrize("name", ["dossier_tensions", "once_only_append", "inferred_edges", "near_duplicate_vectors", "semantic_clusters", "supersession_chain", "grep_terms", "secret_scrub"])
def test_rows_to_compare(duck, name):
    assert duck.sql(ORACLE[name]).fetchall()


def bottom(tokens, k=192):
    return sorted({zlib.crc32(t.encode()) for t in tokens})[:k]


def cross_tier(bodies, least, screen=False):
    """All pairs of classes of different tiers whose shingles or words are alike, by comparing every two."""
    classes = {}
    for k, tier, t in bodies:
        if len(t) >= least:
            classes.setdefault((tier, tuple(t)), []).append(k)
    rows = [(min(ks), len(ks), tier, {t[i : i + 5] for i in range(len(t) - 4)}, set(t), set(bottom(t))) for (tier, t), ks in classes.items()]
    jac = lambda x, y: len(x & y) / len(x | y) if x and y else 0.0
    out = []
    for one, two in itertools.combinations(sorted(rows, key=lambda r: r[0]), 2):
        (a, na, ta, sa, wa, ka), (b, nb, tb, sb, wb, kb) = one, two
        if ta == tb or min(len(wa), len(wb)) < 0.6 * max(len(wa), len(wb)) and min(len(sa), len(sb)) < 0.6 * max(len(sa), len(sb)):
            continue
        if screen and len(ka & kb) < max(1, int(0.25 * min(len(ka), len(kb)))):
            continue
        s, w = jac(sa, sb), jac(wa, wb)
        if max(s, w) >= 0.6:
            out.append((a, b, ta, tb, na, nb, round(s, 6), round(w, 6), "decided" if s >= 0.6 else "undecided"))
    return out


def by_python(data):
    """Rows of queries that SQL can't check, by plain Python over whole tables."""
    read = lambda t: pq.read_table(f"{data}/{t}.parquet").to_pylist()
    x = np.array([r["embedding"] for r in read("embeddings")], float)
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    top = vectors[:, ::-1][:, :3]
    top *= np.sign(top[np.abs(top).argmax(0), range(3)])
    near = (x - x.mean(0)) @ top
    ids = [r["vec_id"] for r in read("embeddings")]
    tiers = {0: 0, 1: 1, 2: 2, 3: 3}  # by the rest of the number; others count as the highest
    bodies = [(r["doc_id"], tiers.get(r["doc_id"] % 7, 4), re.findall(r"\w+", (r["text"] or "").lower())) for r in read("documents")]
    exact, screened = cross_tier(bodies, 1), cross_tier(bodies, 40, screen=True)
    full = cross_tier(bodies, 40)
    of = lambda pairs, kind: sum(p[-1] == kind for p in pairs)
    sketches = [(k, bottom(t)) for k, _, t in bodies]
    return {
        "cross_tier_pairs": exact,
        "cross_tier_sketch_pairs": screened,
        "cross_tier_coverage": [(len(bodies), sum(len(t) >= 40 for *_, t in bodies), of(full, "decided"), of(screened, "decided"), of(full, "undecided"), of(screened, "undecided"), round(len(screened) / len(full), 6))],
        "word_sketches": [(k, len(s), min(s, default=None), max(s, default=None), hashlib.sha256(",".join(map(str, s)).encode()).hexdigest()) for k, s in sketches],
        "pca_projection": [(i, *map(float, np.round(r, 6))) for i, r in zip(ids, near)],
        "chunker": [(r["doc_id"], c["ordinal"], c["heading"], len(c["text"])) for r in read("documents") for c in text.chunks(r["text"] or "")],
        "hash_embeddings": [(r["doc_id"], text.hash_vector(r["text"]).tolist()[:8]) for r in read("documents")],
        "identity_exact": [(r["item_id"], text.identity(r["text"]), text.fold(r["text"])) for r in read("benchmark")],
        "html_extract_exact": [(r["page_id"], *text.html_to_text(r["html"]).values()) for r in read("pages")],
    }


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_by_python(spark, data, name):
    df = QUERIES[name](spark, data)
    rows = df.collect()
    assert rows
    want = by_python(data).get(name)
    if want is not None:
        assert sorted(str([plain(v) for v in r]) for r in rows) == sorted(str([plain(v) for v in r]) for r in want)

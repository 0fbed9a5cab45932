"""Tree BPE, fill-in-middle and periodic runs against the library, plain Python and brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_ops import ODD_TEXTS, empty, odd, texts_of, vocabulary  # noqa: F401

from vaultspark.llm import bpe_tree, infill, periods, queries

SPACE = re.compile("[\x20\x09-\x0d]+")
WORD = re.compile("[^\x20\x09-\x0d]+")
TOKEN = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


# 11


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_tree.read_ranks(vocabulary("byte_bpe_50k.tiktoken")), special_tokens={})


@pytest.fixture(scope="module")
def tree():
    import public_tokenizers

    return bpe_tree.TreeEncoder(bpe_tree.read_ranks(vocabulary("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


def ids_of(tree, texts):
    return [np.frombuffer(x, "<u4").tolist() for x in tree.encode(texts)]


def test_tree_encodes_as_the_library_does(tree, library):
    rnd = random.Random(5)
    texts = ODD_TEXTS + ["a" * 5000, "ab" * 999, "=" * 777, " " * 300, "0123456789" * 70, "é" * 300, "中文字" * 50, "x́" * 90, "\x1c\x1d \x85\xa0", " 　a"]
    texts += ["".join(rnd.choice(["a", "b", "th", "ing", "é", " ", "\n", "1", "'s", "\t", "!", "中", "🙂", "é"]) for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    texts += ["".join(rnd.choice("aetoins") for _ in range(rnd.randint(1, 400))) for _ in range(300)]
    assert ids_of(tree, texts) == [library.encode_ordinary(t) for t in texts]
    assert [tree.decode(x) for x in ids_of(tree, texts)] == [t.encode() for t in texts]


def test_white_space_of_the_pattern_is_the_librarys(tree, library):
    texts = [f"a{chr(c)}{chr(c)}b" for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    assert ids_of(tree, texts) == [library.encode_ordinary(t) for t in texts]


@given(st.text(st.sampled_from("abcdefgh \n'ÉI1"), max_size=80), st.text(max_size=30))
@settings(max_examples=200, deadline=None)
def test_joins_are_encodings(tree, library, left, right):
    for a, b in ((left, right), (right, left)):
        whole = tree.merged((a + b).encode())
        assert tree.join(tree.merged(a.encode()), tree.merged(b.encode())) == whole and tree.join(whole, []) == whole == tree.join([], whole)


def test_joins_associate_on_random_splits(tree):
    rnd = random.Random(8)
    for _ in range(200):
        raw = bytes(rnd.choice(b"aabcdeeinst") for _ in range(rnd.randint(3, 120)))
        i, j = sorted(rnd.sample(range(len(raw) + 1), 2))
        a, b, c = (tree.merged(x) for x in (raw[:i], raw[i:j], raw[j:]))
        assert tree.join(tree.join(a, b), c) == tree.join(a, tree.join(b, c)) == tree.merged(raw)


def test_decoding_up_the_tree(tree):
    ids = list(range(50_000)) + [7] * 3000
    assert tree.decode(ids) == b"".join(tree.bytes_of[i] for i in ids) and tree.decode([]) == b""


def test_tree_bpe_query(spark, data, library):
    texts = texts_of(spark.read.parquet(f"{data}/documents.parquet"))
    got = {r.doc_id: r for r in queries.op11_tree_bpe(spark, data).collect()}
    assert got.keys() == texts.keys()
    for key, text in texts.items():
        ids = library.encode_ordinary(text)
        assert (got[key].n_tokens, got[key].ids_sha256, got[key].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(text))


def test_tree_bpe_odd(spark, odd, empty, library):  # noqa: F811
    import public_tokenizers

    path, pattern = vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    both = bpe_tree.decode(bpe_tree.encode(odd.withColumn("IDS", F.lit(1)), path, pattern), path)
    assert both.columns == ["doc_id", "lang", "source", "n_chars", "row_key", "ids", "decoded"]
    texts = texts_of(odd)
    rows = both.collect()
    assert len(rows) == odd.count() and all((r.ids, bytes(r.decoded)) == (library.encode_ordinary(texts[r.doc_id]), texts[r.doc_id].encode()) for r in rows)
    assert bpe_tree.digest(empty, path, pattern).count() == 0
    assert bpe_tree.decode(spark.createDataFrame([(None,), ([],)], "ids array<int>"), path).filter("decoded = X''").count() == 2


# 12


@given(st.lists(st.integers(0, 9), max_size=300), st.data())
@settings(max_examples=100, deadline=None)
def test_skip_list_seeks(widths, data):
    line = infill.SkipList(np.array(widths, np.int64))
    for rank in {0, len(widths), data.draw(st.integers(0, len(widths)))}:
        assert line.seek(rank) == sum(widths[:rank])


def test_skip_list_is_short_of_steps():
    line = infill.SkipList(np.ones(200_000, np.int64))
    assert 6 <= len(line.lanes) <= 20 and all(line.seek(r) == r for r in (1, 77_777, 199_999))
    sizes = [len(lane[0]) for lane in line.lanes]
    assert all(a > 2.5 * b for a, b in zip(sizes[:5], sizes[1:6]))


@given(st.lists(st.text(st.sampled_from("aé中🙂 \t\n\x0b\x1f "), max_size=40), max_size=6))
@settings(max_examples=150, deadline=None)
def test_token_widths(texts):
    raw = [t.encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    widths, bounds = infill.token_widths(offs, np.frombuffer(b"".join(raw), np.uint8))
    assert [widths[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [[len(x) for x in TOKEN.findall(t)] for t in texts]


def plain_infill(key, text):
    tokens = TOKEN.findall(text)
    n = len(tokens)
    hexes = sha(f"42:{key}")
    h = [int(hexes[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, sha(text), sha(text)
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}"), sha(text)
    return n, "psm", len(p), len(m), sha(f"<P>{p}<S>{s}<M>{m}"), sha(text)


def test_infill_query(spark, data):
    texts = texts_of(spark.read.parquet(f"{data}/documents.parquet"))
    got = {r[0]: tuple(r)[1:] for r in queries.op12_fill_in_middle(spark, data).collect()}
    assert got == {k: plain_infill(k, t) for k, t in texts.items()} and {x[1] for x in got.values()} == {"plain", "spm", "psm"}


def test_infill_odd(spark, odd, empty):  # noqa: F811
    rows = [(i, t, "clash") for i, t in enumerate(["", None, " ", "a <P> b", "<M>", "<<S", "P>x <", "🙂 é  \n", " a b"] * 12)] + [(3, "a b", "clash")] * 2 + [(500 + i, "x " * 9000 + "<", "clash") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, FORM string")
    got = infill.digest(docs).collect()
    assert sorted(tuple(r) for r in got if r.doc_id != 3) == sorted((k, *plain_infill(k, t or "")) for k, t, _ in rows if k != 3)
    assert len(got) == len(rows) and all(r.restored_sha256 == sha(t or "") for k, t, _ in rows for r in got if r.doc_id == k and k != 3)
    full = infill.transform(odd.withColumn("N", F.lit(1)))
    assert full.columns == ["doc_id", "text", "lang", "source", "n_chars", "row_key", "n", "form", "prefix_chars", "middle_chars", "output"] and full.count() == odd.count()
    assert infill.digest(empty).count() == 0 and infill.digest(spark.createDataFrame([(None, "a b c")], "doc_id long, text string")).count() == 1


# 13


def brute_runs(words, least=12):
    """All runs of a list of words, by comparing it with itself at every distance."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


def brute_collapsed(words, runs):
    drop = {i for a, length, q in runs for i in range(a + q, a + length)}
    return [w for i, w in enumerate(words) if i not in drop]


def runs_by_list(texts, least=12):
    of, start, length, period = periods.runs_of(texts, least)
    return [[(int(a), int(b), int(c)) for i, a, b, c in zip(of, start, length, period) if i == k] for k in range(len(texts))]


def test_transform_is_a_convolution():
    rnd = np.random.default_rng(1)
    for size in (2, 8, 64, 1024):
        a, b = rnd.integers(0, periods.PRIME, (3, size)), rnd.integers(0, 50, (3, size))
        got = periods.ntt(periods.ntt(a) * periods.ntt(b) % np.uint64(periods.PRIME), inverse=True)
        assert (periods.ntt(periods.ntt(a), inverse=True) == a).all()
        for row in range(3):
            want = [sum(int(a[row, i]) * int(b[row, (k - i) % size]) for i in range(size)) % periods.PRIME for k in range(0, size, max(1, size // 8))]
            assert got[row, :: max(1, size // 8)].tolist() == want


def test_blocks_that_come_again():
    rnd = np.random.default_rng(2)
    for width, low, high in ((2, 1, 6), (4, 7, 14), (16, 31, 62)):
        words = rnd.integers(0, 2 if width < 16 else 1, 400)
        words[::97] = 5
        starts = np.arange(0, 400 - width - low, width)
        at, d = periods.zero_mismatches(words, starts, width, low, high)
        got = {(int(a), int(x)) for a, x in zip(at, d) if a + x + width <= 400}
        assert got == {(a, x) for a in starts.tolist() for x in range(low, high + 1) if a + x + width <= 400 and (words[a : a + width] == words[a + x : a + x + width]).all()}


WORDS = st.lists(st.integers(0, 2), max_size=25)


@st.composite
def repetitive(draw):
    out = []
    for _ in range(draw(st.integers(1, 4))):
        unit = draw(st.lists(st.integers(0, draw(st.sampled_from([0, 1, 3, 50]))), min_size=1, max_size=draw(st.sampled_from([2, 8, 40]))))
        size = draw(st.integers(0, 5 * len(unit)))
        out += (unit * 6)[:size] + draw(WORDS)
    return out


@given(st.lists(repetitive(), max_size=5), st.sampled_from([12, 5, 20]))
@settings(max_examples=400, deadline=None)
def test_runs_against_brute_force(texts, least):
    assert runs_by_list(texts, least) == [brute_runs(t, least) for t in texts]


def test_runs_of_special_words():
    fibonacci = ["a"], ["a", "b"]
    while len(fibonacci[1]) < 600:
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    rnd = random.Random(4)
    texts = [fibonacci[1], ["x"] * 700, ["a", "b"] * 200 + ["a"] * 200, [str(i) for i in range(500)] * 2, [rnd.choice("ab") for _ in range(900)], ["a"] * 11, ["a"] * 12, [*"abcdef"] * 2, [*"abcdef"] * 2 + ["a"], []]
    base = [rnd.choice("abcdefgh") for _ in range(300)]
    texts += [base[:a] + (base[a : a + p] * 12)[: 300 - a] for a, p in ((0, 100), (7, 37), (100, 66), (290, 5), (13, 1))]
    assert runs_by_list(texts) == [brute_runs(t) for t in texts]
    with pytest.raises(ValueError):
        periods.runs_of(texts, 4)


def test_long_runs_take_linear_work():
    words = ["w"] * 300_000
    (run,) = runs_by_list([words])[0]
    assert run == (0, 300_000, 1)
    unit = [str(i) for i in range(997)]
    assert runs_by_list([unit * 200])[0] == [(0, 997 * 200, 997)]


def plain_periods(key, text):
    words = WORD.findall(text)
    n, h = len(words), zlib.crc32(str(key).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(words)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    told = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(runs), *told, sha("".join(f"{a},{b},{q}\n" for a, b, q in runs)), sha(" ".join(brute_collapsed(words, runs)))


def test_periods_query(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {k: t for k, t in texts_of(docs).items() if len(t.split()) < 1500}
    got = {r[0]: tuple(r)[1:] for r in queries.op13_periodic_runs(spark, data).collect()}
    assert len(got) == docs.count() and len(texts) > 150
    assert {k: got[k] for k in texts} == {k: plain_periods(k, t) for k, t in texts.items()} and sum(got[k][0] > 0 for k in texts) > 10


def test_periods_odd(spark, odd, empty):  # noqa: F811
    texts = [None, "", " ", "a", "a " * 30, "\tx y  x\ny " * 9, "  \x1f " * 20, "é 中 " * 12, "p q r s"]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts * 15)], "doc_id long, text string, RUNS string")
    got = {r[0]: tuple(r)[1:] for r in periods.digest(periods.with_repeats(docs)).collect()}
    assert got == {i: plain_periods(i, t or "") for i, t in enumerate(texts * 15)}
    full = periods.find_runs(docs)
    assert full.columns == ["doc_id", "n_words", "runs", "collapsed"] and full.filter("collapsed is null or n_words is null").count() == 0
    assert periods.find_runs(odd).count() == odd.count() and periods.digest(empty).count() == 0
    (long,) = periods.find_runs(odd.filter("doc_id = 4")).collect()
    assert long.runs[0].asDict() == {"start": 0, "length": 30_000, "period": 1} and long.collapsed == "word"
    assert periods.digest(periods.with_repeats(spark.createDataFrame([(None, "a b")], "doc_id long, text string"))).count() == 1

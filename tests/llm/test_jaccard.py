import collections
import itertools
import random

import duckdb
import numpy as np
import pytest

from tests.llm.conftest import LONG
from threadloom.llm import jaccard as J


def brute(rows, words):
    sets = []
    for r in rows:
        w = words(r[1])
        n = min(J.GRAM, len(w))
        sets.append((r[0], frozenset(zip(*[w[i:] for i in range(n)])) if w else frozenset()))
    out = {}
    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and i is not None and j is not None and i != j:
            v = len(a & b) / len(a | b)
            if v >= J.THRESHOLD - 1e-12:
                key = (min(i, j), max(i, j))
                out[key] = max(v, out.get(key, 0))
    return out


def corpus(seed, n=120, vocab=60):
    """Texts of a small vocabulary (so that frequent classes are used), with copies of many degrees."""
    rng = random.Random(seed)
    rows, texts = [], []
    for i in range(n):
        if texts and rng.random() < 0.6:
            w = rng.choice(texts)[:]
            for _ in range(rng.randrange(0, max(2, len(w) // 6))):
                k = rng.randrange(len(w))
                w[k : k + rng.randrange(2)] = [f"v{rng.randrange(vocab)}"] * rng.randrange(1, 3)
        else:
            w = [f"v{min(rng.randrange(vocab), rng.randrange(vocab))}" for _ in range(rng.choice([1, 2, 3, 8, 30, 90, 300]))]
        texts.append(w or ["v1"])
        rows.append((i, " ".join(texts[-1])))
    return rows


@pytest.mark.parametrize(("seed", "frequent", "very"), [(1, 3, 8), (2, 1, 1), (3, 1, 1000), (4, 64, 4096)])
def test_equals_brute_force(docs, words, seed, frequent, very, monkeypatch):
    monkeypatch.setattr(J, "FREQUENT", frequent)
    monkeypatch.setattr(J, "VERY", very)
    rows = corpus(seed)
    got = {(r["doc_a"], r["doc_b"]): r["jaccard"] for r in J.near_pairs(docs(rows)).collect()}
    want = brute(rows, words)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)


@pytest.mark.parametrize("seed", range(4))
def test_prefixes_share_what_pairs_must(seed):
    """Any two sets at the threshold share at least the needed number of combinations, whatever the classes of shared tokens."""
    rng = np.random.default_rng(seed)
    share = [[0.25, 0.25, 0.25, 0.25], [0, 1, 0, 0], [0, 0, 0.5, 0.5], [0.1, 0.1, 0.1, 0.7]][seed]
    for _ in range(300):
        size = int(rng.integers(1, 400))
        x = np.unique(rng.integers(1, 1 << 62, size=size, dtype=np.uint64))
        level = {int(t): int(rng.choice(4, p=share)) for t in x}
        drop = int(rng.integers(0, J.missing(len(x)) + 1))
        y = rng.permutation(x)[: len(x) - drop]
        extra = rng.integers(1, 1 << 62, size=int(rng.integers(0, max(1, int(len(y) / J.THRESHOLD) - len(x) + 1))), dtype=np.uint64)
        level |= {int(t): int(rng.choice(4, p=share)) for t in extra}
        # Class 0 is only for tokens of one set.
        level |= {int(t): max(1, level[int(t)]) for t in y}
        y = np.unique(np.concatenate([y, extra]))
        both = len(np.intersect1d(x, y))
        if both < J.THRESHOLD * (len(x) + len(y) - both):
            continue
        a, b = (J.signatures(s, np.array([level[int(t)] for t in s])) for s in (x, y))
        assert len(np.intersect1d(a, b)) >= min(J._need(len(x)), J._need(len(y)))


def test_edges(docs, words):
    t = "one two three four five six seven eight"
    rows = [(1, None), (2, ""), (3, "..."), (4, t), (5, t.upper() + "!"), (5, t.upper() + "!"), (None, t), (6, "solo"), (7, "Solo"), (8, LONG), (9, LONG + " extra"), (10, "solo other")]
    got = {(r["doc_a"], r["doc_b"]): r["jaccard"] for r in J.near_pairs(docs(rows)).collect()}
    assert got == pytest.approx(brute(rows, words)) and {(4, 5), (6, 7), (8, 9)} == set(got)
    d = docs(rows)
    kept = J.keep_one(d)
    assert kept.columns == d.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i or 0 for i in ids) == [0, 1, 2, 3, 4, 6, 8, 10]
    assert J.near_pairs(docs([])).count() == 0 and J.keep_one(docs([])).count() == 0


def test_verification_blocks(docs, words, monkeypatch):
    monkeypatch.setattr(J, "_BLOCK_PAIRS", 3)
    rows = [(i, " ".join(f"w{k}" for k in range(40) if k != i)) for i in range(12)]
    got = {(r["doc_a"], r["doc_b"]) for r in J.near_pairs(docs(rows)).collect()}
    assert got == brute(rows, words).keys() and len(got) == 66


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100 + rng.randrange(20), 100 + rng.randrange(20)) for _ in range(15)] + [(300, -5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["group"] for r in J.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    loops = {a for a, b in edges if a == b}
    want = {n: find(n) for n in list(root)}
    assert got == {n: g for n, g in want.items() if n in got} and set(want) - set(got) <= loops


def brute_classes(rows, words):
    """Least reachable id and number of partners, from all pairs."""
    root = {r[0]: r[0] for r in rows if r[0] is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = collections.Counter()
    for a, b in brute(rows, words):
        links.update((a, b))
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: (find(i), links[i]) for i in root}


def classes_of(df):
    got = [(r["doc_id"], (r["class_id"], r["links"])) for r in df.collect()]
    assert len(got) == len(dict(got))
    return dict(got)


@pytest.mark.parametrize(("seed", "least", "most", "block"), [(1, 2, 3, 5), (2, 3, 1000, 40), (5, 8, 800, 200_000)])
def test_classes_equal_brute_force(docs, words, seed, least, most, block, monkeypatch):
    """Groups of any sizes, blocks of clusters, and ids that have several texts."""
    monkeypatch.setattr(J, "_GROUP", least)
    monkeypatch.setattr(J, "_GROUP_ROWS", most)
    monkeypatch.setattr(J, "_BLOCK_PAIRS", block)
    rows = corpus(seed)
    rows += [(3, rows[50][1]), (3, rows[51][1]), (60, rows[61][1]), (None, rows[5][1]), (500, None), (501, "!!"), *rows[:4]] + [(600 + i, rows[50][1]) for i in range(3)]
    assert classes_of(J.classes(docs(rows))) == brute_classes(rows, words)
    if seed == 1:
        got = {(r["doc_a"], r["doc_b"]) for r in J.near_pairs(docs(rows)).collect()}
        assert got == brute(rows, words).keys()
    assert J.classes(docs([])).count() == 0


def test_dense_clusters_have_few_candidates(spark, words):
    """A cluster of many different texts is candidates as a few groups and returns a row a document, not one a pair."""
    rng = random.Random(7)
    base = [f"w{k}" for k in range(90)]
    rows = []
    for i in range(150):
        text = base[:]
        for k in rng.sample(range(90), 3):
            text[k] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    pairs = brute(rows, words)
    assert len(pairs) > 10_000
    chars = sum(len(t) for _, t in rows)
    _, packed, bits = J.frequencies(d, chars)
    grouped, near = J.candidates(d, spark.sparkContext.broadcast(packed), bits, chars)
    assert grouped.count() > 140 and near.count() < 500
    assert classes_of(J.classes(d)) == brute_classes(rows, words)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.001/documents.parquet')")
    want = {i: (c, n) for i, c, n in con.sql(J.JACCARD_SQL).fetchall()}
    assert classes_of(J.jaccard_query(spark, "/root/testdata/sf0.001")) == want
    assert sum(n for _, n in want.values()) > 10

import random

import numpy as np
import pytest

from tests.llm.conftest import LONG
from threadloom.llm import decontaminate as D
from threadloom.llm import textcore as tc


def greedy(doc, item, least):
    """Greedy string tiling by trying every pair of positions."""
    md, mi, out = [False] * len(doc), [False] * len(item), []
    while True:
        best = (least - 1, None)
        for i in range(len(item)):
            for j in range(len(doc)):
                k = 0
                while i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k] and not mi[i + k] and not md[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, (i, j))
        if best[1] is None:
            return out
        k, (i, j) = best
        for n in range(k):
            mi[i + n] = md[j + n] = True
        out.append((i, j, k))


def _hash(words):
    return np.array([tc.hash_word(w) for w in words], dtype=np.uint64)


@pytest.mark.parametrize("seed", range(30))
def test_tiles_equal_brute_force(seed):
    rng = random.Random(seed)
    item = [f"w{rng.randrange(12)}" for _ in range(rng.randrange(1, 40))]
    doc = [f"w{rng.randrange(12)}" for _ in range(rng.randrange(0, 20))]
    for _ in range(3):
        a = rng.randrange(len(item))
        doc += item[a : a + rng.randrange(1, 15)] + [f"w{rng.randrange(12)}" for _ in range(3)]
    got = D.tiles(_hash(doc), _hash(item), 3)
    assert sorted(got) == sorted(greedy(doc, item, 3))


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"


def _cases(docs, spark):
    w = ITEM.split()
    swapped = " ".join(w[8:] + ["filler"] * 3 + w[:8])
    partial, less = "xx " + " ".join(w[:9]) + " yy", "xx " + " ".join(w[:6]) + " yy"
    rows = [(1, f"Before. {ITEM.upper()}; after"), (2, swapped), (3, partial), (4, less), (5, None), (6, ""), (7, LONG + " " + ITEM), (8, "clean text of other words only"), (None, ITEM), (1, f"Before. {ITEM.upper()}; after"), (9, " ".join(w[::-1]))]
    bench = spark.createDataFrame([(1, ITEM, "x"), (2, None, "x"), (3, "", "x"), (4, "too short item", "x"), (None, ITEM, "x"), (5, ITEM, "y"), (5, ITEM, "y")], "item_id bigint, text string, doc_id string")
    return docs(rows), bench


@pytest.mark.parametrize("limit", [D.BROADCAST_BYTES, 0])
def test_leaks_equal_brute_force(docs, spark, words, limit):
    """All pairs of documents and items, tiled by trying every pair of positions; stock phrases, reordered and repeated passages, short items."""
    rng = random.Random(limit + 9)
    stock = "so it was said that".split()
    items = [[f"w{rng.randrange(30)}" for _ in range(rng.choice([1, 2, 3, 5, 9, 20, 30]))] + stock * rng.randrange(3) for _ in range(25)]
    texts = [["w1"], ["w2", "w3"], items[0], stock]
    for _ in range(60):
        t = [f"w{rng.randrange(30)}" for _ in range(rng.randrange(12))]
        for _ in range(rng.randrange(4)):
            own = rng.choice(items)
            a = rng.randrange(len(own))
            t += own[a : a + rng.randrange(1, 16)] + rng.choice([stock, [], ["zz"]])
        texts.append(t)
    bench = spark.createDataFrame([(i, " ".join(t), "x") for i, t in enumerate(items)], "item_id bigint, text string, TEXT string")
    got = {(r["doc_id"], r["item_id"]): r["matched"] for r in D.leaks(docs([(i, " ".join(t)) for i, t in enumerate(texts)]), bench, limit).collect()}
    want = {}
    for i, t in enumerate(texts):
        for k, item in enumerate(items):
            n = sum(x[2] for x in greedy(t, item, D.MIN_MATCH)) if len(item) >= D.MIN_MATCH else len(item) * (t == item)
            if n >= D.COVERAGE * len(item):
                want[i, k] = n
    assert got == want and len(want) > 30


@pytest.mark.parametrize("limit", [D.BROADCAST_BYTES, 0])
def test_leaks(docs, spark, limit):
    d, bench = _cases(docs, spark)
    got = {(r["doc_id"], r["item_id"]): (r["matched"], r["item_words"]) for r in D.leaks(d, bench, limit).collect()}
    want = {1: 16, 2: 16, 3: 9, 7: 16}
    assert got == {(i, b): (n, 16) for i, n in want.items() for b in (1, 5)}


def test_stage_and_empty(docs, spark):
    d, bench = _cases(docs, spark)
    kept = D.keep_unleaked(d, bench)
    assert kept.columns == d.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 4, 5, 6, 8, 9]
    for limit in (D.BROADCAST_BYTES, -1):
        assert D.leaks(docs([]), bench, limit).count() == 0
        assert D.leaks(d, bench.where("false"), limit).count() == 0

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import LONG
from threadloom.llm import language, quality, textcore, toxicity

D = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def labelled():
    rows = duckdb.sql(f"select text, quality, toxic, lang from '{D}/documents.parquet' join '{D}/labels.parquet' using (doc_id) order by md5(text), doc_id").fetchall()
    # Copies of a text fall on one side of the split.
    cut = len(rows) * 3 // 4
    while rows[cut][0] == rows[cut - 1][0]:
        cut += 1
    return rows[:cut], rows[cut:]


def test_quality_held_out(labelled):
    train, test = labelled
    m = quality.fit([(r[0], r[1]) for r in train])
    p = m.scores(pa.array([r[0] for r in test])) >= 0.5
    y = np.array([r[1] for r in test]) == 1
    assert (p == y).mean() > 0.92 and p[y].mean() > 0.96


def test_toxicity_held_out(labelled):
    train, test = labelled
    m = toxicity.fit([(r[0], r[2]) for r in train])
    p = m.scores(pa.array([r[0] for r in test])) >= m.threshold
    y = np.array([r[2] for r in test]) == 1
    assert p[y].mean() > 0.8 and (~p[~y]).mean() > 0.96
    # Misspelt forms share character n-grams with what was learned.
    clean, bad = m.scores(pa.array(["the onand of ther", "you are an idiiot here"]))
    assert bad > 20 * clean


def test_language_held_out(labelled):
    train, test = labelled
    m = language.fit([(r[0], r[3]) for r in train[:1600]])
    best, loss, gap = m.decode(pa.array([r[0] for r in test]))
    assert np.mean([m.names[b] == r[3] for b, r in zip(best, test)]) > 0.99
    assert ((best < 0) | (gap < m.margin)).mean() < 0.01 and (loss[best >= 0] >= 0).all()


@pytest.mark.parametrize("k", [2, 4, 7, 12, 30])
def test_codewords_are_apart(k):
    c = language.codewords(k)
    apart = min(int((c[i] != c[j]).sum()) for i in range(k) for j in range(i))
    assert apart >= (1 if k == 2 else 2 ** (k - 2) if k <= 7 else 5)


EDGES = [(1, None), (2, ""), (3, "  \n "), (4, "!!! ???"), (5, LONG), (6, "plain words here"), (6, "plain words here"), (None, "no id at all"), (7, "\U0001f600\U0001f600"), (8, "a")]


def _edge_models():
    rows = [("good text of words", 1), ("bad %%% $$$ words", 0)] * 5
    return quality.fit(rows), toxicity.fit([("nice day for all of us", 0), ("you total moron you", 1)] * 6), language.fit([("the and of with", "en"), ("der die und das", "de")] * 6)


def test_edges(docs):
    q, x, g = _edge_models()
    d = docs(EDGES)
    a, b, c = quality.classify(d, q).collect(), toxicity.classify(d, x).collect(), language.identify(d, g).collect()
    assert len(a) == len(b) == len(c) == len(EDGES)
    by = lambda rows, i: next(r for r in rows if r["doc_id"] == i)
    assert all(by(a, i)["quality"] is None for i in (1, 2, 3)) and by(a, 5)["quality"] is not None
    assert all(by(b, i)["toxic"] is None for i in (1, 2, 3, 4)) and by(b, 5)["toxic"] is not None
    assert all(by(c, i)["language"] is None and by(c, i)["ambiguous"] for i in (1, 2, 3, 4))
    assert len({str(r) for r in a if r["doc_id"] == 6}) == 1
    assert quality.classify(docs([]), q).count() == toxicity.classify(docs([]), x).count() == language.identify(docs([]), g).count() == 0


def test_stages_keep_rows_and_columns(docs):
    _, x, g = _edge_models()
    d = docs([*EDGES, (9, "you total moron you")])
    kept = toxicity.keep_clean(d, x)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {None, 1, 2, 3, 4, 5, 6, 7, 8}
    known = language.keep_known(docs([(1, "the and of with"), (2, None), (3, "")]), g)
    assert known.columns == d.columns and [r["doc_id"] for r in known.collect()] == [1]


def test_nothing_to_learn_from(docs, spark):
    none = spark.createDataFrame([(1, None, None), (None, 1, 1), (2, 1, 0)], "doc_id bigint, quality int, toxic int")
    d = docs([(1, "some words", None), (2, "more words", None)])
    q = quality.fit_on(d, none)
    assert [r["quality"] for r in quality.classify(d, q).collect()] == [None, None]
    x = toxicity.fit_on(d, none)
    assert toxicity.keep_clean(d, x).count() == 2 and [r["toxic"] for r in toxicity.classify(d, x).collect()] == [None, None]
    g = language.fit_on(d)
    assert language.keep_known(d, g).count() == 2 and all(r["ambiguous"] for r in language.identify(d, g).collect())


def test_folded_scores_equal_the_model():
    """Scoring by one number a feature equals averaging vectors and applying the softmax layer."""
    m = quality.BagModel(quality.BITS, quality.DIM, 3)
    (idx, x), = quality.bags(["Some words, and some more words."])
    for y in (0, 1, 1):
        m.step(idx, x, y, 0.3)
    z = m.W @ (x @ m.E[idx]) + m.c
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    got = quality.QualityModel(*m.folded()).scores(pa.array(["Some words, and some more words."]))
    assert abs(got[0] - p[1]) < 1e-5


def test_words_and_pieces(words):
    texts = ["Ünï Çode-words x2", "", "a b", "ÉÉ " * 400, "x" * 3000, None, "...", "tail\nend"]
    arr = textcore.as_text(pa.array(texts))
    for limit in (1, 50, 1000, 1 << 20):
        got = []
        for _, piece in textcore.pieces(arr, limit):
            w = textcore.Words(piece)
            got += [w.hashes[a:b].tolist() for a, b in zip(w.first[:-1], w.first[1:])]
        assert got == [[textcore.hash_word(x) for x in words(t)] for t in texts]


def test_sample_is_drawn_from_the_documents_at_hand(docs, spark):
    """Labels of documents that are missing or have no text take no place in the sample."""
    labels = spark.createDataFrame([(i, i % 2) for i in range(2000)], "doc_id bigint, quality int")
    at_hand = docs([*((i, f"text {i}") for i in range(0, 2000, 40)), *((i + 1, f"text {i}") for i in range(0, 2000, 40)), *((i + 2, None) for i in range(0, 2000, 40))])
    got = quality.labelled_sample(at_hand, labels, "quality", 40, quality.SEED).collect()
    assert sorted(r["_y"] for r in got) == [0] * 20 + [1] * 20 and all(r["_id"] % 40 < 2 for r in got)

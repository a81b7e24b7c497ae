import collections
import math

import duckdb
import numpy as np
import pytest

from tests.llm.conftest import LONG
from threadloom.llm import crossentropy as C
from threadloom.llm import html as H
from threadloom.llm import neardup as N
from threadloom.llm import textcore as tc


def brute_scores(rows, good, words):
    """From the definition: plain dictionaries of bigrams, each row scored by the counts of all other rows."""
    texts = [(i, words(t)) for i, t in rows]
    chain = lambda t: ["<>", *t, "<>"] if t else []
    grams = [list(zip(chain(t), chain(t)[1:])) for _, t in texts]
    kinds = len({w for g in grams for _, w in g})

    def counts(members):
        pairs = collections.Counter(p for k in members for p in grams[k])
        heads, tails = collections.Counter(), collections.Counter()
        for (v, w), n in pairs.items():
            heads[v] += n
            tails[w] += n
        return pairs, heads, tails, sum(tails.values())

    sides = [counts(range(len(texts))), counts([k for k, (i, _) in enumerate(texts) if i in good])]
    out = collections.defaultdict(list)
    for k, (i, t) in enumerate(texts):
        if i is None:
            continue
        mine = counts([k])
        losses = []
        for side, off in zip(sides, (1, i in good)):
            pairs, heads, tails, total = ((x - off * y if isinstance(x, int) else {q: n - off * y[q] for q, n in x.items()}) for x, y in zip(side, mine))
            low = lambda w: (tails.get(w, 0) + 1) / (total + kinds)  # noqa: B023, E731
            losses.append([-math.log((pairs.get((v, w), 0) + C.PRIOR * low(w)) / (heads.get(v, 0) + C.PRIOR)) for v, w in grams[k]])
        out[i].append((len(t), sum(y - x for x, y in zip(*losses)) / len(grams[k]) if t and sides[1][3] else None))
    return dict(out)


def scored(df):
    out = collections.defaultdict(list)
    for r in df.collect():
        out[r["doc_id"]].append((r["n_words"], r["score"]))
    return dict(out)


def same_scores(got, want):
    assert got.keys() == want.keys()
    for k in want:
        for (n, x), (m, y) in zip(sorted(got[k], key=str), sorted(want[k], key=str), strict=True):
            assert n == m and (x is None) == (y is None) and (x is None or x == pytest.approx(y, rel=1e-9, abs=1e-12))


@pytest.mark.parametrize("run_words", [C.RUN_WORDS, 40])
def test_scores_equal_brute_force(docs, spark, words, run_words, monkeypatch):
    """Also with runs of a few documents, so that totals come from many."""
    monkeypatch.setattr(C, "RUN_WORDS", run_words)
    monkeypatch.setattr(tc, "PIECE_BYTES", 200 if run_words < 100 else tc.PIECE_BYTES)
    monkeypatch.setattr(C, "BUCKET_WORDS", 100 if run_words < 100 else C.BUCKET_WORDS)
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{min(rng.integers(40), rng.integers(40))}" for _ in range(rng.integers(1, 60)))) for i in range(60)]
    rows += [(100, ""), (101, "..."), (102, LONG[:5000]), (None, "w1 w2 w3"), (103, None), (104, "w1 w1 w1 only here"), (104, "w1 w1 w1 only here"), (105, "other w2"), (105, "another w2")]
    labels = spark.createDataFrame([(i, i % 2, 1 if i % 8 == 1 else 0, "z") for i in range(50)] + [(None, 1, 0, "z"), (3, 1, None, "z"), (5, None, None, "z")], "doc_id bigint, quality int, toxic int, TEXT string")
    good = {i for i in range(50) if i % 2 and i % 8 != 1}
    d = docs(rows)
    same_scores(scored(C.score(d, labels)), brute_scores(rows, good, words))


def test_documents_that_occur_twice_are_told_apart(docs, spark, words):
    """Words that one document has weigh alike in both models; those of two copies do not."""
    rows = [(i, " ".join([f"w{(i + k) % 9}" for k in range(30)] + [f"own{i}x{k}" for k in range(5)])) for i in range(40)]
    rows += [(90, "rare one two three four five"), (91, "rare one two three four five"), (92, LONG)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id bigint, quality int, toxic int")
    got = scored(C.score(docs(rows), labels))
    same_scores(got, brute_scores(rows, set(range(10)), words))
    assert min(got[90][0][1], got[91][0][1]) > max(got[i][0][1] for i in range(40)) + 1


def test_packing():
    rng = np.random.default_rng(1)
    for x in (np.zeros(0), np.zeros(5), np.arange(70_000), rng.integers(0, 1 << 63, size=1000)):
        assert np.array_equal(C.unpack(C.pack(x.astype(np.uint64))), x.astype(np.uint64))


def test_scores_without_target_or_rows(docs, spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = C.score(docs([(1, "a b c"), (1, "a b c"), (2, None)]), labels).collect()
    assert sorted((r["doc_id"], r["n_words"], r["score"]) for r in got) == [(1, 3, None), (1, 3, None), (2, 0, None)]
    assert C.score(docs([]), labels).count() == 0


PAGE = (
    "<html><head><title>no</title></head><body><nav><ul><li><a href='/a'>Home</a></li><li><a href=/b>News items</a></li></ul></nav><div class=ad>Buy one now &amp; save</div>"
    "<h1>A heading of words</h1><p>The <b>first</b> paragraph has <a href=x>one link</a> and a good number of other words in it, enough for text.<script>var t='</p>';</script></p>"
    "<p>" + "Second paragraph with words. " * 12 + "</p><footer>&copy; example site notes</footer></body></html>"
)


def test_blocks():
    got = H.blocks(PAGE)
    assert [b[0] for b in got][:4] == ["Home", "News items", "Buy one now & save", "A heading of words"]
    assert got[0][1:] == (1, 1.0) and got[4][2] == pytest.approx(2 / 21, abs=0.02) and got[-1][0] == "© example site notes"


def test_extract(spark):
    rows = [(1, PAGE), (2, None), (3, ""), (4, "<p><b>broken <i>mark < up " + "word " * 30), (5, "just text"), (6, "<script>never closed " * 5000), (7, "<" * 100_000), (8, "<p>" + LONG), (None, PAGE), (1, PAGE), (9, "<!-- only --><style>x</style>")]
    d = spark.createDataFrame([(*r, "u", "t") for r in rows], "page_id bigint, html string, url string, HTML string")
    got = {r["page_id"]: r for r in H.extract(d).collect()}
    assert got[1]["text"].startswith("A heading of words\nThe first paragraph") and "Home" not in got[1]["text"] and "©" not in got[1]["text"]
    assert (got[2]["text"], got[2]["n_blocks"]) == (None, 0) and all(got[k]["text"] == "" and got[k]["n_blocks"] == 0 for k in (3, 6, 9))
    assert got[None]["text"] == got[1]["text"] and got[8]["n_blocks"] == 1 and len(got[8]["text"]) == len(LONG)
    assert H.extract(d).count() == len(rows) and H.extract(d.where("false")).count() == 0


def test_markup_that_misleads():
    """End tags in any case, also where lower-casing changes the length of the page; quoted values with a bracket."""
    body = "<p>" + "words " * 30
    assert "after" in H.visible("\u0130 start<SCRIPT>x</p></Script >after") and "x</p>" not in H.visible("\u0130<SCRIPT>x</p></Script >after")
    assert [b[0] for b in H.blocks(f'<p><img alt="a > b" src=x>shown</p>{body}')][0] == "shown"
    assert [b[0] for b in H.blocks("<p><a title='x > y' href=q>link</a> and text")] == ["link and text"]
    assert [b[0] for b in H.blocks('<p title="open>text</p><p>more</p>')] == ["text", "more"]
    H.blocks('<a ' + 'b="c" ' * 20_000 + "<p>x")


def test_tree_held_out():
    rows = np.array(H.LABELLED, dtype=float)
    order = np.random.default_rng(0).permutation(len(rows))
    right = 0
    for k in range(5):
        test = order[k::5]
        train = np.setdiff1d(order, test)
        t = H.Tree(rows[train, :6], rows[train, 6].astype(int))
        right += (t.predict(rows[test, :6]) == rows[test, 6]).sum()
    assert right / len(rows) > 0.85


def test_article_blocks_of_the_pages(spark):
    """The content of a test page is what stands in its article element."""
    kept = of = wrong = 0
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        inner = r["html"].split("<article>", 1)[-1].split("</article>", 1)[0]
        want = {b[0] for b in H.blocks(inner)}
        got = set(H.extract_page(r["html"])[0].split("\n"))
        kept, of, wrong = kept + len(want & got), of + len(want), wrong + len(got - want - {""})
    assert kept / of > 0.97 and wrong / of < 0.05


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "a") for i, v in rows], "vec_id bigint, embedding array<float>, label int, VEC_ID string")


def test_near_vectors_recall(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((60, 32))
    x = np.concatenate([base, *[base[: 20 + k] + rng.standard_normal((20 + k, 32)) * s for k, s in enumerate((0.05, 0.2, 0.28, 0.33))]])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(u @ u.T >= N.MIN_COSINE, 1)))}
    got = {(r["vec_a"], r["vec_b"]): r["cosine"] for r in N.near_duplicates(_vectors(spark, [(i, (v * 7).tolist()) for i, v in enumerate(x)])).collect()}
    assert len(want) > 40 and len(want & got.keys()) >= 0.95 * len(want)
    assert all(abs(got[i, j] - u[i] @ u[j]) < 1e-5 and got[i, j] >= N.MIN_COSINE for i, j in got)


def test_near_vectors_in_many_cells(spark, monkeypatch):
    """More signs and tables, as large inputs have, and counting in many steps find the same pairs."""
    monkeypatch.setattr(N, "CELL_ROWS", 2)
    monkeypatch.setattr(N, "_AT_ONCE", 50)
    rng = np.random.default_rng(4)
    base = rng.standard_normal((150, 16))
    x = np.concatenate([base, base[:90] + rng.standard_normal((90, 16)) * 0.1])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert N.Plan(16, len(x)).signs >= 6
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(u @ u.T >= N.MIN_COSINE, 1)))}
    got = {(r["vec_a"], r["vec_b"]) for r in N.near_duplicates(_vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)])).collect()}
    assert len(want & got) >= 0.95 * len(want) and got <= want


@pytest.mark.parametrize("n", [1500, 6000])
def test_near_vectors_recall_at_two_sizes(spark, n):
    """Pairs just above the threshold, the hardest ones, with as many signs and tables as the size asks for."""
    rng = np.random.default_rng(n)
    u = rng.standard_normal((n, 24))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    side = rng.standard_normal((n, 24))
    side -= (side * u).sum(axis=1, keepdims=True) * u
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    x = np.concatenate([u, u[: n // 3] * 0.952 + side[: n // 3] * np.sqrt(1 - 0.952**2)])
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(x @ x.T >= N.MIN_COSINE, 1)))}
    got = {(r["vec_a"], r["vec_b"]) for r in N.near_duplicates(_vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)])).collect()}
    assert len(want) >= n // 3 and len(want & got) >= 0.975 * len(want)


def test_tables_grow_slowly_with_the_vectors():
    tables = [N.Plan(64, 10**k).tables for k in (3, 5, 7, 9)]
    assert tables == sorted(tables) and tables[-1] < 60


def test_equal_vectors_are_one_node(spark, monkeypatch):
    from threadloom.llm import pairs

    monkeypatch.setattr(pairs, "CHUNK", 4)
    rows = [(i, [3.0 + i, 0.0, 0.0, 0.0]) for i in range(11)] + [(20 + i, [0.0, 1.0, 0.01 * i, 0.0]) for i in range(3)] + [(20, [0.0, 0.0, 0.0, 5.0]), (5, [0.0, 2.0, 0.0, 0.0]), (20, [1.0, 0.0, 0.0, 0.0])]
    got = {(r["vec_a"], r["vec_b"]): r["cosine"] for r in N.near_duplicates(_vectors(spark, rows)).collect()}
    unit = [(i, np.array(v) / np.linalg.norm(v)) for i, v in rows]
    want: dict = {}
    for k, (i, v) in enumerate(unit):
        for j, w in unit[:k]:
            if i != j and v @ w >= N.MIN_COSINE:
                want[min(i, j), max(i, j)] = max(want.get((min(i, j), max(i, j)), 0), v @ w)
    assert got == pytest.approx(want, abs=1e-6)


def test_near_vectors_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (8, [1.0, None]), (9, [0.0, 1.0])]
    got = N.near_duplicates(_vectors(spark, rows)).collect()
    assert [(r["vec_a"], r["vec_b"], r["cosine"]) for r in got] == [(1, 2, 1.0)]
    assert N.near_duplicates(_vectors(spark, [])).count() == 0 and N.near_duplicates(_vectors(spark, [(1, None)])).count() == 0


def test_near_vectors_of_each_dimension(spark):
    """Vectors of several models: pairs are found within each dimension, none across."""
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((30, 16)))]
    rows += [(100 + i, v.tolist()) for i, v in enumerate(rng.standard_normal((10, 24)))]
    rows += [(50, rows[0][1]), (200, rows[30][1]), (201, rows[31][1]), (30, [1.0, 2.0]), (202, rows[0][1] + [0.0] * 8), (50, rows[32][1])]
    got = {(r["vec_a"], r["vec_b"]): r["cosine"] for r in N.near_duplicates(_vectors(spark, rows)).collect()}
    assert got.keys() == {(0, 50), (100, 200), (101, 201), (50, 102)} and all(c == pytest.approx(1, abs=1e-5) for c in got.values())


def _brute_classes(rows):
    """Least reachable id and number of partners, from all pairs of usable vectors."""
    usable = {}
    for i, v in rows:
        if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v):
            usable.setdefault(len(v), []).append((i, np.array(v) / np.linalg.norm(v)))
    near = {i: set() for i, _ in rows if i is not None}
    for some in usable.values():
        ids, x = [i for i, _ in some], np.array([v for _, v in some])
        for a, b in zip(*np.nonzero(x @ x.T >= N.MIN_COSINE)):
            if ids[a] != ids[b]:
                near[ids[a]].add(ids[b])
    least = {}
    for i in sorted(near):
        reach = [i] if i not in least else []
        while reach:
            k = reach.pop()
            if k not in least:
                least[k] = i
                reach += near[k]
    return {i: (least[i], len(near[i])) for i in near}


def _classes_of(df):
    assert df.columns == ["vec_id", "class_id", "links"]
    got = [(r["vec_id"], (r["class_id"], r["links"])) for r in df.collect()]
    assert len(got) == len(dict(got))
    return dict(got)


def _clusters(rng, sizes, dim, noise):
    """Clusters of different vectors around random directions; unlike clusters are far apart."""
    return np.concatenate([c + rng.standard_normal((n, dim)) * noise for n, c in zip(sizes, rng.standard_normal((len(sizes), dim)))])


@pytest.mark.parametrize(("cell_rows", "at_once", "numbers"), [(512, 1 << 19, 1 << 21), (2, 50, 100)])
def test_vector_classes_equal_brute_force(spark, cell_rows, at_once, numbers, monkeypatch):
    """One cell or many, clusters, chains, copies, ids with several vectors, several dimensions, and rows without a usable vector."""
    monkeypatch.setattr(N, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(N, "_AT_ONCE", at_once)
    monkeypatch.setattr(N, "_NUMBERS", numbers)
    rng = np.random.default_rng(8)
    x = _clusters(rng, [25, 10, 4, 2, *[1] * 40], 48, 0.07)
    chain = [np.cos(0.2 * k) * np.eye(48)[0] + np.sin(0.2 * k) * np.eye(48)[1] for k in range(6)]
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(len(x)) + 100, x)] + [(10 - k, v.tolist()) for k, v in enumerate(chain)]
    rows += [(300 + k, rows[3][1]) for k in range(4)] + [(310, (np.array(rows[30][1]) * 2).tolist())]
    rows += [(320, rows[0][1]), (320, rows[26][1]), (rows[40][0], rows[36][1]), (rows[1][0], rows[2][1]), (321, rows[60][1]), (321, rows[61][1]), *rows[:3]]
    rows += [(400 + k, (v * 3).tolist()) for k, v in enumerate(_clusters(rng, [5, 1], 24, 0.05))] + [(320, rows[-1][1]), (500, [1.0, 2.0])]
    rows += [(501, None), (502, []), (503, [0.0] * 48), (504, [float("nan")] * 48), (505, [1.0, None]), (None, rows[0][1])]
    want = _brute_classes(rows)
    assert _classes_of(N.classes(_vectors(spark, rows))) == want
    assert want[10][0] == want[5][0] == 5 and want[7][1] == 2 and want[501] == (501, 0)
    pairs = N.near_duplicates(_vectors(spark, rows)).collect()
    assert len(pairs) == len({(r["vec_a"], r["vec_b"]) for r in pairs}) and 2 * len(pairs) == sum(n for _, n in want.values())


def test_vector_classes_of_nothing(spark):
    assert _classes_of(N.classes(_vectors(spark, []))) == {}
    assert _classes_of(N.classes(_vectors(spark, [(1, None), (1, [2.0]), (None, [1.0])]))) == {1: (1, 0)}


def test_dense_clusters_of_vectors_return_no_pairs(spark):
    """A cluster of different vectors is a row a vector, and no more than one for each table on the way."""
    x = _clusters(np.random.default_rng(9), [300, 50], 32, 0.08)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    want = _brute_classes(rows)
    assert sum(n for _, n in want.values()) > 80_000
    found = N._found(N._nodes(_vectors(spark, rows)).selectExpr("node", "v", "1 as one", "0 as several"), N.MIN_COSINE, expand=False)
    assert found.count() <= len(rows) * N.Plan(32, len(rows)).tables
    assert _classes_of(N.classes(_vectors(spark, rows))) == want


def test_vector_query_equals_sql(spark, tmp_path):
    rng = np.random.default_rng(10)
    rows = [(i, v.tolist()) for i, v in enumerate(_clusters(rng, [12, 5, 2, *[1] * 60], 16, 0.05))]
    rows += [(3, rows[15][1]), (90, rows[0][1]), (91, rows[0][1]), (92, [1.0]), (93, None), (94, [0.0] * 16)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = {i: (c, n) for i, c, n in con.sql(N.NEARDUP_SQL).fetchall()}
    assert _classes_of(N.neardup_query(spark, str(tmp_path))) == want
    assert want == _brute_classes(rows) and sum(n for _, n in want.values()) > 100

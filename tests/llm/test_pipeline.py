import collections

import duckdb
import numpy as np
import pyarrow as pa

import corpus_pipeline
from tests.llm.test_jaccard import brute
from threadloom.llm import decontaminate, language, mixing, textcore, toxicity

D = "/root/testdata/sf0.001"


def test_run_equals_brute_force(spark, words):
    """Each stage's decisions, made again one document at a time (classifiers: by the same models, read document by document)."""
    base = spark.read.parquet(f"{D}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{D}/{t}.parquet") for t in ("labels", "benchmark"))
    docs = sorted(base.collect(), key=lambda r: r["doc_id"])
    m = language.fit_on(base)
    one = lambda t: pa.array([t])
    docs = [r for r in docs if (d := m.decode(one(r["text"])))[0][0] >= 0 and d[2][0] >= m.margin]
    x = toxicity.fit_on(spark.createDataFrame(docs, base.schema), labels)
    docs = [r for r in docs if not x.scores(one(r["text"]))[0] >= x.threshold]
    root = {r["doc_id"]: r["doc_id"] for r in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in brute([(r["doc_id"], r["text"]) for r in docs], words):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    docs = [r for r in docs if find(r["doc_id"]) == r["doc_id"]]
    h = lambda t: np.array([textcore.hash_word(w) for w in words(t)], dtype=np.uint64)
    items = [h(r["text"]) for r in bench.collect()]
    docs = [r for r in docs if not any(len(i) and sum(t[2] for t in decontaminate.tiles(h(r["text"]), i)) >= decontaminate.COVERAGE * len(i) for i in items)]
    con = duckdb.connect()
    con.register("docs", spark.createDataFrame(docs, base.schema).toPandas())
    want = sorted(con.sql(mixing.decide_sql("docs")).fetchall())
    got = corpus_pipeline.run(spark, D)
    assert got.columns == [*base.columns, "copies"]
    rows = got.collect()
    assert sorted((r["doc_id"], r["source"], r["copies"]) for r in rows) == want
    text = {r["doc_id"]: r["text"] for r in docs}
    assert all(text[r["doc_id"]] == r["text"] for r in rows) and collections.Counter(r["doc_id"] for r in rows).most_common(1)[0][1] == 1


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in every column, empty, blank and very long texts, repeated rows, names that clash, empty labels and benchmark."""
    long = " ".join(f"w{i % 5000}x" for i in range(60_000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "the words of a text", "en", "a", 19), (3, "the words of a text", "en", "a", 19), (None, "no id here", "en", None, 10), (4, long, "en", "b", len(long)), (5, long + " more", None, "b", None), (6, "!!!", "en", "a", 3)]
    base = spark.createDataFrame([(*r, "T", 1) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, TEXT string, copies int")
    for name, schema in (("labels", "doc_id bigint, quality int, toxic int"), ("benchmark", "item_id bigint, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    docs, seen = base, []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns[: len(base.columns)] == base.columns
        seen.append(sorted(r["doc_id"] or 0 for r in docs.collect()))
    assert seen[:4] == [[0, 3, 3, 4, 5], [0, 3, 3, 4, 5], [0, 3, 3, 4], [0, 3, 3, 4]] and set(seen[4]) <= {3, 4} and docs.columns[-1] == "copies_"


def test_stages_chain(spark):
    docs = base = spark.read.parquet(f"{D}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, D)
        assert docs.columns[: len(base.columns)] == base.columns and docs.count() == 0

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom import schemas
from threadloom.functions import text as tx
from threadloom.operators import chunks, cleaning, evaluation, matching, panel, threads, topics
from threadloom.sources import readers, writers
from threadloom.streaming import ingest
from tests.test_functions import LEX


def loop_chunks(n, target=30, least=15, absorb=True):
    i, sizes = 0, []
    while i < n:
        left = n - (i + target)
        size = n - i if absorb and 0 < left < least else min(target, n - i)
        sizes.append(size)
        i += size
    return sizes


def test_absorbed_equals_loop(spark):
    rows = [(n, p) for n in range(1, 160) for p in range(n)]
    d = spark.createDataFrame(rows, "n int, p int").withColumn("c", chunks.absorbed(F.col("p"), F.col("n")))
    got = {}
    for r in d.groupBy("n", "c").count().collect():
        got.setdefault(r["n"], {})[r["c"]] = r["count"]
    assert all([v for _, v in sorted(got[n].items())] == loop_chunks(n) for n in got)


def _messages(spark, sizes):
    rng = random.Random(1)
    rows = [(f"t{t:03}", p + 1, 1_700_000_000 + 50_000 * t + 997 * p + rng.randrange(900), f"m{t}.{p}") for t, n in enumerate(sizes) for p in range(n)]
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "thread string, pos int, s bigint, msg string")
    return d.withColumn("day", F.to_date(F.timestamp_seconds("s"))), rows


def test_training_chunks_equal_loop(spark):
    sizes = [1, 14, 15, 29, 30, 31, 44, 45, 3, 9, 59, 60, 14, 74]
    d, rows = _messages(spark, sizes)
    by = {}
    for t, p, s, m in rows:
        by.setdefault(t, []).append((p, s, m))
    want = []
    for t in sorted((t for t in by if len(by[t]) >= 15), key=lambda t: min(x[1] for x in by[t])):
        msgs, at = [m for _, _, m in sorted(by[t])], 0
        for n in loop_chunks(len(msgs)):
            want.append(" [SEP] ".join(msgs[at : at + n]))
            at += n
    pool = [m for _, _, _, m in sorted((s, t, p, m) for t, p, s, m in rows if len(by[t]) < 15)]
    want += [" [SEP] ".join(pool[i : i + 30]) for i in range(0, len(pool), 30) if len(pool[i : i + 30]) >= 15]
    got = chunks.training_chunks(d, "thread", "s", "pos", "day", "msg").orderBy("chunk_id").collect()
    assert [r["chunk_text"] for r in got] == want and [r["chunk_id"] for r in got] == list(range(len(want)))


def test_daily_chunks_never_span_days(spark):
    d, _ = _messages(spark, [100, 80, 5])
    d = d.withColumns({"stock": F.when(F.col("pos") % 2 == 0, "A").otherwise("B"), "id": F.col("msg")})
    got = chunks.daily_chunks(d, "stock", "s", "id", "day", "msg")
    assert chunks.spanning_days(got).first()["cross_day"] == 0 and got.agg(F.sum("n_messages")).first()[0] == 185
    assert chunks.build(d.withColumn("k", F.split("stock", "x")), ["day"], ["s"], "day", "msg", [chunks.dominant(F.col("k"), ["A", "B"]).alias("l")]).where("l = 'MIXED'").count() > 0


def test_thread_chunks(spark):
    d = spark.createDataFrame([("t", i, f"m{i}", "ctx" if i == 1 else None) for i in range(1, 102)], "submission_id string, p int, m string, c string")
    got = threads.thread_chunks(d, "submission_id", "p", "m", 100, "c").orderBy("chunk_id").collect()
    assert [r["n_messages_in_chunk"] for r in got] == [100, 1] and got[1]["chunk_comments"] == "[MSG 1]\nm101" and got[0]["chunk_comments"].startswith("[MSG 1]\nm1\n\n[MSG 2]\nm2") and got[0]["c"] == "ctx"


def test_summaries_follow_the_thread(spark):
    d = spark.createDataFrame([("t", 0, 1, "p", "x"), ("t", 1, 1, "p", "y"), ("u", 0, 1, None, "z")], "submission_id string, chunk_id int, n_messages_in_chunk int, submission_text string, chunk_comments string")

    def model(prompt):
        return "no answer" if "Messages:\nz" in prompt else 'so {"main_stock_or_company": "A", "thread_topic": "%s", "financial_angle": "mixed"}' % ("again" if "So far:" in prompt else "first")

    got = {(r["submission_id"], r["chunk_id"]): r for r in threads.summarize(d, model).collect()}
    assert "[thread_topic]: first" in got["t", 0]["LLM_summary"] and "[thread_topic]: again" in got["t", 1]["LLM_summary"] and got["u", 0]["main_stock_or_company"] == "unclear"


def test_cleaning_rules_in_order(spark):
    rows = [(0, "a", 5, "x", "s1", "hi"), (1, "a", 5, "y", "s1", "hi"), (2, "b", 5, "VisualMod", "s1", "q"), (3, "c", 5, "Comodo", "s1", "hi"), (4, "d", 6, None, " NaN ", "z"), (5, "e", None, "z", "s1", None), (6, "f", None, "z", "s1", ""), (7, "d", 7, "robotics", "s2", "k"), (8, "g", 1, "w", "s1", "hi")]
    d = spark.createDataFrame(rows, "o int, id string, created_utc bigint, author string, submission_id string, body_text string")
    tagged = cleaning.tag_removals(cleaning.standardized(d), ["o"])
    got = {r["o"]: r["removed_by"] for r in tagged.collect()}
    assert got == {0: None, 1: "duplicate_id", 2: "bot_mod", 3: "composite_duplicate", 4: "missing_submission_id", 5: None, 6: "composite_duplicate", 7: "bot_mod", 8: None}
    report = cleaning.report(tagged).first()
    assert report["input_rows"] == 9 and report["output_rows"] == 3 and report["unique_threads"] == 1
    pos = {r["id"]: r["thread_position"] for r in cleaning.clean(d, ["o"]).collect()}
    assert pos == {"g": 1, "a": 2, "e": 3}
    # The order of rows in the table doesn't matter.
    assert {r["o"]: r["removed_by"] for r in cleaning.tag_removals(cleaning.standardized(d.orderBy(F.desc("o"))), ["o"]).collect()} == got


def test_contract(spark):
    with pytest.raises(schemas.MissingColumns, match="close"):
        schemas.require(spark.createDataFrame([("a", 1.0)], "symbol string, open double"), "bars")
    assert schemas.project(spark.range(1).withColumn("b", F.lit(1)), ["b", "zz", "id"]).columns == ["b", "id"]


def _counts(spark, tn, fp, fn, tp):
    rows = [(-1, -1)] * tn + [(-1, 1)] * fp + [(1, -1)] * fn + [(1, 1)] * tp
    return evaluation.scores(evaluation.confusion(spark.createDataFrame(rows, "t int, p int"), "t", "p")).first()


@pytest.mark.parametrize(("cm", "want"), [((1614, 142, 778, 466), (0.7206, 0.6469, 0.6407, 0.3174)), ((2038, 38, 525, 399), (0.8541, 0.7068, 0.7325, 0.4843))])
def test_published_agreement(spark, cm, want):
    s = _counts(spark, *cm)
    assert tuple(round(s[c], 4) for c in ("precision_macro", "recall_macro", "f1_macro", "kappa")) == want


def test_agreement_edges(spark):
    s = _counts(spark, 0, 0, 0, 3)
    assert s["accuracy"] == 1 and s["kappa"] is None and s["precision_macro"] == 0.5
    empty = evaluation.scores(evaluation.confusion(spark.createDataFrame([], "t int, p int"), "t", "p")).first()
    assert empty["f1_macro"] is None
    full = json.loads(evaluation.full_report(spark.createDataFrame([(1, 0, "a"), (-1, -1, "b")], "t int, p int, g string"), "t", "p", "g").first()[0])
    assert full["strict"]["fn"] == 1 and full["liberal"]["tp"] == 1 and [x["g"] for x in full["per_group"]] == ["a", "b"]


def test_auc_equals_pairs(spark):
    rng = random.Random(2)
    rows = [(g, rng.randrange(2), float(rng.randrange(6))) for g in "ab" for _ in range(60)]
    got = {r["g"]: r["auc"] for r in evaluation.auc(spark.createDataFrame(rows, "g string, y int, s double"), "y", "s", ["g"]).collect()}
    for g in "ab":
        p, n = ([s for k, y, s in rows if k == g and y == c] for c in (1, 0))
        assert got[g] == pytest.approx(sum((a > b) + (a == b) / 2 for a in p for b in n) / len(p) / len(n))
    assert evaluation.auc(spark.createDataFrame([(1, 0.5)], "y int, s double"), "y", "s").first()["auc"] is None


def _days(spark, returns):
    rows = [(f"2025-01-{i + 1:02}", 1.0, 1.0 + r) for i, r in enumerate(returns)]
    return spark.createDataFrame(rows, "d string, open double, close double").select(F.to_date("d").alias("date"), "open", "close")


def test_activity_and_target(spark):
    f = panel.features(_days(spark, [0.1, -0.2, 0.3, 0.4]), _days(spark, [0.0, 0.0, 0.0, 0.0]))
    a = panel.with_activity(f).orderBy("date").collect()
    assert a[0]["threshold"] == pytest.approx(0.325) and [r["active"] for r in a] == [0, 0, 0, 1]
    assert [r["target"] for r in panel.with_target(panel.with_activity(f)).orderBy("date").collect()] == [0, 0, 1]


def test_folds(spark):
    d = _days(spark, [0.0] * 30)
    n = {(r["fold"], r["part"]): r["count"] for r in panel.cv_folds(d).groupBy("fold", "part").count().collect()}
    assert [n[k, "train"] for k in range(5)] == [5, 10, 15, 20, 25] and {n[k, "test"] for k in range(5)} == {5}


def test_logit_by_newton_steps(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((120, 2))
    y = (rng.random(120) < 1 / (1 + np.exp(-(x[:, 0] - 0.5)))).astype(int)
    d = spark.createDataFrame([(float(a), float(b), int(t)) for (a, b), t in zip(x, y)], "a double, b double, target int")
    got = {r["feature"]: r for r in panel.odds_ratios(d, ["a", "b"]).collect()}
    z = np.column_stack([np.ones(120), (x - x.mean(0)) / x.std(0)])
    w = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ w))
        h = z.T @ (z * (p * (1 - p))[:, None])
        w += np.linalg.solve(h, z.T @ (y - p))
    assert got["a"]["coefficient"] == pytest.approx(w[1], abs=1e-5) and got["b"]["odds_ratio"] == pytest.approx(np.exp(w[2]), abs=1e-5)
    from math import erfc, sqrt

    se = np.sqrt(np.diag(np.linalg.inv(h)))
    assert got["a"]["p_value"] == pytest.approx(erfc(abs(w[1] / se[1]) / sqrt(2)), abs=1e-4)


def test_cross_validation_finds_the_signal(spark):
    rng = np.random.default_rng(1)
    rows = [(f"2025-{1 + i // 28:02}-{1 + i % 28:02}", float(v), float(rng.standard_normal()), int(v + 0.3 * rng.standard_normal() > 0)) for i, v in enumerate(rng.standard_normal(60))]
    d = spark.createDataFrame(rows, "d string, m double, topic_1 double, target int").select(F.to_date("d").alias("date"), "m", "topic_1", "target")
    out = panel.compare(d, ["m"], ["topic_0", "topic_1"], folds=3)
    assert out["models"]["market_only"]["auc"] > 0.85 and out["models"]["market_only"]["gini"] == pytest.approx(2 * out["models"]["market_only"]["auc"] - 1)


def test_phrases(spark):
    d = spark.createDataFrame([(["a", "b", "c"] * 10,), (["a", "b"],), (["x", "y"],), ([],), (["a"],)], "tokens array<string>")
    assert {(r["a"], r["b"]): r["n"] for r in topics.bigram_counts(d).collect()} == {("a", "b"): 11, ("b", "c"): 10, ("c", "a"): 9, ("x", "y"): 1}
    joined = [r["tokens"] for r in topics.join_phrases(d, ["a b", "b c"]).collect()]
    assert joined == [["a_b", "c"] * 10, ["a_b"], ["x", "y"], [], ["a"]]


def test_topics_recover_planted_words(spark):
    rng = random.Random(4)
    sets = [["red", "green", "blue", "pink"], ["cat", "dog", "cow", "hen"]]
    d = spark.createDataFrame([(i, [rng.choice(sets[i % 2]) for _ in range(20)]) for i in range(60)], "id int, tokens array<string>")
    vocab = topics.vocabulary(d, no_below=2, no_above=0.9)
    bow = vocab.transform(d)
    model = topics.train(bow, 2, passes=15)
    words = topics.topic_words(model, vocab.vocabulary, 4).cache()
    found = {}
    for r in words.collect():
        found.setdefault(r["topic_id"], set()).add(r["word"])
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, sets))
    theta = topics.topic_panel(model, bow, ["id"]).collect()
    assert all(abs(r["topic_0"] + r["topic_1"] - 1) < 1e-5 for r in theta)
    assert {r["dominant_topic"] for r in topics.dominant_topic(spark.createDataFrame(theta), 2).collect()} == {0, 1}
    assert topics.diversity(words, 4).first()[0] == 1.0 and topics.overlapping(words, 4).count() == 0
    assert topics.perplexity(model, bow)[0] > 0
    rows = topics.search_k(bow, d, vocab.vocabulary, [2, 3], passes=3, top=4)
    assert [r["K"] for r in rows] == [2, 3] and rows[0]["coherence_cv"] > 0.5
    assert topics.best_k(spark.createDataFrame(rows)).first()["K"] in (2, 3)
    template = json.loads(topics.label_template(words, 3).first()[0])
    assert set(template) == {"topic_0", "topic_1"} and len(template["topic_0"]["top_words"]) == 3
    named = topics.named(words.select("topic_id").distinct(), spark.createDataFrame([(0, "colours"), (1, " ")], "topic_id int, name string"))
    assert {r["topic_name"] for r in named.collect()} == {"colours - topic 0", "topic_1"}
    back = topics.expand_bow(bow, vocab.vocabulary).orderBy("id").first()["tokens"]
    assert sorted(back) == sorted(d.orderBy("id").first()["tokens"])
    assert topics.tfidf(bow).count() == 60


def test_npmi_by_hand(spark):
    d = spark.createDataFrame([(["a", "b", "c"],), (["a", "b"],), (["c", "d"],), (["a"],)], "tokens array<string>")
    w = spark.createDataFrame([(0, 1, "a"), (0, 2, "b"), (0, 3, "c")], "topic_id int, rank int, word string")
    got = {(r["wi"], r["wj"]): r["npmi"] for r in topics.npmi_pairs(d, w, 3, size=2).collect()}
    # Windows: ab, bc, ab, cd, a.
    assert got["b", "a"] == pytest.approx(np.log(0.4 / (0.6 * 0.6)) / -np.log(0.4), abs=1e-6)
    assert topics.npmi(d, w, 3, 2).count() == topics.c_v(d, w, 3, 2).count() == 1


RAW = [
    {"id": "1", "link_id": "t3_9", "created_utc": 1735689600, "subreddit": "Talk", "author": "a", "body": "buy $AMD now", "score": 1},
    {"id": "2", "link_id": "t3_9", "created_utc": 1767225599, "subreddit": "talk", "author": "b", "body": "NVDA and amd", "score": 1},
    {"id": "3", "link_id": "t3_9", "created_utc": 1767225600, "subreddit": "talk", "author": "b", "body": "NVDA", "score": 1},
    {"id": "4", "link_id": "t3_9", "created_utc": None, "subreddit": "talk", "author": "b", "body": "NVDA", "score": 1},
    {"id": "5", "link_id": "t3_9", "created_utc": 1735689600, "subreddit": "other", "author": "b", "body": "NVDA", "score": 1},
    {"id": "6", "link_id": "t3_9", "created_utc": 1735689600, "subreddit": "talk", "author": "b", "body": "[Removed]", "score": 1},
]


def _archive(path, window=None):
    import zstandard

    data = ("\n".join(json.dumps(r) for r in RAW) + "\n\nnot json {\n").encode()
    params = zstandard.ZstdCompressionParameters(window_log=28, compression_level=3, enable_ldm=True) if window else None
    out = zstandard.ZstdCompressor(compression_params=params).compressobj() if window else zstandard.ZstdCompressor().compressobj()
    path.write_bytes(out.compress(data) + out.flush())


@pytest.mark.parametrize("read", [readers.read_objects, readers.read_long_window])
def test_extract_from_archive(spark, tmp_path, read):
    _archive(tmp_path / "c.json.zst", window=read is readers.read_long_window)
    raw = read(spark, str(tmp_path / "c.json.zst"), "comment", 2)
    assert raw.count() == 6
    rows = matching.extract_rows(raw, "comment", LEX, "Talk", "2025-01-01", "2025-12-31", "https://forum.example").orderBy("id").collect()
    assert [(r["id"], r["matched_tickers"], r["submission_id"], r["date_utc"]) for r in rows] == [("1", "AMD", "9", "2025-01-01"), ("2", "AMD|NVDA", "9", "2025-12-31")]
    c = matching.ingest_counters(raw, "talk", "2025-01-01", "2025-12-31").first()
    assert tuple(c) == (6, 1, 2, 3)


def test_delimited_round_trip(spark, tmp_path):
    d = spark.createDataFrame([("a", 'quote " and\nline', 1)], "id string, t string, n int")
    writers.write_delimited(d, str(tmp_path / "x"), ["id", "t"])
    back = readers.read_delimited(spark, str(tmp_path / "x"), schemas.T.StructType.fromDDL("id string, t string"))
    assert back.first()["t"] == 'quote " and\nline'
    writers.write_table(d, str(tmp_path / "y"), by=["n"])
    assert spark.read.parquet(str(tmp_path / "y")).count() == 1
    (tmp_path / "l.csv").write_text("id,Relevance\n1,0\n,1\n")
    assert readers.read_labels(spark, str(tmp_path / "l.csv")).count() == 1


def test_append_does_only_what_is_left(spark, tmp_path):
    todo, calls = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string"), []

    def make(df):
        calls.append(df.count())
        return df

    writers.append_remaining(todo.where("k < 3"), str(tmp_path / "t"), ["k"], make)
    assert writers.append_remaining(todo, str(tmp_path / "t"), ["k"], make).count() == 3 and calls == [2, 1]
    assert writers.write_report(todo.agg(F.count("*").alias("n")), str(tmp_path / "r.json")) == {"n": 3} == json.loads((tmp_path / "r.json").read_text())


def test_streaming_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(json.dumps(r) for r in RAW[:3]))
    stream = ingest.extract_stream(ingest.new_objects(spark, str(tmp_path / "in")), "comment", LEX, "talk", "2025-01-01", "2025-12-31")
    run = lambda: ingest.write_stream(ingest.once_by_id(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    (tmp_path / "in/b.json").write_text("\n".join(json.dumps(r) for r in [RAW[0], *RAW[3:], RAW[1] | {"id": "7"}]))
    run()
    got = sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == ["1", "2", "7"]


def test_streamed_fold_keeps_state(spark, tmp_path):
    (tmp_path / "in").mkdir()
    chunk = "submission_id string, chunk_id int, msg string"
    rows = lambda r: "\n".join(json.dumps(dict(zip(("submission_id", "chunk_id", "msg"), x))) for x in r)
    (tmp_path / "in/a.json").write_text(rows([("t", 1, "b"), ("t", 0, "a"), ("u", 0, "z")]))
    fold = ingest.fold_stream(spark.readStream.schema(chunk).json(str(tmp_path / "in")), lambda last, r: (last or "") + r["msg"])
    run = lambda: ingest.write_stream(fold, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    (tmp_path / "in/b.json").write_text(rows([("t", 2, "c")]))
    run()
    assert sorted((r[0], r[1], r[2]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("t", 0, "a"), ("t", 1, "ab"), ("t", 2, "abc"), ("u", 0, "z")]


def test_prompt(spark):
    p = spark.range(1).select(tx.summary_prompt(F.lit("post"), F.lit("[MSG 1]\nx"), F.lit(None).cast("string"))).first()[0]
    assert p.startswith(tx.PROMPT) and "So far" not in p and p.endswith("[MSG 1]\nx")


def test_tokens_are_runs_of_letters(spark):
    d = spark.createDataFrame([("Ab abc ABCd[SEP]efg1hij x-ray déjà naïve cafés \U00010400\U00010401\U00010402",), ("",), (None,)], "t string")
    got = [r["x"] for r in d.select(topics.tokens(F.col("t")).alias("x")).collect()]
    assert got == [["abc", "abcd", "efg", "hij", "ray", "déjà", "naïve", "cafe", "\U00010428\U00010429\U0001042a"], [], []]
    assert d.select(topics.tokens(F.col("t"), least=1).alias("x")).first()["x"][:2] == ["ab", "abc"]
    plan = str(d.select(topics.tokens(F.col("t")))._jdf.queryExecution().optimizedPlan())
    assert "filter(" not in plan and "split(" not in plan


def test_long_documents_are_inferred_in_few_rounds():
    rng = np.random.default_rng(3)
    alpha, lens = np.array(topics.asymmetric_prior(4)), np.array([3000, 1, 40, 800])
    weights = [np.exp(topics._expected_log(rng.gamma(100, 1 / 100, (1, lens.sum()))))[0] for _ in range(4)]
    counts, gamma, rounds = rng.integers(1, 4, lens.sum()).astype(float), rng.gamma(100, 1 / 100, (4, 4)), []
    ratio = topics._ratio
    try:
        topics._ratio = lambda *a: rounds.append(1) or ratio(*a)
        topics._infer(weights, counts, lens, alpha, gamma)
    finally:
        topics._ratio = ratio
    assert len(rounds) < 400
    ends = np.cumsum(lens)
    theta = np.exp(topics._expected_log(gamma))
    r = topics._ratio(weights, counts, lens, theta)
    again = np.stack([np.add.reduceat(w * r, ends - lens) for w in weights], axis=1) * theta + alpha
    assert np.abs(again - gamma).mean(axis=1).max() < 2e-3 and np.allclose(gamma.sum(axis=1), alpha.sum() + np.add.reduceat(counts, ends - lens))


def test_training_matches_mllib_and_takes_vectors_of_any_kind(spark):
    from pyspark.ml.clustering import LDA
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(5)
    rows = [(i, Vectors.sparse(30, {int(t): 1.0 + int(t) % 3 for t in rng.choice(15, 6, False) + 15 * (i % 2)})) for i in range(80)]
    bow = spark.createDataFrame(rows + [(80, Vectors.sparse(30, {})), (81, Vectors.dense([1.0] + [0.0] * 29)), (82, None)], ["id", "bow"]).repartition(3).cache()
    some = bow.where("id < 80")
    # Either may end in one topic for all, by the seed.
    theirs = min(LDA(k=2, maxIter=20, optimizer="online", seed=seed, featuresCol="bow", docConcentration=topics.asymmetric_prior(2), subsamplingRate=1.0).fit(some).logPerplexity(some) for seed in (1, 42))
    assert abs(min(topics.train(some, 2, 20, seed).logPerplexity(some) for seed in (1, 2)) - theirs) < 0.05
    model = topics.train(bow, 2, passes=20)
    assert model.vocabSize() == 30
    assert topics.train(bow, 2, passes=20).describeTopics(30).collect() == model.describeTopics(30).collect()


def test_the_vocabulary_is_whole(spark):
    words = ["".join(chr(97 + int(ch)) for ch in f"{i:06d}") for i in range(270000)]
    d = spark.createDataFrame([(words,), (words[:3],)], "tokens array<string>")
    v = topics.vocabulary(d, no_below=1, no_above=1.0)
    assert len(v.vocabulary) == 270000 and v.vocabulary[:4] == words[:4]
    assert topics.vocabulary(d, no_below=1, no_above=0.5).vocabulary[0] == words[3]
    with pytest.raises(ValueError):
        topics.vocabulary(d, no_below=3)


def test_windows_are_counted_in_one_pass(spark):
    rng = random.Random(8)
    letters = "abcdefghij"
    rows = [(i, [rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 9, 10, 11, 400]))] if i % 7 else None) for i in range(60)]
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def read(tokens):
        seen.add(1)
        return tokens

    d = spark.createDataFrame(rows, "i int, tokens array<string>").select(read("tokens").alias("tokens"))
    w = spark.createDataFrame([(0, r, x) for r, x in enumerate("acegz", 1)], "topic_id int, rank int, word string")
    for size in (1, 2, 10, 50):
        want, total = {}, 0
        for _, x in rows:
            for s in range(max(1, len(x) - size + 1) if x else 0):
                held, total = sorted(set(x[s : s + size]) & set("acegz")), total + 1
                for i, a in enumerate(held):
                    for b in held[i:]:
                        want[a, b] = want.get((a, b), 0) + 1
        co, n = topics.window_counts(d, w, size)
        assert {(r["a"], r["b"]): r["n"] for r in co.collect()} == want and n.first()["n_win"] == total
    seen.value = 0
    topics.npmi_pairs(d, w, 5).collect()
    assert seen.value == 60


def _texts():
    rng = random.Random(11)
    words = ["red", "green", "blue", "cat", "dog", "été", "x"]
    return [[rng.choice(words) for _ in range(rng.choice([0, 1, 2, 30]))] for _ in range(200)] + [None, ["once"], ["dog", "dog", "dog"]]


def _counted(rows):
    ones, twos = {}, {}
    for x in rows:
        for w in x or ():
            ones[w] = ones.get(w, 0) + 1
        for p in zip(x or (), (x or ())[1:]):
            twos[p] = twos.get(p, 0) + 1
    return ones, twos


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_scores_are_counted_by_runs(spark, monkeypatch):
    monkeypatch.setattr(topics, "RUN", 500)
    rows = _texts()
    ones, twos = _counted(rows)
    got = topics.phrase_scores(spark.createDataFrame([(x,) for x in rows], "tokens array<string>").repartition(3), 20)
    assert {(r["a"], r["b"]): (r["n"], round(r["score"], 9)) for r in got.collect()} == {(a, b): (n, round((n - 20) * len(ones) / ones[a] / ones[b], 9)) for (a, b), n in twos.items() if n >= 20}
    assert "Generate" not in _plan(got)
    assert topics.phrase_scores(spark.createDataFrame([], "tokens array<string>"), 1).count() == 0


def test_phrases_found_by_runs(spark):
    rows = _texts()
    ones, twos = _counted(rows)
    d = spark.createDataFrame([(x,) for x in rows] + [([None, "red", None, None],)] * 30, "tokens array<string>")
    ones["red"] += 30
    assert topics.phrases(d, 20, 0.1) == sorted(f"{a} {b}" for (a, b), n in twos.items() if n >= 20 and (n - 20) * len(ones) / ones[a] / ones[b] > 0.1)


def test_bigrams_are_counted_by_runs(spark):
    rows = _texts()
    twos = _counted(rows)[1]
    d = spark.createDataFrame([(x,) for x in rows], "tokens array<string>").repartition(3)
    got = topics.bigram_counts(d, least=5)
    assert {(r["a"], r["b"]): r["n"] for r in got.collect()} == {p: n for p, n in twos.items() if n >= 5} and "Generate" not in _plan(got)
    assert {(r["a"], r["b"]): r["n"] for r in topics.bigram_counts(d).collect()} == twos


def test_the_sweep_is_counted_by_runs(spark):
    twos = _counted(_texts())[1]
    got = topics.bigram_sweep(spark.createDataFrame([(x,) for x in _texts()], "tokens array<string>"), [1, 25, 9999])
    assert [tuple(r) for r in got.collect()] == [(k, sum(n >= k for n in twos.values()), sum(n for n in twos.values() if n >= k)) for k in (1, 25, 9999)]
    assert "explode" not in _plan(got)
    assert [tuple(r) for r in topics.bigram_sweep(spark.createDataFrame([], "tokens array<string>"), [1]).collect()] == [(1, 0, 0)]

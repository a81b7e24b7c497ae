"""Readers, writers and models on small files: what the catalog's queries don't reach."""

import json

import pytest
import zstandard
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from threadloom.functions import lexicon as lx
from threadloom.functions import text as tx
from threadloom.operators import chunks, cleaning, matching, panel, topics
from threadloom.schemas import whole_number
from threadloom.sources import readers, writers
from threadloom.streaming import ingest


def _archive(path, lines, **options):
    data = "\n".join(lines).encode() if isinstance(lines[0], str) else b"\n".join(lines)
    params = zstandard.ZstdCompressionParameters.from_level(3, **options) if options else None
    path.write_bytes(zstandard.ZstdCompressor(compression_params=params).compress(data))


def _object(i, **more):
    return json.dumps({"id": f"c{i}", "body": f"text {i}", "created_utc": 1736000000 + i, "subreddit": "Forum"} | more)


@pytest.mark.parametrize("long", [False, True])
def test_keep_first_by_the_order_in_the_files(spark, tmp_path, long):
    """Of rows with one id the one that stands first in the files stays, whatever its values and however the rows are spread."""
    _archive(tmp_path / "a.zst", [_object(i % 50, body=f"{900 - i}") for i in range(200)])
    _archive(tmp_path / "b.zst", [_object(i % 70, body="later") for i in range(100)])
    read = readers.read_long_window if long else readers.read_objects
    rows = read(spark, f"{tmp_path}/*.zst", "comment", spread=7, order="_ord")
    got = {r["id"]: r["body"] for r in cleaning.first_of(rows, ["id"], ["_ord"]).collect()}
    assert got == {f"c{i}": str(900 - i) if i < 50 else "later" for i in range(70)}
    assert read(spark, f"{tmp_path}/*.zst", "comment", spread=7).rdd.getNumPartitions() == 7
    assert "_ord" not in read(spark, f"{tmp_path}/*.zst", "comment").columns


def test_long_windows_and_bad_bytes(spark, tmp_path):
    _archive(tmp_path / "w.zst", [_object(1), "", "{broken", _object(2)], window_log=28)
    got = readers.read_long_window(spark, str(tmp_path / "w.zst"), "comment").collect()
    assert sorted(r["id"] for r in got) == ["c1", "c2"]
    _archive(tmp_path / "bad.zst", [_object(1).encode(), _object(2).encode().replace(b"text", b"te\xfft")])
    loose = readers.read_long_window(spark, str(tmp_path / "bad.zst"), "comment").collect()
    assert {r["body"] for r in loose} == {"te�t 2", "text 1"}
    with pytest.raises(PythonException):
        readers.read_long_window(spark, str(tmp_path / "bad.zst"), "comment", strict=True).collect()


def test_files_that_are_many_are_not_spread(spark, tmp_path):
    for k in range(6):
        (tmp_path / f"{k}.json").write_text(_object(k))
    spark.conf.set("spark.sql.files.openCostInBytes", 1 << 30)
    try:
        plan = readers.read_objects(spark, str(tmp_path), "comment", spread=4)._jdf.queryExecution().toString()
        assert "RoundRobin" not in plan
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_first_rows_of_a_file(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id,Relevance\n" + "".join(f"{90 - i},{i % 2}\n" for i in range(20)) + '"a ""b""\nc",1\n')
    got = readers.read_delimited(spark, str(tmp_path / "x.csv"), "label", rows=3).collect()
    assert [r["id"] for r in got] == ["90", "89", "88"]
    assert {r["id"] for r in readers.read_delimited(spark, str(tmp_path / "x.csv"), "label").collect()} >= {'a "b"\nc'}
    assert readers.read_delimited(spark, str(tmp_path / "x.csv"), "label", line_breaks=False, skip_bad=True).count() >= 20


def test_bars_and_configuration(spark, tmp_path):
    (tmp_path / "bars.csv").write_text("symbol,date,open,close\nAMD,2025-01-02,1.5,2.5\n")
    (r,) = readers.read_bars(spark, str(tmp_path / "bars.csv")).collect()
    assert (r["symbol"], str(r["date"]), r["open"], r["close"]) == ("AMD", "2025-01-02", 1.5, 2.5)
    (tmp_path / "c.json").write_text('{"a": [1]}')
    assert readers.read_config(str(tmp_path / "c.json")) == {"a": [1]}


def test_lexicon_files(tmp_path):
    (tmp_path / "lex.json").write_text(json.dumps({"AMD": {"cashtags": ["$AMD"], "exact_tickers": ["AMD"]}, "NFLX": {"exact_tickers": ["NFLX"]}}))
    for universe in (["AMD"], {"tickers": ["AMD"]}, {"list": [{"ticker": "AMD"}]}):
        (tmp_path / "u.json").write_text(json.dumps(universe))
        assert lx.load_lexicon(str(tmp_path / "lex.json"), str(tmp_path / "u.json")).tickers == ["AMD"]
    assert lx.load_lexicon(str(tmp_path / "lex.json")).tickers == ["AMD", "NFLX"]


ENTRIES = {
    "AMD": {"cashtags": ["$AMD"], "exact_tickers": ["AMD"], "company_names": ["Advanced Micro"]},
    "META": {"cashtags": ["$META"], "company_names": ["Meta"], "requires_context": True, "context_keywords": ["shares", "stock  price"]},
    "C++": {"exact_tickers": ["C+"]},
}


def test_the_filter_is_the_terms_together(spark):
    """A row passes the one combined pattern just where a term's own pattern, with its context, finds something."""
    lexicon = lx.compile_lexicon(ENTRIES)
    texts = ["AMD", "xAMD", "$amd", "a $AMD.", "AMD_x", "advanced micro", "advanced  micro", "meta", "meta shares", "$META stock price", "shares", "éMeta shares", "C+", "C+1", "", None, "AMDX AMD"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in d.select("t", matching.has_match(F.col("t"), lexicon).alias("any"), F.size(matching.matches(F.col("t"), lexicon)).alias("n")).collect():
        assert r["any"] == (r["n"] > 0), r
    plan = matching.with_matches(d, "t", lexicon)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") <= len(lexicon.terms) * 2 + 5
    empty = lx.compile_lexicon({})
    assert matching.with_matches(d, "t", empty).count() == 0


def test_extraction_counters(spark):
    lexicon = lx.compile_lexicon(ENTRIES)
    rows = [("Forum", 1736000000, "AMD and meta shares"), ("forum", 1736000000, "none"), ("forum", 1, "AMD"), ("other", 1736000000, "AMD"), ("forum", 1736000000, "[removed]"), (None, None, None), ("forum", 1736000000, "$amd AMD")]
    raw = spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], "id string, subreddit string, created_utc bigint, body string")
    (r,) = matching.extraction_counters(raw, "comment", lexicon, "FORUM", "2025-01-01", "2025-12-31").collect()
    assert r.asDict() == {"seen": 7, "skipped_subreddit": 2, "skipped_period": 1, "matched": 2, "written": 3}


def test_chunks_are_numbered_without_one_task_for_all(spark):
    d = spark.createDataFrame([(s, f"2025-01-{k:02d}", k, "t" * k) for s in ("b", "a") for k in range(1, 9)], "stock string, day string, seq int, chunk_text string")
    out = chunks.number(d, ["stock", "day", "seq"], [F.col("stock"), F.col("day")])
    assert [r["chunk_id"] for r in out.orderBy("stock", "day", "seq").collect()] == list(range(16)) and out.columns == [*d.columns, "chunk_id"]
    null = d.withColumn("stock", F.when(F.col("stock") == "b", F.col("stock")))
    got = chunks.number(null, ["stock", "day", "seq"], [F.col("stock")])
    assert sorted(r["chunk_id"] for r in got.collect()) == list(range(16)) and all(r["chunk_id"] < 8 for r in got.where("stock is null").collect())


TOKENS = [["deep", "red", "sea", "wave"]] * 30 + [["deep", "red", "sea"], ["red", "deep"], ["sea"], [], ["wave", "other"]] * 4


def test_phrases_are_applied(spark):
    """Bigrams join first; trigrams are pairs of what then stands."""
    d = spark.createDataFrame([(i, t) for i, t in enumerate(TOKENS)], "i int, tokens array<string>")
    two = topics.join_phrases(d, ["deep red"], "tokens")
    assert two.orderBy("i").first()["tokens"] == ["deep_red", "sea", "wave"] and two.where("i = 31").first()["tokens"] == ["red", "deep"]
    assert topics.join_phrases(two, ["deep_red sea"], "tokens").orderBy("i").first()["tokens"] == ["deep_red_sea", "wave"]
    chained = spark.createDataFrame([(1, ["a", "a", "a"])], "i int, tokens array<string>")
    assert topics.join_phrases(chained, ["a a"]).first()["tokens"] == ["a_a", "a"]
    found = topics.phrases(d, 5, 0.05)
    want = {"deep red", "red sea", "sea wave"}
    assert set(found) <= want and found
    out = topics.with_phrases(d)
    assert out.count() == len(TOKENS) and out.columns == d.columns


def test_models_of_tokens_and_corpora(spark, tmp_path):
    def load():
        return lambda texts: [[w.lower().removesuffix("s") for w in t.split()] for t in texts]

    d = spark.createDataFrame([(1, "Shares [SEP] rose"), (2, None)], "i int, t string")
    got = d.select("i", topics.model_tokens(load)(F.col("t")).alias("x")).orderBy("i").collect()
    assert [r["x"] for r in got] == [["share", "rose"], []]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TOKENS)], "i int, tokens array<string>")
    vocab = topics.vocabulary(docs, no_below=2, no_above=1.0)
    bow = vocab.transform(docs).select("i", "bow")
    topics.save_corpus(bow, vocab, str(tmp_path / "corpus"))
    again, words = topics.load_corpus(spark, str(tmp_path / "corpus"))
    back = {r["i"]: sorted(r["tokens"]) for r in topics.expand_bow(again, words.vocabulary).collect()}
    assert back == {i: sorted(t) for i, t in enumerate(TOKENS)}
    with pytest.raises(Exception):
        topics.load_corpus(spark, str(tmp_path / "nothing"))
    writers.save_model(topics.train(bow, 2, passes=1), str(tmp_path / "lda"))
    assert (tmp_path / "lda" / "metadata").exists()


def test_window_counts_equal_windows(spark):
    docs = spark.createDataFrame([(i, t * (1 + i % 3)) for i, t in enumerate(TOKENS)], "i int, tokens array<string>")
    words = spark.createDataFrame([(0, 1, "deep"), (0, 2, "sea"), (0, 3, "wave"), (0, 4, "absent")], "topic_id int, rank int, word string")
    for size in (1, 2, 3, 50):
        co, total = topics.window_counts(docs, words, size)
        win = topics.windows(docs, size)
        want = {(r["a"], r["b"]): r["n"] for r in topics.co_documents(win, words).collect()}
        assert {(r["a"], r["b"]): r["n"] for r in co.collect()} == want and total.first()["n_win"] == win.count()


def test_model_report(spark, tmp_path):
    rows = [(f"2025-{1 + i // 28:02d}-{1 + i % 28:02d}", (i * 7 % 11) / 10, (i * 5 % 13) / 10, (i * 3 % 7) / 10, 1 - (i * 3 % 7) / 10, int((i * 7 % 11 + i % 3) > 5)) for i in range(90)]
    d = spark.createDataFrame(rows, "date string, return_t double, index_return double, topic_0 double, topic_1 double, target int").withColumn("date", F.to_date("date"))
    out = panel.model_report(d, ["return_t", "index_return"], ["topic_0", "topic_1"], {"topic_1": "news"}, folds=3)
    assert out["n_days"] == 90 and set(out["models"]) == {"market_only", "topics_only", "combined"}
    assert {r["label"] for r in out["odds_ratios"]} == {"news", "return_t", "index_return"}
    assert out["auc_improvement_over_market"] == pytest.approx(out["models"]["combined"]["auc"] - out["models"]["market_only"]["auc"])
    assert json.loads((writers.write_report(out, str(tmp_path / "r.json")) and (tmp_path / "r.json")).read_text())["n_days"] == 90


def test_whole_numbers(spark):
    d = spark.createDataFrame([("1",), ("2",)], "x string")
    assert [r[0] for r in d.select(whole_number(F.col("x"), "x")).collect()] == [1, 2]
    for bad in (None, "y"):
        with pytest.raises(Exception):
            spark.createDataFrame([("1",), (bad,)], "x string").select(whole_number(F.col("x"), "x")).collect()


def brace_scan(text):
    """From each brace to its match, strings and escapes skipped; the last that is an object."""
    found = None
    for at in range(len(text)):
        depth, quoted, skip = 0, False, False
        for i in range(at, len(text) if text[at] == "{" else at):
            ch = text[i]
            if skip:
                skip = False
            elif ch == "\\":
                skip = True
            elif ch == '"':
                quoted = not quoted
            elif not quoted and ch in "{}":
                depth += 1 if ch == "{" else -1
                if depth == 0:
                    try:
                        if isinstance(json.loads(text[at : i + 1]), dict):
                            found = text[at : i + 1]
                    except ValueError:
                        pass
                    break
    return found


def test_last_json_equals_a_brace_scan():
    import random

    rng = random.Random(4)
    parts = ['{"a": 1}', "{", "}", '"', "\\", '{"b": {"c": "}"}}', "text", '{"d": "\\"{"}', "[1]", "{bad}", " ", '{"e": [', "]}"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(9)))
        assert tx.last_json_object(text) == brace_scan(text), text
    assert tx.last_json_object("{" * 200_000) is None and tx.last_json_object(None) is None


def test_daily_counts(spark, tmp_path):
    """Batch by batch, as from the whole."""
    day = 86400
    for k, rows in enumerate([[(20_000 * day + 5, "AMD"), (20_000 * day + 9, "AMD")], [(20_001 * day, "NVDA"), (20_000 * day + 50, "AMD")]]):
        (tmp_path / f"{k}.json").write_text("\n".join(json.dumps({"created_utc": t, "matched_tickers": m}) for t, m in rows))
    stream = spark.readStream.schema("created_utc bigint, matched_tickers string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "*.json"))
    q = ingest.daily_counts(stream).writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["matched_tickers"], r["n"]) for r in spark.table("daily").collect()} == {("AMD", 3), ("NVDA", 1)}


def test_pictographs_in_sequences():
    words = lambda t: tx.emoji_words(t).split()
    assert words("go \U0001f680\U0001f680 now") == ["go", "rocket", "rocket", "now"]
    assert words("1\ufe0f\u20e3#\u20e3") == ["keycap", "1", "keycap", "#"] and words("\U0001f1fa\U0001f1f8!") == ["flag", "u", "s", "!"]
    assert words("\U0001f44d\U0001f3fd") == ["thumbs", "up", "sign", "medium", "skin", "tone"]
    assert words("\U0001f468\u200d\U0001f4bb a:b_c") == ["man", "personal", "computer", "a", "b", "c"]


def test_place_in_the_input_reaches_cleaning(spark, tmp_path):
    """From an archive to cleaned rows: of two rows with one id the first in the file stays."""
    _archive(tmp_path / "c.zst", [_object(1, body="AMD first", link_id="t3_x", author="a"), _object(1, body="AMD second", link_id="t3_x", author="a"), _object(2, body="AMD", link_id="t3_x", author="b")])
    raw = readers.read_objects(spark, str(tmp_path / "c.zst"), "comment", order="_ord")
    rows = matching.extract_rows(raw, "comment", lx.compile_lexicon(ENTRIES), "forum", "2025-01-01", "2025-12-31", keep=("_ord",))
    got = cleaning.clean(rows, order=["_ord"]).drop("_ord")
    assert [(r["id"], r["body_text"], r["thread_position"]) for r in got.orderBy("thread_position").collect()] == [("c1", "AMD first", 1), ("c2", "AMD", 2)]

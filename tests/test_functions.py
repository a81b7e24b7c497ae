import json
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadloom.functions import text as tx
from threadloom.functions.lexicon import alias_stop_words, compile_lexicon, term_pattern
from threadloom.operators import matching, relevance


def column(spark, values, f, kind="string"):
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[1] for r in d.select("i", f(F.col("x"))).orderBy("i").collect()]


def python_clean(text):
    """The chain in Python's own expressions."""
    text = re.sub(r"![\[]img[]][(]emote[^)]*[)]", " ", text)
    text = re.sub(r"[>]!(.*?)![<]", r"\1", text)
    text = re.sub(r"[\[]([^]]*)[]][(]https?://[^)]+[)]", lambda m: t if len(t := m[1].strip()) > 3 else "", text)
    for pattern, new in ((r"(?:https?://|www[.])\S+", " "), (r"[*]{1,3}([^*\n]+)[*]{1,3}", r"\1"), (r"(?m)^[>]+\s?", " "), (r"u/\w+", " "), (r"r/\w+", " "), (r"!\w+", " ")):
        text = re.sub(pattern, new, text)
    return re.sub(r"\s+", " ", re.sub(r"[^$!?a-z\s]", " ", text.lower())).strip()


PIECES = ["[two words](https://a.b)", "[ab](https://a.b)", "[this](http://a.b/c)", ">!x y!<", "**b** *i*", "\n> quote", "u/some", "and/or/not", "!banbet", "www.a.b", "https://x.y ", "![img](emote|t|1)", "É", " ", "\x1c", " ", "\x85", "\r", "\x0b", "İ", "K", "🚀", " ", "\n", "a", "$!?", "[", "](", ">", "*", "9"]


def test_cleaning_chain_equals_python(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 12))) for _ in range(4000)]
    got = column(spark, texts, tx.clean_text)
    assert [(t, g) for t, g in zip(texts, got) if g != python_clean(t)] == []


def test_emoji_words(spark):
    got = column(spark, ["to the 🚀 now", "plain", None], lambda c: tx.clean_text(c, emoji=True))
    assert got == ["to the rocket now", "plain", ""]


def test_sanitize_and_sources(spark):
    assert column(spark, ["a\0 b\n\tc ", None, "\x1c x"], tx.sanitize) == ["a b c", "", "x"]
    assert column(spark, ["[Removed]", " [deleted] ", "ok", None], tx.comment_text) == ["", "", "ok", ""]
    d = spark.createDataFrame([("T", "B"), ("T", "[removed]"), (None, "B"), ("", None)], "t string, b string")
    got = [(r[0], r[1]) for r in d.select(tx.submission_raw_text(F.col("t"), F.col("b")), tx.submission_context(F.col("t"), F.col("b"))).collect()]
    assert got == [("T \n B", "T\n\nB"), ("T", "T"), ("B", "\n\nB"), ("", "")]


def test_permalink_and_day(spark):
    d = spark.createDataFrame([("L", "1", "t3_9"), (None, "1", "t3_9"), ("", "1", None), (None, None, "t3_9")], "l string, i string, t string")
    link = lambda post: [r[0] for r in d.select(tx.permalink(F.col("l"), F.col("i"), F.col("t"), "https://forum.example", post)).collect()]
    assert link(False) == ["L", "https://forum.example/comments/9/_/1", "", ""]
    assert link(True) == ["L", "https://forum.example/comments/1", "https://forum.example/comments/1", ""]
    assert column(spark, ["0", "1735689600", "x", None], tx.utc_day) == ["1970-01-01", "2025-01-01", "", ""]


def slow_last_json(text):
    out = None
    for start in range(len(text)):
        if text[start] != "{":
            continue
        depth, quoted, skip = 0, False, False
        for i in range(start, len(text)):
            c = text[i]
            if skip:
                skip = False
            elif c == "\\":
                skip = True
            elif c == '"':
                quoted = not quoted
            elif not quoted:
                depth += (c == "{") - (c == "}")
                if depth == 0 and c == "}":
                    try:
                        json.loads(text[start : i + 1])
                        out = text[start : i + 1]
                    except ValueError:
                        pass
                    break
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(['{"a":1}', "{", "}", '"', "\\", "x", '{"b":{"c":2}}', ",", "[1]"]), max_size=9).map("".join))
def test_last_json_equals_forward_scan(text):
    assert tx.last_json_object(text) == slow_last_json(text)


def test_last_json_columns(spark):
    texts = ['x {"a":{"b":1},"c":2}', '{"a":1} {bad} {"z":"}{"}', "none", None]
    assert column(spark, texts, tx.last_json) == ['{"b":1}', '{"z":"}{"}', None, None]
    assert column(spark, ['{"a":1} then {"b":2} {x'], tx.last_flat_json) == ['{"b":2}']


def test_summary_fields(spark):
    d = spark.createDataFrame([("AMD", "", "earnings", "nonsense", None)], "a string, b string, c string, d string, e string")
    s = d.select(tx.normalized_summary({n: F.col(c) for n, c in zip(tx.SUMMARY_FIELDS, "abcde")}).alias("s")).select("s", tx.summary_text(F.col("s")).alias("t")).first()
    assert list(s["s"]) == ["AMD", "unclear", "earnings", "unclear", "unclear"]
    assert s["t"].split("\n")[1] == "[financial_angle]: earnings" and s["t"].count("\n") == 3


def test_labels(spark):
    d = spark.createDataFrame([(0.75, 0.25), (0.74, 0.26), (0.5, 0.5), (0.6, 0.4), (0.2, 0.8)], "a double, b double")
    got = [(r[0], r[1]) for r in d.select(relevance.label(F.col("a"), F.col("b")), relevance.confidence(F.col("a"), F.col("b"))).collect()]
    assert got == [(1, 0.75), (0, 0.74), (-1, 0.5), (0, 0.6), (-1, 0.8)]


def test_predict(spark):
    rows = [("!banbet X 200 by friday please", None, None), ("to the moon", None, None), ("the calls and puts of the earnings are good", "sum", "post")]
    d = spark.createDataFrame(rows, "message_text string, LLM_summary string, submission_text string")
    got = {r["message_text"][:6]: (r["predicted_relevance"], r["relevance_confidence"]) for r in relevance.predict(d, relevance.lexical_scorer(["calls", "puts", "earnings"])).collect()}
    assert got["!banbe"] == got["to the"] == (-1, 0.0) and got["the ca"] == (1, 1.0)
    model = relevance.model_scorer(lambda: lambda texts: [0.9 if "THREAD_CONTEXT: sum" in t else 0.1 for t in texts])
    assert relevance.predict(d, model).where("predicted_relevance = 1").count() == 1
    assert relevance.predict(d.limit(2), model).where("predicted_relevance = -1").count() == 2


ENTRIES = {
    "AMD": {"company_names": ["AMD", "Advanced Micro Devices"], "exact_tickers": ["AMD"], "cashtags": ["$AMD"], "risky_aliases": ["Ryzen"]},
    "NVDA": {"company_names": ["Nvidia", "NVIDIA"], "exact_tickers": ["NVDA"], "cashtags": ["$NVDA"]},
    "GOOG": {"company_names": ["Google"], "requires_context": True, "context_keywords": ["stock", "ad  revenue"]},
    "META": {"cashtags": ["$META"], "requires_context": True, "context_keywords": ["shares"]},
    "NFLX": {"exact_tickers": ["NFLX"]},
}
LEX = compile_lexicon(ENTRIES, ["AMD", "NVDA", "GOOG", "META"])


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("buy $AMD now", ("AMD", "cashtag|company_name", "high")), ("NVDA_x", ("NVDA", "ticker", "high")), ("xNVDAx éNvidia", None), ("just google it", None), ("$META alone", None),
        ("Google stock", ("GOOG", "company_name", "medium")), ("google AD REVENUE", ("GOOG", "company_name", "medium")), ("NVDA and amd", ("AMD|NVDA", "company_name|ticker", "multi_stock")), ("NFLX", None), ("ryzen", None), ("$NVDA", ("NVDA", "cashtag", "high")),
    ],
)
def test_matches(spark, text, want):
    r = matching.with_matches(spark.createDataFrame([(text,)], "x string"), "x", LEX).first()
    assert (r and (r["matched_tickers"], r["match_sources"], r["match_confidence"])) == want


def test_lexicon_helpers():
    assert [t.term for t in LEX.terms if t.ticker == "NVDA"] == ["$NVDA", "NVDA", "Nvidia"]
    assert alias_stop_words(ENTRIES, ["AMD"]) == {"amd", "advanced", "micro", "devices", "ryzen"}


def test_term_patterns_equal_python(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("aé_-.$9 \u0130") if rng.random() < 0.6 else rng.choice(["AMD", "amd", "A.B"]) for _ in range(5)) for _ in range(3000)]
    for term in ("AMD", "A.B", "$AMD"):
        for kind, before, after in (("company_name", r"(?<!\w)", r"(?!\w)"), ("ticker", r"(?<![$0-9A-Za-z])", r"(?![0-9A-Za-z])")):
            rx = re.compile(before + re.escape(term) + after, re.I)
            assert column(spark, texts, lambda c: c.rlike(term_pattern(term, kind))) == [bool(rx.search(t)) for t in texts]

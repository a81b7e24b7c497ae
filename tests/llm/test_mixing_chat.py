import collections
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from threadloom.llm import chat, mixing
from threadloom.llm.common import pick


def _rows(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def test_mixing_equals_sorted_ranks(docs):
    rows = [(i, "x" * (1 + i * 7 % 900), "en", None if i % 10 == 9 else f"s{min(i % 10, 3)}") for i in range(400)] + [(3, "x" * 800, "en", "s3")]
    d = docs(rows)
    con = duckdb.connect()
    con.register("docs", pick(d, "doc_id", "source", "n_chars").toPandas())
    for share in (0.1, 0.5, 2.5):
        want = sorted(tuple(map(str, r)) for r in con.sql(mixing.decide_sql("docs", share)).fetchall())
        assert _rows(mixing.decide(d, total_share=share)) == want
    got = mixing.decide(d, total_share=0.5).groupBy("source").sum("copies").collect()
    n = collections.Counter(r[3] for r in rows[:400])
    w = {s: c**0.5 for s, c in n.items()}
    assert {r[0]: r[1] for r in got} == {s: int(200 * x / sum(w.values()) + 0.5) for s, x in w.items()}


def test_inclusion_follows_size(docs):
    """Over many ids, documents of four times the measure are sampled four times as often."""
    rows = [(i, "x" * (1600 if i % 2 else 100), "en", "s") for i in range(6000)]
    got = collections.Counter(r["doc_id"] % 2 for r in mixing.decide(docs(rows), total_share=0.2).collect())
    assert got[0] + got[1] == 1200 and abs(got[1] / got[0] - 4) < 0.6


def test_mixing_edges(docs, spark):
    assert mixing.decide(docs([])).count() == 0
    d = docs([(1, None, None, None), (2, "", None, None), (None, "x", None, "s"), (3, "y", None, "s"), (3, "y", None, "s")])
    got = mixing.decide(d, total_share=1.0).collect()
    assert {r["doc_id"] for r in got} <= {1, 2, 3} and sum(r["copies"] for r in got) == 3
    w = spark.createDataFrame([("s", 1.0), ("none", 5.0), (None, 0.0)], "source string, weight double")
    assert {r["doc_id"]: r["copies"] for r in mixing.decide(d, w, 4 / 3).collect()} == {3: 4}
    mixed = mixing.mix(d)
    assert mixed.columns == [*d.columns, "copies_"]


def test_ties_of_the_ratio_go_to_the_smaller_id(docs, monkeypatch):
    """With all random numbers alike, documents of one measure have one ratio, and the places left go to the least ids."""
    monkeypatch.setattr(mixing, "_uniform", lambda doc_id: F.lit(0.5))
    got = mixing.decide(docs([(i, "x" * 100, "en", "s") for i in range(20, 0, -1)]), total_share=0.25).collect()
    assert sorted((r["doc_id"], r["copies"]) for r in got) == [(i, 1) for i in range(1, 6)]


def test_turns_that_tie(spark):
    """Rows of one turn are ordered by role, then by text."""
    rows = [(1, 1, "user", "b"), (1, 1, "assistant", "z"), (1, 1, "user", "a"), (1, 1, "assistant", "y"), (1, 1, "user", "a")]
    (r,) = chat.format_chats(spark.createDataFrame([(*x, "e") for x in rows], "conv_id bigint, turn bigint, role string, text string, TEXT string")).collect()
    end = "\n<|end|>\n"
    assert (r["n_turns"], r["n_messages"], r["chat"]) == (4, 2, f"<|assistant|>\ny\nz{end}<|user|>\na\nb{end}")


def test_chat(spark):
    rows = [(1, 0, "system", "S"), (1, 2, "user", "b"), (1, 1, " User ", "a"), (1, 3, "assistant", "c"), (1, 4, "user", None), (1, 5, "assistant", "d"), (1, 5, "assistant", "d"), (1, 6, None, "e"),
            (2, 0, "user", "  "), (None, 0, "user", "x"), (None, None, "user", "y"), (3, 0, "", "t" * 200_000)]
    d = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id bigint, turn bigint, role string, text string, turns string")
    got = {r["conv_id"]: (r["n_turns"], r["n_messages"], r["chat"]) for r in chat.format_chats(d).collect()}
    end = "\n<|end|>\n"
    assert got[1] == (6, 4, f"<|system|>\nS{end}<|user|>\na\nb{end}<|assistant|>\nc\nd{end}<|unknown|>\ne{end}")
    assert got[None] == (2, 1, f"<|user|>\ny\nx{end}") and 2 not in got and len(got[3][2]) > 200_000
    assert chat.format_chats(d.where("false")).count() == 0
    con = duckdb.connect()
    con.register("conversations", d.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    assert sorted(map(str, con.sql(chat.CHAT_SQL).fetchall())) == sorted(str((k, *got[k][:2], got[k][2])) for k in got)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="no test tables")
def test_round_trip(spark):
    """Messages split out of the formatted text are the turns again."""
    d = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    turns = collections.defaultdict(list)
    for r in sorted(d.collect(), key=lambda r: (r["conv_id"], r["turn"])):
        turns[r["conv_id"]].append((r["role"], r["text"]))
    for r in chat.format_chats(d).collect():
        got = [m.split("|>\n", 1) for m in r["chat"].split("\n<|end|>\n")[:-1]]
        assert [(a[2:], b) for a, b in got] == turns[r["conv_id"]]

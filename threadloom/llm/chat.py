"""Chat formatting with Spark expressions: sorted turn structs, adjacent turns of a role merged, one training text a conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import pick, table

OPEN, CLOSE, JOIN = "<|{}|>\n", "\n<|end|>\n", "\n"


def _starts(turns: Column) -> Column:
    """0-based positions at which the role changes: those whose turn before has another role, or that have none before."""
    every = F.sequence(F.lit(0), F.size(turns) - 1)
    return F.filter(every, lambda i: (i == 0) | ~turns[i]["role"].eqNullSafe(F.get(turns, i - 1)["role"]))


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns (that were kept), n_messages (after merging) and chat (the formatted text).

    Turns are ordered by turn, NULL turns first, then role, then text; turns with
    a NULL or blank text are dropped, and exact repeats of (turn, role, text)
    count once.  A NULL role is "unknown"; roles are trimmed and lower-cased.
    Adjacent turns of a role are joined by a line break.  Rows with a NULL
    conv_id form one conversation; a conversation without a usable turn has none
    of the output; an empty table gives none.  Other columns are ignored whatever
    their names, in any case.
    """
    role = F.lower(F.trim(F.coalesce(F.col("role"), F.lit("unknown"))))
    rows = pick(conversations, "conv_id", "turn", "role", "text").select("conv_id", F.struct(F.col("turn").alias("turn"), F.when(role == "", "unknown").otherwise(role).alias("role"), F.col("text").alias("text")).alias("t")).where(F.trim(F.col("t.text")) != "")
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_set("t"), _order).alias("turns"))
    chats = chats.withColumn("at", _starts(F.col("turns")))
    text = lambda a: F.array_join(F.transform(a, lambda t: t["text"]), JOIN)
    size = F.size("turns")
    message = lambda i, k: F.concat(F.format_string(OPEN.replace("{}", "%s"), F.col("turns")[i]["role"]), text(F.slice("turns", i + 1, F.coalesce(F.get(F.col("at"), k + 1), size) - i)), F.lit(CLOSE))
    return chats.select("conv_id", size.alias("n_turns"), F.size("at").alias("n_messages"), F.array_join(F.transform("at", message), "").alias("chat"))


def _order(a: Column, b: Column) -> Column:
    def by(x: Column, y: Column, rest: Column) -> Column:
        return F.when(x.isNull() & y.isNotNull(), -1).when(x.isNotNull() & y.isNull(), 1).when(x < y, -1).when(x > y, 1).otherwise(rest)

    return by(a["turn"], b["turn"], by(a["role"], b["role"], by(a["text"], b["text"], F.lit(0))))


def chat_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, formatted."""
    return format_chats(table(spark, sf_dir, "conversations"))


CHAT_SQL = r"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, CASE WHEN trim(coalesce(role, 'unknown'), ' ') = '' THEN 'unknown' ELSE lower(trim(coalesce(role, 'unknown'), ' ')) END AS role, text
  FROM conversations WHERE trim(text, ' ') <> ''),
o AS (SELECT *, row_number() OVER w AS i, CASE WHEN lag(role) OVER w IS NOT DISTINCT FROM role AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS fresh FROM t
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY i) AS run FROM o),
m AS (SELECT conv_id, run, any_value(role) AS role, count(*) AS n, string_agg(text, chr(10) ORDER BY i) AS body FROM r GROUP BY conv_id, run)
SELECT conv_id, sum(n)::INT AS n_turns, count(*)::INT AS n_messages,
       string_agg('<|' || role || '|>' || chr(10) || body || chr(10) || '<|end|>' || chr(10), '' ORDER BY run) AS chat
FROM m GROUP BY conv_id"""

"""Queries over the test tables that exercise the operators, each with SQL that gives the same rows.

Conversations stand in for threads of comments, documents for texts, labels for
human labels, events for timed messages and prices.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions import text as tx
from threadloom.functions.lexicon import compile_lexicon
from threadloom.operators import chunks, cleaning, evaluation, matching, panel, relevance, threads, topics
from threadloom.schemas import whole_number

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: A lexicon of words of the invented prose; BETA only counts in context.
ENTRIES = {
    "ALFA": {"cashtags": ["$"], "exact_tickers": ["thon"], "company_names": ["eron", "Eron"]},
    "BETA": {"exact_tickers": ["onan"], "company_names": ["ther"], "requires_context": True, "context_keywords": ["with", "was"]},
    "GAMA": {"company_names": ["une la", "heit", "ciónas"], "exact_tickers": ["anat"]},
    "OUTSIDE": {"company_names": ["the"]},
}
LEXICON = compile_lexicon(ENTRIES, ["ALFA", "BETA", "GAMA"])
FINANCE_WORDS = ["and", "for", "is", "la", "of", "que", "the", "und", "with"]


def query(name: str, sql: str | None = None):
    def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        if sql:
            SQL[name] = sql.strip()
        return f

    return add


# == matching

_NON = r"[^\pL\pM\pN_]"


def _re2(term: str, kind: str) -> str:
    body = "".join("\\" + ch if ch in "$.()" else ch for ch in term)
    if kind == "ticker":
        return rf"(?i)(^|[^$0-9A-Za-z]){body}([^0-9A-Za-z]|$)"
    return rf"(?i)(^|{_NON}){body}({_NON}|$)"


_CTX = {t: rf"(?i)(^|{_NON})({'|'.join(e['context_keywords'])})({_NON}|$)" for t, e in ENTRIES.items() if e.get("requires_context")}
_HITS = " UNION ALL ".join(
    f"SELECT doc_id, source, lang, '{t.ticker}' AS ticker, '{t.term}' AS term, '{t.kind}' AS kind FROM documents WHERE regexp_matches(text, '{_re2(t.term, t.kind)}')"
    + (f" AND regexp_matches(text, '{_CTX[t.ticker]}')" if t.ticker in _CTX else "")
    for t in LEXICON.terms
)
_MATCHED = f"""
SELECT doc_id, source, string_agg(DISTINCT ticker, '|' ORDER BY ticker) AS matched_tickers, string_agg(DISTINCT term, '|' ORDER BY term) AS matched_terms,
       string_agg(DISTINCT kind, '|' ORDER BY kind) AS match_sources, count(DISTINCT ticker)::INT AS match_count, (count(DISTINCT ticker) > 1)::INT AS is_multi_match,
       CASE WHEN count(DISTINCT ticker) > 1 THEN 'multi_stock' WHEN bool_or(kind IN ('cashtag', 'ticker')) THEN 'high' WHEN bool_or(ticker = 'BETA') THEN 'medium' ELSE 'high' END AS match_confidence,
       bool_or(ticker = 'BETA')::INT AS needs_context_filter
FROM ({_HITS}) GROUP BY doc_id, source"""


def _matched(t) -> DataFrame:
    return matching.with_matches(t("documents").select("doc_id", "source", "text"), "text", LEXICON).drop("text")


@query("q01_lexicon_match", _MATCHED)
def _(t):
    return _matched(t)


@query("q02_lexicon_counts_by_source", f"SELECT source, ticker, count(DISTINCT doc_id) AS n FROM ({_HITS}) GROUP BY ALL")
def _(t):
    hits = t("documents").where(matching.has_match(F.col("text"), LEXICON)).select("source", F.explode(F.array_distinct(F.transform(matching.matches(F.col("text"), LEXICON), lambda m: m["ticker"]))).alias("ticker"))
    return hits.groupBy("source", "ticker").agg(F.count("*").alias("n"))


@query("q03_match_confidence", f"SELECT match_confidence, count(*) AS n, sum(match_count)::BIGINT AS tickers FROM ({_MATCHED}) GROUP BY ALL")
def _(t):
    return _matched(t).groupBy("match_confidence").agg(F.count("*").alias("n"), F.sum("match_count").alias("tickers"))


@query("q04_date_range", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE (epoch_us(ts) // 1000000) BETWEEN epoch(TIMESTAMP '2024-01-05')::BIGINT AND epoch(TIMESTAMP '2024-01-12')::BIGINT + 86399")
def _(t):
    e = t("events").select("event_id", F.unix_timestamp("ts").alias("s"))
    return e.where(matching.in_period(F.col("s"), "2024-01-05", "2024-01-12")).select("event_id", tx.utc_day(F.col("s")).alias("day"))


@query("q05_set_overlap_filter", f"SELECT doc_id, list_has_any(list_transform(string_split(matched_tickers, '|'), lambda x: trim(x)), ['BETA', 'GAMA']) AS stripped, matched_tickers IN ('BETA', 'GAMA') AS single FROM ({_MATCHED}) WHERE list_has_any(string_split(matched_tickers, '|'), ['BETA', 'GAMA'])")
def _(t):
    c, targets = F.col("matched_tickers"), ["BETA", "GAMA"]
    return _matched(t).where(matching.overlaps(c, targets)).select("doc_id", matching.overlaps(c, targets, strip=True).alias("stripped"), matching.is_single_target(c, targets).alias("single"))


# == cleaning

_KEYED_SQL = "SELECT *, CASE doc_id % 11 WHEN 0 THEN NULL WHEN 1 THEN ' NaN ' WHEN 2 THEN '' WHEN 3 THEN '<NA>' ELSE source END AS thread FROM documents"


def _thread():
    return F.expr("CASE doc_id % 11 WHEN 0 THEN NULL WHEN 1 THEN ' NaN ' WHEN 2 THEN '' WHEN 3 THEN '<NA>' ELSE source END")


@query("q06_missing_key_filter", f"SELECT doc_id, thread FROM ({_KEYED_SQL}) WHERE thread IS NOT NULL AND lower(trim(thread)) NOT IN ('', 'nan', 'none', 'null', '<na>')")
def _(t):
    d = t("documents").select("doc_id", _thread().alias("thread"))
    return d.where(~cleaning.key_is_missing(F.col("thread")))


_AUTHOR = "CASE conv_id % 7 WHEN 0 THEN 'VisualMod' WHEN 1 THEN 'a_mod' WHEN 2 THEN 'robotics' WHEN 3 THEN 'Comodo' WHEN 4 THEN NULL ELSE role END"
_BOT_SQL = r"(?i)(^|[^A-Za-z])mod([^A-Za-z]|$)|visualmod|automoderator|bot"


@query("q07_author_anti_regex", f"SELECT conv_id, turn, author FROM (SELECT conv_id, turn, {_AUTHOR} AS author FROM conversations) WHERE NOT coalesce(regexp_matches(author, '{_BOT_SQL}'), false)")
def _(t):
    c = t("conversations").select("conv_id", "turn", F.expr(_AUTHOR).alias("author"))
    return c.where(~cleaning.is_automatic(F.col("author")))


@query("q08_dedup_pk_keep_first", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) = 1")
def _(t):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"]
    return cleaning.first_of(t("lineitem").select("l_orderkey", *order), ["l_orderkey"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("q09_dedup_composite", "SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY lang, text ORDER BY doc_id) = 1")
def _(t):
    # The text is compared by a 128-bit digest, so that the shuffle and the sort don't carry whole texts.
    d = t("documents").select("doc_id", "lang", "source", F.md5("text").alias("digest"))
    return cleaning.first_of(d, ["lang", "digest"], ["doc_id"]).drop("digest")


@query("q10_thread_position", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000000) NULLS LAST, event_id)::INT AS thread_position FROM events")
def _(t):
    e = t("events").select("event_id", "user_id", F.unix_timestamp("ts").alias("s"))
    return cleaning.with_thread_position(e, "user_id", "s", "event_id").drop("s")


_ALIVE1 = "row_number() OVER (PARTITION BY id, r0 IS NULL ORDER BY doc_id)"
_REPORT_SQL = f"""
WITH a AS (SELECT doc_id, doc_id // 2 AS id, thread, CASE doc_id % 13 WHEN 0 THEN 'helper_bot' ELSE lang END AS author, n_chars % 50 AS t, md5(text) AS body,
             CASE WHEN thread IS NULL OR lower(trim(thread)) IN ('', 'nan', 'none', 'null', '<na>') THEN 'missing_submission_id' END AS r0 FROM ({_KEYED_SQL})),
b AS (SELECT *, CASE WHEN r0 IS NULL AND row_number() OVER (PARTITION BY id, r0 IS NULL ORDER BY doc_id) > 1 THEN 'duplicate_id' ELSE r0 END AS r1 FROM a),
c AS (SELECT *, coalesce(r1, CASE WHEN regexp_matches(author, '{_BOT_SQL}') THEN 'bot_mod' END) AS r2 FROM b),
d AS (SELECT *, CASE WHEN r2 IS NULL AND row_number() OVER (PARTITION BY thread, t, body, r2 IS NULL ORDER BY doc_id) > 1 THEN 'composite_duplicate' ELSE r2 END AS r FROM c)
SELECT count(*) AS input_rows, count_if(r IS NULL)::BIGINT AS output_rows, count_if(r IS NOT NULL)::BIGINT AS rows_removed_total, count_if(r = 'missing_submission_id')::BIGINT AS removed_missing_submission_id,
       count_if(r = 'duplicate_id')::BIGINT AS removed_duplicate_id, count_if(r = 'bot_mod')::BIGINT AS removed_bot_mod, count_if(r = 'composite_duplicate')::BIGINT AS removed_composite_duplicate,
       count(DISTINCT CASE WHEN r IS NULL THEN thread END) AS unique_threads, count(DISTINCT CASE WHEN r IS NULL THEN id END) AS unique_ids FROM d"""


@query("q11_clean_report", _REPORT_SQL)
def _(t):
    d = t("documents").select("doc_id", F.expr("doc_id div 2").alias("id"), _thread().alias("thread"), F.expr("CASE doc_id % 13 WHEN 0 THEN 'helper_bot' ELSE lang END").alias("author"), F.expr("n_chars % 50").alias("t"), F.md5("text").alias("body"))
    return cleaning.report(cleaning.tag_removals(d, ["doc_id"], "id", "thread", "author", "t", "body"), "thread", "id")


@query("q12_required_keys", f"SELECT DISTINCT trim(thread) AS thread FROM ({_KEYED_SQL}) WHERE trim(thread) <> ''")
def _(t):
    return cleaning.required_threads(t("documents").select(_thread().alias("thread")), "thread")


# == joins


@query("q13_semi_join", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(t):
    keys = t("customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return threads.only_keys(t("orders").select("o_orderkey", "o_custkey"), keys, ["o_custkey"])


_POSTS_SQL = """SELECT conv_id, max(CASE WHEN turn = 0 THEN trim(role) || CASE WHEN trim(text) = '' OR lower(trim(text)) IN ('[removed]', '[deleted]') THEN '' ELSE chr(10) || chr(10) || trim(text) END END) AS submission_text FROM conversations GROUP BY conv_id"""


@query("q14_left_join_context", f"SELECT c.conv_id AS submission_id, c.turn, length(p.submission_text)::INT AS context_chars, md5(p.submission_text) AS context FROM conversations c LEFT JOIN (SELECT * FROM ({_POSTS_SQL}) WHERE conv_id % 3 <> 0) p ON c.conv_id = p.conv_id WHERE c.turn > 0")
def _(t):
    c = t("conversations")
    posts = c.where("turn = 0 and conv_id % 3 <> 0").select(F.col("conv_id").alias("id"), F.col("role").alias("title"), F.col("text").alias("body_text"))
    out = threads.join_posts(c.where("turn > 0").select(F.col("conv_id").alias("submission_id"), "turn"), posts, ["title", "body_text"])
    return out.select("submission_id", "turn", F.length("submission_text").alias("context_chars"), F.md5("submission_text").alias("context"))


@query("q15_join_coverage", "SELECT count(*) AS n_rows, count_if(quality IS NULL)::BIGINT AS missing, (count(*) - count_if(quality IS NULL))::DOUBLE / nullif(count(*), 0) AS coverage FROM documents LEFT JOIN labels USING (doc_id)")
def _(t):
    return threads.coverage(t("documents").select("doc_id").join(t("labels"), "doc_id", "left"), "quality")


_POS_SQL = "SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000000), event_id) AS p FROM events"


def _positions(t) -> DataFrame:
    e = t("events").select("event_id", "user_id", "value", "event_type", F.unix_timestamp("ts").alias("s"), F.to_date("ts").alias("day"))
    return cleaning.with_thread_position(e, "user_id", "s", "event_id", "p")


@query("q16_computed_key_join", f"WITH e AS (SELECT *, ((p - 1) // 20)::INT AS chunk_id FROM ({_POS_SQL})) SELECT event_id, e.user_id, e.chunk_id, n FROM e LEFT JOIN (SELECT user_id, chunk_id, count(*) AS n FROM e GROUP BY ALL HAVING count(*) = 20) c ON e.user_id = c.user_id AND e.chunk_id = c.chunk_id")
def _(t):
    e = threads.with_chunk(_positions(t).select("event_id", "user_id", "p"), "p", 20).drop("p")
    return e.join(e.groupBy("user_id", "chunk_id").agg(F.count("*").alias("n")).where("n = 20"), ["user_id", "chunk_id"], "left").select("event_id", "user_id", "chunk_id", "n")


@query("q17_anti_join_remaining", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def _(t):
    return threads.not_done(t("documents").select("doc_id", "lang"), t("labels"), ["doc_id"])


@query("q18_lookup_fallback", "SELECT c_custkey, CASE WHEN n.n_name IS NULL THEN 'topic_' || c_nationkey ELSE n.n_name || ' - topic ' || c_nationkey END AS topic_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 4 <> 0) n ON c_nationkey = n_nationkey")
def _(t):
    names = t("nation").where("n_nationkey % 4 <> 0").select(F.col("n_nationkey").alias("topic_id"), F.col("n_name").alias("name"))
    return topics.named(t("customer").select("c_custkey", "c_nationkey"), names, "c_nationkey").drop("c_nationkey")


# == chunks


@query("q19_chunk100", "SELECT conv_id, chunk_id, count(*) AS n_messages_in_chunk, string_agg('[MSG ' || (turn % 3 + 1) || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS chunk_comments FROM (SELECT conv_id, turn, text, (turn // 3)::INT AS chunk_id FROM conversations) GROUP BY ALL")
def _(t):
    return threads.thread_chunks(t("conversations").withColumn("p", F.col("turn") + 1), "conv_id", "p", "text", 3)


@query("q20_first_value_per_thread", "SELECT conv_id, arg_min(text, turn) AS first_text, count(*) AS turns FROM conversations GROUP BY conv_id")
def _(t):
    return t("conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("first_text"), F.count("*").alias("turns"))


def _absorb(p: str, n: str) -> str:
    return f"least(({p}) // 30, greatest(({n}) // 30 + CASE WHEN ({n}) % 30 >= 15 THEN 1 ELSE 0 END, 1) - 1)"


_BUILD = "min(day) AS date_start, max(day) AS date_end, count(*) AS n_messages, string_agg(event_type, ' [SEP] ' ORDER BY p) AS chunk_text"
_EVENT_SQL = "SELECT event_id, user_id, event_type, (epoch_us(ts) // 1000000) AS s, ts::DATE AS day, row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000000), event_id) AS p, count(*) OVER (PARTITION BY user_id) AS n FROM events"


@query("q21_chunk_absorb_thread", f"SELECT user_id, seq, {_BUILD} FROM (SELECT *, {_absorb('p - 1', 'n')}::INT AS seq FROM ({_EVENT_SQL}) WHERE n >= 15) GROUP BY user_id, seq")
def _(t):
    rows = chunks.assign(_positions(t), ["user_id"], ["p"])
    return chunks.build(rows, ["user_id", "seq"], ["p"], "day", "event_type")


@query("q22_chunk_pool", f"SELECT seq, {_BUILD.replace('ORDER BY p', 'ORDER BY g')} FROM (SELECT *, ((g - 1) // 30)::INT AS seq FROM (SELECT *, row_number() OVER (ORDER BY s, user_id, p) AS g FROM ({_EVENT_SQL}) WHERE n < 70)) GROUP BY seq HAVING count(*) >= 15")
def _(t):
    short = _positions(t).withColumn("n", F.expr("count(*) over (partition by user_id)")).where("n < 70")
    order = ["s", "user_id", "p"]
    return chunks.build(chunks.assign_pool(short, order, "day"), ["seq"], order, "day", "event_type").where("n_messages >= 15")


@query("q23_chunk_daily", f"SELECT event_type, seq, {_BUILD} FROM (SELECT *, {_absorb('p - 1', 'n')}::INT AS seq FROM (SELECT event_id, event_type, ts::DATE AS day, row_number() OVER w AS p, count(*) OVER (PARTITION BY event_type, ts::DATE) AS n FROM events WINDOW w AS (PARTITION BY event_type, ts::DATE ORDER BY (epoch_us(ts) // 1000000), event_id))) GROUP BY event_type, day, seq")
def _(t):
    rows = chunks.assign(_positions(t), ["event_type", "day"], ["s", "event_id"])
    return chunks.build(rows, ["event_type", "day", "seq"], ["s", "event_id"], "day", "event_type").drop("day")


@query("q24_chunk_numbering", f"""
WITH e AS (SELECT * FROM ({_EVENT_SQL})),
own AS (SELECT user_id, min(s) OVER (PARTITION BY user_id) AS start, {_absorb('p - 1', 'n')}::INT AS seq, day, p, event_type FROM e WHERE n >= 70),
a AS (SELECT 0 AS pool, min(start) AS start, user_id, seq, min(day) AS date_start, max(day) AS date_end, count(*) AS n_messages, string_agg(event_type, ' [SEP] ' ORDER BY p) AS chunk_text FROM own GROUP BY user_id, seq),
b AS (SELECT 1 AS pool, NULL::BIGINT AS start, NULL::BIGINT AS user_id, seq, min(day) AS date_start, max(day) AS date_end, count(*) AS n_messages, string_agg(event_type, ' [SEP] ' ORDER BY g) AS chunk_text
      FROM (SELECT *, ((g - 1) // 30)::INT AS seq FROM (SELECT *, row_number() OVER (ORDER BY s, user_id, p) AS g FROM e WHERE n < 70)) GROUP BY seq HAVING count(*) >= 70)
SELECT (row_number() OVER (ORDER BY pool, start, user_id, seq) - 1)::INT AS chunk_id, date_start, date_end, n_messages, chunk_text FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""")
def _(t):
    e = _positions(t)
    sized = e.withColumn("n", F.expr("count(*) over (partition by user_id)"))
    own = chunks.build(chunks.assign(sized.where("n >= 70"), ["user_id"], ["p"]), ["user_id", "seq"], ["p"], "day", "event_type")
    start = sized.where("n >= 70").groupBy("user_id").agg(F.min("s").alias("start"))
    own = own.join(start, "user_id").withColumn("pool", F.lit(0))
    order = ["s", "user_id", "p"]
    pool = chunks.build(chunks.assign_pool(sized.where("n < 70"), order, "day"), ["seq"], order, "day", "event_type").where("n_messages >= 70")
    pool = pool.withColumns({"user_id": F.lit(None).cast("bigint"), "start": F.lit(None).cast("bigint"), "pool": F.lit(1)})
    parts = [F.col("pool"), F.floor(F.col("start") / 86400), F.floor(F.when(F.col("pool") == 1, F.col("seq")) / 100)]
    return chunks.number(own.unionByName(pool), ["pool", "start", "user_id", "seq"], parts).select("chunk_id", "date_start", "date_end", "n_messages", "chunk_text")


@query("q25_cross_day_check", f"SELECT count(*) AS chunks, count_if(a <> b)::BIGINT AS cross_day FROM (SELECT min(day) AS a, max(day) AS b FROM (SELECT *, {_absorb('p - 1', 'n')}::INT AS seq FROM ({_EVENT_SQL})) GROUP BY user_id, seq)")
def _(t):
    return chunks.spanning_days(chunks.build(chunks.assign(_positions(t), ["user_id"], ["p"]), ["user_id", "seq"], ["p"], "day", "event_type"))


@query("q25b_dominant_label", "SELECT user_id, day, CASE WHEN len(x) = 1 THEN x[1] ELSE 'MIXED' END AS stock FROM (SELECT user_id, ts::DATE AS day, list_distinct(list(event_type) FILTER (event_type IN ('click', 'purchase'))) AS x FROM events GROUP BY ALL)")
def _(t):
    e = t("events").select("user_id", F.to_date("ts").alias("day"), F.array("event_type").alias("k"))
    return e.groupBy("user_id", "day").agg(chunks.dominant(F.col("k"), ["click", "purchase"]).alias("stock"))


# == text

_SQUEEZE = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"


@query("q26_sanitize", f"SELECT doc_id, md5(x) AS clean, length(x)::INT AS chars, md5(lang || CASE WHEN x = '' THEN '' ELSE ' ' || chr(10) || ' ' || x END) AS raw FROM (SELECT doc_id, lang, {_SQUEEZE.format('text')} AS x FROM documents)")
def _(t):
    d = t("documents").select("doc_id", "lang", "text")
    return d.select("doc_id", F.md5(tx.comment_text(F.col("text"))).alias("clean"), F.length(tx.sanitize(F.col("text"))).alias("chars"), F.md5(tx.submission_raw_text(F.col("lang"), F.col("text"))).alias("raw"))


_CHAIN = "text"
for _p, _r in ((r"!\[img\]\(emote[^)]*\)", " "), (r">!(.*?)!<", r"\1"), (r"(https?://|www\.)\S+", " "), (r"\*{1,3}([^*\n]+)\*{1,3}", r"\1"), (r"(?m)^>+\s?", " "), (r"u/[\pL\pM\pN_]+", " "), (r"r/[\pL\pM\pN_]+", " "), (r"![\pL\pM\pN_]+", " ")):
    _CHAIN = f"regexp_replace({_CHAIN}, '{_p}', '{_r}', 'g')"
_CHAIN = f"regexp_replace(lower({_CHAIN}), '[^a-z\\s$!?]', ' ', 'g')"


@query("q27_clean_text", f"SELECT doc_id, {_SQUEEZE.format(_CHAIN)} AS clean FROM documents")
def _(t):
    return t("documents").select("doc_id", tx.clean_text(F.col("text")).alias("clean"))


_WORDS = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))"


@query("q28_word_count_filter", f"SELECT doc_id, n::INT AS n, n < 5 AS too_short FROM (SELECT doc_id, {_WORDS} AS n FROM documents) WHERE n >= 3")
def _(t):
    d = t("documents").select("doc_id", tx.word_count(F.col("text")).alias("n"))
    return d.where("n >= 3").withColumn("too_short", F.col("n") < relevance.MIN_WORDS)


_CMD = "CASE conv_id % 5 WHEN 0 THEN ' !BanBet ' WHEN 1 THEN '!better ' WHEN 2 THEN 'x !ban ' ELSE '' END || text"


@query("q29_bot_command", f"SELECT conv_id, turn FROM (SELECT conv_id, turn, {_CMD} AS text FROM conversations) WHERE regexp_matches(text, '(?i)^\\s*!(ban|banbet|bet|remind|remindme)([^\\pL\\pM\\pN_]|$)')")
def _(t):
    c = t("conversations").select("conv_id", "turn", F.expr(_CMD).alias("text"))
    return c.where(relevance.is_bot_command(F.col("text"))).drop("text")


@query("q30_input_text", r"""
SELECT doc_id, left('COMMENT: ' || trim(text) || CASE WHEN trim(s) <> '' THEN chr(10) || 'THREAD_CONTEXT: ' || trim(s) WHEN trim(p) <> '' THEN chr(10) || 'POST_CONTEXT: ' || trim(p) ELSE '' END, 3000) AS input
FROM (SELECT doc_id, text, CASE WHEN quality = 1 THEN ' good ' || doc_id WHEN quality = 0 THEN '  ' END AS s, CASE WHEN toxic = 0 THEN source END AS p FROM documents LEFT JOIN labels USING (doc_id))""")
def _(t):
    d = t("documents").select("doc_id", "text", "source").join(t("labels"), "doc_id", "left")
    s = F.when(F.col("quality") == 1, F.concat(F.lit(" good "), F.col("doc_id").cast("string"))).when(F.col("quality") == 0, "  ")
    return d.select("doc_id", tx.context_input(F.col("text"), s, F.when(F.col("toxic") == 0, F.col("source"))).alias("input"))


@query("q31_assign_label", "SELECT event_id, CASE WHEN r >= 0.75 AND r >= 1 - r THEN 1 WHEN 1 - r >= 0.5 THEN -1 ELSE 0 END AS label FROM (SELECT event_id, (event_id % 101)::DOUBLE / 100 AS r FROM events)")
def _(t):
    r = (F.col("event_id") % 101).cast("double") / 100
    return t("events").select("event_id", relevance.label(r, 1 - r).alias("label"))


# == evaluation

_PRED_SQL = "SELECT l.doc_id, lang, CASE WHEN quality = 1 THEN 1 ELSE -1 END AS truth, CASE WHEN d.doc_id % 6 = 0 THEN 0 WHEN n_chars > 600 THEN 1 ELSE -1 END AS pred, (d.doc_id % 97)::DOUBLE / 97 AS conf FROM labels l JOIN documents d USING (doc_id)"


def _predictions(t) -> DataFrame:
    d = t("documents").select("doc_id", "lang", "n_chars").join(t("labels"), "doc_id")
    return d.select("doc_id", "lang", F.when(F.col("quality") == 1, 1).otherwise(-1).alias("truth"), F.when(F.col("doc_id") % 6 == 0, 0).when(F.col("n_chars") > 600, 1).otherwise(-1).alias("pred"), ((F.col("doc_id") % 97).cast("double") / 97).alias("conf"))


def _strict(t) -> DataFrame:
    return _predictions(t).withColumn("pred", evaluation.strict(F.col("pred")))


_CM = "count_if(truth = 1 AND pred = 1)::BIGINT AS tp, count_if(truth = 1 AND pred = -1)::BIGINT AS fn, count_if(truth = -1 AND pred = 1)::BIGINT AS fp, count_if(truth = -1 AND pred = -1)::BIGINT AS tn"
_STRICT_SQL = f"SELECT * REPLACE (CASE WHEN pred = 0 THEN -1 ELSE pred END AS pred) FROM ({_PRED_SQL})"
_LIBERAL_SQL = f"SELECT * REPLACE (CASE WHEN pred = 0 THEN 1 ELSE pred END AS pred) FROM ({_PRED_SQL})"


def _div(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN 0 ELSE ({a})::DOUBLE / ({b}) END"


_P = f"(({_div('tp', 'tp + fp')}) + ({_div('tn', 'tn + fn')})) / 2"
_R = f"(({_div('tp', 'tp + fn')}) + ({_div('tn', 'tn + fp')})) / 2"
_F1 = f"(({_div('2 * tp', '2 * tp + fp + fn')}) + ({_div('2 * tn', '2 * tn + fp + fn')})) / 2"
_N = "(tp + fn + fp + tn)"
_CHANCE = f"(((tp + fn)::DOUBLE * (tp + fp) + (fp + tn)::DOUBLE * (fn + tn)) / ({_N}::DOUBLE * {_N}))"
_KAPPA = f"CASE WHEN {_CHANCE} <> 1 THEN ((tp + tn)::DOUBLE / {_N} - {_CHANCE}) / (1 - {_CHANCE}) END"


@query("q32_confusion_matrix", f"SELECT 'strict' AS view, {_CM} FROM ({_STRICT_SQL}) UNION ALL SELECT 'liberal', {_CM} FROM ({_LIBERAL_SQL})")
def _(t):
    p = _predictions(t)
    one = lambda v, n: evaluation.confusion(p.withColumn("pred", v(F.col("pred"))), "truth", "pred").select(F.lit(n).alias("view"), "*")
    return one(evaluation.strict, "strict").unionByName(one(evaluation.liberal, "liberal"))


@query("q33_prf_macro", f"SELECT round({_P}, 9) AS precision_macro, round({_R}, 9) AS recall_macro, round({_F1}, 9) AS f1_macro FROM (SELECT {_CM} FROM ({_STRICT_SQL}))")
def _(t):
    s = evaluation.scores(evaluation.confusion(_strict(t), "truth", "pred"))
    return s.select(*[F.round(c, 9).alias(c) for c in ("precision_macro", "recall_macro", "f1_macro")])


@query("q34_kappa", f"SELECT round({_KAPPA}, 9) AS kappa FROM (SELECT {_CM} FROM ({_LIBERAL_SQL}))")
def _(t):
    p = _predictions(t).withColumn("pred", evaluation.liberal(F.col("pred")))
    return evaluation.scores(evaluation.confusion(p, "truth", "pred")).select(F.round("kappa", 9).alias("kappa"))


@query("q35_per_group_metrics", f"SELECT lang, round((tp + tn)::DOUBLE / {_N}, 9) AS accuracy, round({_F1}, 9) AS f1_macro FROM (SELECT lang, {_CM} FROM ({_STRICT_SQL}) GROUP BY lang)")
def _(t):
    s = evaluation.scores(evaluation.confusion(_strict(t), "truth", "pred", ["lang"]))
    return s.select("lang", F.round("accuracy", 9).alias("accuracy"), F.round("f1_macro", 9).alias("f1_macro"))


@query("q36_confidence_buckets", f"SELECT CASE WHEN conf < 0.6 THEN 'low' WHEN conf < 0.8 THEN 'medium' ELSE 'high' END AS bucket, count(*) AS n, round(avg((truth = pred)::INT), 9) AS accuracy FROM ({_STRICT_SQL}) GROUP BY ALL")
def _(t):
    return evaluation.accuracy_by_bucket(_strict(t), "truth", "pred", "conf").withColumn("accuracy", F.round("accuracy", 9))


# == vocabulary

_TOKENS = "list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\pL\\s]', ' ', 'g'), '\\s+'), lambda x: length(x) >= 3)"
_DF = f"SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct({_TOKENS})) AS token FROM documents) GROUP BY token"


def _tokenized(t) -> DataFrame:
    return t("documents").select("doc_id", "lang", topics.tokens(F.col("text")).alias("tokens"))


@query("q37_doc_frequency", _DF)
def _(t):
    return topics.document_frequency(_tokenized(t))


@query("q38_vocab_thresholds", f"SELECT k AS no_below, count_if(df >= k AND NOT df > 0.5 * n)::BIGINT AS kept, count_if(df < k)::BIGINT AS dropped_low, count_if(df >= k AND df > 0.5 * n)::BIGINT AS dropped_high FROM ({_DF}), (SELECT unnest([3, 5, 10, 15]) AS k), (SELECT count(*)::DOUBLE AS n FROM documents) GROUP BY k")
def _(t):
    d = _tokenized(t)
    return topics.threshold_sweep(topics.document_frequency(d), t("documents").count(), [3, 5, 10, 15], 0.5)


_BIGRAMS = f"SELECT x[i] AS a, x[i + 1] AS b, count(*) AS n FROM (SELECT x, unnest(range(1, len(x))) AS i FROM (SELECT {_TOKENS} AS x FROM documents)) GROUP BY ALL"


@query("q39_bigram_counts", f"SELECT a, b, n FROM ({_BIGRAMS}) WHERE n >= 5")
def _(t):
    return topics.bigram_counts(_tokenized(t), least=5)


@query("q40_phrase_scores", f"WITH u AS (SELECT w, count(*) AS c FROM (SELECT unnest({_TOKENS}) AS w FROM documents) GROUP BY w) SELECT a, b, n, round((n - 5)::DOUBLE * (SELECT count(*) FROM u) / x.c / y.c, 9) AS score FROM ({_BIGRAMS}) g JOIN u x ON x.w = a JOIN u y ON y.w = b WHERE n >= 5")
def _(t):
    return topics.phrase_scores(_tokenized(t), 5).withColumn("score", F.round("score", 9))


_TOPIC_WORDS = [("en", ["the", "and", "that", "was"]), ("fr", ["les", "des", "que", "the"]), ("de", ["der", "die", "und", "des"])]
_TW_SQL = "(VALUES " + ", ".join(f"({i}, {r}, '{w}')" for i, (_, ws) in enumerate(_TOPIC_WORDS) for r, w in enumerate(ws, 1)) + ") AS tw(topic_id, rank, word)"


def _topic_words(spark: SparkSession) -> DataFrame:
    rows = [f"({i}, {r}, '{w}')" for i, (_, ws) in enumerate(_TOPIC_WORDS) for r, w in enumerate(ws, 1)]
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS tw(topic_id, rank, word)")


@query("q41_umass_pairs", f"""
WITH tw AS (SELECT * FROM {_TW_SQL}), d AS (SELECT doc_id, unnest(list_distinct({_TOKENS})) AS word FROM documents), o AS (SELECT doc_id, word FROM d WHERE word IN (SELECT word FROM tw)),
one AS (SELECT word, count(*) AS n FROM o GROUP BY word), two AS (SELECT x.word AS a, y.word AS b, count(*) AS n FROM o x JOIN o y USING (doc_id) GROUP BY ALL)
SELECT i.topic_id, round(avg(ln((coalesce(two.n, 0) + 1)::DOUBLE / one.n)), 6) AS coherence FROM tw i JOIN tw j ON i.topic_id = j.topic_id AND i.rank > j.rank JOIN one ON one.word = j.word LEFT JOIN two ON two.a = i.word AND two.b = j.word GROUP BY i.topic_id""")
def _(t):
    d = _tokenized(t)
    return topics.umass(d, _topic_words(d.sparkSession), 4).withColumn("coherence", F.round("coherence", 6))


@query("q42_topic_overlap_diversity", f"SELECT word, count(DISTINCT topic_id) AS topics, (SELECT round(count(DISTINCT word)::DOUBLE / (count(DISTINCT topic_id) * 4), 4) FROM {_TW_SQL}) AS diversity FROM {_TW_SQL} GROUP BY word HAVING count(DISTINCT topic_id) > 1")
def _(t):
    tw = _topic_words(t("nation").sparkSession)
    return topics.overlapping(tw, 4).crossJoin(topics.diversity(tw, 4))


@query("q43_lda_topics", "SELECT t::INT AS topic_id, r::INT AS rank, true AS listed, true AS falling FROM range(4) a(t), range(1, 11) b(r)")
def _(t):
    # Topics depend on the solver; what holds of any: each has its ten words, all from the bounded vocabulary, by falling probability.
    d = _tokenized(t).where("lang = 'en'")
    vocab = topics.vocabulary(d, no_below=10, no_above=0.35)
    bow = vocab.transform(d).select("doc_id", "bow").persist()
    out = topics.topic_words(topics.train(bow, 4, passes=5), vocab.vocabulary, 10)
    rows = out.collect()
    bow.unpersist()
    n = d.count()
    wanted = F.array(*[F.lit(w) for w in sorted({r["word"] for r in rows})])
    df = topics.document_frequency(d.select(F.array_intersect("tokens", wanted).alias("tokens"))).where((F.col("df") >= 10) & (F.col("df") <= 0.35 * n)).select(F.col("token").alias("word"), F.lit(True).alias("_in"))
    words = d.sparkSession.createDataFrame(rows, out.schema).join(df, "word", "left")
    before = F.lag("probability").over(Window.partitionBy("topic_id").orderBy("rank"))
    return words.select("topic_id", "rank", F.coalesce("_in", F.lit(False)).alias("listed"), F.coalesce(F.col("probability") <= before, F.lit(True)).alias("falling"))


# == panel


@query("q44_daily_weighted_mean", "SELECT day, sum(k)::BIGINT AS k, round(sum(value * k) / nullif(sum(k), 0), 6) AS value FROM (SELECT ts::DATE AS day, value, json_extract_string(props, '$.k')::BIGINT AS k FROM events) GROUP BY day")
def _(t):
    e = t("events").select(F.to_date("ts").alias("day"), "value", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))
    return panel.weighted_daily(e, "day", "k", ["value"]).withColumn("value", F.round("value", 6))


_BARS_SQL = "SELECT event_type AS symbol, ts::DATE AS date, arg_min(value, (ts, event_id)) AS open, arg_max(value, (ts, event_id)) AS close FROM events GROUP BY ALL"


def _bars(t) -> DataFrame:
    return panel.daily_bars(t("events").select("event_type", "ts", "event_id", "value"), "event_type", "ts", "event_id", "value")


@query("q45_daily_bars", _BARS_SQL)
def _(t):
    return _bars(t)


_INDEX_SQL = "SELECT ts::DATE AS date, arg_min(value, (ts, event_id)) AS open, arg_max(value, (ts, event_id)) AS close FROM events GROUP BY ALL"
_FEATURES_SQL = f"SELECT b.date, (b.close - b.open) / nullif(b.open, 0) AS return_t, (i.close - i.open) / nullif(i.open, 0) AS index_return, abs((b.close - b.open) / nullif(b.open, 0)) AS volatility_t, abs((i.close - i.open) / nullif(i.open, 0)) AS index_volatility FROM ({_BARS_SQL}) b JOIN ({_INDEX_SQL}) i USING (date) WHERE symbol = 'click'"


def _features(t) -> DataFrame:
    every = panel.daily_bars(t("events").select(F.lit("all").alias("event_type"), "ts", "event_id", "value"), "event_type", "ts", "event_id", "value")
    return panel.features(_bars(t).where("symbol = 'click'"), every)


@query("q46_return_features", _FEATURES_SQL)
def _(t):
    return _features(t)


_ACTIVE_SQL = f"SELECT f.*, threshold, (abs(return_t) > threshold)::INT AS active FROM ({_FEATURES_SQL}) f, (SELECT quantile_cont(abs(return_t), 0.75) AS threshold FROM ({_FEATURES_SQL}))"


@query("q47_activity_threshold", f"SELECT date, round(threshold, 9) AS threshold, active FROM ({_ACTIVE_SQL})")
def _(t):
    return panel.with_activity(_features(t)).select("date", F.round("threshold", 9).alias("threshold"), "active")


_TARGET_SQL = f"SELECT * FROM (SELECT *, lead(active) OVER (ORDER BY date) AS target FROM ({_ACTIVE_SQL})) WHERE target IS NOT NULL AND return_t IS NOT NULL AND index_return IS NOT NULL"


def _targets(t) -> DataFrame:
    return panel.with_target(panel.with_activity(_features(t)))


@query("q48_next_day_target", f"SELECT date, active, target FROM ({_TARGET_SQL})")
def _(t):
    return _targets(t).select("date", "active", "target")


@query("q49_cv_folds", f"""
WITH r AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS r, count(*) OVER () AS n FROM ({_TARGET_SQL})), x AS (SELECT date, fold, r, n - (5 - fold) * (n // 6) AS first, n // 6 AS size FROM r, (SELECT unnest(range(5))::INT AS fold))
SELECT date, fold, CASE WHEN r < first THEN 'train' ELSE 'test' END AS part FROM x WHERE r < first + size""")
def _(t):
    return panel.cv_folds(_targets(t))


@query("q50_rank_auc", """
WITH r AS (SELECT quality AS y, n_chars // 100 AS s FROM labels JOIN documents USING (doc_id)), k AS (SELECT *, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS mid FROM r)
SELECT round(a, 9) AS auc, round(2 * a - 1, 9) AS gini FROM (SELECT (sum(mid) FILTER (y = 1) - count_if(y = 1) * (count_if(y = 1) + 1) / 2.0::DOUBLE) / (count_if(y = 1) * count_if(y = 0))::DOUBLE AS a FROM k)""")
def _(t):
    d = t("labels").join(t("documents").select("doc_id", F.expr("n_chars div 100").alias("s")), "doc_id")
    return evaluation.auc(d, "quality", "s").select(F.round("auc", 9).alias("auc"), F.round("gini", 9).alias("gini"))


@query("q51_zscore", f"SELECT date, round((return_t - avg(return_t) OVER ()) / stddev_pop(return_t) OVER (), 6) AS return_t, round((index_return - avg(index_return) OVER ()) / stddev_pop(index_return) OVER (), 6) AS index_return FROM ({_FEATURES_SQL})")
def _(t):
    z = panel.standardized(_features(t), ["return_t", "index_return"])
    return z.select("date", F.round("return_t", 6).alias("return_t"), F.round("index_return", 6).alias("index_return"))


#: All four features separate the few days of the test tables, so that no finite coefficients fit best; two have a unique best fit.
_LOGIT = ["volatility_t", "index_return"]


def _newton_sql(features: list[str], steps: int = 14) -> str:
    """CTEs z and b0 to b<steps>: Newton's method for a logit with an intercept, each step's linear system solved by elimination, written out."""
    n = range(len(features) + 1)
    x = ["1.0::DOUBLE", *(f"z{i}" for i in n if i)]
    scaled = ", ".join(f"CASE WHEN stddev_pop({f}) OVER () > 0 THEN ({f} - avg({f}) OVER ()) / stddev_pop({f}) OVER () ELSE 0 END AS z{i + 1}" for i, f in enumerate(features))
    parts = [f"z AS (SELECT target AS y, {scaled} FROM ({_TARGET_SQL}))", "b0 AS (SELECT " + ", ".join(f"0.0::DOUBLE AS b{i}" for i in n) + ")"]
    b = ", ".join(f"b{i}" for i in n)
    for k in range(steps):
        line = " + ".join(f"b{i} * {x[i]}" for i in n)
        sums = ", ".join([*(f"sum((y - p) * {x[i]}) AS r{i}" for i in n), *(f"sum(p * (1 - p) * {x[i]} * {x[j]}) AS a{i}{j}" for i in n for j in n)])
        parts.append(f"e{k}_0 AS (SELECT {b}, {sums} FROM (SELECT *, 1 / (1 + exp(-({line}))) AS p FROM z, b{k}) GROUP BY {b})")
        for s in n:
            cols = [f"r{s} / a{s}{s} AS r{s}" if i == s else f"r{i} - a{i}{s} * r{s} / a{s}{s} AS r{i}" for i in n]
            cols += [f"a{s}{j} / a{s}{s} AS a{s}{j}" if i == s else f"a{i}{j} - a{i}{s} * a{s}{j} / a{s}{s} AS a{i}{j}" for i in n for j in n]
            parts.append(f"e{k}_{s + 1} AS (SELECT {b}, {', '.join(cols)} FROM e{k}_{s})")
        parts.append(f"b{k + 1} AS (SELECT {', '.join(f'b{i} + r{i} AS b{i}' for i in n)} FROM e{k}_{len(n)})")
    return ", ".join(parts)


def _odds(t, features: list[str]) -> DataFrame:
    o = panel.odds_ratios(_targets(t), features)
    return o.select("feature", F.round("coefficient", 5).alias("coefficient"), F.round("odds_ratio", 5).alias("odds_ratio"))


def _odds_sql(features: list[str]) -> str:
    rows = " UNION ALL ".join(f"SELECT '{f}' AS feature, round(b{i + 1}, 5) AS coefficient, round(exp(b{i + 1}), 5) AS odds_ratio FROM b14" for i, f in enumerate(features))
    return f"WITH {_newton_sql(features)} {rows}"


@query("q52_logit_odds", _odds_sql(_LOGIT))
def _(t):
    return _odds(t, _LOGIT)


@query("q53_group_mean_std", "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS least, max(value) AS most FROM events GROUP BY event_type")
def _(t):
    return t("events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("std"), F.min("value").alias("least"), F.max("value").alias("most"))


@query("q54_histogram", "SELECT floor(value / 10)::BIGINT AS bin, count(*) AS n FROM events GROUP BY ALL")
def _(t):
    return t("events").groupBy(F.floor(F.col("value") / 10).alias("bin")).agg(F.count("*").alias("n"))


@query("q55_value_counts", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 20")
def _(t):
    return t("events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(20)


@query("q56_dominant_topic", "SELECT user_id, CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS dominant_topic FROM (SELECT user_id, count_if(event_type = 'click') AS a, count_if(event_type = 'view') AS b, count_if(event_type = 'purchase') AS c FROM events GROUP BY user_id)")
def _(t):
    n = lambda k: F.count_if(F.col("event_type") == k)
    p = t("events").groupBy("user_id").agg(n("click").alias("topic_0"), n("view").alias("topic_1"), n("purchase").alias("topic_2"))
    return topics.dominant_topic(p, 3).select("user_id", "dominant_topic")


@query("q57_thread_fold", "SELECT conv_id, turn, string_agg(upper(left(role, 1)) || length(text), '>') OVER (PARTITION BY conv_id ORDER BY turn) AS state FROM conversations")
def _(t):
    def step(previous, row):
        return (f"{previous}>" if previous else "") + f"{row['role'][:1].upper()}{len(row['text'])}"

    return threads.fold_threads(t("conversations"), step, "conv_id", "turn")


@query("q58_json_extract", "SELECT event_id, props AS found, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def _(t):
    text = F.concat(F.lit('answer {"k": '), F.col("props"))
    found = tx.last_flat_json(text)
    return t("events").select("event_id", found.alias("found"), F.get_json_object(found, "$.k").try_cast("bigint").alias("k"))


# == more


@query("q59_multi_chunk_threads", "SELECT conv_id, chunk_id, n_messages_in_chunk FROM (SELECT conv_id, (turn // 3)::INT AS chunk_id, count(*) AS n_messages_in_chunk FROM conversations GROUP BY ALL) QUALIFY count(*) OVER (PARTITION BY conv_id) > 1")
def _(t):
    c = threads.thread_chunks(t("conversations").withColumn("p", F.col("turn") + 1), "conv_id", "p", "text", 3)
    return threads.multi_chunk(c, "conv_id").select("conv_id", "chunk_id", "n_messages_in_chunk")


@query("q60_labels_without_prediction", "SELECT (SELECT count(*) FROM labels) AS labels, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')) AS unmatched")
def _(t):
    return evaluation.with_labels(t("documents").where("lang = 'en'").select("doc_id"), t("labels"), "doc_id")[1]


@query("q61_conditional_share", "SELECT lang, count(*) AS n, round(avg((quality = 1)::INT) * 100, 6) AS percent FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def _(t):
    joined, _ = evaluation.with_labels(t("documents").select("doc_id", "lang"), t("labels"), "doc_id")
    return evaluation.shares(joined, "lang", F.col("quality") == 1).withColumn("percent", F.round("percent", 6))


@query("q62_top_words_per_group", f"SELECT lang, word, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word)::INT AS rank FROM (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest({_TOKENS}) AS word FROM documents) GROUP BY lang, word) QUALIFY rank <= 20")
def _(t):
    n = _tokenized(t).select("lang", F.explode("tokens").alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    return topics.ranked(n, "lang", [F.desc("n"), "word"], 20)


@query("q63_argmax", "SELECT user_id, arg_max(event_type, (value, event_id)) AS event_type FROM events GROUP BY user_id")
def _(t):
    return t("events").groupBy("user_id").agg(F.max_by("event_type", F.struct("value", "event_id")).alias("event_type"))


_LOOSE = "CASE event_id % 5 WHEN 0 THEN 'x' || event_id WHEN 1 THEN NULL ELSE event_id::VARCHAR END"


@query("q64_coerced_cast", f"SELECT event_id, try_cast({_LOOSE} AS BIGINT) AS n, coalesce(try_cast({_LOOSE} AS BIGINT), 1) AS filled FROM events")
def _(t):
    c = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("x"), F.col("event_id").cast("string"))).when(F.col("event_id") % 5 != 1, F.col("event_id").cast("string"))
    n = c.try_cast("bigint")
    return t("events").select("event_id", n.alias("n"), F.coalesce(n, F.lit(1)).cast("bigint").alias("filled"))


@query("q65_permalink", "SELECT conv_id, turn, CASE WHEN turn = 1 THEN 'https://forum.example/x' WHEN conv_id % 4 = 0 THEN '' ELSE 'https://forum.example/comments/' || conv_id || '/_/' || turn END AS link FROM conversations")
def _(t):
    thread = F.when(F.col("conv_id") % 4 != 0, F.concat(F.lit("t3_"), F.col("conv_id").cast("string")))
    have = F.when(F.col("turn") == 1, "https://forum.example/x")
    return t("conversations").select("conv_id", "turn", tx.permalink(have, F.col("turn").cast("string"), thread, "https://forum.example", False).alias("link"))


@query("q66_summary_text", """
SELECT event_id, '[thread_topic]: ' || CASE WHEN trim(topic) = '' THEN 'unclear' ELSE trim(topic) END || chr(10) || '[financial_angle]: ' || CASE WHEN event_type = 'view' THEN 'earnings' ELSE 'unclear' END || chr(10)
  || '[conversation_character]: ' || CASE WHEN event_type = 'click' THEN 'reactive' ELSE 'unclear' END || chr(10) || '[brief_summary]: unclear' AS summary
FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN '  ' ELSE ' about ' || user_id || ' ' END AS topic FROM events)""")
def _(t):
    topic = F.when(F.col("event_id") % 3 == 0, "  ").otherwise(F.concat(F.lit(" about "), F.col("user_id").cast("string"), F.lit(" ")))
    fields = {"thread_topic": topic, "financial_angle": F.when(F.col("event_type") == "view", "earnings").otherwise("hype"), "conversation_character": F.when(F.col("event_type") == "click", "reactive")}
    return t("events").select("event_id", tx.summary_text(tx.normalized_summary(fields)).alias("summary"))


@query("q67_group_sizes", "SELECT min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean FROM (SELECT count(*) AS n FROM events GROUP BY user_id)")
def _(t):
    return t("events").groupBy("user_id").agg(F.count("*").alias("n")).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"))


@query("q68_ingest_counters", "SELECT count(*) AS seen, count_if(lower(event_type) <> 'click')::BIGINT AS skipped_subreddit, count_if(lower(event_type) = 'click' AND NOT ts::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-12')::BIGINT AS skipped_period, count_if(lower(event_type) = 'click' AND ts::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-12')::BIGINT AS passed FROM events")
def _(t):
    e = t("events").select(F.col("event_type").alias("subreddit"), F.unix_timestamp("ts").alias("created_utc"))
    return matching.ingest_counters(e, "Click", "2024-01-05", "2024-01-12")


@query("q69_bar_histogram", "SELECT (CASE WHEN value < 0 THEN 0 WHEN value >= 100 THEN 41 ELSE floor(value / 2.5) + 1 END)::BIGINT AS bin, count(*) AS n FROM events GROUP BY ALL")
def _(t):
    return topics.histogram(t("events"), "value", 40, 0.0, 100.0)


_WANTED = "['" + "', '".join(sorted({w for _, ws in _TOPIC_WORDS for w in ws})) + "']"


@query("q70_npmi_pairs", f"""
WITH tw AS (SELECT * FROM {_TW_SQL}), d AS (SELECT doc_id, {_TOKENS} AS x FROM documents), w AS (SELECT doc_id, s, list_distinct(list_intersect(x[s:s + 9], {_WANTED})) AS ws FROM (SELECT doc_id, x, unnest(range(1, greatest(1, len(x) - 9) + 1)) AS s FROM d WHERE len(x) > 0)),
o AS (SELECT doc_id, s, unnest(ws) AS word FROM w), total AS (SELECT count(*)::DOUBLE AS n FROM w), one AS (SELECT word, count(*) AS n FROM o GROUP BY word),
two AS (SELECT x.word AS a, y.word AS b, count(*) AS n FROM o x JOIN o y USING (doc_id, s) GROUP BY ALL),
p AS (SELECT i.topic_id, i.rank AS i, j.rank AS j, i.word AS wi, j.word AS wj, coalesce(two.n, 0) / total.n + 1e-12::DOUBLE AS pij, x.n / total.n AS pi, y.n / total.n AS pj
      FROM tw i JOIN tw j ON i.topic_id = j.topic_id AND i.rank > j.rank CROSS JOIN total JOIN one x ON x.word = i.word JOIN one y ON y.word = j.word LEFT JOIN two ON two.a = i.word AND two.b = j.word)
SELECT topic_id, i, j, wi, wj, round(ln(pij / (pi * pj)) / -ln(pij), 6) AS npmi FROM p""")
def _(t):
    d = _tokenized(t)
    return topics.npmi_pairs(d, _topic_words(d.sparkSession), 4, 10).withColumn("npmi", F.round("npmi", 6))


@query("q71_relevant_rows", f"SELECT doc_id, conf FROM ({_PRED_SQL}) WHERE pred = 1")
def _(t):
    return relevance.relevant(_predictions(t), "pred").select("doc_id", "conf")


_PANEL_SQL = "SELECT user_id, event_type AS stock, count_if(value < 30)::DOUBLE / count(*) AS topic_0, count_if(value >= 30 AND value < 60)::DOUBLE / count(*) AS topic_1, count_if(value >= 60)::DOUBLE / count(*) AS topic_2 FROM events GROUP BY ALL"


def _panel(t) -> DataFrame:
    share = lambda c: F.count_if(c).cast("double") / F.count("*")
    v = F.col("value")
    return t("events").groupBy("user_id", F.col("event_type").alias("stock")).agg(share(v < 30).alias("topic_0"), share((v >= 30) & (v < 60)).alias("topic_1"), share(v >= 60).alias("topic_2"))


@query("q72_rows_of_a_stock", f"SELECT * FROM ({_PANEL_SQL}) WHERE stock = 'click'")
def _(t):
    return topics.of_stock(_panel(t), "click")


@query("q73_topic_name_second", "SELECT c_custkey, 'nation ' || c_nationkey AS topic_name, c_mktsegment FROM customer")
def _(t):
    return topics.name_second(t("customer").select("c_custkey", "c_mktsegment", F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")).alias("topic_name")))


@query("q74_whole_numbers", "SELECT event_id, event_id::INT AS n, user_id::INT AS who FROM events")
def _(t):
    return t("events").select("event_id", whole_number(F.col("event_id").cast("string"), "event_id").alias("n"), whole_number(F.col("user_id"), "user_id").alias("who"))


@query("q75_bigram_sweep", f"SELECT k AS min_count, count_if(n >= k)::BIGINT AS bigrams, coalesce(sum(n) FILTER (n >= k), 0)::BIGINT AS occurrences FROM ({_BIGRAMS}), (SELECT unnest([2, 5, 20, 100]) AS k) GROUP BY k")
def _(t):
    return topics.bigram_sweep(_tokenized(t), [2, 5, 20, 100])


@query("q76_topics_by_stock", f"SELECT stock, CASE WHEN topic_0 >= topic_1 AND topic_0 >= topic_2 THEN 0 WHEN topic_1 >= topic_2 THEN 1 ELSE 2 END AS dominant_topic, count(*) AS n FROM ({_PANEL_SQL}) GROUP BY ALL")
def _(t):
    return topics.dominant_by_stock(_panel(t), 3)


@query("q77_shares_by_stock", f"SELECT stock, {', '.join(f'round(avg(topic_{i}), 6) AS mean_{i}, round(stddev_samp(topic_{i}), 6) AS std_{i}' for i in range(3))} FROM ({_PANEL_SQL}) GROUP BY stock")
def _(t):
    p = topics.by_stock(_panel(t), 3)
    return p.select("stock", *[F.round(c, 6).alias(c) for c in p.columns if c != "stock"])


@query("q78_last_json", r"""SELECT event_id, CASE event_id % 5 WHEN 0 THEN '{"b":' || event_id || '}' WHEN 1 THEN '{"z":"}{"}' WHEN 3 THEN '{"m": "\" }"}' WHEN 4 THEN props END AS found FROM events""")
def _(t):
    n = F.col("event_id").cast("string")
    k = F.col("event_id") % 5
    text = F.when(k == 0, F.concat(F.lit('x {"a":{"b":'), n, F.lit('},"c":2}'))).when(k == 1, F.lit('{"a":1} {bad} {"z":"}{"}')).when(k == 2, F.lit("none {at all} [1]"))
    text = text.when(k == 3, F.lit('{"k": [1, {"m": "\\" }"}]} tail {')).otherwise(F.concat(F.lit("{ {"), F.col("props"), F.lit(" }")))
    return t("events").select("event_id", tx.last_json(text).alias("found"))


_LINKED = [("[two words](https://a.b) ", "two words "), ("[ab](https://a.b) ", " "), ("[this](https://a.b/c_d) x", "this x"), ("see https://x.y/z and u/someone ", "see https://x.y/z and u/someone ")]


def _linked(side: int) -> str:
    return "CASE doc_id % 4 " + " ".join(f"WHEN {i} THEN '{p[side]}'" for i, p in enumerate(_LINKED)) + " END || text"


@query("q79_clean_links", f"SELECT doc_id, {_SQUEEZE.format(_CHAIN)} AS clean FROM (SELECT doc_id, {_linked(1)} AS text FROM documents)")
def _(t):
    return t("documents").select("doc_id", tx.clean_text(F.expr(_linked(0))).alias("clean"))


@query("q80_extraction_counters", f"""
WITH h AS ({_HITS}), d AS (SELECT doc_id, source = 'web' AS here, n_chars % 3 <> 0 AS inside FROM documents)
SELECT count(*) AS seen, count_if(NOT here)::BIGINT AS skipped_subreddit, count_if(here AND NOT inside)::BIGINT AS skipped_period,
       count_if(here AND inside AND doc_id IN (SELECT doc_id FROM h))::BIGINT AS matched, (SELECT count(DISTINCT (doc_id, ticker)) FROM h JOIN d USING (doc_id) WHERE here AND inside) AS written FROM d""")
def _(t):
    day = F.when(F.col("n_chars") % 3 != 0, F.lit(1736000000)).otherwise(F.lit(0))
    raw = t("documents").select(F.col("doc_id").alias("id"), F.col("source").alias("subreddit"), day.alias("created_utc"), F.col("text").alias("body"))
    return matching.extraction_counters(raw, "comment", LEXICON, "Web", "2025-01-01", "2025-12-31")


@query("q81_logit_of_one_feature", _odds_sql(["return_t"]))
def _(t):
    return _odds(t, ["return_t"])


@query("q82_phrases_found", f"WITH u AS (SELECT w, count(*) AS c FROM (SELECT unnest({_TOKENS}) AS w FROM documents) GROUP BY w) SELECT a || ' ' || b AS phrase FROM ({_BIGRAMS}) g JOIN u x ON x.w = a JOIN u y ON y.w = b WHERE n >= 5 AND (n - 5)::DOUBLE * (SELECT count(*) FROM u) / x.c / y.c > 20")
def _(t):
    d = _tokenized(t)
    return d.sparkSession.createDataFrame([(p,) for p in topics.phrases(d, 5, 20.0)], "phrase string")

"""Entity matching against a lexicon, and the extraction of matched rows from raw objects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import text as tx
from threadloom.functions.lexicon import Lexicon, any_pattern
from threadloom.schemas import struct


def matches(c: Column, lexicon: Lexicon) -> Column:
    """Array of the matched (ticker, term, kind); literal patterns only, so Spark compiles each once and stays in the JVM.

    A ticker that needs context loses all its matches where its context pattern finds nothing.
    """
    def hit(t):
        found = c.rlike(t.pattern)
        return found & c.rlike(lexicon.context[t.ticker]) if t.ticker in lexicon.context else found

    items = [F.when(hit(t), F.struct(F.lit(t.ticker).alias("ticker"), F.lit(t.term).alias("term"), F.lit(t.kind).alias("kind"))) for t in lexicon.terms]
    none = F.array().cast("array<struct<ticker:string,term:string,kind:string>>")
    return F.filter(F.array(*items), lambda m: m.isNotNull()) if items else none


def has_match(c: Column, lexicon: Lexicon) -> Column:
    """Whether :func:`matches` finds anything: one pattern for all terms that need no context, two for each ticker that does."""
    free = any_pattern(t for t in lexicon.terms if t.ticker not in lexicon.context)
    found = [c.rlike(free)] if free else []
    for ticker, context in lexicon.context.items():
        own = any_pattern(t for t in lexicon.terms if t.ticker == ticker)
        if own:
            found.append(c.rlike(own) & c.rlike(context))
    return F.coalesce(reduce(lambda a, b: a | b, found, F.lit(False)), F.lit(False))


def confidence(tickers: Column, kinds: Column, lexicon: Lexicon) -> Column:
    """multi_stock, high or medium, from the distinct tickers and kinds of a row's matches."""
    gated = F.arrays_overlap(tickers, F.array(*[F.lit(t) for t in sorted(lexicon.needs_context)])) if lexicon.needs_context else F.lit(False)
    strong = F.arrays_overlap(kinds, F.array(F.lit("cashtag"), F.lit("ticker")))
    return F.when(F.size(tickers) == 0, "none").when(F.size(tickers) > 1, "multi_stock").when(strong, "high").when(gated, "medium").otherwise("high")


def with_matches(df: DataFrame, text: str, lexicon: Lexicon) -> DataFrame:
    """Rows with at least one match, with the match columns (lists sorted and joined by a pipe)."""
    roll = lambda f: F.array_sort(F.array_distinct(F.transform("_m", lambda m: m[f])))
    # The filter is exact, so the terms' own patterns only run on rows that stay, and once.
    df = df.where(has_match(F.col(text), lexicon)).withColumn("_m", matches(F.col(text), lexicon))
    df = df.withColumns({"_t": roll("ticker"), "_w": roll("term"), "_k": roll("kind")})
    conf = confidence(F.col("_t"), F.col("_k"), lexicon)
    gated = [F.lit(t) for t in sorted(lexicon.needs_context)]
    needs = F.arrays_overlap("_t", F.array(*gated)) if gated else F.lit(False)
    return df.withColumns({
        "matched_tickers": F.array_join("_t", "|"), "matched_terms": F.array_join("_w", "|"), "match_sources": F.array_join("_k", "|"),
        "match_count": F.size("_t"), "is_multi_match": (F.size("_t") > 1).cast("int"), "match_confidence": conf, "needs_context_filter": needs.cast("int"),
    }).drop("_m", "_t", "_w", "_k")


def in_community(c: Column, name: str) -> Column:
    return F.lower(F.coalesce(c, F.lit(""))) == name.lower()


def in_period(epoch: Column, start: str, end: str) -> Column:
    """Epoch seconds on the days ``start`` to ``end`` in UTC, as a range that a scan can push down; NULL isn't."""
    first, last = (F.unix_timestamp(F.lit(f"{d} 00:00:00")) for d in (start, end))
    return F.coalesce(epoch.between(first, last + 86399), F.lit(False))


def extract_rows(raw: DataFrame, kind: str, lexicon: Lexicon, community: str, start: str, end: str, link_root: str = "", keep: tuple[str, ...] = ()) -> DataFrame:
    """Raw comments or submissions to matched rows: cheap filters first, the patterns last. ``keep`` names further columns to carry (the place in the input, say)."""
    post = kind == "submission"
    c = lambda n: F.col(n) if n in raw.columns else F.lit(None).cast("string")
    kept = raw.where(in_community(c("subreddit"), community) & in_period(c("created_utc").try_cast("bigint"), start, end))
    body = tx.sanitize(c("selftext")) if post else tx.comment_text(c("body"))
    title = tx.sanitize(c("title")) if post else F.lit("")
    text = tx.submission_raw_text(c("title"), c("selftext")) if post else body
    thread = c("id") if post else tx.strip_kind_prefix(F.coalesce(c("link_id"), F.lit("")))
    rows = kept.select(
        c("id").alias("id"), c("created_utc").try_cast("bigint").alias("created_utc"), tx.utc_day(c("created_utc")).alias("date_utc"), F.lit(kind).alias("source_type"),
        c("subreddit").alias("subreddit"), c("author").alias("author"), c("score").try_cast("bigint").alias("score"), title.alias("title"), body.alias("body_text"), text.alias("raw_text"),
        tx.permalink(c("permalink"), c("id"), c("link_id"), link_root, post).alias("permalink"), c("link_id").alias("link_id"), c("parent_id").alias("parent_id"), thread.alias("submission_id"), *keep,
    ).where("raw_text <> ''")
    return with_matches(rows, "raw_text", lexicon).select(*struct("matched").names, *keep)


def extraction_counters(raw: DataFrame, kind: str, lexicon: Lexicon, community: str, start: str, end: str) -> DataFrame:
    """One row, in one pass: seen, skipped_subreddit, skipped_period, matched (rows with a match) and written (tickers matched, over all rows)."""
    post = kind == "submission"
    c = lambda n: F.col(n) if n in raw.columns else F.lit(None).cast("string")
    here, when = in_community(c("subreddit"), community), in_period(c("created_utc").try_cast("bigint"), start, end)
    text = tx.submission_raw_text(c("title"), c("selftext")) if post else tx.comment_text(c("body"))
    tickers = F.when(here & when & has_match(text, lexicon), F.size(F.array_distinct(F.transform(matches(text, lexicon), lambda m: m["ticker"])))).otherwise(0)
    return raw.select(here.alias("_h"), when.alias("_p"), tickers.alias("_k")).agg(
        F.count("*").alias("seen"), F.count_if(~F.col("_h")).alias("skipped_subreddit"), F.count_if(F.col("_h") & ~F.col("_p")).alias("skipped_period"),
        F.count_if(F.col("_k") > 0).alias("matched"), F.coalesce(F.sum("_k"), F.lit(0)).alias("written"),
    )


def ingest_counters(raw: DataFrame, community: str, start: str, end: str) -> DataFrame:
    """One row: seen, skipped_subreddit, skipped_period and passed, in one pass."""
    here, when = in_community(F.col("subreddit"), community), in_period(F.col("created_utc"), start, end)
    return raw.agg(F.count("*").alias("seen"), F.count_if(~here).alias("skipped_subreddit"), F.count_if(here & ~when).alias("skipped_period"), F.count_if(here & when).alias("passed"))


def overlaps(pipe: Column, targets: list[str], strip: bool = False) -> Column:
    """Whether a pipe-joined list holds one of ``targets``; ``strip`` trims its elements first."""
    items = F.split(F.coalesce(pipe, F.lit("")), r"\|")
    return F.arrays_overlap(F.transform(items, F.trim) if strip else items, F.array(*map(F.lit, targets)))


def is_single_target(pipe: Column, targets: list[str]) -> Column:
    """Whether the list is just one of ``targets``."""
    return F.coalesce(pipe.isin(*targets), F.lit(False))

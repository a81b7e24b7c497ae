"""Text functions from Column to Column. Patterns are Java's, with flags and classes chosen to agree with Python's ``re``."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Python's \\s has it: Java's Unicode class plus the four separators U+001C to U+001F.
WS = r"[\s\x1c-\x1f]"
_NOT_WS = r"[^\s\x1c-\x1f]"
REMOVED = ("[removed]", "[deleted]")
CONTEXT_CHARS = 3000


def squeeze(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, rf"(?U){WS}+", " "))


def sanitize(c: Column) -> Column:
    """Squeezed text with NUL characters as spaces; NULL becomes empty."""
    return squeeze(F.replace(F.coalesce(c, F.lit("")), F.lit("\0"), F.lit(" ")))


def is_removed(c: Column) -> Column:
    return F.lower(c).isin(*REMOVED)


def comment_text(body: Column) -> Column:
    """Text of a comment: empty where the body was removed or deleted."""
    clean = sanitize(body)
    return F.when(is_removed(clean), "").otherwise(clean)


def submission_raw_text(title: Column, body: Column) -> Column:
    """Title and body of a post, each unless empty or removed, parted by " \\n "."""
    parts = F.filter(F.array(sanitize(title), sanitize(body)), lambda p: (p != "") & ~is_removed(p))
    return F.array_join(parts, " \n ")


def submission_context(title: Column, body: Column) -> Column:
    """Title, and the body two lines below it unless it is empty or removed."""
    t, b = F.trim(F.coalesce(title, F.lit(""))), F.trim(F.coalesce(body, F.lit("")))
    return F.when((b == "") | is_removed(b), t).otherwise(F.concat(t, F.lit("\n\n"), b))


def strip_kind_prefix(c: Column) -> Column:
    """An id without its t3_ marks."""
    return F.replace(c, F.lit("t3_"), F.lit(""))


def permalink(existing: Column, row_id: Column, thread_id: Column, root: str, is_post: bool) -> Column:
    """The link that is there, else one built under ``root`` from the ids; empty where there is no id (or, of a comment, no thread)."""
    have, rid, tid = (F.coalesce(x, F.lit("")) for x in (existing, row_id, strip_kind_prefix(F.coalesce(thread_id, F.lit("")))))
    built = F.concat(F.lit(f"{root}/comments/"), rid) if is_post else F.when(tid != "", F.concat(F.lit(f"{root}/comments/"), tid, F.lit("/_/"), rid)).otherwise("")
    return F.when(have != "", have).when(rid == "", "").otherwise(built)


def utc_day(epoch: Column) -> Column:
    """YYYY-MM-DD of epoch seconds, empty where they can't be read. Needs a session in UTC."""
    return F.coalesce(F.date_format(F.timestamp_seconds(epoch.try_cast("bigint")), "yyyy-MM-dd"), F.lit(""))


def words(c: Column) -> Column:
    """Whitespace-separated words; none of a blank or NULL text."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), rf"(?U){WS}+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def context_input(message: Column, summary: Column, submission: Column, limit: int = CONTEXT_CHARS) -> Column:
    """Message with its context (the summary if there is one, else the post), cut at ``limit`` characters."""
    ctx = lambda c: F.nullif(F.trim(c), F.lit(""))
    tail = F.coalesce(F.concat(F.lit("\nTHREAD_CONTEXT: "), ctx(summary)), F.concat(F.lit("\nPOST_CONTEXT: "), ctx(submission)), F.lit(""))
    return F.left(F.concat(F.lit("COMMENT: "), F.trim(F.coalesce(message, F.lit(""))), tail), F.lit(limit))


# == the cleaning chain

#: (pattern, replacement) in order, which the contract of cleaned text prescribes; emoji names come between STEPS and LAST_STEPS.
STEPS = [
    (r"(?Ud)!\[img\]\(emote[^)]*\)", " "),
    (r"(?Ud)>!(.*?)!<", "$1"),
    # One pass: a link whose text has at most three characters goes, any other leaves its text.
    (rf"(?Ud)\[(?:{WS}*([^\]]{{0,3}}?){WS}*|{WS}*([^\]]*?){WS}*)\]\(https?://[^)]+\)", "$2"),
    (rf"(?Ud)(?:https?://|www\.){_NOT_WS}+", " "),
    (r"(?Ud)\*{1,3}([^*\n]+)\*{1,3}", "$1"),
    (rf"(?Udm)^>+{WS}?", " "),
    (r"(?Ud)u/\w+", " "),
    (r"(?Ud)r/\w+", " "),
    (r"(?Ud)!\w+", " "),
]
LAST_STEPS = [(r"(?Ud)[^a-z\s\x1c-\x1f$!?]", " ")]


def apply_steps(c: Column, steps: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, step: F.regexp_replace(x, F.lit(step[0]), F.lit(step[1])), steps, c)


_KEYCAP = re.compile("([#*0-9])\ufe0f?\u20e3")
_FLAG = re.compile("([\U0001f1e6-\U0001f1ff])([\U0001f1e6-\U0001f1ff])")
_TONES = dict(zip("\U0001f3fb\U0001f3fc\U0001f3fd\U0001f3fe\U0001f3ff", ("light", "medium light", "medium", "medium dark", "dark")))


def emoji_words(text: str) -> str:
    """Pictographs as the words of their Unicode names; colons and underscores as spaces.

    Keycaps and flags are read as wholes ("keycap 1", "flag u s": countries' names
    aren't in the standard library), skin tones as such; joiners and variation
    selectors within sequences go.
    """
    text = _KEYCAP.sub(r" keycap \1 ", text)
    text = _FLAG.sub(lambda m: " flag " + " ".join(chr(ord(c) - 0x1F1E6 + ord("a")) for c in m.groups()) + " ", text)
    out = []
    for ch in text:
        if ch in _TONES:
            out.append(f" {_TONES[ch]} skin tone ")
        elif ord(ch) > 0x2190 and unicodedata.category(ch) in ("So", "Sk"):
            out.append(" " + unicodedata.name(ch, "").lower().replace("-", " ") + " ")
        else:
            out.append("" if ch in "\u200d\ufe0e\ufe0f" else " " if ch in ":_" else ch)
    return "".join(out)


@F.arrow_udf(T.StringType())
def _emoji_words(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array([None if t is None else emoji_words(t) for t in texts.to_pylist()], pa.string())


def clean_text(c: Column, emoji: bool = False) -> Column:
    """The cleaning chain: markup, links, mentions and commands out, lower case, only a-z, $, ! and ?.

    ``emoji`` puts pictographs into words first (a Python step, only run on
    texts that have characters beyond U+2190); without it they go.
    """
    x = apply_steps(F.coalesce(c, F.lit("")), STEPS)
    if emoji:
        x = F.when(x.rlike("[\u200d←-\U0010ffff:_]"), _emoji_words(x)).otherwise(x)
    return squeeze(apply_steps(F.lower(x), LAST_STEPS))


# == summaries

SUMMARY_FIELDS = tuple("main_stock_or_company thread_topic financial_angle conversation_character brief_summary".split())
ANGLES = ("company_news", "earnings", "mixed", "price_action", "product_or_company_discussion", "sector_macro", "trading_positions", "unclear", "valuation")
CHARACTERS = ("analytical", "meme_heavy", "mixed", "off_topic", "reactive", "speculative")


def normalized_summary(fields: dict[str, Column]) -> Column:
    """A struct of the five fields, blank or out-of-vocabulary values as "unclear"."""
    def one(name: str) -> Column:
        v = F.trim(F.coalesce(fields.get(name, F.lit(None).cast("string")), F.lit("unclear")))
        allowed = {"financial_angle": ANGLES, "conversation_character": CHARACTERS}.get(name)
        return F.when(v.isin(*allowed), v).otherwise("unclear") if allowed else F.when(v == "", "unclear").otherwise(v)

    return F.struct(*[one(n).alias(n) for n in SUMMARY_FIELDS])


def summary_text(s: Column) -> Column:
    """The four descriptive fields, one labelled line each."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"[{n}]: "), s[n]) for n in SUMMARY_FIELDS[1:]])


def last_json_object(text: str | None) -> str | None:
    """The JSON object in ``text`` with the latest start; None without one.

    The decoder is tried at each brace from the last backwards, and gives up at the
    first character that can't belong to an object.
    """
    text = text or ""
    decode = json.JSONDecoder().raw_decode
    at = text.rfind("{")
    while at >= 0:
        try:
            return text[at : decode(text, at)[1]]
        except (ValueError, RecursionError):
            at = text.rfind("{", 0, at)
    return None


@F.arrow_udf(T.StringType())
def last_json(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Column form of :func:`last_json_object`."""
    for texts in batches:
        yield pa.array([last_json_object(t) for t in texts.to_pylist()], pa.string())


def last_flat_json(c: Column) -> Column:
    """The last brace-free object of a text, without Python: right where no object or string holds braces."""
    found = F.regexp_extract_all(c, F.lit(r"(\{[^{}]*\})"), F.lit(1))
    valid = F.filter(found, lambda x: F.try_parse_json(x).isNotNull())
    return F.try_element_at(valid, F.lit(-1))


PROMPT = (
    "Summarise one part of an online discussion about listed companies.\n"
    "Answer with a JSON object that has the keys " + ", ".join(SUMMARY_FIELDS) + ".\n"
    "financial_angle is one of " + ", ".join(ANGLES) + "; conversation_character is one of " + ", ".join(CHARACTERS) + ".\n"
)


def summary_prompt(submission: Column, comments: Column, previous: Column) -> Column:
    """The summariser's prompt for one chunk; ``previous`` is the summary of the chunk before it, if any."""
    before = F.coalesce(F.concat(F.lit("\nSo far: "), F.nullif(F.trim(previous), F.lit(""))), F.lit(""))
    return F.concat(F.lit(PROMPT), F.lit("\nPost: "), F.coalesce(submission, F.lit("")), before, F.lit("\nMessages:\n"), F.coalesce(comments, F.lit("")))


import re

import pytest

WORD = re.compile("[0-9a-z\u0080-\U0010ffff]+")
DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, node string, copies string, text_ string, `a b` int, label int, TEXT string, Doc_Id string"


@pytest.fixture
def words():
    return lambda text: WORD.findall((text or "").lower())


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text, lang, source) tuples, with columns whose names clash with internal ones, or with theirs but for the case."""

    def make(rows):
        full = [(*r, *[None] * (4 - len(r))) for r in rows]
        return spark.createDataFrame([(i, t, g, s, len(t) if t is not None else None, "n", "c", "t", 1, 2, "other text", "7") for i, t, g, s in full], DOC_SCHEMA)

    return make


LONG = " ".join(f"w{i % 5000}x" for i in range(60_000))

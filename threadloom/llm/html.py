"""HTML extraction: flat text blocks, word counts and link densities of each block and its neighbours, a decision tree.

A page becomes a flat list of text blocks, cut at block-level tags.  A block's
features are the word count and link density of the block before, itself and the
block after.  A decision tree, grown by Gini impurity on the small table
``LABELLED``, says which blocks are content.
"""

from __future__ import annotations

import functools
import html as _html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import pick, table

#: words and link density of the block before, the block, and the block after (0, 0: none); 1 for content.
LABELLED = [
    # navigation, tag clouds, breadcrumbs
    (0, 0, 1, 1, 1, 1, 0), (1, 1, 1, 1, 1, 1, 0), (1, 1, 2, 1, 1, 1, 0), (2, 1, 1, 1, 8, 0, 0), (1, 1, 1, 1, 30, 0, 0), (0, 0, 6, 1, 40, 0, 0),
    (3, 1, 3, 1, 25, 0, 0), (60, 0, 4, 1, 5, 1, 0), (5, 1, 4, 1, 0, 0, 0), (25, 0.1, 12, 0.9, 9, 1, 0), (0, 0, 20, 0.8, 50, 0.05, 0), (40, 0, 15, 0.7, 12, 0.6, 0),
    (1, 1, 1, 1, 14, 0, 0), (0, 0, 2, 1, 2, 1, 0), (9, 0.9, 30, 0.6, 9, 0.9, 0),
    # advertisements and teasers after navigation
    (1, 1, 7, 0, 8, 0, 0), (1, 1, 12, 0, 6, 0, 0), (2, 1, 20, 0, 12, 0, 0), (1, 1, 4, 0, 10, 0, 0), (1, 1, 25, 0, 3, 0, 0), (3, 1, 9, 0.3, 7, 0, 0), (1, 1, 16, 0, 1, 0, 0),
    (1, 1, 5, 0, 11, 0, 0), (2, 1, 14, 0, 9, 0, 0), (1, 1, 9, 0, 2, 0, 0), (1, 1, 30, 0, 10, 0, 0),
    # footers, copyright lines, comment forms: nothing after them, or links
    (50, 0, 9, 0, 0, 0, 0), (20, 0, 12, 0, 0, 0, 0), (120, 0, 25, 0, 0, 0, 0), (8, 0, 6, 0, 0, 0, 0), (35, 0, 18, 0.1, 0, 0, 0), (5, 0, 30, 0, 0, 0, 0), (90, 0, 4, 0, 6, 1, 0),
    (70, 0, 3, 0, 0, 0, 0), (45, 0, 35, 0, 0, 0, 0), (15, 0, 15, 0, 0, 0, 0), (0, 0, 5, 0, 0, 0, 0), (12, 0, 40, 0, 0, 0, 0), (3, 1, 10, 0, 0, 0, 0), (100, 0, 20, 0, 0, 0, 0),
    # headings before text
    (8, 0, 8, 0, 25, 0, 1), (12, 0, 6, 0, 60, 0, 1), (20, 0, 11, 0, 30, 0, 1), (40, 0, 4, 0, 80, 0, 1), (5, 0, 9, 0, 12, 0, 1), (25, 0, 2, 0, 40, 0, 1), (0, 0, 8, 0, 45, 0, 1),
    (9, 0, 12, 0, 5, 0, 1), (7, 0, 1, 0, 33, 0, 1), (0, 0, 6, 0, 20, 0, 1),
    # running text
    (8, 0, 25, 0, 40, 0, 1), (30, 0, 60, 0, 45, 0, 1), (60, 0, 120, 0.02, 30, 0, 1), (45, 0, 35, 0.1, 90, 0, 1), (100, 0, 18, 0, 60, 0, 1), (70, 0, 80, 0, 9, 0, 1),
    (35, 0, 22, 0, 12, 0, 1), (12, 0, 200, 0.05, 15, 0, 1), (0, 0, 150, 0, 60, 0, 1), (80, 0, 90, 0.15, 25, 1, 1), (0, 0, 90, 0, 0, 0, 1), (60, 0, 110, 0, 0, 0, 1),
    (1, 1, 80, 0, 70, 0, 1), (2, 1, 120, 0.05, 40, 0, 1), (25, 0.1, 70, 0.2, 20, 0.9, 1), (1, 1, 60, 0, 20, 0, 1), (10, 0, 300, 0.01, 0, 0, 1),
    # short paragraphs within text
    (40, 0, 5, 0, 30, 0, 1), (60, 0, 2, 0, 50, 0, 1), (20, 0, 8, 0, 9, 0, 1), (9, 0, 6, 0, 14, 0, 1), (35, 0, 12, 0, 10, 0, 1), (15, 0, 1, 0, 70, 0, 1), (80, 0, 7, 0.2, 25, 0, 1),
    (5, 0, 31, 0, 1, 0, 1), (31, 0, 1, 0, 40, 0, 1), (60, 0, 46, 0, 10, 0, 1), (30, 0, 12, 0, 9, 0, 1), (25, 0, 26, 0, 15, 0, 1), (3, 0, 34, 0, 20, 0, 1), (12, 0, 19, 0, 8, 0, 1),
    (2, 0, 40, 0, 10, 0, 1), (50, 0, 5, 0, 12, 0, 1), (9, 0, 28, 0, 28, 0, 1), (44, 0, 33, 0, 5, 0, 1), (18, 0, 24, 0, 3, 0, 1), (1, 0, 22, 0, 2, 0, 1), (70, 0, 15, 0, 6, 0, 1),
    (12, 0, 4, 0, 8, 0, 1), (22, 0, 14, 0, 30, 0, 1), (30, 0, 3, 0, 12, 0, 1), (50, 0, 10, 0, 20, 0, 1), (6, 0, 3, 0, 6, 0, 1),
]

_RAW = re.compile(r"<!--|<(script|style|noscript|template|svg|textarea|head)\b", re.I)
_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9]*)(?:=\s*"[^"<]*"|=\s*'[^'<]*'|[^<>])*+>|<[!?][^<>]*>""")
_END = {name: re.compile(f"</{name}", re.I) for name in ("script", "style", "noscript", "template", "svg", "textarea", "head")} | {"": re.compile("-->")}
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())


def visible(page: str) -> str:
    """The page without comments, scripts, styles, its head and the like; an element that isn't closed takes the rest of the page (an unclosed head only its tag)."""
    out, at = [], 0
    while m := _RAW.search(page, at):
        out.append(page[at : m.start()])
        name = (m[1] or "").lower()
        stop = _END[name].search(page, m.end())
        if not stop:
            if name == "head":
                at = m.end()
                out.append("<head")
                continue
            return "".join(out)
        if not name:
            at = stop.end()
            continue
        close = page.find(">", stop.start())
        at = len(page) if close < 0 else close + 1
        out.append("<div>")
    out.append(page[at:])
    return "".join(out)


def blocks(page: str) -> list[tuple[str, int, float]]:
    """(text, words, link density) of each block with words, in order."""
    out: list[tuple[str, int, float]] = []
    parts: list[tuple[str, bool]] = []
    links = 0

    def close() -> None:
        words = " ".join(p for p, _ in parts)
        text = " ".join(_html.unescape(words).split())
        if text:
            n = len(text.split())
            linked = sum(len(_html.unescape(p).split()) for p, k in parts if k)
            out.append((text, n, min(1.0, linked / n)))
        parts.clear()

    page, at = visible(page), 0
    for m in _TAG.finditer(page):
        if m.start() > at:
            parts.append((page[at : m.start()], links > 0))
        at = m.end()
        name = (m[2] or "").lower()
        if name == "a":
            links = max(0, links - 1) if m[1] else links + 1
        elif name and name not in _INLINE:
            close()
            if m[1]:
                links = 0
    parts.append((page[at:], links > 0))
    close()
    return out


def neighbour_features(found: list[tuple[str, int, float]]) -> np.ndarray:
    x = np.zeros((len(found) + 2, 2))
    x[1:-1] = [(n, d) for _, n, d in found] if found else np.zeros((0, 2))
    return np.hstack([x[:-2], x[1:-1], x[2:]])


class Tree:
    """A binary classification tree: each node splits on the feature and threshold with the least Gini impurity (first of equals)."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 2):
        self.value = int(y.mean() >= 0.5)
        self.split: tuple[int, float, Tree, Tree] | None = None
        if depth == 0 or y.min() == y.max() or len(y) < 2 * least:
            return
        best = (2 * y.mean() * (1 - y.mean()) - 1e-9, None)
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for cut in (values[1:] + values[:-1]) / 2:
                left = x[:, f] <= cut
                n = left.sum()
                if least <= n <= len(y) - least:
                    p, q = y[left].mean(), y[~left].mean()
                    gini = (2 * p * (1 - p) * n + 2 * q * (1 - q) * (len(y) - n)) / len(y)
                    if gini < best[0] - 1e-12:
                        best = (gini, (f, float(cut)))
        if best[1]:
            f, cut = best[1]
            left = x[:, f] <= cut
            self.split = (f, cut, Tree(x[left], y[left], depth - 1, least), Tree(x[~left], y[~left], depth - 1, least))

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.split is None:
            return np.full(len(x), self.value)
        f, cut, left, right = self.split
        go = x[:, f] <= cut
        out = np.empty(len(x), dtype=int)
        out[go], out[~go] = left.predict(x[go]), right.predict(x[~go])
        return out


@functools.cache
def trained() -> Tree:
    rows = np.array(LABELLED, dtype=float)
    return Tree(rows[:, :6], rows[:, 6].astype(int))


def extract_page(page: str | None) -> tuple[str | None, int, int]:
    """(content blocks joined by line breaks, number of blocks, number of content blocks)."""
    if page is None:
        return None, 0, 0
    found = blocks(page)
    keep = trained().predict(neighbour_features(found)) if found else np.zeros(0, dtype=int)
    return "\n".join(b[0] for b, k in zip(found, keep) if k), len(found), int(keep.sum())


def extract(pages: DataFrame) -> DataFrame:
    """page_id, text (content), n_blocks and n_content of every row of ``pages``.

    A NULL page gives a NULL text and no blocks; a page without words, or without
    content, gives an empty text.  Text outside any tag is a block like others;
    broken markup is read as far as tags can be told.  Repeated rows are
    extracted alike; a NULL page_id passes through; pages of any length are read
    whole; an empty table gives an empty one; other columns are ignored whatever
    their names, in any case.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for page in batches:
            rows = [extract_page(p) for p in page.to_pylist()]
            text, n, kept = zip(*rows) if rows else ((), (), ())
            yield pa.StructArray.from_arrays([pa.array(text, pa.string()), pa.array(n, pa.int32()), pa.array(kept, pa.int32())], names=["text", "n_blocks", "n_content"])

    udf = F.arrow_udf(run, "struct<text string, n_blocks int, n_content int>")
    return pick(pages, "page_id", "html").select("page_id", udf("html").alias("p")).select("page_id", "p.text", "p.n_blocks", "p.n_content")


def extraction_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, extracted."""
    return extract(table(spark, sf_dir, "pages"))

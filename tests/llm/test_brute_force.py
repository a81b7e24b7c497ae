"""Scores and extractions made again from the definitions: plain integers, dictionaries and the standard library's parser, none of the operators' functions."""

import collections
import itertools
import math
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import LONG
from threadloom.llm import html, language, quality, subword, textcore, toxicity

M = (1 << 64) - 1
TEXTS = ["Plain words, plain words again.", "Ünï Çode — straße\tİx", "x", "", "   ", "Re Re Re Re", "a b\nc  d", "!!! ???", "you are an idiiot", None, "ab " * 700 + "end", "1 22 333 4444 55555"]


def finish(h):
    h ^= h >> 33
    h = h * 0xFF51AFD7ED558CCD & M
    h ^= h >> 33
    h = h * 0xC4CEB9FE1A85EC53 & M
    return h ^ h >> 33


def word_hash(w):
    value, base, total = textcore._BYTE_VALUE, textcore._BASE, 0
    for k, b in enumerate(w):
        total += int(value[b]) * pow(base, k, 1 << 64)
    return finish(total & M)


def gram_bucket(g, bits):
    h = (int.from_bytes(g, "little") + len(g)) * 0x9E3779B97F4A7C15 & M
    h ^= h >> 29
    h = h * 0xBF58476D1CE4E5B9 & M
    return h >> (64 - bits)


def grams(raw, orders):
    """Runs of bytes that hold a space at their ends only, and at one of them at most."""
    for n in orders:
        for k in range(len(raw) - n + 1):
            g = raw[k : k + n]
            if 32 not in g[1:-1] and not g[0] == g[-1] == 32:
                yield g


def spaced(text, words_only, lower):
    raw = (text.lower() if lower else text).encode()
    word = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(128, 256))
    return b" " + bytes(b if (b in word if words_only else b > 32) else 32 for b in raw) + b" "


def logistic(z):
    return 1 / (1 + math.exp(-z))


def test_quality_scores():
    rng = np.random.default_rng(1)
    weights, bias, bits = rng.standard_normal(1 << quality.BITS), 0.3, quality.BITS
    got = quality.QualityModel(weights, bias).scores(pa.array(TEXTS))
    for text, z in zip(TEXTS, got):
        raw = spaced(text or "", False, False)
        words = [word_hash(w) for w in raw.split()]
        found = [h >> (64 - bits) for h in words] + [finish(b - a & M) >> (64 - bits) for a, b in itertools.pairwise(words)] + [gram_bucket(g, bits) for g in grams(raw, quality.ORDERS)]
        assert math.isnan(z) if not found else z == pytest.approx(logistic(sum(weights[f] for f in found) / len(found) + bias), abs=1e-9)


def test_toxicity_scores():
    rng = np.random.default_rng(2)
    weights, bias, bits = rng.standard_normal(1 << toxicity.BITS), -0.2, toxicity.BITS
    texts = [t for t in TEXTS if t is None or "İ" not in t]
    for window in (0, 1, 2, 5):
        got = toxicity.ToxicityModel(weights, bias, 0.5, window).scores(pa.array(texts))
        for text, z in zip(texts, got):
            own = []
            for w in spaced(text or "", True, True).split():
                found = [word_hash(w) >> (64 - bits)] + [gram_bucket(g, bits) for g in grams(b" " + w + b" ", toxicity.ORDERS)]
                own.append(sum(weights[f] for f in found) / len(found))
            means = [sum(own)] if not window else [sum(own[k : k + window]) for k in range(len(own))]
            sizes = [max(1, len(own))] if not window else [len(own[k : k + window]) for k in range(len(own))]
            assert math.isnan(z) if not own else z == pytest.approx(logistic(max(m / n for m, n in zip(means, sizes)) + bias), abs=1e-9)


def test_language_decoding():
    rng = np.random.default_rng(3)
    names = ["aa", "bb", "cc", "dd"]
    codes = language.codewords(4)
    W, c = rng.standard_normal((1 << language.BITS, codes.shape[1])), rng.standard_normal(codes.shape[1])
    texts = [t for t in TEXTS if t is None or "İ" not in t]
    best, loss, gap = language.LanguageModel(names, codes, W, c).decode(pa.array(texts))
    for k, text in enumerate(texts):
        n = collections.Counter(gram_bucket(g, language.BITS) for g in grams(spaced(text or "", True, True), language.ORDERS))
        if not n:
            assert best[k] == -1 and math.isnan(loss[k])
            continue
        length = math.sqrt(sum(n.values()))
        f = [c[b] + sum(math.sqrt(v) / length * W[i, b] for i, v in n.items()) for b in range(len(c))]
        each = [sum(math.log1p(math.exp(-x * y)) for x, y in zip(f, code)) / len(f) for code in codes]
        near, next_ = sorted(range(4), key=lambda i: each[i])[:2]
        assert best[k] == near and loss[k] == pytest.approx(each[near], abs=1e-4) and gap[k] == pytest.approx(each[next_] - each[near], abs=1e-4)


def test_a_step_follows_the_gradient():
    """The softmax layer and the vectors move against the derivative of the loss, found by differences."""
    rng = np.random.default_rng(4)
    m = subword.BagModel(6, 3, 1)
    m.W[:] = rng.standard_normal((2, 3))
    idx, x = np.array([3, 9, 20]), np.array([0.5, 0.25, 0.25], dtype=np.float32)

    def loss(E, W, c):
        z = W.astype(float) @ (x.astype(float) @ E[idx].astype(float)) + c.astype(float)
        return math.log(np.exp(z).sum()) - z[1]

    E, W, c = m.E.copy(), m.W.copy(), m.c.copy()
    m.step(idx, x, 1, 0.01)
    for i in range(2):
        for j in range(3):
            up, down = W.astype(float), W.astype(float)
            up[i, j] += 1e-5
            down[i, j] -= 1e-5
            slope = (loss(E, up, c) - loss(E, down, c)) / 2e-5
            assert m.W[i, j] - W[i, j] == pytest.approx(-0.01 * slope, abs=1e-5)
    for i in idx:
        for j in range(3):
            up, down = E.astype(float), E.astype(float)
            up[i, j] += 1e-5
            down[i, j] -= 1e-5
            slope = (loss(up, W, c) - loss(down, W, c)) / 2e-5
            assert m.E[i, j] - E[i, j] == pytest.approx(-0.01 / float(x @ x) * slope, abs=1e-5)


INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
SKIP = {"script", "style", "noscript", "template", "svg", "textarea", "head"}


class Blocks(HTMLParser):
    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.done, self.parts, self.links, self.skip = [], [], 0, 0
        self.feed(page)
        self.close()
        self.end()

    def end(self):
        text = " ".join("".join(t for t, _ in self.parts).split())
        if text:
            n = len(text.split())
            self.done.append((text, n, min(1.0, sum(len(t.split()) for t, k in self.parts if k) / n)))
        self.parts = []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in SKIP
        if tag == "a":
            self.links += 1
        elif tag not in INLINE:
            self.end()

    def handle_endtag(self, tag):
        self.skip -= tag in SKIP and self.skip > 0
        if tag == "a":
            self.links = max(0, self.links - 1)
        elif tag not in INLINE:
            self.end()
            self.links = 0

    def handle_data(self, data):
        if not self.skip:
            self.parts += [(data + " ", self.links > 0)]


def test_blocks_and_verdicts_of_the_pages(spark):
    rows = np.array(html.LABELLED, dtype=float)

    def grow(x, y, depth):
        value = int(y.mean() >= 0.5)
        if depth == 0 or len(set(y)) < 2 or len(y) < 4:
            return lambda r: value
        options = [(2 * y.mean() * (1 - y.mean()), None)]
        for f in range(6):
            v = sorted(set(x[:, f]))
            for a, b in itertools.pairwise(v):
                left = y[x[:, f] <= (a + b) / 2]
                right = y[x[:, f] > (a + b) / 2]
                if min(len(left), len(right)) >= 2:
                    options.append((sum(2 * s.mean() * (1 - s.mean()) * len(s) for s in (left, right)) / len(y), (f, (a + b) / 2)))
        low = min(o[0] for o in options)
        split = next(o[1] for o in options if o[0] <= low + 1e-9)
        if split is None:
            return lambda r: value
        f, cut = split
        go = x[:, f] <= cut
        sides = grow(x[go], y[go], depth - 1), grow(x[~go], y[~go], depth - 1)
        return lambda r: sides[0](r) if r[f] <= cut else sides[1](r)

    tree = grow(rows[:, :6], rows[:, 6].astype(int), 6)
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    got = {r["page_id"]: r for r in html.extract(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).collect()}
    for r in pages:
        found = Blocks(r["html"]).done
        assert html.blocks(r["html"]) == found
        around = [(0, 0), *((n, d) for _, n, d in found), (0, 0)]
        keep = [tree((*around[k], *around[k + 1], *around[k + 2])) for k in range(len(found))]
        assert got[r["page_id"]]["text"] == "\n".join(b[0] for b, k in zip(found, keep) if k) and got[r["page_id"]]["n_content"] == sum(keep)


def test_blank_training_texts_teach_nothing(docs, spark):
    for fit in (quality.fit, toxicity.fit):
        assert fit([("", 1), ("  ", 0)]).weights is None and fit([("words here", 1), ("  ", 0)]).weights is None
    assert toxicity.fit([("", 1), ("!!", 0)]).weights is None
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0)], "doc_id bigint, quality int, toxic int")
    d = docs([(1, "  "), (2, ""), (3, "some words")])
    assert toxicity.keep_clean(d, toxicity.fit_on(d, labels)).count() == 3
    assert {r["quality"] for r in quality.classify(d, quality.fit_on(d, labels)).collect()} == {None}


def test_samples_do_not_depend_on_the_order_of_rows(docs, spark):
    """An id with several texts gives the least, whatever the order; one with several labels the greatest."""
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(4, 1)], "doc_id bigint, quality int")
    rows = [(i, f"text {i} {k}", "en" if i % 3 else "de") for i in range(20) for k in range(3)] + [(5, None), (6, LONG)]
    one, two = (sorted(map(str, quality.labelled_sample(docs(r), labels, "quality", 30, 1).collect())) for r in (rows, rows[::-1]))
    assert one == two and sum("text 4 0" in r and "_y=1" in r for r in one) == 1 and len(one) == 19 or len(one) == 20
    a, b = (language.fit_on(docs(r)) for r in (rows, rows[::-1]))
    assert a.names == b.names == ["de", "en"] and np.array_equal(a.W, b.W)

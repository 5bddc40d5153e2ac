"""Scores of fixed models against plain code for one text at a time, and the recall of a nearest-neighbour block of full size."""

import math
import random
import re

import numpy as np
import pytest

from memoria.llm import nearest, quality, toxicity
from memoria.llm.common import Rolling

TEXTS = ["", " ", "Plain words, plain words and more.", "!!! LOUD | LOUD | LOUD !!!", "a\nb\r\n\nc 123 é ü 日本語", "x" * 30 + " y", "One two one two one two.", "#$% {weird} A1 B2 CC dd|", "word " * 400 + "\n"]


def joined(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw])))


def plain_features(text):
    raw = text.encode()
    kinds = ["upper", "lower", "digit", "blank", "feed", "high", "stop", "mark", "bar", "bang"]

    def kind(c):
        ch = chr(c)
        if c >= 128:
            return "high"
        return "upper" if ch.isupper() else "lower" if ch.islower() else "digit" if ch.isdigit() else "blank" if ch in "\t " else "feed" if ch in "\n\r" else "stop" if ch in ".,;:'\"-()?" else "bar" if ch == "|" else "bang" if ch == "!" else "mark"

    out = [sum(kind(c) == k for c in raw) / max(1, len(raw)) for k in kinds]
    w = [x for x in re.split(rb"[\x20\x09-\x0d]+", raw) if x]
    if not w:
        return out + [0.0] * 14
    n, pairs = len(w), [None, *zip(w, w[1:])]
    share = lambda f: sum(map(f, w)) / n
    return out + [
        len(set(w)) / n, len(set(pairs)) / n, sum(a == b for a, b in zip(w, w[1:])) / n, share(len) / 10,
        share(lambda x: kind(x[-1]) == "mark"), share(lambda x: kind(x[-1]) == "bang"), share(lambda x: kind(x[-1]) == "stop"), share(lambda x: kind(x[0]) == "upper"),
        share(lambda x: len(x) > 1 and kind(x[0]) == kind(x[1]) == "upper"), share(lambda x: x == b"|"), share(lambda x: len(x) > 20), math.log1p(n) / 10, share(lambda x: len(x) ** 2) / 100, math.log1p(sum(kind(c) == "feed" for c in raw)) / 5,
    ]


def test_quality_scores_are_the_plain_ones():
    found = quality.features(*joined(TEXTS))
    plain = np.array([plain_features(t) for t in TEXTS])
    assert np.allclose(found, plain, atol=1e-6), np.argwhere(~np.isclose(found, plain, atol=1e-6))
    r = np.random.default_rng(1)
    model = quality.QualityModel(found[[2, 6, 8, 4]].repeat(40, 0) + r.normal(0, 0.01, (160, quality.FEATURES)), found.repeat(40, 0) + r.normal(0, 0.01, (360, quality.FEATURES)))
    a, b, c, d = model.net.w
    for text, score in zip(TEXTS, model.score(found)):
        x = [min(8, max(-8, (v - m) / s)) for v, m, s in zip(plain_features(text), model.mean, model.scale)]
        hidden = [max(0, sum(v * a[i][j] for i, v in enumerate(x)) + b[j]) for j in range(len(b))]
        z = sum(h * w for h, w in zip(hidden, c)) + d[0] + model.shift
        assert score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-4)


def test_toxicity_scores_are_the_plain_ones():
    model = toxicity.ToxicityModel([], np.zeros(0))
    model.grams, model.bias = np.random.default_rng(2).normal(0, 1, toxicity.BUCKETS).astype(np.float32), 0.3
    found = model.score(*joined(TEXTS))

    def bucket(gram, whole=False):
        h = Rolling(np.frombuffer(gram, np.uint8))(np.array([0]), np.array([len(gram)]))
        return int((h * np.uint64(3) >> np.uint64(46) if whole else h >> np.uint64(46))[0])

    for text, score in zip(TEXTS, found):
        values = []
        for w in re.findall(rb"[a-z0-9\x80-\xff]+", bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())):
            w = b"<" + w + b">"
            grams = [bucket(w[i : i + n]) for n in toxicity.GRAMS for i in range(len(w) - n + 1)] + [bucket(w, True)]
            values.append(sum(float(model.grams[g]) for g in grams) / len(grams))
        z = model.bias + (sum(values) / len(values) if values else 0)
        assert score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-5)


@pytest.mark.parametrize("dim, spread", [(64, 0.0), (24, 0.0), (24, 0.5)])
def test_recall_of_a_full_block(dim, spread):
    """All neighbours in one block of the size that a task scans: the least that a query can be given."""
    r = np.random.default_rng(dim)
    x = r.normal(size=(nearest.BLOCK, dim)) * np.exp(r.normal(0, spread, (nearest.BLOCK, 1)))
    q = np.arange(0, nearest.BLOCK, 205)
    found = nearest.search_block(nearest.AnisotropicQuantiser(x[: nearest.MAX_TRAINING]), np.arange(len(x)), x, q, x[q])
    hits = 0
    for i in q:
        scores = x @ x[i]
        scores[i] = -np.inf
        hits += len(set(np.argsort(-scores)[:20]) & set(found[1][found[0] == i].tolist()))
    print(dim, spread, hits / 20 / len(q))
    assert hits >= 0.9 * 20 * len(q)


def test_ties_at_block_borders(spark):
    r = random.Random(3)
    rows = [(k, [float(r.choice((1, 2))), 1.0]) for k in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {(x.query_id, x["rank"]): (x.vec_id, x.score) for x in nearest.nearest(df, every=50, top=5, block=40, query_block=2).collect()}
    for q in range(0, 300, 50):
        best = sorted(((-(a * rows[q][1][0] + b * rows[q][1][1]), k) for k, (a, b) in rows if k != q))[:5]
        assert [found[q, i + 1] for i in range(5)] == [(k, -s) for s, k in best]

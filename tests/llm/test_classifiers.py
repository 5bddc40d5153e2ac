import zlib

import numpy as np

from memoria.llm import quality, toxicity

WORDS = ["alpha", "river", "stone", "house", "table", "green", "light", "paper", "cloud", "bridge"]


def texts(n, make):
    r = np.random.default_rng(3)
    return [(i, make(r, i)) for i in range(n)]


def prose(r):
    return " ".join(r.choice(WORDS, 40)).capitalize() + "."


def test_quality_is_learned_from_positives_alone(spark):
    rows = texts(900, lambda r, i: prose(r) if i % 6 else " ".join(w.upper() + "!!" for w in r.choice(WORDS, 40)))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(i, int(i % 6 > 0), 0) for i, _ in rows if i % 3], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    assert len(found) == 900
    right = [found[i].predicted == int(i % 6 > 0) for i, _ in rows]
    assert np.mean(right) > 0.97
    for i, r in found.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    # Labels of negatives change nothing: they are never read.
    only = quality.quality_scores(docs, labels.filter("quality = 1")).collect()
    assert {r.doc_id: r.score for r in only} == {i: r.score for i, r in found.items()}
    kept = quality.keep_quality(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in found.items() if r.predicted}


def test_risk_never_falls_below_zero_and_prior_is_near():
    r = np.random.default_rng(1)
    good, bad = r.normal(2, 1, (4000, 3)), r.normal(-2, 1, (4000, 3))
    unlabelled = np.concatenate((good[:1500], bad[:500]))
    net = quality.fit_pu(good[2000:], unlabelled, 0.75, epochs=20)
    assert (net.forward(good[1500:2000])[0] > 0).mean() > 0.95 and (net.forward(bad[500:])[0] < 0).mean() > 0.95
    assert 0.6 < quality.estimate_prior(good[2000:, 0], unlabelled[:, 0]) < 0.85


def test_gradient_is_that_of_the_risk():
    r = np.random.default_rng(2)
    loss = lambda z: np.logaddexp(0, z).mean()
    for zp, zu, prior in ((r.normal(0, 1, 7), r.normal(1, 1, 9), 0.4), (r.normal(3, 1, 7), r.normal(-2, 1, 9), 0.8)):
        bracket = lambda p, u: loss(u) - prior * loss(p)  # noqa: E731, B023
        risk = (lambda p, u: prior * loss(-p) + bracket(p, u)) if bracket(zp, zu) >= 0 else (lambda p, u: -bracket(p, u))  # noqa: B023
        z, found = np.concatenate((zp, zu)), quality.pu_gradient(zp, zu, prior)
        for k in range(len(z)):
            step = np.zeros(len(z))
            step[k] = 1e-5
            up, down = ((z + step)[:7], (z + step)[7:]), ((z - step)[:7], (z - step)[7:])
            assert abs((risk(*up) - risk(*down)) / 2e-5 - found[k]) < 1e-6


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, None), (1, ""), (2, "  \n "), (3, "é" * 3000), (3, "é" * 3000), (4, "one")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = quality.quality_scores(docs, labels).collect()
    assert len(found) == 6 and {r.score for r in found} == {0.5}
    assert quality.quality_scores(docs.limit(0), labels).count() == 0


def test_toxicity_finds_unseen_spellings(spark):
    r = np.random.default_rng(5)
    bad = ["blorgut", "snarvish", "grumptor"]

    def make(i):
        words = list(r.choice(WORDS, 30))
        if i % 3 == 0:
            word = bad[i % 9 // 3]
            words[5:5] = [word + ("xy"[i % 2] if i > 600 else ""), word]
        return " ".join(words)

    rows = [(i, make(i)) for i in range(900)]
    docs = spark.createDataFrame(rows + [(None, None), (1000, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(600)], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert len(found) == 902 and all(0 <= r.score <= 1 for r in found.values())
    assert np.mean([found[i].predicted == int(i % 3 == 0) for i in range(600, 900)]) > 0.95
    assert all(r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items())
    nothing = toxicity.toxicity_scores(docs, labels.filter("toxic = 0")).collect()
    assert {r.score for r in nothing} == {0.5}


def test_word_bag_numbers_words():
    data = b"Dog dog! cat"
    row, number, bucket, begin = toxicity.word_bag(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert number[0] == number[1] != number[2] and len(begin) == 2 and list(row) == [0, 0, 0]
    assert len(toxicity.word_bag(np.zeros(0, np.uint8), np.array([0, 0]))[0]) == 0

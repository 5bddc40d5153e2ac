"""Filter interactions, divergence of sources and exact top-k products against brute force, with odd input."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from memoria.llm import top_products as tp
from memoria.llm.common import word_slices
from memoria.llm.divergence import divergences
from memoria.llm.filter_audit import audit_filters, incidence, text_failures

DOCS = "doc_id long, text string, lang string, source string, part string, mask string"


def test_word_slices_cut_no_word():
    r = random.Random(3)
    for limit in (1, 7, 50):
        for _ in range(30):
            raw = bytes(r.choice(b"ab \n\t") for _ in range(r.randrange(0, 200)))
            a, b = sorted((r.randrange(0, len(raw) + 1), r.randrange(0, len(raw) + 1)))
            assert [w for part in word_slices(raw, a, b, limit) for w in part] == raw[a:b].split()


def failures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}


def audit(docs, labels):
    least = {}
    for doc, text, *_ in docs:
        if doc is not None:
            least[text or ""] = min(doc, least.get(text or "", doc))
    good, toxic = ({d for d, *x in labels if x[k] == 1} for k in (0, 1))
    parts = defaultdict(list)
    for doc, text, lang, *_ in docs:
        fails = failures(text or "") | {"E": doc is not None and doc > least[text or ""]}
        parts[lang or ""].append((fails, doc in good and doc is not None, doc in toxic and doc is not None))
    out, shapley = {}, Counter()
    for part, rows in parts.items():
        for order in itertools.permutations("ABCDE"):
            for k, c in enumerate(order):
                gone = [any(f[x] for x in order[:k]) for f, _, _ in rows]
                removed = [f[c] and not g for (f, _, _), g in zip(rows, gone)]
                shapley[part, c] += sum(removed)
                out[part, "".join(order), k + 1] = (
                    sum(not f[c] and not g for (f, _, _), g in zip(rows, gone)), sum(removed), sum(f[c] and g for (f, _, _), g in zip(rows, gone)),
                    sum(f[c] and sum(f.values()) == 1 for f, _, _ in rows), sum(a and b for a, (_, b, _) in zip(removed, rows)), sum(a and b for a, (_, _, b) in zip(removed, rows)))
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit_equals_brute_force(spark):
    r = random.Random(5)
    texts = [None, "", " \n", "x", "é" * 9 + "A", "É" * 9 + "AB", "a|b", "word " * 120, " ".join(f"w{k}" for k in range(100)), " ".join(f"w{k % 80}" for k in range(100)), " ".join(f"W{k % 79}" for k in range(100)), "nb sp " * 99 + "\x1f \x85"]
    docs = [(k, r.choice(texts), r.choice(["en", "de", None, ""]), None, "p", "m") for k in range(150)]
    docs += docs[:20] + [(None, r.choice(texts), "en", None, "p", "m") for _ in range(10)] + [(5, "again", "fr", None, "p", "m")]
    labels = [(k, r.choice([0, 1, None]), r.choice([0, 1, None])) for k in range(100)] + [(7, 1, 1), (7, 0, 0), (None, 1, 1), (999, 1, 1)]
    found = audit_filters(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {(x.part, x.filter_order, x.step): tuple(x)[3:] for x in found.collect()} == audit(docs, labels)
    assert found.count() == 600 * 4


def test_filter_audit_of_nothing(spark):
    none = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit_filters(none, labels).count() == 0
    one = audit_filters(spark.createDataFrame([(1, "x", "en", None, None, None)], DOCS), labels)
    assert {(x.kept, x.removed) for x in one.filter("step = 5").collect()} == {(0, 0), (0, 1)}  # A fails, wherever it stands


def test_a_long_text_counts_as_a_whole(spark):
    text = "AB " * 400_000 + "c$"
    row = text_failures(spark.createDataFrame([(1, text, "en", None, None, None)], DOCS)).first()
    assert row["mask"] == 0b1110


def test_incidence_matrices_partition_the_masks():
    columns, m = incidence("ABC")
    assert len(columns) == 18 and m["kept"].shape == (8, 18)
    gone = np.array([[any(mask >> "ABC".index(x) & 1 for x in order[: step - 1]) for order, step, _ in columns] for mask in range(8)])
    assert ((m["kept"] + m["removed"] + (gone & (m["kept"] == 0))) == 1).all()


def diverge(docs, least=3, top=200):
    langs = defaultdict(lambda: defaultdict(Counter))
    df = defaultdict(Counter)
    for _, text, lang, source, *_ in docs:
        terms = [t.translate({k: k + 32 for k in range(65, 91)}) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        langs[lang or ""][source or ""].update(terms)
        df[lang or ""].update(set(terms))
    out = set()
    for lang, groups in langs.items():
        kept = sorted(t for t, n in df[lang].items() if n >= least)
        v = len(kept)

        def share(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 1) // (n + v) for t in kept}

        p = {s: share(c) for s, c in groups.items()}
        q = share(sum(groups.values(), Counter()))
        for s in groups:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode(), o) for o in groups if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            out |= {(lang, s, "pair", o, -x, k + 1) for k, (x, _, o) in enumerate(sorted(pairs))}
            out |= {(lang, s, "term", t, -x, k + 1) for k, (x, _, t) in enumerate(sorted(terms)[:top])}
    return out


@pytest.mark.parametrize("held", [1, 1 << 18])
def test_divergence_equals_brute_force(spark, held, monkeypatch):
    monkeypatch.setattr("memoria.llm.divergence.HELD_TERMS", held)
    r = random.Random(7)
    words = ["Haus", "haus", "été", "Été", "日本", "a1b", "x", "y_z", "Ω", "co-op", "don't", "\x7fq", "ß"] + [f"w{chr(97 + k)}" for k in range(20)]
    docs = []
    for k in range(240):
        source = r.choice([None, "", "s1", "s2", "s3", "hot", "hot"])
        text = r.choice([None, ""]) if k % 17 == 0 else " ".join(r.choices(words, [1 + len(source or "") * (i % 3) for i in range(len(words))], k=r.randrange(0, 40)))
        docs.append((k, text, r.choice(["en", "de", None]), source, "p", "m"))
    docs += docs[:30] + [(None, "only once here", "rare", "s1", "p", "m"), (None, None, "rare", "s2", "p", "m"), (1, "!!", "alone", "s", "p", "m")]
    found = divergences(spark.createDataFrame(docs, DOCS).repartition(3), top=7)
    found = [tuple(x) for x in found.collect()]
    assert len(found) == len(set(found)) and set(found) == diverge(docs, top=7)
    assert divergences(spark.createDataFrame([], DOCS)).count() == 0


def brute(rows, every, top, steps=1024):
    good = {(k, tuple(math.floor(steps * x) for x in v)) for k, v in rows if k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q in {k for k, _ in good if k % every == 0}:
        scores = {}
        for k, v in good:
            for own, w in good:
                if own == q and k != q and len(w) == len(v):
                    s = max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(v, w))))
                    scores[k] = max(s, scores.get(k, s))
        first = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:top]
        out |= {(q, i + 1, k, s) for i, (k, s) in enumerate(first)}
    return out


def search(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "vec_id AS size", "'x' AS dim", "0 AS v").repartition(3)
    found = [tuple(x) for x in tp.top_products(df, **how).collect()]
    assert len(found) == len(set(found))
    return set(found)


@pytest.mark.parametrize("spread", [0.0, 1.5])
def test_top_products_equal_brute_force(spark, spread):
    """Several buckets and blocks; with unequal lengths both prunings take part."""
    r = np.random.default_rng(11)
    centres = r.normal(size=(6, 12))
    x = (centres[r.integers(0, 6, 700)] + r.normal(0, 0.4, (700, 12))) * np.exp(r.normal(0, spread, (700, 1)))
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    assert search(spark, rows, every=10, top=5, bucket=64, block_bytes=1, seed_bytes=4000) == brute(rows, 10, 5)


def test_top_products_with_copies_ties_and_odd_vectors(spark):
    r = random.Random(13)
    rows = [(k, [1.0, 2.0, -1.0]) for k in range(0, 120)] + [(k, [float(r.randrange(-2, 3)) for _ in range(3)]) for k in range(120, 200)]
    rows += rows[:5] + [(7, [9.0, 9.0, 9.0]), (20, [0.0, 0.0, 0.0]), (30, [-1.0, -2.0, 1.0])]
    rows += [(300, None), (310, [math.nan, 1.0, 1.0]), (320, [math.inf, 0.0, 0.0]), (330, [None, 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (340, [0.0] * 3), (350, [-0.0, 0.0, 0.0])]
    rows += [(400, [1.0, 1.0]), (401, [2.0, -1.0]), (410, [5.0]), (420, [])]
    assert search(spark, rows, every=10, top=4, bucket=16, block_bytes=1, seed_bytes=1) == brute(rows, 10, 4)


def test_top_products_of_huge_components_are_exact(spark):
    rows = [(k, [1e300 if k % 3 else 1.0, -1e17 * k, 3.5]) for k in range(12)] + [(k, [float(k << 40), 1.0, float(-k)]) for k in range(20, 40)]
    assert search(spark, rows, every=4, top=6, bucket=8) == brute(rows, 4, 6)


def test_top_products_of_nothing(spark):
    assert search(spark, []) == set()
    assert search(spark, [(100, [1.0])]) == set()


def test_both_prunings_leave_out_and_keep_the_right_rows():
    r = np.random.default_rng(17)
    x = np.floor(1024 * (r.normal(size=(5, 16))[r.integers(0, 5, 2000)] + r.normal(0, 0.2, (2000, 16))))
    size = np.linalg.norm(x, axis=1)
    order = np.argsort(-size)
    bucket, sizes = tp.Bucket(order, x[order], size[order]), []
    for q in range(0, 2000, 100):
        scores = bucket.vectors @ x[q]
        need = np.sort(scores)[-20]
        exact = set(np.flatnonzero(scores >= need))
        assert exact <= set(range(bucket.by_length(need / size[q])))
        left = bucket.by_coordinates(x[q] / size[q], need / size[q] / bucket.longest)
        assert exact <= set(left.tolist())
        sizes.append(len(left))
    assert np.mean(sizes) < 0.8 * len(x)

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from memoria.llm import decontamination as d

DOCS = "doc_id long, text string, item_id long"
ITEMS = "item_id long, text string"
ITEM = "the quick brown fox jumps over the lazy dog while seven wizards boil quarts of nitrogen under a cold moon"


def plain(a: str, text: str) -> int:
    before = [0] * (len(text) + 1)
    for i, c in enumerate(a, 1):
        now = [i] + [0] * len(text)
        for j, x in enumerate(text, 1):
            now[j] = min(before[j] + 1, now[j - 1] + 1, before[j - 1] + (c != x))
        before = now
    return min(before)


@settings(max_examples=150, deadline=None)
@given(st.text("abc", min_size=1, max_size=40), st.text("abc", max_size=60))
def test_edit_distance_is_the_plain_one(a, text):
    distance, end = d.edit_distance_within(a, text)
    assert distance == plain(a, text)
    assert plain(a, text[:end]) == distance or not text


def test_edited_passages_are_found_and_clean_texts_are_not(spark):
    r = random.Random(4)
    filler = lambda: " ".join("".join(r.choice("aeioutnsrh") for _ in range(r.randint(2, 8))) for _ in range(80))
    rows, expected = [], set()
    for i in range(60):
        kind, body = i % 3, filler()
        if kind:
            passage = list(ITEM)
            for _ in range(9 if kind == 2 else 0):
                passage[r.randrange(len(passage))] = r.choice("xyz")
            body = body + " " + "".join(passage) + " " + filler()
            expected.add(i)
        rows.append((i, body, 99))
    found = d.contaminations(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(7, ITEM)], ITEMS)).collect()
    assert {r.doc_id for r in found} == expected
    brute = {i: plain(ITEM, body) for i, body, _ in rows}
    for row in found:
        assert row.item_id == 7 and row.edits == brute[row.doc_id] <= row.item_chars * d.EDIT_RATE
    clean = d.decontaminate(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(7, ITEM)], ITEMS))
    assert {r.doc_id for r in clean.collect()} == set(range(60)) - expected and clean.columns == ["doc_id", "text", "item_id"]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, ITEM, 1), (1, None, 1), (2, "", 1), (3, ITEM, 1), (3, ITEM, 1), (4, "a short item here", 1), (5, "ashort item here", 1), (6, "amoon moonb", 1), (7, "a moon", 1), (8, "a shrt item", 1), (9, "a shrt itm", 1)], DOCS)
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, "  "), (4, "short item"), (None, ITEM.upper()), (6, "moon")], ITEMS)
    found = sorted((r.doc_id if r.doc_id is not None else -1, r.item_id if r.item_id is not None else -1) for r in d.contaminations(docs, items).collect())
    assert found == [(-1, -1), (-1, 1), (-1, 6), (3, -1), (3, -1), (3, 1), (3, 1), (3, 6), (3, 6), (4, 4), (5, 4), (7, 6), (8, 4)]
    assert d.contaminations(docs.limit(0), items).count() == 0
    assert d.contaminations(docs, items.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "word " * 200_000 + ITEM, 1)], DOCS)
    assert d.contaminations(long, items.filter("item_id = 1")).count() == 1


@pytest.mark.parametrize("kind", d.KINDS)
def test_recall_at_the_edit_limit(kind):
    """Copies with as many edits as are allowed, by size of the item and by how the edits lie, against exact edit distance."""
    r, word = random.Random(7), lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    for size in (12, 20, 33, 48, 64, 75, 90, 105, 200, 400):
        items = [(k, prose(100)[:size].strip().encode()) for k in range(40)]
        bench, edits = d.Benchmark(items), np.random.default_rng(size)
        hits = within = 0
        for k, t in items * 3:
            text = f"{prose(15)} {d.spread_edits(t, int(0.1 * len(t)), kind, edits).decode()} {prose(15)}".encode()
            within += (distance := d.edit_distance_within(t.decode(), text.decode())[0]) <= 0.1 * len(t)
            hits += any(row[1] == k and row[2] == distance for row in bench.search(np.frombuffer(text, np.uint8), np.array([0, len(text)])))
        print(kind, size, hits / within, len(bench.tables))
        assert within == 120 and hits >= 0.98 * within, size


def test_items_without_words_and_far_edits(monkeypatch):
    """Text without spaces is looked at from every byte; where edits leave nothing whole, the plain edit distance decides."""
    r, edits = random.Random(8), np.random.default_rng(8)
    items = [(k, "".join(chr(r.randrange(0x4E00, 0x5E00)) for _ in range(60)).encode()) for k in range(20)]
    bench = d.Benchmark(items)
    assert not bench.tables or not any(t[0] for t in bench.tables)
    far = [(k, " ".join("".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(20)).encode()) for k in range(10)]
    monkeypatch.setattr(d, "MOST_WALKS", 1)
    loose = d.Benchmark(far, rate=0.6)
    assert loose.plain
    for some, rate, own in ((items, 0.1, bench), (far, 0.6, loose)):
        for k, t in some:
            chars = list(t.decode())
            for at in edits.choice(len(chars), int(rate * len(chars)), replace=False):
                chars[at] = "z"
            text = f"before {''.join(chars)} after"
            assert any(row[1] == k for row in own.search(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())])))


def test_walks_are_added_until_the_recall_is_met():
    texts = [ITEM.encode()]
    assert d.walks_needed(texts, 0.1, d.SHAPES[0]) >= d.walks_needed(texts, 0.1, d.SHAPES[0], recall=0.5) >= 1
    assert d.walks_needed(texts, 0.2, d.SHAPES[0]) > d.walks_needed(texts, 0.02, d.SHAPES[0])
    assert d.walks_needed(texts, 0.5, d.SHAPES[0]) == 0
    data = np.frombuffer(b"abc abc" + b"\0" * 40, np.uint8)
    walk = d.Walk(0, 20, 10)
    assert walk.keys(data, np.array([0]))[0] == walk.keys(data, np.array([0]))[0]


def test_blocks_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(d, "BLOCK_BYTES", 100)  # a block for each item
    items = spark.createDataFrame([(1, ITEM), (2, ITEM[::-1]), (3, "short item")], ITEMS)
    docs = spark.createDataFrame([(1, "a " + ITEM, "x", 1.0), (2, ITEM[::-1], "y", 2.0), (3, "short item", "z", 3.0), (4, None, "w", 4.0), (5, "clean", None, 5.0)], "doc_id long, text string, item_id string, edits double")
    assert sorted((r.doc_id, r.item_id) for r in d.contaminations(docs, items).collect()) == [(1, 1), (2, 2), (3, 3)]
    assert sorted(map(tuple, d.decontaminate(docs, items).collect()), key=str) == [(4, None, "w", 4.0), (5, "clean", None, 5.0)]

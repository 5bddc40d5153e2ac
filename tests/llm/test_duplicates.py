import hashlib
import itertools
import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from memoria.llm import near_duplicates as nd
from memoria.llm import repeats as rp

SCHEMA = "doc_id long, text string, class_id long"


def shingles(text):
    w = (text or "").split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


def brute_classes(rows):
    sets = [shingles(t) for _, t in rows]
    root, links = list(range(len(rows))), Counter()

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and both >= 0.8 * len(sets[i] | sets[j]):
            links[i] += 1
            links[j] += 1
            a, b = sorted((find(i), find(j)))
            root[b] = a
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return [(k, least.get(find(i)) if sets[i] else k, links[i]) for i, (k, _) in enumerate(rows)]


def near_copies(seed, n=160):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    base = [[word() for _ in range(r.choice([3, 12, 60, 150]))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 5])):
            w[r.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    return rows


def test_classes_against_brute_force(spark, monkeypatch):
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or 0, x[2])
    for seed, block, members, rows_at_once in ((1, nd.BLOCK_SHINGLES, nd.BLOCK_MEMBERS, nd.WALK_ROWS), (2, 300, 5, 50)):  # the second splits families into blocks, and tries into short walks
        monkeypatch.setattr(nd, "BLOCK_MEMBERS", members)
        monkeypatch.setattr(nd, "WALK_ROWS", rows_at_once)
        rows = near_copies(seed) + [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "one two"), (None, "one two"), (5, near_copies(seed)[5][1])]
        found = nd.near_duplicates(spark.createDataFrame([(i, t, 0) for i, t in rows], SCHEMA), block_shingles=block).collect()
        assert sorted(((r.doc_id, r.class_id, r.n_links) for r in found), key=key) == sorted(brute_classes(rows), key=key)
    assert nd.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_of_each_class_stays(spark):
    rows = near_copies(3) + [(7, near_copies(3)[7][1])]
    kept = nd.keep_one(spark.createDataFrame([(i, t, 0) for i, t in rows], SCHEMA))
    assert kept.columns == ["doc_id", "text", "class_id"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c, _ in brute_classes(rows)})


def test_forest_reaches_its_recall():
    """Pairs at the threshold itself, by size of the texts: the share that some tree finds by a prefix of the length at which both stop."""
    depth = nd.forest_depth()
    assert 1 - (1 - 0.8**depth) ** nd.TREES >= nd.TARGET_RECALL > 1 - (1 - 0.8 ** (depth + 1)) ** nd.TREES
    r, forest = np.random.default_rng(0), nd.Forest(nd.TREES, nd.MAX_DEPTH)
    for n in (5, 10, 45, 200, 1000):  # of 10/9 n shingles, n are common: 0.8 or a little more
        hits = 0
        for _ in range(300):
            a = r.integers(0, 1 << 63, n, dtype=np.uint64)
            b = np.concatenate((a[: n - n // 9], r.integers(0, 1 << 63, n // 9, dtype=np.uint64))) if n >= 9 else a[:-1]
            keys = [forest.labels(forest.signature(np.unique(x))) for x in (a, b)]
            stop = max(nd.forest_depth(nd.least_similarity(len(x))) for x in (a, b))
            hits += bool((nd.shared_labels(*keys) >= stop).any())
        assert hits >= 299, n


def test_prefixes_shorten_by_record():
    assert nd.least_similarity(3) == 1 and nd.least_similarity(4) == 0.8 and abs(nd.least_similarity(7) - 6 / 7) < 1e-9
    assert nd.forest_depth(nd.least_similarity(7)) > nd.forest_depth()
    r = np.random.default_rng(2)
    n = 400
    keys = (r.integers(0, 2, (n, 8)).astype(np.uint64).reshape(n, 2, 4) << np.array([48, 32, 16, 0], np.uint64)).sum(2, dtype=np.uint64)
    tree, depth = r.integers(0, 2, n), r.integers(5, 9, n)
    order = np.lexsort((keys[:, 1], keys[:, 0], tree))
    tree, keys, depth = tree[order], keys[order], depth[order]
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = 0
    for u, v in nd.climb(tree, keys, depth):
        for a, b in zip(u.tolist(), v.tolist()):
            links += 1
            root[find(a)] = find(b)
    found = [find(i) for i in range(n)]
    root = list(range(n))
    for i, j in itertools.combinations(range(n), 2):
        if tree[i] == tree[j] and nd.shared_labels(keys[i : i + 1], keys[j : j + 1])[0] >= max(depth[i], depth[j]):
            root[find(j)] = find(i)
    expected = [find(i) for i in range(n)]
    assert len(set(zip(found, expected))) == len(set(found)) == len(set(expected)) and links < n  # one link for a record at most


def covered(rows, length):
    """For each text a mark for each byte that a repeated string covers."""
    seen = Counter(b[s : s + length] for b in rows for s in range(len(b) - length + 1))
    for b in rows:
        mark = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                mark[s : s + length] = b"\1" * length
        yield mark


def brute_repeats(rows, length):
    out = []
    for b, mark in zip(rows, covered(rows, length)):
        kept = bytes(x for x, m in zip(b, mark) if not m)
        spans = sum(1 for k in range(len(b)) if mark[k] and (k == 0 or not mark[k - 1]))
        out.append((len(b), sum(mark), spans, hashlib.sha256(kept).hexdigest()))
    return out


def passages(seed):
    r = random.Random(seed)
    line = lambda n: "".join(r.choice("abcde é") for _ in range(n))
    shared = [line(n) for n in (399, 405, 700, 1500)]
    texts = [line(r.randint(0, 900)) + r.choice(shared) + line(r.randint(0, 500)) for _ in range(50)]
    texts += [texts[3], texts[3], "ab" * 900, "xyz" * 140, "", line(300), shared[2] * 3, "q" * 5000]
    return texts


def test_repeats_against_brute_force(spark, monkeypatch):
    texts = passages(6)
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, None), (None, texts[0]), (None, texts[0]), (3, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = rp.repeat_report(docs).collect()
    raw = [(t or "").encode() for _, t in rows]
    expected = [(*e, sum(m)) for e, m in zip(brute_repeats(raw, 400), covered(raw, rp.PASSAGE))]
    key = lambda x: (x[0] is None, *map(str, x))
    assert sorted(map(tuple, found), key=key) == sorted(((i, *e) for (i, _), e in zip(rows, expected)), key=key)
    monkeypatch.setattr(rp, "HOT_BYTES", 2000)  # seeds cut again in tables, and many indexes
    small = rp.repeat_report(docs, index_bytes=3000).collect()
    assert sorted(map(str, small)) == sorted(map(str, found))
    monkeypatch.setattr(rp, "LEVELS", 0)  # and within their tasks
    small = rp.repeat_report(docs, index_bytes=1000).collect()
    assert sorted(map(str, small)) == sorted(map(str, found))
    assert rp.repeat_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_removed_runs_leave_the_rest(spark):
    texts = passages(8)
    extra = ["_key", "_word", "_mask", "_spot", "_may", "_runs", "seed", "row", "a", "b", "c", "n", "spans", "Body"]
    docs = spark.createDataFrame([(i, t, len(t), *[f"{x}{i}" for x in extra]) for i, t in enumerate(texts)] + [(99, None, 0, *extra)], "doc_id long, text string, n_chars long, " + ", ".join(f"{x} string" for x in extra))
    for length in (400, rp.PASSAGE):
        out = rp.remove_repeats(docs, length=length)
        assert out.columns == docs.columns
        out = {r.doc_id: r for r in out.collect()}
        assert len(out) == len(texts) + 1 and out[99].text is None
        for (i, t), mark in zip(enumerate(texts), covered([t.encode() for t in texts], length)):
            assert out[i].text == bytes(x for x, m in zip(t.encode(), mark) if not m).decode(errors="ignore")
            assert out[i].n_chars == len(out[i].text) and [out[i][x] for x in extra] == [f"{x}{i}" for x in extra]
    spans = rp.find_repeats(docs).collect()
    assert {r.doc_id: r["_key"] for r in spans if r.doc_id < 99} == {i: f"_key{i}" for i in range(len(texts))} and any(r.spans for r in spans)
    assert rp.remove_repeats(docs.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=40), min_size=1, max_size=6))
def test_matching_statistics_are_longest_matches(texts):
    raw = [t.encode() for t in texts]
    index = rp.RunLengthIndex(raw)
    found = index.matching_statistics()
    suffixes = [(k, s, t[s:]) for k, t in enumerate(raw) for s in range(len(t))]

    def common(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    assert found.tolist() == [max([common(x, y) for k2, s2, y in suffixes if (k2, s2) != (k, s)], default=0) for k, s, x in suffixes]
    assert len(index.heads) <= index.size


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    import corpus_pipeline
    import public_tokenizers
    import sentencepiece

    r = random.Random(9)
    item = "the quick brown fox jumps over the lazy dog while seven wizards boil quarts of nitrogen under a cold moon"
    word = lambda: "".join(r.choice("aeioutnsrh") for _ in range(r.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    passage = " ".join(prose(120).split()[:51])  # some 300 bytes
    texts = [prose(r.randint(60, 200)) for _ in range(150)]
    texts += [t for t in texts[:15]] + [f"{prose(80)} {passage} {prose(60)}" for _ in range(8)] + [f"{prose(60)} {item} {prose(60)}" for _ in range(6)]
    texts += [" ".join(word().upper() + "!!" for _ in range(80)) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, int(not t.isupper()), 0) for i, t in enumerate(texts) if i % 2], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    result = {x.doc_id: x.ids for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    rows = [(i, t) for i, t in enumerate(texts) if not t.isupper()]
    rows = [(i, t) for (i, t), (_, c, _) in zip(rows, brute_classes(rows)) if c == i]
    left = [(i, "".join(c for c, m in zip(t, mark) if not m)) for (i, t), mark in zip(rows, covered([t for _, t in rows], rp.PASSAGE))]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert result == {i: library.encode(t) for i, t in left if item not in t}

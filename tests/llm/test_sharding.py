import zlib
from collections import defaultdict

from memoria.llm.sharding import SHARDS, WHOLE_GROUP, op2_sharding, shard_by_size

SCHEMA = "doc_id long, text string, shard int"


def check(rows, found, shards):
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.size, r.text_crc32) for r in found) == sorted(((i is None, i or 0), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in found:
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    return [sizes[k] for k in range(shards)]


def test_sizes_are_near_equal_and_groups_stay_together(spark):
    rows = [(i, f"text {i} " * (1 + i % 9), 3) for i in range(4000)] + [(5000 + i, "the same small text", 3) for i in range(12)] + [(6000 + i, "a hot text " * 4, 3) for i in range(3000)]
    found = shard_by_size(spark.createDataFrame(rows, SCHEMA)).collect()
    sizes = check(rows, found, SHARDS)
    mean = sum(sizes) / SHARDS
    assert max(sizes) < (1 + 2 * WHOLE_GROUP) * mean and min(sizes) > (1 - 2 * WHOLE_GROUP) * mean
    assert len({r.shard for r in found if 5000 <= r.doc_id < 6000}) == 1
    assert len({r.shard for r in found if r.doc_id >= 6000}) > 4  # far more than one shard's share


def test_placement_against_brute_force(spark):
    """Sorted by the texts' hashes, each record goes where the middle of its bytes lies, a small group of equal texts as one."""
    texts = [(i, f"text {i} " * (1 + i % 9)) for i in range(1500)] + [(2000 + i, "the same small text") for i in range(12)] + [(3000 + i, "a hot text " * 4) for i in range(900)] + [(9, None), (None, "x"), (None, None)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts], SCHEMA)
    low = -(1 << 63)
    rows = sorted((r.h, low if r.doc_id is None else r.doc_id, zlib.crc32((r.text or "").encode()), len((r.text or "").encode()) + 8) for r in docs.selectExpr("doc_id", "text", "xxhash64(text, 0) AS h").collect())
    total, shards, start, expected, slots = sum(r[3] for r in rows), 7, 0, [], defaultdict(int)
    group, begin = defaultdict(int), {}
    for h, _, _, size in rows:
        begin.setdefault(h, start)
        group[h] += size
        start += size
    start = 0
    for h, i, crc, size in rows:
        middle = begin[h] + group[h] / 2 if group[h] <= WHOLE_GROUP * total / shards else start + size / 2
        shard = min(shards - 1, int(middle * shards / total))
        expected.append((i, crc, shard, slots[shard]))
        slots[shard] += 1
        start += size
    found = shard_by_size(docs, shards=shards).collect()
    assert sorted((low if r.doc_id is None else r.doc_id, r.text_crc32, r.shard, r.slot) for r in found) == sorted(expected)


def test_odd_rows(spark):
    rows = [(None, None, 1), (None, None, 1), (1, "", 1), (1, "", 1), (2, "x" * 100_000, 1), (3, None, 1)]
    check(rows, shard_by_size(spark.createDataFrame(rows, SCHEMA), shards=3).collect(), 3)
    assert shard_by_size(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_is_whole_and_stable(spark, small):
    a, b = (sorted(map(tuple, op2_sharding(spark, small).select("doc_id", "shard", "slot").collect())) for _ in range(2))
    assert a == b and len(a) == spark.read.parquet(f"{small}/documents.parquet").count()

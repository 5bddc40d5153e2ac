"""The stored index against searches over the texts themselves, after merges, deletions and a second opening."""

import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from memoria.operators import rank
from memoria.operators.stored import StoredIndex

WORDS = ["alpha", "beta", "gamma", "delta", "the", "epsilon", "ab", "zeta", "omega", "été"]
TERMS = ["alpha", "zeta", "absent"]
SCHEMA = "doc_id long, text string, source string, segment int, hash string"


@pytest.fixture
def stored(spark, tmp_path):
    made = []

    def make(**how):
        name = f"idx_{uuid.uuid4().hex[:8]}"
        made.append(StoredIndex(spark, name, f"file://{tmp_path}/index", **({"segments": 4, "buckets": 8} | how)))
        return made[-1]

    yield make
    for x in made:
        x.drop()


def corpus(r, ids):
    return {k: (r.choice([None, "", " ".join(r.choices(WORDS, k=r.randrange(1, 40)))]) if k % 9 == 0 else " ".join(r.choices(WORDS, k=r.randrange(1, 40))), r.choice(["research", None, "x"])) for k in ids}


def frame(spark, docs):
    return spark.createDataFrame([(k, t, s, 0, "h") for k, (t, s) in docs.items()], SCHEMA)


def found(df):
    return sorted((x.doc_id, round(x.bm25, 9), x.matched, x.length) for x in df.collect())


def agrees(spark, index, docs):
    assert found(index.bm25(TERMS)) == found(rank.bm25(frame(spark, docs), TERMS))
    best = lambda df: [(x.doc_id, x.source, x.score, x.matched) for x in df.collect()]
    assert best(index.search(TERMS, 10)) == best(rank.search(frame(spark, docs), TERMS, limit=10))


def test_search_equals_search_over_texts_after_merges(spark, stored):
    r = random.Random(4)
    docs = corpus(r, range(60))
    index = stored()
    index.merge(frame(spark, docs))
    agrees(spark, index, docs)
    # New and changed documents, a repeated row, a null id; others go, one is changed and deleted at once.
    changes = corpus(r, [3, 7, 100, 101])
    gone = [5, 6, 7, 999, None]
    rows = frame(spark, changes).union(frame(spark, {3: changes[3]})).union(frame(spark, {None: ("alpha", "x")}))
    docs = {k: v for k, v in docs.items() if k not in gone} | changes
    for _ in range(2):  # a merge may be run again
        index.merge(rows, spark.createDataFrame([(k,) for k in gone], "doc_id long"))
        agrees(spark, index, docs)


def test_sync_touches_changed_segments_alone(spark, stored):
    r = random.Random(5)
    docs = corpus(r, range(80))
    index = stored()
    assert {x.status for x in index.sync(frame(spark, docs)).collect()} == {"merged"}
    files = lambda: {(x.segment, x.f) for t in ("postings", "entries", "manifest") for x in index.table(t).select("segment", F.col("_metadata.file_path").alias("f")).distinct().collect()}
    before = files()
    assert {x.status for x in index.sync(frame(spark, docs)).collect()} == {"unchanged"} and files() == before
    at = {x.doc_id: x.segment for x in index.table("entries").collect()}
    docs[10] = ("alpha alpha alpha", "new")
    status = {x.segment: x.status for x in index.sync(frame(spark, docs)).collect()}
    assert {s for s, x in status.items() if x == "merged"} == {at[10]} and len(status) == 4
    assert {f for s, f in before if s != at[10]} == {f for s, f in files() if s != at[10]}
    agrees(spark, index, docs)
    # All documents of one segment go, then all others too.
    docs = {k: v for k, v in docs.items() if at[k] != at[10]}
    index.sync(frame(spark, docs))
    agrees(spark, index, docs)
    index.sync(frame(spark, {}))
    assert index.table("postings").count() == index.table("entries").count() == index.table("manifest").count() == index.bm25(TERMS).count() == 0


def test_plans_open_the_buckets_and_segments_that_are_asked_for(spark, stored):
    index = stored(segments=4, buckets=16)
    index.merge(frame(spark, corpus(random.Random(6), range(40))))
    # A scan shows its buckets where it has a task for each of them; pruning is the same in other scans.
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        plan = index.postings(["alpha"])._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert re.search(r"SelectedBucketsCount: 1 out of 16", plan)
    plan = index.lookup([3])._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*segment#\d+ (?:IN|=) ", plan)
    assert [x.doc_id for x in index.lookup([3, 12345]).collect()] == [3] and index.lookup([]).count() == 0


def test_an_index_is_opened_again(spark, stored):
    docs = corpus(random.Random(7), range(30))
    stored().merge(frame(spark, docs))
    agrees(spark, stored(), docs)

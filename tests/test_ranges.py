"""Positions and running sums over ranges: groups over many tasks, null keys, ties, odd names, empty tables."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from memoria.operators import conversation, ranges


def test_positions_of_a_hot_group_over_many_tasks(spark):
    r = random.Random(1)
    rows = [(k, r.choice(["hot", "hot", "hot", "a", None]), r.choice([None, 1, 2, 5]), "x") for k in range(3000)]
    df = spark.createDataFrame(rows, "`id` long, `a.b` string, size int, _position string").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = ranges.positions(df, ["a.b"], ["id"], {"size": "size"})
        got = {x["id"]: x.asDict() for x in found.collect()}
        parts = found.filter("`a.b` = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert parts > 1
    groups = defaultdict(list)
    for k, g, n, _ in rows:
        groups[g].append((k, n or 0))
    for group in groups.values():
        total, used = sum(n for _, n in group), 0
        for i, (k, n) in enumerate(group):
            x = got[k]
            assert (x["_position"], x["_count"], x["_before_size"], x["_total_size"]) == (i, len(group), used, total)
            used += n
    assert len(got) == len(rows)


def test_positions_without_keys_and_of_nothing(spark):
    df = spark.range(100).withColumn("text", F.lit("t")).repartition(5)
    assert [x._position for x in ranges.positions(df, [], ["-id"]).orderBy(F.desc("id")).collect()] == list(range(100))
    assert ranges.positions(df.filter("id < 0"), ["text"], ["id"], {"n": F.lit(1)}).count() == 0


def test_percentiles_with_ties_and_nulls(spark):
    r = random.Random(2)
    rows = [(r.choice(["a", "b", None]), r.choice([None, 1.0, 1.0, 2.0, 3.5])) for _ in range(500)] + [("one", 4.0), ("none", None)]
    found = {x.g: (x.p0, x.p50, x.p95, x.n) for x in ranges.percentiles(spark.createDataFrame(rows, "g string, v double"), "v", ["g"], {"p0": 0.0, "p50": 0.5, "p95": 0.95}).collect()}
    groups = defaultdict(list)
    for g, v in rows:
        if v is not None:
            groups[g].append(v)
    expected = {g: (*[sorted(x)[min(int(p * len(x)), len(x) - 1)] for p in (0.0, 0.5, 0.95)], len(x)) for g, x in groups.items()}
    assert found == expected


def test_acknowledged_by_group(spark):
    r = random.Random(3)
    rows = [(g, k, r.choice("abc"), r.choice(["hi", "@a look", "@B and @c", "@zz @a @a"])) for g in (1, 2, None) for k in range(60)]
    df = spark.createDataFrame(rows, "g int, key long, sender string, text string").repartition(4)
    found = sorted((x.key, x.mentioner, x.mentioned, x.acknowledged) for x in conversation.acknowledged(df, key="key", sender="sender", text="text", group=["g"]).collect())
    expected = []
    for g in (1, 2, None):
        own = [x for x in rows if x[0] == g]
        for i, (_, k, s, t) in enumerate(own):
            for w in t.lower().replace("@", " @").split():
                if w[0] == "@":
                    expected.append((k, s, w[1:], w[1:] in [x[2] for x in own[i + 1 : i + 11]]))
    assert found == sorted(expected)


def test_budget_and_tiers_follow_the_order(spark):
    df = spark.createDataFrame([("s", k, 10) for k in range(10)] + [("t", 1, None)], "source string, doc long, n int").repartition(3)
    kept = {(x.source, x.doc): x.used for x in conversation.budget_prefix(df, ["source"], ["doc"], "n", 35).collect()}
    assert kept == {("s", 0): 10, ("s", 1): 20, ("s", 2): 30, ("t", 1): 0}
    tiers = {(x.source, x.doc): x.tier for x in conversation.tiers(df, ["source"], ["doc"]).collect()}
    assert [tiers["s", k] for k in range(10)] == ["full"] * 3 + ["brief"] * 4 + ["mention"] * 3

from collections import deque
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from memoria.operators import aggregates, conversation, graph, rank, relational, sync
from memoria.sources import tables
from memoria.streaming import events as streams

START = datetime(2024, 1, 1)


def test_pagerank_spreads_mass(spark):
    links = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0), (2, 3, 3.0), (3, 1, 1.0), (4, 1, 1.0)], "source_id long, target_id long, strength double")
    found = {r.node: r.score for r in graph.pagerank(links, [1], sweeps=40).collect()}
    shares = {1: {2: 1.0}, 2: {1: 0.25, 3: 0.75}, 3: {1: 1.0}, 4: {1: 1.0}}
    residual, score = {1: 1.0}, {}
    for _ in range(40):
        after = {}
        for n, r in residual.items():
            score[n] = score.get(n, 0) + 0.15 * r
            for t, s in shares[n].items():
                after[t] = after.get(t, 0) + 0.85 * r * s
        residual = after
    assert found == pytest.approx(score) and sum(found.values()) <= 1


def test_walks(spark):
    links = spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.4), (1, 3, 0.1), (3, 3, 1.0), (3, 4, 1.0)], "source_id long, target_id long, strength double")
    seeds = spark.createDataFrame([(1,)], "node long")
    assert {(r.node, r.hop) for r in graph.khop(links, seeds, 2).collect()} == {(1, 0), (2, 1), (3, 1), (4, 2)}
    near = {(r.neighbor, r.hops, r.strength) for r in graph.top_neighbors(links).filter("source_id = 1").collect()}
    assert near == {(2, 1, 0.5), (3, 1, 0.1), (4, 2, 0.1)}
    nodes = spark.createDataFrame([(i,) for i in range(1, 7)], "id long")
    assert {r.id for r in graph.orphans(nodes, links).collect()} == {5, 6}
    loops = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "a"), ("d", "d")], "mentioner string, mentioned string")
    assert {(r.members, r.length) for r in graph.feedback_loops(loops).collect()} == {("a,b", 2), ("a,b,c", 3)}


def test_link_states(spark):
    rows = spark.createDataFrame([(2, False), (3, False), (5, False), (5, True), (10, True)], "n int, explored boolean")
    assert [r.s for r in rows.select(graph.link_state(F.col("n"), F.col("explored")).alias("s")).collect()] == ["active", "soft_suppressed", "sub_hidden", "soft_suppressed", "once_thought"]
    up, less = graph.rehabilitate(F.lit("sub_hidden"), F.lit(1))
    row = spark.range(1).select(up.alias("u"), less.alias("n")).first()
    assert (row.u, row.n) == ("soft_suppressed", 0)


def test_diversity_sample(spark):
    nodes = spark.createDataFrame([(i, "abc"[i % 3], float(i) if i % 4 else None) for i in range(60)], "id long, type string, complexity double")
    found = graph.diversity_sample(nodes, 20).collect()
    # The best of every kind is among the eight best, so the first round adds none and is the last; no kind is structural.
    assert len({r.id for r in found}) == 20 and [sum(r.phase == p for r in found) for p in (1, 2, 3, 4)] == [8, 0, 0, 12]
    few = graph.diversity_sample(nodes.withColumn("complexity", F.when(F.col("type") == "a", 0.5).otherwise(F.col("complexity"))), 20).collect()
    assert [sum(r.phase == p for r in few) for p in (1, 2, 3, 4)] == [8, 8, 0, 4] and {r.type for r in few if r.phase == 2} == {"a", "b", "c"}


def limiter(times, most, seconds):
    live, out = deque(), []
    for t in times:
        while live and live[0] < t - timedelta(seconds=seconds):
            live.popleft()
        out.append(len(live) < most)
        if out[-1]:
            live.append(t)
    return out


def test_rate_limit_batch_and_stream(spark, tmp_path):
    times = [START + timedelta(seconds=s) for s in (0, 5, 10, 15, 20, 25, 30, 61, 62, 66, 70, 200, 201)]
    rows = [("a", i, t) for i, t in enumerate(times)] + [("b", 100, START)]
    frame = spark.createDataFrame(rows, "agent string, key long, ts timestamp")
    expected = dict(enumerate(limiter(times, 5, 60))) | {100: True}
    found = conversation.rate_limit(frame, "agent", "ts", "key")
    assert {r.key: r.accepted for r in found.collect()} == expected
    frame.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = streams.rate_limit(streams.read(spark, f"{tmp_path}/in", "agent string, key long, ts timestamp"), agent="agent", key="key", at="ts")
    assert {r.key: r.accepted for r in streams.run_available(stream, "limited", f"{tmp_path}/c").collect()} == expected


def test_stream_windows_equal_batch(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    events.orderBy("ts").coalesce(1).write.parquet(f"{tmp_path}/in")
    source = streams.read(spark, f"{tmp_path}/in", events.schema)
    batch = {(r.topic, r.begin, r.n) for r in streams.heat(events).collect()}
    assert {(r.topic, r.begin, r.n) for r in streams.run_available(streams.heat(source, late="1 day"), "heated", f"{tmp_path}/h", "complete").collect()} == batch
    batch = {(r.user_id, r.begin, r.end, r.n) for r in streams.sessions(events).collect()}
    assert {(r.user_id, r.begin, r.end, r.n) for r in streams.run_available(streams.sessions(source, late="1 day"), "visits", f"{tmp_path}/s", "complete").collect()} == batch


def test_cooldown_counts_successes_only(spark):
    rows = [("p", START + timedelta(seconds=s), ok) for s, ok in ((0, False), (5, True), (20, True), (36, True), (40, False))]
    found = streams.cooldown(spark.createDataFrame(rows, "path string, ts timestamp, ok boolean")).collect()
    assert [r.accepted for r in sorted(found, key=lambda r: r.ts)] == [True, True, False, True, False]


def test_threads(spark):
    rows = [(1, None, "a"), (2, 1, "b"), (3, 2, "a"), (4, 3, "b"), (5, 1, "c"), (6, 99, "a"), (7, 8, "x"), (8, 7, "x")]
    messages = spark.createDataFrame(rows, "id long, parent_id long, sender string")
    found = {r.id: (r.root, r.depth) for r in conversation.threads(messages).collect()}
    assert {k: found[k] for k in (1, 2, 3, 4, 5, 6)} == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (1, 3), 5: (1, 1), 6: (6, 0)}
    assert set(found) == set(range(1, 9))  # a cycle ends
    summary = conversation.thread_summary(conversation.threads(messages), messages).filter("root = 1").first()
    assert (summary.messages, summary.participants, summary.depth, summary.significant) == (5, 3, 3, True)


def test_echo_edges(spark):
    texts = ["alpha beta gamma delta epsilon zeta eta", "alpha beta gamma delta epsilon zeta eta", "alpha beta gamma delta epsilon zeta other", "", "new words here"]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "conv long, turn long, text string")
    found = {r.turn: r for r in conversation.echoes(rows, ["conv"], ["turn"]).collect()}
    assert [found[i].is_echo for i in range(5)] == [False, True, True, False, False] and found[2].similarity == pytest.approx(6 / 8)
    fresh = {r.turn: r for r in conversation.novelty(rows, ["conv"], ["turn"]).collect()}
    assert fresh[0].novelty == 1.0 and fresh[1].novelty == 0.0 and fresh[1].is_novel is False and fresh[4].is_novel


def test_votes_claims_and_chain(spark):
    rows = [(1, "Ann", "I vote for red @bob"), (2, "Bob", "my vote: blue"), (3, "Ann", "+1 for blue"), (4, "Bob", "I was not mentioned"), (5, "Cy", "Decision: keep the old parser\nnote: no")]
    m = spark.createDataFrame(rows, "key long, sender string, text string")
    kw = {"key": "key", "sender": "sender", "text": "text"}
    assert {(r.choice, r.votes) for r in conversation.tally(conversation.votes(m, **kw)).collect()} == {("blue", 2)}
    audit = conversation.audit_denials(conversation.claims(m, **kw), conversation.mentions(m, **kw)).collect()
    assert [(r.key, r.contradicted) for r in audit] == [(4, True)]
    assert [(r.category, r.content) for r in conversation.knowledge(m, key="key", text="text").collect()] == [("DECISION", "keep the old parser")]
    chained = m.withColumn("g", F.lit(1))
    chain = conversation.hash_chain(chained, ["g"], "key", "text")
    assert conversation.verify_chain(chain, chained, ["g"], "key", "text").filter("holds").count() == 5
    forged = chain.withColumn("link", F.when(F.col("key") == 3, F.lit("x")).otherwise(F.col("link")))
    assert [r.key for r in conversation.verify_chain(forged, chained, ["g"], "key", "text").filter("NOT holds").orderBy("key").collect()] == [3, 4]


def test_rank_numbers(spark):
    numbers = spark.range(1).select(*[rank.coverage(F.lit(n), 3).alias(f"c{n}") for n in (1, 2, 3)], rank.convergence(F.lit(4)).alias("v"), rank.authority(F.lit("My Research notes")).alias("a"), rank.temporal(F.lit(48.0), "recent").alias("t"), rank.graph_boost(F.lit(0.8), F.lit(2), F.lit(False)).alias("g")).first()
    assert numbers.c3 == 1.0 and numbers.c1 == pytest.approx(0.15 + 0.85 * (1 / 3) ** 1.5)
    assert (numbers.v, numbers.a, numbers.t) == (1.7, 1.15, 1.5) and numbers.g == pytest.approx(1.4 * 1.3)
    assert rank.temporal_intent(["latest", "status", "first"]) == "recent" and rank.temporal_intent(["x"]) == "neutral"


def test_costs_and_quorum(spark):
    usage = spark.createDataFrame([("a", "large", 1_000_000, 0), ("b", "strange", 0, 1_000_000)], "agent string, model string, input_tokens long, output_tokens long")
    found = {(r.level, r.name): r.cost for r in aggregates.usage_rollup(usage).collect()}
    assert found[("total", "*")] == 30.0 and found[("agent", "a")] == 15.0 and found[("model", "strange")] == 15.0
    votes = spark.createDataFrame([(1, 1), (2, 1), (2, 1), (2, 0), (3, 0), (3, 0)], "request int, approve int")
    assert {r.request: r.status for r in aggregates.quorum(votes).collect()} == {1: "PENDING", 2: "PENDING", 3: "REJECTED"}


def test_states(spark):
    a = sync.schema_columns(spark, {"users": spark.createDataFrame([], "id int, email string"), "old": spark.createDataFrame([], "x int")})
    b = sync.schema_columns(spark, {"users": spark.createDataFrame([], "id bigint, email string, active boolean"), "fresh": spark.createDataFrame([], "y int")})
    found = {(r.table, r.column): (r.change, r.migration) for r in sync.schema_diff(a, b).collect()}
    assert found[("users", "id")] == ("type_changed", "ALTER TABLE `users` ALTER COLUMN `id` TYPE bigint") and found[("users", "active")][0] == "column_added"
    assert found[("old", "x")][0] == "table_dropped" and found[("fresh", "y")][0] == "table_added" and ("users", "email") not in found
    assert sync.schema_diff(a, a).count() == 0
    schema = "scope string, key string, value string, updated int"
    memory = spark.createDataFrame([("p", "a", "1", 1), ("p", "b", "2", 1)], schema)
    after = sync.upsert(memory, spark.createDataFrame([("p", "a", "3", 2), ("p", "b", "0", 0), ("q", "a", "9", 1)], schema))
    assert {(r.scope, r.key, r.value) for r in after.collect()} == {("p", "a", "3"), ("p", "b", "2"), ("q", "a", "9")}
    assert [r.key for r in sync.lookup(after, "p", "a").collect()] == ["a"]
    entry = "id int, content string, updated int"
    merged = sync.sync_merge(spark.createDataFrame([(1, "x", 1), (2, "y", 5), (3, "q", 2)], entry), spark.createDataFrame([(1, "z", 2), (3, "r", 2), (4, "n", 1)], entry)).collect()
    assert {(r.id, r.content, r.conflict) for r in merged} == {(1, "z", False), (2, "y", False), (3, "q", True), (4, "n", False)}


def test_relational_shapes(spark):
    times = [START + timedelta(seconds=s) for s in (0, 299, 300, 601)]
    a = spark.createDataFrame(list(enumerate(times)), "a int, at timestamp")
    b = a.select(F.col("a").alias("b"), F.col("at").alias("bt"))
    found = {(r.a, r.b) for r in relational.band_join(a, b, at_left="at", at_right="bt", seconds=300).filter("a < b").collect()}
    assert found == {(0, 1), (0, 2), (1, 2)} and relational.like(F.lit("x"), "y") is not None
    row = spark.range(1).select(relational.clean_float(F.lit(float("nan"))).alias("n"), relational.clean_float(F.lit(1.5)).alias("v"), relational.normal_path(F.lit("a\\b")).alias("p"), relational.merge_ordered(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3))).alias("m")).first()
    assert (row.n, row.v, row.p, row.m) == (None, 1.5, "a/b", [1, 2, 3])


def test_sources(spark, tmp_path):
    (tmp_path / "in" / "skip").mkdir(parents=True)
    (tmp_path / "in" / "a.log").write_text("CLIO: hello there\nno agent line\nbolt: yes: indeed\n")
    (tmp_path / "in" / "skip" / "b.log").write_text("X: hidden")
    (tmp_path / "in" / "empty.log").write_text("")
    log = tables.chat_log(spark, f"{tmp_path}/in/a.log")
    assert {(r.agent, r.content) for r in log.collect()} == {("CLIO", "hello there"), ("BOLT", "yes: indeed")}
    files = tables.sweep(spark, f"{tmp_path}/in", pattern="*.log", exclude=["skip"])
    assert [r.path.rsplit("/", 1)[-1] for r in files.collect()] == ["a.log"]
    assert tables.changed_files(files, files.select("path", "hash")).count() == 0
    chats = spark.createDataFrame([(1, "**Ann:** hi\n**Bob:** yo"), (2, "ANN: one\nBOB: two"), (3, "[ann] x"), (4, "just\n\nparagraphs")], "id int, text string")
    found = {(r.id, r.position, r.agent, r.content) for r in tables.group_chat(chats, "id", "text").collect()}
    assert found == {(1, 0, "ANN", "hi"), (1, 1, "BOB", "yo"), (2, 0, "ANN", "one"), (2, 1, "BOB", "two"), (3, 0, "ANN", "x"), (4, 0, "UNKNOWN", "just"), (4, 1, "UNKNOWN", "paragraphs")}
    routed = tables.route(spark.createDataFrame([("c:\\work\\notes\\deep\\x.md",), ("/other",)], "path string"), "path", {"work": "projects", "deep": "deep"}, "default")
    assert [r.source for r in routed.collect()] == ["deep", "default"]
    for kind in ("csv", "json", "parquet", "markdown"):
        tables.export(chats, f"{tmp_path}/{kind}", kind)
    assert spark.read.parquet(f"{tmp_path}/parquet").count() == 4 and spark.read.json(f"{tmp_path}/json").count() == 4

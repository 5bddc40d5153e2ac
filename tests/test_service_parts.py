"""Overrides in PageRank, diversity with structural nodes, page totals, decay of a memory and layers of disclosure, against plain computations."""

import hashlib
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from memoria.operators import aggregates, disclosure, graph, relational

NOW = datetime(2024, 3, 1, tzinfo=timezone.utc)


def test_overrides_change_pagerank(spark):
    edges = [(1, 2, 1.0), (1, 3, 1.0), (2, 1, 0.5), (3, 1, None), (3, 2, 0.0), (2, 3, 0.2)]
    deltas = [(1, 2, -0.5), (1, 2, -0.9), (3, 2, 0.5), (9, 9, 1.0)]
    links, overrides = spark.createDataFrame(edges, "source_id long, target_id long, strength double"), spark.createDataFrame(deltas, "source_id long, target_id long, delta double")
    found = {x.node: x.score for x in graph.pagerank(links, [1], epsilon=1e-6, overrides=overrides).collect()}
    weight = {(a, b): max(0.0, (w or 1.0) + sum(d for x, y, d in deltas if (x, y) == (a, b))) for a, b, w in edges}
    r, score = {1: 1.0}, {}
    for _ in range(50):
        nxt = {}
        for node, mass in r.items():
            if mass <= 1e-6:
                nxt[node] = nxt.get(node, 0) + mass
                continue
            score[node] = score.get(node, 0) + 0.15 * mass
            total = sum(w for (a, _), w in weight.items() if a == node)
            for (a, b), w in weight.items():
                if a == node and w:
                    nxt[b] = nxt.get(b, 0) + 0.85 * mass * w / total
        r = nxt
    assert found == pytest.approx(score, abs=1e-9)


def plain_sample(nodes, n):
    worth = lambda x: (-(x[2] or 0), x[0])
    by = {}
    for x in sorted(nodes, key=worth):
        by.setdefault(x[1], []).append(x)
    content = sorted(k for k in by if k not in graph.STRUCTURAL)
    out = [(x, 1) for x in sorted([x for k in content for x in by[k]], key=worth)[: int(n * 0.4)]]
    ids, most, i = {x[0] for x, _ in out}, int(n * 0.4) + int(n * 0.4), 0
    while len(out) < most:
        added = False
        for k in content:
            if i < len(by[k]) and by[k][i][0] not in ids:
                out.append((by[k][i], 2))
                ids.add(by[k][i][0])
                added = True
            if len(out) >= most:
                break
        i += 1
        if not added:
            break
    for x in [x for k in sorted(by) if k in graph.STRUCTURAL for x in by[k]][: int(n * 0.2)]:
        out.append((x, 3))
        ids.add(x[0])
    for x in sorted(nodes, key=worth):
        if len(out) < n and x[0] not in ids:
            out.append((x, 4))
            ids.add(x[0])
    return sorted((x[0], p) for x, p in out)


@pytest.mark.parametrize("seed, n", [(1, 10), (2, 25), (3, 7), (4, 200)])
def test_diversity_sample(spark, seed, n):
    r = random.Random(seed)
    kinds = ["fact", "episode", "header", "import", "config_key", "note"][: 3 + seed]
    nodes = [(k, r.choice(kinds), r.choice([None, 0.0, 1.0, r.uniform(-1, 5)])) for k in range(60)]
    found = graph.diversity_sample(spark.createDataFrame(nodes, "id long, type string, complexity double").repartition(3), n)
    assert sorted((x.id, x.phase) for x in found.collect()) == plain_sample(nodes, n)


def test_pages_say_what_they_show(spark):
    df = spark.range(45)
    page = relational.browse_page(df, ["id"], where=F.col("id") % 2 == 0, limit=10, offset=20).collect()
    assert [x.id for x in page] == [40, 42, 44] and {x.showing for x in page} == {"21-23 of 23"} and page[0].total == 23
    assert relational.browse_page(df, ["id"], offset=100).count() == 0


def test_decay_of_a_memory(spark):
    frame = lambda hours: spark.createDataFrame([(None if h is None else NOW - timedelta(hours=h),) for h in hours], "at timestamp")
    row = aggregates.context_decay(frame([5, 10, 20, 30, 40, None, 5000]), F.lit(NOW), at="at", window=5).first()
    assert (row.entries, row.health) == (5, "aging") and row.decay == pytest.approx(21 / 168) and row.gap_hours == pytest.approx(5)
    assert tuple(aggregates.context_decay(frame([100, 200]), F.lit(NOW), at="at").first())[3:] == (0.0, "healthy")
    assert aggregates.context_decay(frame([30 + k for k in range(9)]), F.lit(NOW), at="at").first().health == "decaying"
    assert aggregates.context_decay(frame([]), F.lit(NOW), at="at").first().entries == 0


def test_layers_of_disclosure(spark):
    r = random.Random(9)
    states = graph.STATES
    links = list({(a, b): (a, b, round(r.random(), 3), r.choice(states), r.choice([True, False]), r.choice(["shared_annotation", "session"])) for a, b in [(r.randrange(12), r.randrange(12)) for _ in range(90)]}.values())
    summaries = [(k, f"s{k % 3}", None if k == 4 else f"text {k} " * 60) for k in range(12)]
    verbatim = [(100 + k, f"s{k % 4}", f"whole {k} " * 90) for k in range(30)]
    seeds = [(s, k, round(r.random(), 2)) for s in ("a", "b") for k in range(12)]
    rejected = [("a", 1), ("a", 2), ("b", 5), ("a", 1)]
    frame = spark.createDataFrame
    ldf, rdf = frame(links, "source_id long, target_id long, strength double, link_state string, explored boolean, link_type string"), frame(rejected, "session string, summary_id long")
    found = disclosure.layer_zero(frame(seeds, "session string, summary_id long, score double"), ldf, rdf).collect()
    worst = {k: max((states.index(x[3]) for x in links if k in x[:2]), default=0) for k in range(12)}
    for s in ("a", "b"):
        kept = [(k, score) for q, k, score in seeds if q == s and (s, k) not in rejected and worst[k] != 3 and (worst[k] != 1 or int(hashlib.sha256(f"{s}{k}".encode()).hexdigest(), 16) % 2 == 0)]
        kept.sort(key=lambda x: (-x[1], x[0]))
        assert [(x.summary_id, x.state, x.cohort) for x in sorted(found, key=lambda x: x.place) if x.session == s] == [(k, states[worst[k]], i // 3 + 1) for i, (k, _) in enumerate(kept)]
    asked = [("a", layer, p) for layer in (1, 2, 3) for p in range(12)] + [("b", 3, 0), ("b", 3, 0), ("b", 1, 77)]
    found = disclosure.layer_candidates(frame(asked, "session string, layer int, parent_id long"), ldf, frame(summaries, "id long, source string, content string"), frame(verbatim, "id long, source string, content string"), rdf).collect()
    got = {}
    for x in sorted(found, key=lambda x: (x.place, x.summary_id)):
        got.setdefault((x.session, x.layer, x.parent_id), []).append(x.summary_id)
        assert len(x.preview) <= (500 if x.layer == 2 else 200)
    shown = sorted([x for x in links if x[3] in ("active", "soft_suppressed")], key=lambda x: (-x[2], x[0], x[1]))
    for s, layer, p in set(asked):
        if layer == 1:
            near = [x for x in shown if p in x[:2] and (x[4] or x[5] == "shared_annotation")][:5]
            expected = list(dict.fromkeys(k for x in near for k in x[:2] if k != p and (s, k) not in rejected))
        elif layer == 2:
            expected = sorted(k for k, src, _ in verbatim if p < 12 and src == f"s{p % 3}")[:5]
        else:
            expected = [x[1] for x in [x for x in shown if x[0] == p and not x[4]][:8] if (s, x[1]) not in rejected]
        assert got.get((s, layer, p), []) == expected, (s, layer, p)

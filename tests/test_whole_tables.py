"""Queries read every row of their tables: brute force on a small fixture."""

import hashlib
from collections import defaultdict
from datetime import datetime
from itertools import permutations

import pytest

from memoria.operators import graph
from memoria.plans.catalogue import QUERIES


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    """Lines, events and documents, most of them where a subset by id or line number would end."""
    d = str(tmp_path_factory.mktemp("whole"))
    lines = [(i + 1, 1 + i * 7 % 5, 1 + i * 13 % 97, 1 + i % 3) for i in range(60)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_partkey long, l_linenumber int").write.parquet(f"{d}/lineitem.parquet")
    seen = [(63 + (i + 1) % 5, i) for i in range(5)] + [(105, 1), (100, 2)]
    spark.createDataFrame([(e, u, datetime(2024, 1, 1)) for e, u in seen], "event_id long, user_id long, ts timestamp").write.parquet(f"{d}/events.parquet")
    spark.createDataFrame([(i, f"text {i % 90}") for i in range(50, 130)], "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, f"text {i}") for i in range(60, 120)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, lines, seen


def edges(lines):
    out = defaultdict(dict)
    for _, supplier, part, _ in lines:
        w = 0.3 + 0.1 * (part % 7)
        for a, b in ((supplier, 100000 + part % 500), (100000 + part % 500, supplier)):
            out[a][b] = max(w, out[a].get(b, 0))
    return out


@pytest.mark.parametrize("most", [3, 20])
def test_top_neighbors_whole(spark, whole, most):
    d, lines, _ = whole
    out, expected = edges(lines), set()
    for a in out:
        best = {b: (1, -round(w, 9)) for b, w in out[a].items()}
        for b, w in out[a].items():
            for c, v in out[b].items():
                if c != a and best.get(c, (3, 0)) > (two := (2, -round(round(w, 9) * round(v, 9), 9))):
                    best[c] = two
        for r, (c, (hops, w)) in enumerate(sorted(best.items(), key=lambda x: (*x[1], x[0]))[:most], 1):
            expected.add((a, c, hops, round(-w, 4), r))
    if most == 20:
        found = QUERIES["top_neighbors"](spark, d)
    else:
        links = spark.createDataFrame([(a, b, round(w, 9)) for a in out for b, w in out[a].items()], "source_id long, target_id long, strength double")
        found = graph.top_neighbors(links, most)
    assert {(r.source_id, r.neighbor, r.hops, round(r.strength, 4), r["rank"]) for r in found.collect()} == expected


def test_khop_subgraph_whole(spark, whole):
    d, lines, _ = whole
    out = edges(lines)
    one = set(out[1])
    two = {c for b in one for c in out[b]} - one - {1}
    assert {(r.node, r.hop) for r in QUERIES["khop_subgraph"](spark, d).collect()} == {(1, 0)} | {(n, 1) for n in one} | {(n, 2) for n in two}


def test_feedback_loops_whole(spark, whole):
    d, _, seen = whole
    arcs = {(str(u % 6), str(e % 7)) for e, u in seen}
    nodes = sorted({n for arc in arcs for n in arc})
    expected = {(",".join(sorted(p)), n) for n in range(2, 6) for p in permutations(nodes, n) if all((p[i], p[(i + 1) % n]) in arcs for i in range(n))}
    assert max(n for _, n in expected) == 5
    assert {(r.members, r.length) for r in QUERIES["feedback_loops"](spark, d).collect()} == expected


def test_outer_compare_whole(spark, whole):
    digest = lambda s: hashlib.md5(s.encode()).hexdigest()
    a, b = {i: digest(f"text {i % 90}") for i in range(50, 130)}, {i + 20: digest(f"text {i}") for i in range(60, 120)}
    expected = {(i, "added" if i not in a else "deleted" if i not in b else "modified" if a[i] != b[i] else "unchanged") for i in a.keys() | b.keys()}
    assert {(r.id, r.status) for r in QUERIES["outer_compare"](spark, whole[0]).collect()} == expected


def test_ppr_scores_push_to_epsilon(spark, whole):
    d, lines, _ = whole
    out = edges(lines)
    residual, score = {1: 1 / 3, 2: 1 / 3, 3: 1 / 3}, defaultdict(float)
    for _ in range(50):
        live = {n: r for n, r in residual.items() if r > 1e-4}
        if not live:
            break
        residual = defaultdict(float, {n: r for n, r in residual.items() if n not in live})
        for n, r in live.items():
            score[n] += 0.15 * r
            for t, w in out[n].items():
                residual[t] += 0.85 * r * w / sum(out[n].values())
    assert max(residual.values()) <= 1e-4 and sum(score.values()) > 0.99
    found = {r.node: r.score for r in QUERIES["ppr_scores"](spark, d).collect()}
    assert found == pytest.approx(dict(score), abs=2e-6)

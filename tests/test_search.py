"""The ranked search against a plain computation of all its stages."""

import math
import random
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from memoria.operators import index, search

NOW = datetime(2024, 3, 1, tzinfo=timezone.utc)
TERMS = ["alpha", "beta", "python", "latest"]


def made(seed):
    r = random.Random(seed)
    ids = range(40)
    return {
        "annotations": [(d, t, round(r.uniform(0.1, 3), 3)) for d in ids for t in r.sample(["alpha", "beta", "python", "x", "y", "z"], r.randrange(1, 6))],
        "facts": [(d, r.choice(["my_research", "session_log x", None]), r.choice([0, 10, 500]), r.choice(["a.py", "b.JS", "c.md", "d/e", None]), r.choice([None, NOW - timedelta(hours=r.randrange(0, 300))]), r.choice(["ME", "other", "", None])) for d in ids if d % 11],
        "aspects": [(d, r.choice([5, 7, 5 ^ (1 << 62), 0x7FFF]), *[r.randrange(2) for _ in range(4)]) for d in ids if d % 7],
        "heat": [(r.choice(["alpha", "beta", "x"]), r.choice(["*", "me", "you"]), r.uniform(0, 2), NOW - timedelta(hours=r.randrange(-5, 250))) for _ in range(60)],
        "selections": [(r.randrange(40), r.choice(["user_selected", "ranking_promoted", "curator_suggested", "odd"])) for _ in range(60)],
        "rejections": [(r.randrange(40), NOW - timedelta(days=r.randrange(0, 220))) for _ in range(60)],
        "links": [(r.randrange(40), r.randrange(40), round(r.uniform(0.1, 1), 3)) for _ in range(60)],
        "explored": [(d,) for d in ids if d % 3 == 0],
        "mass": [(d, r.choice([0.0, r.uniform(0, 0.4)])) for d in ids if d % 2],
    }


SCHEMAS = {
    "annotations": "doc_id long, token string, weight double", "facts": "doc_id long, source string, chars long, path string, at timestamp, author string", "aspects": f"doc_id long, {', '.join(f'{c} long' for c in index.ASPECTS)}",
    "heat": "topic string, agent string, weight double, at timestamp", "selections": "doc_id long, signal string", "rejections": "doc_id long, at timestamp", "links": "source_id long, target_id long, strength double",
    "explored": "doc_id long", "mass": "doc_id long, mass double",
}
ASKED = {"sem_hash": 5, "source_hash": 1, "agent_hash": 1, "intent_hash": 0, "project_hash": 1}


def plain(t, terms, agent, asked, fetch, use):
    docs, facts = defaultdict(dict), {f[0]: f for f in t["facts"]}
    for d, tok, w in t["annotations"]:
        docs[d][tok] = w
    n_docs, mean = len(facts), sum(map(len, docs.values())) / len(docs)
    df = {x: sum(x in a for a in docs.values()) for x in terms}
    total = {d: sum(a.get(x, 0) for x in terms) for d, a in docs.items() if any(x in a for x in terms)}
    order = sorted(total, key=lambda d: (-round(total[d], 9), d))[:fetch]
    hours = lambda x: (NOW - x).total_seconds() / 3600
    heat = {x: round(sum(w * math.exp(-hours(at) / 24) for k, g, w, at in t["heat"] if k == x and g in (agent, "*") and 0 <= hours(at) <= 168), 3) for x in terms}
    graph = defaultdict(lambda: (9, 0.0))
    links = defaultdict(list)
    for a, b, s in t["links"]:
        links[a].append((b, s))
    one = {}
    for a in order[:5]:
        for b, s in links[a]:
            one[b] = max(one.get(b, 0), s)
    for b, s in one.items():
        graph[b] = (1, s)
    for b, s in one.items():
        for c, more in links[b]:
            if c not in one and round(s * more, 9) > graph[c][1]:
                graph[c] = (2, round(s * more, 9))
    out = {}
    for d in order:
        a, f = docs[d], facts.get(d, (d, None, 0, None, None, None))
        s = math.log1p(total[d]) * (0.15 + 0.85 * (sum(x in a for x in terms) / len(terms)) ** (1.5 if len(terms) > 1 else 1))
        if "heat" in use and max(heat.values()) > 0:
            s *= 1 + 0.5 * min(sum(heat[x] for x in terms if x in a) / max(heat.values()), 1)
        if not search.is_file_lookup(terms):
            s = 0.6 * s + 0.4 * sum(math.log((n_docs - df[x] + 0.5) / (df[x] + 0.5) + 1) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * len(a) / mean)) for x in terms if x in a)
        if "aspects" in use:
            mine = [x[1:] for x in t["aspects"] if x[0] == d]
            n = sum(bin((mine[0][0] ^ asked["sem_hash"]) & (2**64 - 1)).count("1") <= 6 if i == 0 else mine[0][i] == asked[c] for i, c in enumerate(index.ASPECTS)) if mine else 0
            s *= {2: 1.0, 3: 1.3, 4: 1.7, 5: 2.2}.get(n, 1.0)
        s /= (1 + math.log(len(a))) * (1 + 0.15 * math.log(max(f[2], 1)))
        if "mass" in use:
            mass = dict(t["mass"])
            if mass.get(d, 0) > 0:
                s = 0.7 * s + 0.3 * mass[d] / max(mass.values())
        elif "links" in use and d in graph and d not in order[:5]:
            s *= (1 + graph[d][1] * 0.5 ** (graph[d][0] - 1)) * (1 if "explored" in use and d % 3 == 0 else 1.3)
        if f[4]:
            s *= 1 + 2 ** (-hours(f[4]) / 48) * (1 if "latest" in terms else 0.2)
        chosen = [{"user_selected": 1, "curator_suggested": 0.5}.get(k, 0.3) for x, k in t["selections"] if x == d]
        if "selections" in use and chosen:
            s *= 1 + 0.3 * math.log1p(sum(chosen))
        s *= max(0.2, 1 - sum(0.1 * math.exp(-hours(at) / 24 / 60) for x, at in t["rejections"] if x == d and hours(at) / 24 <= 180)) if "rejections" in use else 1
        s *= 1.15 if "research" in (f[1] or "") else 1
        if {"python", "code"} & set(terms):
            ext = (f[3] or "").lower().rpartition(".")[2] if "." in (f[3] or "") else ""
            s *= (2.10 if ext == "py" else 0.35 if ext == "js" else 0.20 if ext else 1) if "python" in terms else (1.55 if ext == "py" else 1.08 if ext == "js" else 0.72 if ext else 1)
        out[d] = [round(s, 9), False]
    if agent != "*":
        weight = {d: round(w, 9) for d, w in total.items() if facts.get(d, [None] * 6)[5] and facts[d][5].upper() != agent.upper()}
        every = {d: round(sum(docs[d].get(x, 0) for x in terms), 9) for d in weight}
        for d in sorted(every, key=lambda d: (-every[d], d))[:5]:
            out.setdefault(d, [0.5, True])[1] = True
    return sorted(((d, s, c) for d, (s, c) in out.items()), key=lambda x: (-x[1], x[0]))


@pytest.mark.parametrize("use, terms, agent, fetch", [
    (set(SCHEMAS) - {"mass"}, TERMS, "me", None), (set(SCHEMAS), TERMS[:2], "*", None), ({"links"}, ["beta", "code"], "me", 12), (set(), ["alpha"], "*", 7), ({"heat"}, ["x_y", "alpha"], "*", None),
])
def test_all_stages(spark, use, terms, agent, fetch):
    t = made(len(use) + len(terms))
    frames = {k: spark.createDataFrame(t[k], SCHEMAS[k]) for k in {"annotations", "facts"} | use}
    found = search.ranked_search(search.Corpus(**frames), terms, as_of=F.lit(NOW), agent=agent, asked=ASKED, limit=15, fetch=fetch).collect()
    expected = plain(t, terms, agent, ASKED, fetch, use)[:15]
    assert [(x.doc_id, x.cross_agent) for x in found] == [(d, c) for d, _, c in expected]
    assert [x.score for x in found] == pytest.approx([s for _, s, _ in expected], abs=1e-8)


def test_searches_without_hits(spark):
    t = made(1)
    corpus = search.Corpus(*[spark.createDataFrame(t[k], SCHEMAS[k]) for k in ("annotations", "facts")])
    assert search.ranked_search(corpus, ["nothing", "at_all"], as_of=F.lit(NOW)).count() == 0
    assert search.ranked_search(corpus, [" ", "", None], as_of=F.lit(NOW)).count() == 0
    none = search.Corpus(*[spark.createDataFrame([], SCHEMAS[k]) for k in ("annotations", "facts")])
    assert search.ranked_search(none, TERMS, as_of=F.lit(NOW), agent="me").count() == 0

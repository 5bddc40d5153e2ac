"""More of the engine's queries, each beside its SQL: rankings in full, context for agents, links, the knowledge graph, statistics and texts to be shortened or spoken."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import compress, emotion, safety, text
from ..operators import aggregates, assembly, code, conversation, disclosure, graph, index, links, rank, relational, search, sync
from ..scratch import materialize
from ..sources import tables
from ..sources.tables import table
from ..streaming import state
from .catalogue import _ANNOTATE, _annotate_sql, _BM25, _MENTION, _MESSAGES, _ORDER_LINKS, _TOKENS, AS_OF, ORACLES, QUERIES, QUERY_TERMS, _as_of, _docs, _emotion_sql, _list, _messages, _order_links, query

__all__ = ["ORACLES", "QUERIES"]
_DIMS = [n.lower() for n in emotion.DIMENSIONS]
_TWO = lambda x: f"floor(({x}) * 100 + 0.5) / 100"


def _dominant_sql(columns: list[str]) -> str:
    most = f"greatest({', '.join(columns)})"
    return f"CASE {' '.join(f"WHEN {c} = {most} THEN '{n}'" for c, n in zip(columns, emotion.DIMENSIONS))} END"


def _emotions(spark, d):
    rows = table(spark, d, "conversations").filter(F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")) > 0)
    return rows.select("conv_id", "turn", "role", "text", *[c.alias(n.lower()) for n, c in emotion.emotion_scores(F.col("text")).items()])


# -- emotion, safety ------------------------------------------------------------------------------

@query(f"WITH e AS ({_emotion_sql('conv_id, turn, role')}), a AS (SELECT role, count(*) AS n, {', '.join(f'{_TWO(f"avg({c})")} AS {c}' for c in _DIMS)} FROM e GROUP BY role) SELECT role, n, {', '.join(_DIMS)}, {_dominant_sql(_DIMS)} AS dominant FROM a")
def emotion_by_role(spark, d):
    means = _emotions(spark, d).groupBy("role").agg(F.count(F.lit(1)).alias("n"), *[emotion.two_digits(F.avg(c)).alias(c) for c in _DIMS])
    return means.select("role", "n", *_DIMS, emotion.dominant({c.upper(): F.col(c) for c in _DIMS}).alias("dominant"))


@query(f"WITH e AS ({_emotion_sql('conv_id, turn, role')}) SELECT conv_id, turn, role, {_dominant_sql(_DIMS)} AS dominant, {_TWO(f'({" + ".join(_DIMS)}) / 10')} AS intensity FROM e")
def emotion_arc(spark, d):
    p = emotion.emotion_profile({c.upper(): F.col(c) for c in _DIMS})
    return _emotions(spark, d).select("conv_id", "turn", "role", p["dominant"].alias("dominant"), p["mean"].alias("intensity"))


@query(f"""WITH e AS ({_emotion_sql('conv_id, turn, text')}), l AS ({' UNION ALL '.join(f"SELECT conv_id, turn, '{c}' AS dim, {c} AS score, {k} AS k FROM e WHERE length(text) >= 20" for k, c in enumerate(_DIMS))}),
 r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, k) AS r FROM l WHERE score > 0.5)
 SELECT conv_id, turn, 'emotion_' || dim AS token, {_TWO('least(score, 5.0)')} AS weight FROM r WHERE r <= 5 UNION ALL SELECT conv_id, turn, 'dominant_' || dim, {_TWO('least(score * 1.5, 5.0)')} FROM r WHERE r = 1 AND score > 1""")
def emotion_annotations(spark, d):
    made = emotion.emotion_annotations({c.upper(): F.col(c) for c in _DIMS})
    return _emotions(spark, d).filter(F.length("text") >= 20).select("conv_id", "turn", F.explode(made).alias("a")).select("conv_id", "turn", "a.token", "a.weight")


@query(f"SELECT conv_id, turn, {' OR '.join(f"contains(lower(text), '{w}')" for w in safety.CRITICAL)} AS critical FROM conversations")
def critical_actions(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", safety.critical_action(F.col("text")).alias("critical"))


# -- shorter and spoken texts ---------------------------------------------------------------------

_PARAGRAPHS = "string_split(text, chr(10) || chr(10))"
_STRIP = "array_to_string(list_transform(string_split(regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '\\s+$', '')), chr(10))"
_SUMMARY = f"array_to_string(list_concat({_PARAGRAPHS}[1:1], list_filter({_PARAGRAPHS}[2:], lambda x: length(x) < 200)), chr(10) || chr(10))"


@query(f"""SELECT doc_id, md5(array_to_string(CASE WHEN len(list_filter(p, lambda x: contains(lower(x), 'ther'))) > 0 THEN list_filter(p, lambda x: contains(lower(x), 'ther')) ELSE p[1:3] END, chr(10) || chr(10))) AS relevant,
 md5({_SUMMARY}) AS summary, md5({_STRIP}) AS strip, length(CASE WHEN length(text) > 10000 THEN {_SUMMARY} ELSE {_STRIP} END) AS auto_chars FROM (SELECT doc_id, text, {_PARAGRAPHS} AS p FROM documents)""")
def compress_texts(spark, d):
    md5 = lambda c: F.md5(c.cast("binary"))
    text = F.col("text")
    return _docs(spark, d).select("doc_id", md5(compress.compress(text, "THER")).alias("relevant"), md5(compress.compress(text, method="summary")).alias("summary"), md5(compress.compress(text, method="strip")).alias("strip"), F.length(compress.compress(text)).cast("long").alias("auto_chars"))


def _speech_sql(text: str) -> str:
    for pattern, by in compress.SPOKEN:
        pattern = pattern.replace("@", "(?m)", 1) if pattern[0] == "@" else pattern
        text = f"regexp_replace({text}, $q${pattern}$q$, '{by.replace('$', chr(92))}', 'g')"
    return f"trim({text}, ' ')"


@query(f"WITH s AS (SELECT page_id, {_speech_sql('html')} AS said FROM pages) SELECT page_id, md5(said) AS said, len(string_split(regexp_replace(said, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS sentences FROM s")
def spoken_text(spark, d):
    said = table(spark, d, "pages").select("page_id", compress.speech(F.col("html")).alias("said"))
    return said.select("page_id", F.md5(F.col("said").cast("binary")).alias("said"), F.size(compress.sentences(F.col("said"))).cast("long").alias("sentences"))


@query("""WITH b AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'a <think>b</think> c <think>' || user_id WHEN 'click' THEN 'a <think>x' || chr(10) || '</think>' || user_id ELSE 'plain ' || user_id END AS buffer FROM events), c AS (SELECT event_id, regexp_replace(buffer, '(?s)<think>.*?</think>', '', 'g') AS clean FROM b)
 SELECT event_id, CASE WHEN contains(clean, '<think>') THEN trim(left(clean, length(clean) - strpos(reverse(clean), '>kniht<') - 6), ' ') ELSE clean END AS clean, contains(clean, '<think>') AS thinking FROM c""")
def strip_thinking(spark, d):
    user = F.col("user_id").cast("string")
    buffer = F.when(F.col("event_type") == "error", F.concat(F.lit("a <think>b</think> c <think>"), user)).when(F.col("event_type") == "click", F.concat(F.lit("a <think>x\n</think>"), user)).otherwise(F.concat(F.lit("plain "), user))
    clean, opened = compress.strip_thinking(buffer)
    return table(spark, d, "events").select("event_id", clean.alias("clean"), opened.alias("thinking"))


# -- ranking, further stages ----------------------------------------------------------------------

_FILES = "['notes/a.py', 'notes/b.JS', 'notes/c.md', 'src/d.rs', 'plain', 'x.tar.gz'][event_id % 6 + 1]"


@query(f"""WITH f AS (SELECT event_id, lower(regexp_extract({_FILES}, '(\\.[^./]+)$', 1)) AS ext FROM events), b AS (SELECT event_id, ext, ext IN ({_list(rank.CODE_FILES)}) AS code FROM f)
 SELECT event_id, CASE WHEN ext = '.py' THEN 2.10 WHEN code THEN 0.35 WHEN ext <> '' THEN 0.20 ELSE 1.0 END AS python, CASE WHEN ext = '.py' THEN 1.55 WHEN code THEN 1.08 WHEN ext <> '' THEN 0.72 ELSE 1.0 END AS code FROM b""")
def code_intent_boost(spark, d):
    path = F.element_at(F.array(*map(F.lit, ["notes/a.py", "notes/b.JS", "notes/c.md", "src/d.rs", "plain", "x.tar.gz"])), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", rank.code_boost(path, ["python"]).alias("python"), rank.code_boost(path, ["function", "x"]).alias("code"))


@query(f"""WITH {_ORDER_LINKS}, r AS (SELECT s_suppkey AS id, s_acctbal AS score FROM supplier), seeds AS (SELECT id FROM r ORDER BY score DESC, id LIMIT 5),
 one AS (SELECT target_id AS id, max(strength) AS strength FROM best JOIN seeds ON source_id = seeds.id GROUP BY 1), two AS (SELECT b.target_id AS id, max(round(one.strength * b.strength, 9)) AS strength FROM one JOIN best b ON b.source_id = one.id GROUP BY 1),
 m AS (SELECT id, min(hops) AS hops, arg_max(strength, (-hops, strength)) AS strength FROM (SELECT id, 1 AS hops, strength FROM one UNION ALL SELECT id, 2, strength FROM two) WHERE id NOT IN (SELECT id FROM seeds) GROUP BY id)
 SELECT r.id, m.hops::BIGINT AS hops, round(score * coalesce((1 + m.strength * pow(0.5, m.hops - 1)) * CASE WHEN r.id % 2 = 0 THEN 1.0 ELSE 1.3 END, 1.0), 4) AS score FROM r LEFT JOIN m ON r.id = m.id""")
def graph_distance_boost(spark, d):
    results = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("score"), (F.col("s_suppkey") % 2 == 0).alias("explored"))
    return rank.graph_distance(results, _order_links(spark, d)).select("id", F.col("hops").cast("long").alias("hops"), F.round("score", 4).alias("score"))


@query()
def ppr_blend(spark, d):
    results = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 10_000).alias("score"))
    mass = graph.pagerank(_order_links(spark, d), [1, 2, 3], sweeps=50, epsilon=1e-4).select(F.col("node").alias("id"), F.col("score").alias("mass"))
    return rank.ppr_blend(results, mass).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {_BM25} SELECT doc_id, round(bm25 * (1 + (contains(lower(text), 'tion')::INT + contains(lower(text), 'hein')::INT + contains(lower(text), 'zzz')::INT) / 3.0 * 1.3), 4) AS score FROM bm JOIN documents USING (doc_id)")
def topic_boosted(spark, d):
    docs = _docs(spark, d)
    found = rank.bm25(docs, QUERY_TERMS).join(docs.select("doc_id", "text"), "doc_id")
    return found.select("doc_id", F.round(assembly.topic_boost(F.col("bm25"), F.col("text"), ["tion", "HEIN", "zzz"]), 4).alias("score"))


@query(f"WITH {_BM25} SELECT doc_id, round(0.15 + 0.85 * pow(matched / 3.0, 1.5), 4) AS score FROM bm WHERE round(0.15 + 0.85 * pow(matched / 3.0, 1.5), 4) >= 0.3 ORDER BY score DESC, doc_id LIMIT 5")
def confident_top(spark, d):
    scored = rank.bm25(_docs(spark, d), QUERY_TERMS).select("doc_id", F.round(rank.coverage(F.col("matched"), len(QUERY_TERMS)), 4).alias("score"))
    return assembly.confident(scored, "score", "doc_id")


@query(f"""WITH {_BM25}, r AS (SELECT doc_id, round(bm25, 4) AS score FROM bm ORDER BY score DESC, doc_id LIMIT 20),
 o AS (SELECT doc_id FROM (SELECT doc_id, sum(weight) AS w FROM ann JOIN documents USING (doc_id) WHERE token IN ({_list(QUERY_TERMS)}) AND upper(lang) <> 'EN' GROUP BY doc_id) ORDER BY round(w, 9) DESC, doc_id LIMIT 5)
 SELECT coalesce(r.doc_id, o.doc_id) AS doc_id, coalesce(score, 0.5) AS score, o.doc_id IS NOT NULL AS cross_agent FROM r FULL JOIN o ON r.doc_id = o.doc_id""")
def cross_agent_inject(spark, d):
    docs = _docs(spark, d)
    results = rank.topk(rank.bm25(docs, QUERY_TERMS).select("doc_id", F.round("bm25", 4).alias("score")), "score", "doc_id", 20)
    return assembly.inject_others(results, index.keywords(docs), docs.select("doc_id", F.col("lang").alias("author")), QUERY_TERMS, "en")


_RAG = f"""WITH {_BM25}, t AS (SELECT doc_id, round(bm25, 4) AS score FROM bm WHERE round(bm25, 4) > 0.5 ORDER BY score DESC, doc_id LIMIT 4)
 SELECT coalesce(string_agg(substring('[' || source || '] ' || text, 1, 400), chr(10) || '---' || chr(10) ORDER BY score DESC, doc_id), '') AS context FROM t JOIN documents USING (doc_id)"""


@query(_RAG)
def rag_context(spark, d):
    docs = _docs(spark, d)
    found = rank.bm25(docs, QUERY_TERMS).select("doc_id", F.round("bm25", 4).alias("score")).join(docs.select("doc_id", "source", F.col("text").alias("summary")), "doc_id")
    return assembly.rag_context(found)


# -- what agents want -----------------------------------------------------------------------------

_PRIORS = f"""said AS (SELECT role AS agent, unnest(regexp_split_to_array(lower(CASE WHEN contains(text, '=') THEN regexp_replace(text, '(?s)^[^=]*=', '') ELSE text END), '\\s+')) AS keyword FROM (SELECT * FROM conversations ORDER BY conv_id DESC, turn DESC LIMIT 5000)),
 counted AS (SELECT agent, keyword, count(*) AS n FROM said WHERE length(keyword) >= 3 AND keyword NOT IN ({_list(assembly.TOPIC_STOPWORDS)}) GROUP BY ALL),
 priors AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY n DESC, keyword) AS rank FROM counted) WHERE rank <= 5)"""


def _priors(spark, d):
    return assembly.topic_priors(table(spark, d, "conversations"), agent="role", text="text", order=[F.desc("conv_id"), F.desc("turn")])


@query(f"WITH {_PRIORS} SELECT * FROM priors")
def topic_priors(spark, d):
    return _priors(spark, d)


_ASKED = ["with", "the", "that", "THIS", "zebra"]


@query(f"""WITH {_PRIORS}, a AS (SELECT agent, max(n) AS most FROM priors GROUP BY agent), k AS (SELECT unnest([{_list(_ASKED)}]) AS keyword, unnest(range(0, {len(_ASKED)})) AS pos),
 s AS (SELECT a.agent, k.keyword, pos, 1 - coalesce(p.n, 0) / greatest(most, 1) AS novelty FROM a, k LEFT JOIN priors p ON p.agent = a.agent AND p.keyword = lower(k.keyword)) SELECT agent, keyword, round(novelty, 6) AS novelty, row_number() OVER (PARTITION BY agent ORDER BY novelty DESC, pos) AS place FROM s""")
def novelty_order(spark, d):
    return assembly.novelty_order(_priors(spark, d), _ASKED).withColumn("novelty", F.round("novelty", 6))


@query(f"""WITH {_TOKENS}, l AS (SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS n FROM documents) WHERE n <= 5),
 b AS (SELECT source AS agent, token, round(max(weight), 4) AS weight FROM ann JOIN l USING (doc_id) WHERE token <> lower(source) GROUP BY ALL) SELECT agent, token, weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY weight DESC, token) AS rank FROM b) WHERE rank <= 15""")
def agent_keywords(spark, d):
    docs = _docs(spark, d)
    annotations = index.keywords(docs).withColumn("weight", F.round("weight", 4))
    return assembly.agent_keywords(annotations, docs.select(F.col("source").alias("agent"), "doc_id"), order=[F.desc("doc_id")])


@query(f"""WITH {_TOKENS}, x AS (SELECT source AS agent, token AS topic, doc_id AS place FROM ann JOIN documents USING (doc_id) WHERE rnk = 1 AND upper(source) <> 'SRC0'),
 o AS (SELECT topic, arg_min(agent, (place, agent)) AS from_agent, min(place) AS place FROM x GROUP BY topic ORDER BY 3, 2 LIMIT 5),
 h AS (SELECT topic, from_agent, place, doc_id, sum(weight) AS w FROM ann JOIN o ON token = topic GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(w, 9) DESC, doc_id) AS r FROM h),
 f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place, from_agent, r) AS f FROM r WHERE r <= 2) SELECT topic, from_agent, doc_id, r AS place FROM f WHERE f = 1 ORDER BY f.place, from_agent, r LIMIT 3""")
def cross_pollination(spark, d):
    # Written once: texts are cut into words a single time.
    annotations = materialize(index.keywords(_docs(spark, d)).select("doc_id", "token", "weight", "rank"), "keywords")
    topics = annotations.filter("rank = 1").join(table(spark, d, "documents").select("doc_id", F.col("source").alias("agent")), "doc_id").select("agent", F.col("token").alias("topic"), F.col("doc_id").alias("place"))
    return assembly.cross_pollinate(annotations, topics, "src0")


# -- context --------------------------------------------------------------------------------------

_SOURCES = ["research_a", "document", "session_log", "Synapse", "project_x", "bookmarks", "agent_communication", "toolbox", "memory_core", "other", "x_document"]
_BUCKET = ["facts", "facts", "reflections", "episodes", "episodes", "reflections", "episodes", "facts", "reflections", "facts", "facts"]
_STORY = ["fact", "episode", "session", "episode", "project", "reflection", "episode", "fact", "reflection", "fact", "episode"]


@query(f"SELECT p_partkey, [{_list(_BUCKET)}][p_partkey % 11 + 1] AS bucket, [{_list(_STORY)}][p_partkey % 11 + 1] AS story FROM part")
def classify_sources(spark, d):
    source = F.element_at(F.array(*map(F.lit, _SOURCES)), (F.col("p_partkey") % 11 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", assembly.classify_source(source).alias("bucket"), assembly.story_type(source).alias("story"))


@query(f"""WITH r AS (SELECT c_custkey AS node, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer QUALIFY rank <= 80),
 f AS (SELECT node, o_orderkey AS key, rank, row_number() OVER (PARTITION BY node ORDER BY o_orderdate DESC, o_orderkey) AS own FROM r JOIN orders ON o_custkey = node), g AS (SELECT *, row_number() OVER (ORDER BY rank, own) AS place FROM f WHERE own <= 8),
 x AS (SELECT node, o_orderkey * 10 + l_linenumber AS key, rank, row_number() OVER (PARTITION BY node ORDER BY l_shipdate DESC, o_orderkey * 10 + l_linenumber) AS own FROM r JOIN orders ON o_custkey = node JOIN (SELECT DISTINCT l_orderkey, l_linenumber, max(l_shipdate) OVER (PARTITION BY l_orderkey, l_linenumber) AS l_shipdate FROM lineitem) ON l_orderkey = o_orderkey),
 y AS (SELECT *, row_number() OVER (ORDER BY rank, own) AS place FROM x WHERE own <= 3)
 SELECT 'fact' AS kind, node, key, place FROM g WHERE place <= 60 UNION ALL SELECT 'reflection', node, key, place FROM y WHERE place <= 20 UNION ALL SELECT 'episode', node, node, rank FROM r""")
def gather_context(spark, d):
    customers, orders = table(spark, d, "customer"), table(spark, d, "orders")
    top = customers.orderBy(F.desc("c_acctbal"), "c_custkey").limit(assembly.EPISODES).select(F.col("c_custkey").alias("node"), "c_acctbal")
    from pyspark.sql import Window

    ranked = top.select("node", F.row_number().over(Window.orderBy(F.desc("c_acctbal"), "node")).alias("rank"))  # eighty rows
    facts = orders.select(F.col("o_custkey").alias("node"), F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("at"))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_shipdate").alias("at"))
    reflections = lines.join(facts.select("node", F.col("key").alias("l_orderkey")), "l_orderkey").select("node", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), "at")
    return assembly.gather(ranked, facts, reflections)


_ITEMS = "i AS (SELECT event_id, 'file:' || (event_id % 40) AS source, CASE event_id % 3 WHEN 0 THEN 'fact' WHEN 1 THEN 'reflection' ELSE 'episode' END AS type, CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts END AS created_at, event_id AS position, CASE WHEN event_id % 10 < 4 THEN 'full' WHEN event_id % 10 < 7 THEN 'truncated' ELSE 'mention' END AS tier FROM (SELECT * FROM events ORDER BY event_id LIMIT 100))"


def _items(spark, d):
    """A context of a hundred items, as its assembly caps it."""
    e = F.col("event_id")
    rows = table(spark, d, "events").orderBy("event_id").limit(100)
    kind = F.when(e % 3 == 0, "fact").when(e % 3 == 1, "reflection").otherwise("episode")
    tier = F.when(e % 10 < 4, "full").when(e % 10 < 7, "truncated").otherwise("mention")
    return rows.select("event_id", F.concat(F.lit("file:"), e % 40).alias("source"), kind.alias("type"), F.when(e % 5 != 0, F.col("ts")).alias("created_at"), e.alias("position"), tier.alias("tier"))


@query(f"WITH {_ITEMS}, c AS (SELECT 'file:' || k AS source, 100 - k AS step FROM range(0, 20) t(k)), o AS (SELECT event_id, CASE WHEN type = 'episode' THEN c.step END AS step, created_at, position FROM i LEFT JOIN c ON c.source = i.source), g AS (SELECT *, CASE WHEN step IS NOT NULL THEN 0 WHEN created_at IS NOT NULL THEN 1 ELSE 2 END AS grp FROM o) SELECT event_id, row_number() OVER (ORDER BY grp, CASE WHEN grp = 0 THEN step END, CASE WHEN grp = 1 THEN -epoch_us(created_at) END, position) AS spot FROM g")
def chronological_items(spark, d):
    chain = spark.range(20).select(F.concat(F.lit("file:"), "id").alias("source"), (100 - F.col("id")).alias("step"))
    return assembly.chronological(_items(spark, d), chain).select("event_id", "spot")


@query(f"""WITH {_ITEMS}, c AS (SELECT *, sum((tier = 'full' AND type = 'fact')::INT) OVER w AS f, sum((tier = 'full' AND type = 'reflection')::INT) OVER w AS r FROM i WINDOW w AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING))
 SELECT event_id, tier IN ('full', 'truncated') AS detailed, tier = 'full' AND CASE type WHEN 'fact' THEN f <= 5 WHEN 'reflection' THEN r <= 2 ELSE least(f, 5) + least(r, 2) < 7 END AS quick FROM c""")
def disclosure_layers(spark, d):
    return assembly.layers(_items(spark, d), order=["event_id"]).select("event_id", "detailed", "quick")


_SUMMARIES = "s AS (SELECT event_id AS id, CASE event_type WHEN 'purchase' THEN 'agent_handoff' WHEN 'click' THEN 'x/SESSION_LOG_1' WHEN 'view' THEN 'synapse' ELSE 'other' END AS source, 'by user_' || user_id || '.' AS content, ts AS created_at, strftime(ts + INTERVAL 1 DAY * (event_id % 3), '%Y-%m-%d') AS effective FROM events)"
_TIER_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS tier, id, effective, place FROM (SELECT *, row_number() OVER (ORDER BY effective DESC, created_at DESC, id DESC) AS place FROM (SELECT * FROM s WHERE contains(lower(source), '{p}') AND {'NOT ' if t == 'team' else ''}contains(lower(content), 'user_3.') ORDER BY created_at DESC, id DESC LIMIT 20){f" WHERE effective >= strftime(TIMESTAMP '{AS_OF}' - INTERVAL 48 HOUR, '%Y-%m-%d')" if t == 'team' else ''}) WHERE place <= {assembly.SESSION_TIERS[t]}"
    for t, p in (("handoff", "agent_handoff"), ("session", "session_log"), ("message", "synapse"), ("team", "agent_handoff")))


@query(f"WITH {_SUMMARIES} {_TIER_SQL}")
def session_start(spark, d):
    kind = F.col("event_type")
    source = F.when(kind == "purchase", "agent_handoff").when(kind == "click", "x/SESSION_LOG_1").when(kind == "view", "synapse").otherwise("other")
    effective = F.date_format(F.date_add("ts", (F.col("event_id") % 3).cast("int")), "yyyy-MM-dd")
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), source.alias("source"), F.concat(F.lit("by user_"), "user_id", F.lit(".")).alias("content"), F.col("ts").alias("created_at"), effective.alias("effective"))
    return assembly.session_start(rows, "user_3.", _as_of())


@query(f"WITH {_TOKENS}, r AS (SELECT doc_id FROM documents ORDER BY doc_id DESC LIMIT 20) SELECT doc_id, coalesce((SELECT string_agg(token || '=' || round(weight, 2), ',' ORDER BY weight DESC, token) FROM ann WHERE ann.doc_id = r.doc_id), '') AS annotations FROM r")
def recent_with_annotations(spark, d):
    docs = _docs(spark, d)
    recent = docs.orderBy(F.desc("doc_id")).limit(20).select("doc_id", "text")
    listed = index.keywords(recent).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "token"))).alias("l"))
    shown = F.array_join(F.transform("l", lambda x: F.concat(x["token"], F.lit("="), F.round(-x["w"], 2).cast("string"))), ",")
    return recent.join(listed, "doc_id", "left").select("doc_id", F.coalesce(shown, F.lit("")).alias("annotations"))


# -- links and the knowledge graph ----------------------------------------------------------------

@query("""WITH p AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'C:/misc/' || source ELSE 'C:/PROJECTS/' || lang || '/' || source END AS project, lang FROM documents)
 SELECT doc_id, 'same_project' AS link_type, project AS class, n_links, 0.7 AS strength FROM (SELECT *, count(*) OVER (PARTITION BY project) - 1 AS n_links FROM p WHERE doc_id % 5 <> 0) WHERE n_links > 0
 UNION ALL SELECT doc_id, 'same_author', lang, n_links, 0.5 FROM (SELECT *, count(*) OVER (PARTITION BY lang) - 1 AS n_links FROM p) WHERE n_links > 0""")
def peer_links(spark, d):
    docs = _docs(spark, d)
    path = F.concat(F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("C:\\misc\\"), "source")).otherwise(F.concat(F.lit("C:\\PROJECTS\\"), "lang", F.lit("\\"), "source")), F.lit("\\doc.txt"))
    return links.peers(docs, "same_project", links.project_path(path)).unionByName(links.peers(docs, "same_author", F.col("lang")))


@query("SELECT event_id AS key, n_links, 0.4 AS strength FROM (SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 5 MINUTE PRECEDING AND INTERVAL 5 MINUTE FOLLOWING) - 1 AS n_links FROM events) WHERE n_links > 0")
def session_adjacent(spark, d):
    return links.session_adjacent(table(spark, d, "events"), key="event_id", agent="event_type", at="ts")


@query("""WITH f AS (SELECT s_suppkey AS target_id, 'note_file-' || s_suppkey AS stem FROM supplier ORDER BY s_suppkey DESC LIMIT 200), n AS (SELECT target_id, unnest([stem || '.md', replace(stem, '_', ' '), replace(stem, '-', ' ')]) AS name FROM f),
 t AS (SELECT event_id AS source_id, CASE event_id % 3 WHEN 0 THEN 'See Note_File-' || user_id || '.md now' WHEN 1 THEN 'the note_file ' || user_id || ' says' ELSE 'note file-' || user_id || 'x' END AS text FROM events)
 SELECT DISTINCT source_id, target_id, 0.8 AS strength FROM t JOIN n ON regexp_matches(lower(text), '\\b' || replace(name, '.', '\\.') || '\\b') AND source_id <> target_id""")
def referenced_files(spark, d):
    e, u = F.col("event_id"), F.col("user_id").cast("string")
    text = F.when(e % 3 == 0, F.concat(F.lit("See Note_File-"), u, F.lit(".md now"))).when(e % 3 == 1, F.concat(F.lit("the note_file "), u, F.lit(" says"))).otherwise(F.concat(F.lit("note file-"), u, F.lit("x")))
    files = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("C:\\notes\\note_file-"), "s_suppkey", F.lit(".md")).alias("path"))
    return links.referenced(table(spark, d, "events").select("event_id", text.alias("text")), files, key="event_id", text="text", file_key="s_suppkey", path="path")


@query("SELECT user_id AS source_id, event_id % 50 AS target_id, max(greatest(0.0, least(1.0, value / 50 - 0.2))) AS strength FROM events WHERE user_id IN (SELECT s_suppkey FROM supplier) AND event_id % 50 IN (SELECT s_suppkey FROM supplier) GROUP BY ALL")
def curator_links(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("source_id"), (F.col("event_id") % 50).alias("target_id"), (F.col("value") / 50 - 0.2).alias("strength"))
    return links.curator_links(rows, table(spark, d, "supplier").select(F.col("s_suppkey").alias("doc_id")))


@query(f"WITH {_ANNOTATE}, known AS (SELECT doc_id, token FROM annotated WHERE step = 3) SELECT doc_id, token, round(weight, 4) AS weight FROM ann WHERE rnk <= 25 AND NOT EXISTS (SELECT 1 FROM known k WHERE k.doc_id = ann.doc_id AND k.token = ann.token)")
def merge_annotations(spark, d):
    docs = _docs(spark, d)
    return links.merge_annotations(index.annotate(docs, author="lang").filter("step = 3"), index.keywords(docs)).select("doc_id", "token", F.round("weight", 4).alias("weight"))


@query("SELECT event_id FROM events LEFT JOIN customer ON c_custkey = (props->>'k')::BIGINT AND event_id % 4 <> 0 WHERE (event_id % 4 = 0 AND event_id % 8 = 0) OR (event_id % 4 <> 0 AND c_mktsegment = 'BUILDING')")
def domain_filtered(spark, d):
    """Metadata name the domain in every fourth row, else the file; even ones of those are of the domain asked for."""
    e = F.col("event_id")
    own = F.to_json(F.struct(F.when(e % 8 == 0, "Building").otherwise("other").alias("domain")))
    path = F.to_json(F.struct(F.get_json_object("props", "$.k").alias("filepath")))
    nodes = table(spark, d, "customer").select(F.concat(F.lit("file:"), "c_custkey").alias("id"), F.col("c_mktsegment").alias("domain"))
    return links.domain_filter(table(spark, d, "events").select("event_id", F.when(e % 4 == 0, own).otherwise(path).alias("metadata")), nodes, "building").select("event_id")


def _kg(spark, d):
    """Files are brands, their children parts; a third of the parts have no edge, and parts are linked to the next part."""
    part = table(spark, d, "part")
    child = F.concat(F.lit("part:"), F.regexp_replace("p_brand", "#", ""), F.lit(":"), "p_partkey")
    files = part.select(F.concat(F.lit("file:"), "p_brand").alias("id"), F.concat(F.regexp_replace("p_brand", "#", ""), F.lit(".txt")).alias("name"), F.lit("file").alias("type"), F.lit("").alias("summary")).distinct()
    nodes = files.unionByName(part.select(child.alias("id"), F.col("p_name").alias("name"), F.lower("p_type").alias("type"), F.col("p_brand").alias("summary")))
    edges = part.filter("p_partkey % 3 <> 0").select(F.concat(F.lit("file:"), "p_brand").alias("source_id"), child.alias("target_id"), F.lit("contains").alias("type"))
    return nodes, edges.unionByName(part.select(child.alias("source_id"), F.concat(F.lit("part:?:"), F.col("p_partkey") + 1).alias("target_id"), F.lit("next").alias("type")))


_KG = """files AS (SELECT DISTINCT 'file:' || p_brand AS id, replace(p_brand, '#', '') || '.txt' AS name, 'file' AS type, '' AS summary FROM part),
 parts AS (SELECT p_partkey, p_brand, 'part:' || replace(p_brand, '#', '') || ':' || p_partkey AS id, p_name AS name, lower(p_type) AS type, p_brand AS summary FROM part),
 nodes AS (SELECT * FROM files UNION ALL SELECT id, name, type, summary FROM parts),
 edges AS (SELECT 'file:' || p_brand AS source_id, id AS target_id, 'contains' AS type FROM parts WHERE p_partkey % 3 <> 0 UNION ALL SELECT id, 'part:?:' || (p_partkey + 1), 'next' FROM parts)"""


@query(f"""WITH {_KG}, m AS (SELECT id AS file_id, id FROM files UNION SELECT source_id, target_id FROM edges WHERE type = 'contains'),
 t AS (SELECT file_id, count(DISTINCT (source_id, target_id, e.type)) AS edges FROM m JOIN edges e ON m.id IN (e.source_id, e.target_id) GROUP BY file_id)
 SELECT m.file_id, n.type, count(*) AS children, any_value(t.edges) AS edges FROM m JOIN nodes n ON n.id = m.id JOIN t ON t.file_id = m.file_id WHERE m.id <> m.file_id GROUP BY m.file_id, n.type""")
def file_children(spark, d):
    return links.file_children(*_kg(spark, d))


@query(f"""WITH {_KG}, h AS (SELECT * FROM nodes WHERE list_has_any(list_filter(regexp_split_to_array(lower(concat_ws(' ', id, name, summary)), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''), ['ring', 'brand7']) ORDER BY id LIMIT 200)
 SELECT id, type, CASE WHEN type = 'file' THEN id ELSE coalesce((SELECT min(source_id) FROM edges e WHERE e.target_id = h.id AND e.type = 'contains'), (SELECT min(f.id) FROM files f WHERE f.name LIKE split_part(h.id, ':', 2) || '.%')) END AS parent FROM h""")
def node_search(spark, d):
    return links.node_search(*_kg(spark, d), "Ring  brand7", most=200)


@query(f"WITH {_KG}, t AS (SELECT id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(concat_ws(' ', id, name, summary)), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''))) AS token FROM nodes) SELECT token, count(*) AS nodes FROM t GROUP BY token")
def node_postings(spark, d):
    return links.postings(_kg(spark, d)[0]).groupBy("token").agg(F.count(F.lit(1)).alias("nodes"))


@query(f"WITH {_ORDER_LINKS}, r AS (SELECT source_id AS node, target_id AS neighbor, strength, row_number() OVER (PARTITION BY source_id ORDER BY strength DESC, target_id) AS rank FROM best WHERE source_id IN (1, 2, 100007)) SELECT node, neighbor, round(strength, 4) AS strength, rank FROM r WHERE rank <= 50")
def one_hop(spark, d):
    nodes = spark.createDataFrame([(1,), (2,), (100007,)], "node long")
    return links.expand(_order_links(spark, d), nodes).withColumn("strength", F.round("strength", 4))


@query(f"""WITH {_BM25}, r AS (SELECT doc_id, source AS agent, round(bm25, 4) AS score FROM bm JOIN documents USING (doc_id) ORDER BY round(bm25, 4) DESC, doc_id LIMIT 10)
 SELECT 'result' AS kind, 'query' AS source, 'doc:' || doc_id AS target, score AS weight FROM r UNION ALL SELECT 'agent', 'doc:' || doc_id, 'agent:' || agent, 1.0 FROM r
 UNION ALL SELECT 'keyword', 'doc:' || doc_id, 'keyword:' || token, round(weight, 4) FROM (SELECT doc_id, token, weight, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, token) AS k FROM ann WHERE doc_id IN (SELECT doc_id FROM r)) WHERE k <= 5""")
def story_graph(spark, d):
    docs = _docs(spark, d)
    top = rank.topk(rank.bm25(docs, QUERY_TERMS).select("doc_id", F.round("bm25", 4).alias("score")).join(docs.select("doc_id", F.col("source").alias("agent")), "doc_id"), "score", "doc_id", 10)
    return links.story_graph(top, index.keywords(docs)).withColumn("weight", F.round("weight", 4))


# -- statistics and catalogue ---------------------------------------------------------------------

@query("SELECT CASE WHEN grouping(event_type) = 0 THEN 'scope' ELSE 'owner' END AS level, coalesce(event_type, user_id::VARCHAR) AS name, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY GROUPING SETS ((event_type), (user_id))")
def memory_stats(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("scope"), F.col("user_id").cast("string").alias("owner"), "value")
    return aggregates.by_each(rows, ["scope", "owner"], F.round(F.sum("value"), 4).alias("total"))


@query("SELECT CASE WHEN grouping(source) = 0 THEN 'source' ELSE 'category' END AS level, coalesce(source, lang) AS name, count(*) AS n, round(avg(least(n_chars, 1000) / 1000), 4) AS confidence FROM documents GROUP BY GROUPING SETS ((source), (lang))")
def knowledge_stats(spark, d):
    rows = table(spark, d, "documents").select("source", F.col("lang").alias("category"), (F.least("n_chars", F.lit(1000)) / 1000).alias("c"))
    return aggregates.by_each(rows, ["source", "category"], F.round(F.avg("c"), 4).alias("confidence"))


@query("SELECT event_type AS tool, count(*) AS calls, count(*) FILTER (value < 10) AS failures, round(sum(value), 4) AS total_ms FROM events GROUP BY event_type")
def tool_usage(spark, d):
    return aggregates.tool_usage(table(spark, d, "events").select(F.col("event_type").alias("tool"), (F.col("value") >= 10).alias("ok"), F.col("value").alias("ms"))).withColumn("total_ms", F.round("total_ms", 4))


@query("SELECT user_id AS session, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS messages FROM events GROUP BY user_id")
def visitors(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("session")).agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("messages"))


@query(f"WITH e AS ({ORACLES['echo_jaccard']}) SELECT role AS agent, count(*) AS n, round(max(similarity), 4) AS worst FROM e JOIN conversations c ON c.conv_id = e.conv_id AND c.turn = e.turn WHERE is_echo GROUP BY role")
def echo_violations(spark, d):
    found = conversation.echoes(table(spark, d, "conversations"), ["conv_id"], ["turn"]).filter("is_echo")
    return found.groupBy(F.col("role").alias("agent")).agg(F.count(F.lit(1)).alias("n"), F.round(F.max("similarity"), 4).alias("worst"))


@query("SELECT user_id, array_to_string(list(event_type || '=' || n ORDER BY event_type), ',') AS signals FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def signal_map(spark, d):
    return aggregates.count_map(table(spark, d, "events"), "user_id", "event_type").select(F.col("key").alias("user_id"), F.array_join(F.transform(F.array_sort(F.map_entries("counts")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("signals"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows, (SELECT count(*) FROM (DESCRIBE {t})) AS columns FROM {t}" for t in tables.TABLES))
def catalog_list(spark, d):
    return sync.catalog({t: table(spark, d, t) for t in tables.TABLES})


@query("SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def raw_sql(spark, d):
    return sync.run_sql(spark, {t: table(spark, d, t) for t in ("nation", "region")}, "SELECT r_name, count(*) AS n FROM {nation} JOIN {region} ON n_regionkey = r_regionkey GROUP BY r_name")


@query(f"SELECT event_id FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 10 DAY ORDER BY ts DESC, event_id DESC LIMIT 1000")
def hot_tier(spark, d):
    return relational.hot(table(spark, d, "events"), _as_of(), at="ts", key="event_id", days=10, most=1000).select("event_id")


@query(f"SELECT o_orderkey, CASE WHEN o_orderdate <= TIMESTAMP '1997-06-01' AND (o_orderkey % 3 = 0 OR epoch(TIMESTAMP '1997-06-01') - epoch(o_orderdate) >= 86400 * (o_orderkey % 700)) THEN true ELSE false END AS due FROM orders")
def reminders_due(spark, d):
    """Reminders due on a day: never shown before (every third), or last shown at their date at least their interval ago."""
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("due_at"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate")).alias("shown_at"), (F.col("o_orderkey") % 700).alias("days"))
    return rows.select("o_orderkey", relational.resurfaces(F.lit("1997-06-01").cast("timestamp"), F.col("due_at"), F.col("shown_at"), F.col("days")).alias("due"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '' ELSE upper('ab' || user_id) END AS author FROM events")
def detect_author(spark, d):
    path = F.when(F.col("event_id") % 4 == 0, F.lit("C:\\x\\notes.txt")).otherwise(F.concat(F.lit("C:\\x\\ab"), "user_id", F.lit("_notes_1.txt")))
    return table(spark, d, "events").select("event_id", tables.author(path).alias("author"))


# -- conversations, further -----------------------------------------------------------------------

@query("SELECT conv_id, turn, count(*) OVER w AS messages, sum(length(text)) OVER w::BIGINT AS chars, count(*) OVER (PARTITION BY conv_id, role ORDER BY turn ROWS UNBOUNDED PRECEDING) AS by_sender FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)".replace("sum(length(text)) OVER w::BIGINT", "(sum(length(text)) OVER w)::BIGINT"))
def running_history(spark, d):
    return conversation.history(table(spark, d, "conversations"), ["conv_id"], "turn", sender="role", text="text").select("conv_id", "turn", "messages", "chars", "by_sender")


@query("SELECT DISTINCT conv_id FROM conversations WHERE contains(lower(text), 'ther') UNION SELECT DISTINCT conv_id FROM conversations WHERE role = 'system'")
def threads_about(spark, d):
    rows = table(spark, d, "conversations")
    return conversation.threads_about(rows, thread="conv_id", sender="role", text="text", topic="THER", participant="System").select("conv_id")


@query(f"""WITH {_MENTION}, t AS (SELECT key, 'message' AS kind, sender AS agent, left(text, 20) AS detail FROM m UNION ALL SELECT key, 'mention', mentioner, mentioned FROM x UNION ALL SELECT key, 'vote', sender, regexp_extract(lower(text), 'i\\s+vote\\s+(?:for\\s+)?(\\w+)', 1) FROM m) SELECT * FROM t""")
def timeline(spark, d):
    return conversation.timeline(_messages(spark, d), key="key", sender="sender", text="text")


@query(f"WITH {_MENTION}, a AS (SELECT sender AS agent, count(*) AS messages, count(*) AS votes FROM m GROUP BY sender), b AS (SELECT mentioner AS agent, count(*) AS made FROM x GROUP BY 1), c AS (SELECT mentioned AS agent, count(*) AS received FROM x GROUP BY 1) SELECT a.agent, messages, votes, coalesce(made, 0) AS made, coalesce(received, 0) AS received FROM a LEFT JOIN b ON a.agent = b.agent LEFT JOIN c ON a.agent = c.agent")
def agent_contexts(spark, d):
    return conversation.agent_contexts(_messages(spark, d), key="key", sender="sender", text="text")


_CLAIMED = "c AS (SELECT event_id AS key, ['mention', 'vote_count', 'vote_target', 'presence', 'response'][event_id % 5 + 1] AS kind, 'user_' || (user_id % 30) AS subject, event_type AS target, (event_id % 30)::BIGINT AS number, event_id % 2 = 0 AS says FROM events)"


@query(f"""WITH {_MENTION}, {_CLAIMED}, v AS (SELECT sender AS voter, arg_max(regexp_extract(lower(text), 'i\\s+vote\\s+(?:for\\s+)?(\\w+)', 1), key) AS choice FROM m GROUP BY 1),
 f AS (SELECT c.*, v.choice, EXISTS (SELECT 1 FROM x WHERE x.mentioned = subject) AS mentioned, EXISTS (SELECT 1 FROM m WHERE m.sender = subject) AS present, (SELECT count(*) FROM v) AS votes FROM c LEFT JOIN v ON v.voter = subject)
 SELECT key, kind, CASE kind WHEN 'mention' THEN says = mentioned WHEN 'vote_count' THEN number = votes WHEN 'vote_target' THEN coalesce(choice = target, false) ELSE says = present END AS verified,
 CASE WHEN CASE kind WHEN 'mention' THEN says = mentioned WHEN 'vote_count' THEN number = votes WHEN 'vote_target' THEN coalesce(choice = target, false) ELSE says = present END THEN 'INFO'
  WHEN kind = 'mention' THEN CASE WHEN mentioned THEN 'CRITICAL' ELSE 'WARNING' END WHEN kind = 'vote_count' THEN CASE WHEN abs(number - votes) > 1 THEN 'CRITICAL' ELSE 'ERROR' END WHEN kind = 'vote_target' THEN CASE WHEN choice IS NULL THEN 'WARNING' ELSE 'ERROR' END ELSE 'WARNING' END AS severity FROM f""")
def verify_claims(spark, d):
    e = F.col("event_id")
    claims = table(spark, d, "events").select(e.alias("key"), F.element_at(F.array(*map(F.lit, ["mention", "vote_count", "vote_target", "presence", "response"])), (e % 5 + 1).cast("int")).alias("kind"), F.concat(F.lit("user_"), F.col("user_id") % 30).alias("subject"), F.col("event_type").alias("target"), (e % 30).alias("number"), (e % 2 == 0).alias("says"))
    return conversation.verify(claims, _messages(spark, d), key="key", sender="sender", text="text").select("key", "kind", "verified", "severity")


# -- the stored index -----------------------------------------------------------------------------

def _stored(spark, d):
    """An index of the documents that was built from another state of them and then brought up to date twice."""
    from uuid import uuid4

    from ..operators.stored import StoredIndex
    from ..scratch import scratch_path

    docs = table(spark, d, "documents")
    kept = StoredIndex(spark, f"stored_{uuid4().hex}", scratch_path(spark, "stored"))
    kept.merge(docs.filter("doc_id % 3 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" ther"))).otherwise(F.col("text"))))
    kept.merge(docs.filter("doc_id % 5 = 0"), docs.filter("doc_id % 7 = 0").select("doc_id"))
    kept.sync(docs)
    return kept


@query(f"WITH {_BM25} SELECT doc_id, round(bm25, 4) AS bm25, matched, length::BIGINT AS length FROM bm")
def stored_bm25(spark, d):
    return _stored(spark, d).bm25(QUERY_TERMS).select("doc_id", F.round("bm25", 4).alias("bm25"), "matched", "length")


@query("SELECT doc_id, source, length(text) AS chars, sha256(text) AS hash FROM documents")
def stored_entries(spark, d):
    return _stored(spark, d).table("entries").select("doc_id", "source", "chars", "hash")


# -- machines that fold a key's rows --------------------------------------------------------------

@query("""WITH e AS (SELECT event_type AS topic, epoch_us(ts) AS t, value AS w FROM events), k AS (SELECT unnest(range(min(t) // 86400000000, max(t) // 86400000000 + 10)) AS k FROM e)
 SELECT topic, make_timestamp(k * 86400000000) AS as_of, round(sum(w * exp(-(k * 86400000000 - t) / 3.6e9 / 24)), 4) AS heat FROM e, k WHERE k * 86400000000 - t BETWEEN 0 AND 168 * 3600000000 GROUP BY ALL""")
def heat_series(spark, d):
    found = state.heat_series(table(spark, d, "events"), topic="event_type", at="ts", weight="value")
    return found.select("topic", F.col("as_of").cast("timestamp_ntz").alias("as_of"), F.round("heat", 4).alias("heat"))


@query()
def heat_by_event(spark, d):
    return state.heat(table(spark, d, "events"), topic="event_type", at="ts", weight="value")


@query()
def sentence_buffer(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.timestamp_seconds("turn").alias("at"), F.concat(F.coalesce("text", F.lit("")), F.lit(" ")).alias("piece"))
    return state.sentences(turns, key="conv_id", at="at", text="piece", order="turn")


@query()
def disclosure_sessions(spark, d):
    said = F.create_map(*map(F.lit, ["signup", "start", "click", "explore", "view", "ignore", "error", "reject", "purchase", "explore"]))
    rows = table(spark, d, "events").select("user_id", "ts", "event_id", said[F.col("event_type")].alias("response"))
    return state.disclosure(rows, session="user_id", at="ts", summary="event_id", response="response")


@query()
def file_gate(spark, d):
    return state.file_gate(table(spark, d, "events").select(F.concat(F.lit("notes/"), "user_id", F.lit(".md")).alias("path"), F.col("ts").alias("at"), F.col("event_type").alias("hash")))


# -- one search -----------------------------------------------------------------------------------

_SOUGHT = [*QUERY_TERMS, "latest", "code"]
_PATH = "['notes/a.py', 'b.js', 'c.md', 'plain'][doc_id % 4 + 1]"
_SEARCH = f"""{_TOKENS}, q(t) AS (VALUES {', '.join(f"('{t}')" for t in _SOUGHT)}),
 docs AS (SELECT count(*)::DOUBLE AS docs FROM documents), sizes AS (SELECT doc_id, count(*) AS n FROM ann GROUP BY 1), mean AS (SELECT avg(n) AS avg_n FROM sizes),
 hit AS (SELECT doc_id, token, weight FROM ann WHERE token IN (SELECT t FROM q)), dfs AS (SELECT token, count(*) AS df FROM hit GROUP BY 1),
 warm AS (SELECT ['ther', 'eran', 'anhe', 'zzz'][event_id % 4 + 1] AS topic, round(sum(value * exp(-{{age}} / 24.0)), 3) AS heat FROM events WHERE event_id % 3 <> 1 AND {{age}} BETWEEN 0 AND 168 GROUP BY 1),
 hot AS (SELECT greatest(max(heat), 0) AS most FROM warm WHERE topic IN (SELECT t FROM q)),
 base AS (SELECT h.doc_id, sum(weight) AS total, count(*) AS matched, any_value(n) AS n, sum(ln((docs - df + 0.5) / (df + 0.5) + 1) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * n / avg_n))) AS lexical, sum(coalesce(heat, 0)) AS held
   FROM hit h JOIN sizes USING (doc_id) JOIN dfs USING (token) LEFT JOIN warm ON topic = token, docs, mean GROUP BY h.doc_id),
 lex AS (SELECT doc_id, round(total, 9) AS total, (0.6 * ln(1 + total) * (0.15 + 0.85 * pow(matched / 5.0, 1.5)) * CASE WHEN most > 0 THEN 1 + 0.5 * least(held / most, 1) ELSE 1 END + 0.4 * lexical) / (1 + ln(n)) / (1 + 0.15 * ln(greatest(length(text), 1))) AS s
   FROM base JOIN documents USING (doc_id), hot),
 links AS (SELECT DISTINCT l_suppkey AS source_id, l_partkey % 500 AS target_id, 0.3 + 0.1 * (l_partkey % 7) AS strength FROM lineitem), best AS (SELECT source_id, target_id, max(strength) AS strength FROM links GROUP BY ALL),
 seeds AS (SELECT doc_id AS id FROM lex ORDER BY total DESC, doc_id LIMIT 5), one AS (SELECT target_id AS id, max(strength) AS strength FROM best JOIN seeds ON source_id = seeds.id GROUP BY 1),
 two AS (SELECT b.target_id AS id, max(round(one.strength * b.strength, 9)) AS strength FROM one JOIN best b ON b.source_id = one.id GROUP BY 1),
 near AS (SELECT id, min(hops) AS hops, arg_max(strength, (-hops, strength)) AS strength FROM (SELECT id, 1 AS hops, strength FROM one UNION ALL SELECT id, 2, strength FROM two) WHERE id NOT IN (SELECT id FROM seeds) GROUP BY id),
 sel AS (SELECT user_id AS doc_id, 1 + 0.3 * ln(1 + sum(CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'click' THEN 0.5 ELSE 0.3 END)) AS boost FROM events GROUP BY 1),
 rej AS (SELECT user_id AS doc_id, greatest(0.2, 1 - sum(0.1 * exp(-({{age}} / 24) / 60.0))) AS penalty FROM events WHERE event_type = 'error' AND {{age}} / 24 BETWEEN 0 AND 180 GROUP BY 1),
 r AS (SELECT lex.doc_id, round(s * coalesce((1 + strength * pow(0.5, hops - 1)) * CASE WHEN lex.doc_id % 2 = 0 THEN 1.0 ELSE 1.3 END, 1) * (1 + pow(2.0, -((lex.doc_id % 500) / 1.0) / 48)) * coalesce(boost, 1) * coalesce(penalty, 1)
   * CASE WHEN contains(source, 'research') THEN 1.15 ELSE 1 END * CASE lex.doc_id % 4 WHEN 0 THEN 1.55 WHEN 1 THEN 1.08 WHEN 2 THEN 0.72 ELSE 1 END, 9) AS score
   FROM lex JOIN documents USING (doc_id) LEFT JOIN near ON near.id = lex.doc_id LEFT JOIN sel USING (doc_id) LEFT JOIN rej USING (doc_id)),
 other AS (SELECT doc_id FROM hit JOIN documents USING (doc_id) WHERE lang <> 'en' AND trim(lang) <> '' GROUP BY doc_id ORDER BY round(sum(weight), 9) DESC, doc_id LIMIT 5)""".replace("{age}", f"((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts)) / 3.6e9)")


@query(f"WITH {_SEARCH} SELECT coalesce(r.doc_id, o.doc_id) AS doc_id, round(coalesce(score, 0.5), 6) AS score, o.doc_id IS NOT NULL AS cross_agent FROM r FULL JOIN other o ON r.doc_id = o.doc_id")
def ranked_search(spark, d):
    """Every match through all stages: heat, selections and rejections are made of events, links of lines, and times, paths and authors of the documents' columns."""
    docs, events = _docs(spark, d), table(spark, d, "events")
    facts = docs.select("doc_id", "source", F.length("text").alias("chars"), F.element_at(F.array(*map(F.lit, ["notes/a.py", "b.js", "c.md", "plain"])), (F.col("doc_id") % 4 + 1).cast("int")).alias("path"),
                        (_as_of() - F.make_interval(hours=(F.col("doc_id") % 500).cast("int"))).alias("at"), F.col("lang").alias("author"))
    topic = F.element_at(F.array(*map(F.lit, ["ther", "eran", "anhe", "zzz"])), (F.col("event_id") % 4 + 1).cast("int"))
    heat = events.select(topic.alias("topic"), F.element_at(F.array(*map(F.lit, ["*", "someone", "en"])), (F.col("event_id") % 3 + 1).cast("int")).alias("agent"), F.col("value").alias("weight"), F.col("ts").alias("at"))
    signal = F.element_at(F.create_map(*map(F.lit, ["purchase", "user_selected", "click", "curator_suggested", "view", "ranking_promoted", "error", "odd", "signup", "odd"])), F.col("event_type"))
    links = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source_id"), (F.col("l_partkey") % 500).alias("target_id"), (0.3 + 0.1 * (F.col("l_partkey") % 7)).alias("strength")).groupBy("source_id", "target_id").agg(F.max("strength").alias("strength"))
    corpus = search.Corpus(
        index.keywords(docs).select("doc_id", "token", "weight"), facts, heat=heat, selections=events.select(F.col("user_id").alias("doc_id"), signal.alias("signal")),
        rejections=events.filter("event_type = 'error'").select(F.col("user_id").alias("doc_id"), F.col("ts").alias("at")), links=links, explored=docs.filter("doc_id % 2 = 0").select("doc_id"))
    return search.ranked_search(corpus, _SOUGHT, as_of=_as_of(), agent="en", limit=1 << 30).withColumn("score", F.round("score", 6))


# -- files and pieces -----------------------------------------------------------------------------

_RFIND = lambda mark, n: f"(CASE WHEN strpos(reverse(left(rest, 1000)), {mark}) > 0 THEN 1001 - strpos(reverse(left(rest, 1000)), {mark}) - {n} ELSE -1 END)"
_CUT = f"CASE WHEN {_RFIND('chr(10) || chr(10)', 2)} >= 500 THEN {_RFIND('chr(10) || chr(10)', 2)} WHEN {_RFIND('chr(10)', 1)} >= 500 THEN {_RFIND('chr(10)', 1)} WHEN {_RFIND(repr(' '), 1)} >= 500 THEN {_RFIND(repr(' '), 1)} ELSE 1000 END"


@query(f"""WITH RECURSIVE c AS (SELECT doc_id, 0 AS n, text AS rest, {_CUT.replace('rest', 'text')} AS cut FROM documents WHERE text IS NOT NULL
 UNION ALL SELECT doc_id, n, rest, {_CUT} FROM (SELECT doc_id, n + 1 AS n, ltrim(substr(rest, cut + 1), chr(10)) AS rest FROM c WHERE length(rest) > 1000))
 SELECT doc_id, n, md5(CASE WHEN length(rest) > 1000 THEN left(rest, cut) ELSE rest END) AS chunk FROM c WHERE rest <> '' OR n = 0""")
def document_chunks(spark, d):
    return text.chunks(_docs(spark, d).select("doc_id", "text"), "text", 1000).select("doc_id", "n", F.md5(F.col("chunk").cast("binary")).alias("chunk"))


def _scripts(spark, d):
    """Pages as files: every third one a Python file, every third a script."""
    suffix = F.element_at(F.array(*map(F.lit, [".py", ".js", ".html"])), (F.col("page_id") % 3 + 1).cast("int"))
    return table(spark, d, "pages").select(F.concat(F.lit("site"), (F.col("page_id") % 7).cast("string"), F.lit("/p"), F.col("page_id").cast("string"), suffix).alias("path"), F.col("html").alias("content"))


@query()
def code_strip(spark, d):
    return code.strip_code(_scripts(spark, d)).select("key", F.md5(F.col("text").cast("binary")).alias("text"))


@query()
def code_structure(spark, d):
    return code.code_structure(_scripts(spark, d)).select("key", F.md5(F.col("text").cast("binary")).alias("text"))


@query()
def code_context(spark, d):
    return code.line_context(_scripts(spark, d), "href").select("key", F.md5(F.col("text").cast("binary")).alias("text"))


@query()
def project_summaries(spark, d):
    found = code.project_summary(code.file_summaries(_scripts(spark, d)), project=F.split_part("path", F.lit("/"), F.lit(1)))
    return found.select("project", "files", "lines", "functions", "classes", F.to_json("kinds").alias("kinds"), F.size("todos").alias("todos"))


@query()
def table_sizes(spark, d):
    return code.table_sizes({t: table(spark, d, t) for t in tables.TABLES})


# -- all steps of annotation ----------------------------------------------------------------------

_AGENTS = ["ther", "eran"]
_MORE = f"""UNION ALL SELECT doc_id, 'chat_' || lang, 8, 0, 1.5 FROM documents UNION ALL SELECT doc_id, 'emotion_' || dim, 9, r - 1, {_TWO('least(score, 5.0)')} FROM felt WHERE r <= 5
  UNION ALL SELECT doc_id, 'dominant_' || dim, 9, 99, {_TWO('least(score * 1.5, 5.0)')} FROM felt WHERE r = 1 AND score > 1"""


@query(f"""WITH documents AS (SELECT conv_id * 1000 + turn AS doc_id, text, role AS lang FROM conversations),
 e AS ({_emotion_sql('doc_id, text').replace('FROM conversations', 'FROM documents')}), l AS ({' UNION ALL '.join(f"SELECT doc_id, '{c}' AS dim, {c} AS score, {k} AS k FROM e WHERE length(text) >= 20" for k, c in enumerate(_DIMS))}),
 felt AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, k) AS r FROM l WHERE score > 0.5),
 {_annotate_sql(_MORE, _AGENTS)} SELECT doc_id, token, step, round(weight, 4) AS weight FROM annotated""")
def annotate_full(spark, d):
    rows = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text", F.col("role").alias("lang"), F.concat(F.lit("Chat "), "role").alias("channel"))
    return index.annotate(rows, author="lang", agents=_AGENTS, metadata=["channel"], emotions=True).withColumn("weight", F.round("weight", 4))


# -- pages, decay and layers ----------------------------------------------------------------------

@query("SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total, '41-60 of ' || (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS showing FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 20 OFFSET 40")
def browse_showing(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return relational.browse_page(rows, ["o_orderkey"], where=F.col("o_orderstatus") == "F", limit=20, offset=40).drop("o_orderstatus")


@query(f"""WITH a AS (SELECT (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts)) / 3.6e9 AS h FROM (SELECT ts FROM events WHERE ts IS NOT NULL ORDER BY ts DESC LIMIT 50)), r AS (SELECT count(*) AS entries, avg(h) AS mean, min(h) AS gap FROM a)
 SELECT entries, round(mean, 4) AS mean_age_hours, round(gap, 4) AS gap_hours, round(CASE WHEN entries < 5 THEN 0.0 ELSE least(1.0, mean / 168) END, 6) AS decay, CASE WHEN entries < 5 THEN 'healthy' WHEN gap > 24 THEN 'decaying' WHEN gap > 4 THEN 'aging' ELSE 'healthy' END AS health FROM r""")
def memory_decay(spark, d):
    found = aggregates.context_decay(table(spark, d, "events"), _as_of(), at="ts")
    return found.select("entries", F.round("mean_age_hours", 4).alias("mean_age_hours"), F.round("gap_hours", 4).alias("gap_hours"), F.round("decay", 6).alias("decay"), "health")


@query()
def ppr_overridden(spark, d):
    deltas = table(spark, d, "events").filter("event_type = 'click'").select((F.col("user_id") % 100 + 1).alias("source_id"), (100000 + F.col("event_id") % 500).alias("target_id"), ((F.col("value") - 50) / 1000).alias("delta"))
    return graph.pagerank(_order_links(spark, d), [1, 2, 3], sweeps=50, epsilon=1e-4, overrides=deltas).select("node", F.round("score", 6).alias("score"))


@query()
def disclosure_candidates(spark, d):
    """Layers 1 to 3 of every supplier, over the links of lines with states made of their columns."""
    links = _order_links(spark, d).select("source_id", "target_id", "strength", F.element_at(F.array(*map(F.lit, graph.STATES)), (F.col("target_id") % 4 + 1).cast("int")).alias("link_state"), (F.col("source_id") % 2 == 0).alias("explored"), F.when(F.col("target_id") % 3 == 0, "shared_annotation").otherwise("session").alias("link_type"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", F.col("text").alias("content"))
    suppliers = table(spark, d, "supplier")
    summaries = docs.unionByName(suppliers.select((F.col("s_suppkey") % 500 + 100000).alias("id"), F.lit("src1").alias("source"), F.col("s_name").alias("content")).distinct())
    asked = suppliers.select((F.col("s_suppkey") % 7).cast("string").alias("session"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("layer"), F.col("s_suppkey").alias("parent_id"))
    rejected = table(spark, d, "events").filter("event_type = 'error'").select((F.col("event_id") % 7).cast("string").alias("session"), F.col("user_id").alias("summary_id"))
    return disclosure.layer_candidates(asked, links, summaries, docs, rejected)

"""Context for an agent: gathering, ordering and layering what was found, and what an agent is likely to want next."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How much of each kind a context takes, for one node and in all.
FACTS_EACH, FACTS, REFLECTIONS_EACH, REFLECTIONS, EPISODES = 8, 60, 3, 20, 80
QUICK_FACTS, QUICK_REFLECTIONS = 5, 2
# Rows of each tier at the start of a session, and how many recent ones are looked at.
SESSION_TIERS, SESSION_RECENT, SESSION_HOURS = {"handoff": 3, "session": 3, "message": 3, "team": 2}, 20, 48
# What begins the name of a source of each bucket.
FACT_SOURCES = ["research_", "document", "code_", "tool", "knowledge_base", "research", "doc", "code"]
REFLECTION_SOURCES = ["session_log", "bookmark", "memory_core", "consciousness_marker", "conversation_snapshot"]
EPISODE_SOURCES = ["synapse", "project_", "active_project", "cursor_ide_session", "claude_cli_session", "agent_communication"]
REFLECTION_STARTS = ["session", "book", "memory"]
# The type that a source is drawn as; the first part that its name holds decides.
STORY_TYPES = {
    "research_": "fact", "document": "episode", "code_": "fact", "tool": "fact", "knowledge_base": "fact", "session_log": "session", "bookmark": "reflection",
    "memory_core": "reflection", "consciousness_marker": "birth_event", "conversation_snapshot": "session", "synapse": "episode", "project_": "project",
    "active_project": "project", "cursor_ide_session": "episode", "claude_cli_session": "episode", "agent_communication": "episode",
}
# Short words that are no topics of an agent.
TOPIC_STOPWORDS = ["the", "a", "an", "is", "in", "at", "to", "for", "of", "and", "or", "on", "with", "by", "from", "as", "it"]
TOPIC_BOOST, INJECTED, MOST_INJECTED, LEAST_CONFIDENCE = 1.3, 0.5, 5, 0.3


def _starts(name: Column, parts: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.startswith(name, F.lit(p))
    return out


def classify_source(source: Column) -> Column:
    """facts, reflections or episodes; facts where nothing else is known."""
    low = F.lower(F.coalesce(source, F.lit("")))
    exact = low.isin(REFLECTION_SOURCES)
    return (
        F.when(_starts(low, FACT_SOURCES[:5]), "facts").when(exact, "reflections").when(_starts(low, EPISODE_SOURCES), "episodes")
        .when(_starts(low, FACT_SOURCES), "facts").when(_starts(low, REFLECTION_STARTS), "reflections").otherwise("facts")
    )


def story_type(source: Column) -> Column:
    low = F.lower(F.coalesce(source, F.lit("")))
    return F.coalesce(*[F.when(F.contains(low, F.lit(p)), F.lit(t)) for p, t in STORY_TYPES.items()], F.lit("fact"))


def capped(ranked: DataFrame, rows: DataFrame, *, node: str, key: str, at: str, each: int, total: int) -> DataFrame:
    """(node, key, place): the newest ``each`` rows of every ranked node, in the order of the nodes, ``total`` in all.

    Nodes past the ``total`` best that have rows cannot contribute, so only those are ordered among themselves.
    """
    own = Window.partitionBy(node).orderBy(F.desc(at), key)
    newest = rows.join(ranked.select(node, "rank"), node).withColumn("own", F.row_number().over(own)).filter(F.col("own") <= each)
    first = newest.orderBy("rank", "own").limit(total)  # a top-k: partial in each task
    return first.select(node, key, F.row_number().over(Window.orderBy("rank", "own")).cast("long").alias("place"))


def gather(ranked: DataFrame, facts: DataFrame, reflections: DataFrame, *, episodes: int = EPISODES) -> DataFrame:
    """(kind, node, key, place) of facts (node, key, at), reflections (node, key, at) and the nodes themselves, for ranked nodes (node, rank)."""
    some = ranked.orderBy("rank").limit(episodes)
    parts = [
        capped(some, facts, node="node", key="key", at="at", each=FACTS_EACH, total=FACTS).withColumn("kind", F.lit("fact")),
        capped(some, reflections, node="node", key="key", at="at", each=REFLECTIONS_EACH, total=REFLECTIONS).withColumn("kind", F.lit("reflection")),
        some.select("node", F.col("node").alias("key"), F.col("rank").cast("long").alias("place"), F.lit("episode").alias("kind")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("kind", "node", "key", "place")


def chronological(items: DataFrame, chain: DataFrame) -> DataFrame:
    """Adds ``spot``: items whose source stands in a chain first, in its order, then dated ones, newest first, then the rest as they stood.

    ``items`` (source, type, created_at, position) is one context, whose size is capped; ``chain`` is (source, step).
    """
    steps = chain.select(F.col("source").alias("linked"), "step")
    found = items.join(steps, (F.col("source") == F.col("linked")) & (F.col("type") == "episode"), "left")
    group = F.when(F.col("step").isNotNull(), 0).when(F.col("created_at").isNotNull(), 1).otherwise(2)
    order = Window.orderBy(group, F.when(group == 0, F.col("step")), F.when(group == 1, -F.unix_micros(F.col("created_at").cast("timestamp"))), "position")
    return found.withColumn("spot", F.row_number().over(order).cast("long")).drop("linked", "step")


def layers(items: DataFrame, *, order: list[str], keys: list[str] = ()) -> DataFrame:
    """Adds detailed and quick: the items (type, tier) of each context that the shorter layers keep; the full layer keeps all."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    full = F.col("tier") == "full"
    count = lambda kind, most: F.least(F.sum(F.when(full & (F.col("type") == kind), 1).otherwise(0)).over(before), F.lit(most))
    nth = lambda kind: F.sum(F.when(full & (F.col("type") == kind), 1).otherwise(0)).over(before)
    held = count("fact", QUICK_FACTS) + count("reflection", QUICK_REFLECTIONS)
    quick = F.when(F.col("type") == "fact", nth("fact") <= QUICK_FACTS).when(F.col("type") == "reflection", nth("reflection") <= QUICK_REFLECTIONS).otherwise(held < QUICK_FACTS + QUICK_REFLECTIONS)
    return items.withColumn("detailed", F.col("tier").isin("full", "truncated")).withColumn("quick", full & quick)


def session_start(summaries: DataFrame, agent: str, as_of: Column) -> DataFrame:
    """(tier, id, effective, place): what an agent begins with, from rows (id, source, content, created_at, effective).

    Its handoffs, session logs and messages, then other agents' handoffs of the last two days; each tier takes the newest by effective date
    of the twenty that came last.
    """
    low, name = F.lower("content"), F.lit(agent.lower())
    mine = F.contains(low, name)
    source = F.lower("source")
    tiers = {
        "handoff": F.contains(source, F.lit("agent_handoff")) & mine, "session": F.contains(source, F.lit("session_log")) & mine,
        "message": F.contains(source, F.lit("synapse")) & mine, "team": F.contains(source, F.lit("agent_handoff")) & ~mine,
    }
    out = None
    for tier, wanted in tiers.items():
        rows = summaries.filter(wanted).orderBy(F.desc("created_at"), F.desc("id")).limit(SESSION_RECENT)
        if tier == "team":
            rows = rows.filter(F.substring("effective", 1, 10) >= F.date_format(as_of - F.expr(f"INTERVAL {SESSION_HOURS} HOURS"), "yyyy-MM-dd"))
        order = Window.orderBy(F.desc("effective"), F.desc("created_at"), F.desc("id"))  # twenty rows
        rows = rows.withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= SESSION_TIERS[tier]).select(F.lit(tier).alias("tier"), "id", "effective", "place")
        out = rows if out is None else out.unionByName(rows)
    return out


# -- what an agent wants next ---------------------------------------------------------------------

def topic_priors(log: DataFrame, *, agent: str, text: str, order: list, recent: int = 5000, most: int = 5) -> DataFrame:
    """(agent, keyword, n, rank): each agent's most frequent words in the last ``recent`` rows; ties to the smaller word."""
    rows = log.orderBy(*order).limit(recent)
    said = F.when(F.instr(F.col(text), "=") > 0, F.regexp_replace(text, r"(?s)^[^=]*=", "")).otherwise(F.col(text))
    words = rows.select(F.col(agent).alias("agent"), F.explode(F.split(F.lower(said), r"\s+")).alias("keyword")).filter((F.length("keyword") >= 3) & ~F.col("keyword").isin(TOPIC_STOPWORDS))
    counted = words.groupBy("agent", "keyword").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy("agent").orderBy(F.desc("n"), "keyword")).cast("long")).filter(F.col("rank") <= most)


def novelty_order(priors: DataFrame, keywords: list[str]) -> DataFrame:
    """(agent, keyword, novelty, place): the keywords for each agent, those that it asks for least first; equal ones keep their order."""
    known = priors.groupBy("agent").agg(F.map_from_entries(F.collect_list(F.struct("keyword", "n"))).alias("freq"), F.max("n").alias("most"))  # a few words each
    asked = known.select("agent", "freq", "most", F.posexplode(F.array(*map(F.lit, keywords))).alias("at", "keyword"))
    scored = asked.withColumn("novelty", 1 - F.coalesce(F.try_element_at("freq", F.lower("keyword")), F.lit(0)) / F.greatest("most", F.lit(1)))
    return scored.select("agent", "keyword", "novelty", F.row_number().over(Window.partitionBy("agent").orderBy(F.desc("novelty"), "at")).cast("long").alias("place"))


def topic_boost(score: Column, summary: Column, topics: list[str], boost: float = TOPIC_BOOST) -> Column:
    """A score times 1 + boost x the share of topics that the summary holds."""
    held = sum(F.when(F.contains(F.lower(summary), F.lit(t.lower())), 1).otherwise(0) for t in sorted(set(topics)))
    return score * (1 + held / len(set(topics)) * boost)


def confident(results: DataFrame, score: str, key: str, *, least: float = LEAST_CONFIDENCE, most: int = 5) -> DataFrame:
    return results.filter(F.col(score) >= least).orderBy(F.desc(score), key).limit(most)


def agent_keywords(annotations: DataFrame, activity: DataFrame, *, order: list, recent: int = 5, most: int = 15) -> DataFrame:
    """(agent, token, weight, rank): the heaviest annotations of each agent's last activities (agent, doc_id); never its own name."""
    last = activity.withColumn("n", F.row_number().over(Window.partitionBy("agent").orderBy(*order))).filter(F.col("n") <= recent).select("agent", "doc_id")
    best = annotations.join(last, "doc_id").groupBy("agent", "token").agg(F.max("weight").alias("weight")).filter(F.lower("agent") != F.col("token"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("agent").orderBy(F.desc("weight"), "token")).cast("long")).filter(F.col("rank") <= most)


def inject_others(results: DataFrame, annotations: DataFrame, authors: DataFrame, terms: list[str], agent: str, most: int = MOST_INJECTED) -> DataFrame:
    """(doc_id, score, cross_agent): the results, with what other authors wrote on the terms added at a fixed score; results of theirs are only marked."""
    hits = annotations.filter(F.col("token").isin(terms)).groupBy("doc_id").agg(F.sum("weight").alias("weight"))
    others = authors.filter((F.trim("author") != "") & (F.upper("author") != agent.upper()))
    best = hits.join(others, "doc_id").orderBy(F.desc(F.round("weight", 9)), "doc_id").limit(most).select("doc_id", F.lit(True).alias("other"))
    both = results.select("doc_id", "score").join(best, "doc_id", "full")
    return both.select("doc_id", F.coalesce("score", F.lit(INJECTED)).alias("score"), F.coalesce("other", F.lit(False)).alias("cross_agent"))


def cross_pollinate(annotations: DataFrame, topics: DataFrame, agent: str, *, terms: int = 5, each: int = 2, most: int = 3) -> DataFrame:
    """(topic, from_agent, doc_id, place): the best documents on what other agents look at (agent, topic, place), each once."""
    other = topics.filter(F.upper("agent") != agent.upper()).groupBy("topic").agg(F.min(F.struct("place", "agent")).alias("f")).orderBy("f").limit(terms)
    other = other.select("topic", F.col("f.agent").alias("from_agent"), F.col("f.place").alias("place"))
    # A handful of topics.
    hits = annotations.join(F.broadcast(other), F.col("token") == F.col("topic")).groupBy("topic", "from_agent", "place", "doc_id").agg(F.sum("weight").alias("weight"))
    ranked = hits.withColumn("r", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc(F.round("weight", 9)), "doc_id"))).filter(F.col("r") <= each)
    once = ranked.withColumn("first", F.row_number().over(Window.partitionBy("doc_id").orderBy("place", "from_agent", "r"))).filter("first = 1")
    return once.orderBy("place", "from_agent", "r").limit(most).select("topic", "from_agent", "doc_id", F.col("r").cast("long").alias("place"))


def rag_context(results: DataFrame, *, least: float = 0.5, most: int = 4, chars: int = 400) -> DataFrame:
    """One row, context: the best results (doc_id, source, summary, score) above ``least``, cut and joined."""
    top = results.filter(F.col("score") > least).orderBy(F.desc("score"), "doc_id").limit(most)
    cut = F.substring(F.concat(F.lit("["), "source", F.lit("] "), "summary"), 1, chars)
    listed = top.agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "doc_id", cut.alias("c")))).alias("l"))
    return listed.select(F.array_join(F.col("l.c"), "\n---\n").alias("context"))

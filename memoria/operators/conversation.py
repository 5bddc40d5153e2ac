"""Conversation analytics: echoes, novelty, threads, mentions, votes, claims and baselines."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WORD_BREAK, message_keywords
from ..scratch import materialize
from .fold import ordered_fold
from .ranges import positions

# Windows and thresholds.
ECHO_WINDOW, ECHO_SIMILARITY = 10, 0.70
NOVELTY_WINDOW, NOVELTY_SHARE, NOVELTY_WORDS = 20, 0.30, 3
RATE_MESSAGES, RATE_SECONDS = 5, 60
ACKNOWLEDGE_WITHIN = 10
BASELINE_MESSAGES, BASELINE_WORDS = 100, 20


def echoes(messages: DataFrame, keys: list[str], order: list[str], text: str = "text") -> DataFrame:
    """Adds similarity, the greatest Jaccard similarity of a message's keywords with those of the ten before it, and is_echo."""
    words = messages.withColumn("words", message_keywords(F.col(text)))
    before = F.collect_list("words").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(-ECHO_WINDOW, -1))
    jaccard = lambda w: F.when((F.size(w) == 0) | (F.size("words") == 0), 0.0).otherwise(F.size(F.array_intersect(w, "words")) / F.size(F.array_union(w, "words")))
    best = F.coalesce(F.array_max(F.transform("before", jaccard)), F.lit(0.0))
    return words.withColumn("before", before).withColumn("similarity", best).withColumn("is_echo", F.col("similarity") >= ECHO_SIMILARITY).drop("words", "before")


def novelty(messages: DataFrame, keys: list[str], order: list[str], text: str = "text") -> DataFrame:
    """Adds novelty, the share of a message's keywords that the twenty before it lack, new_words and is_novel. First or wordless messages are novel."""
    words = messages.withColumn("words", message_keywords(F.col(text)))
    before = F.flatten(F.collect_list("words").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(-NOVELTY_WINDOW, -1)))
    words = words.withColumn("before", before).withColumn("fresh", F.array_except("words", "before"))
    share = F.when((F.size("before") == 0) | (F.size("words") == 0), 1.0).otherwise(F.size("fresh") / F.size("words"))
    out = words.withColumn("novelty", share).withColumn("new_words", F.size("fresh").cast("long"))
    return out.withColumn("is_novel", (F.col("novelty") >= NOVELTY_SHARE) | (F.col("new_words") >= NOVELTY_WORDS)).drop("words", "before", "fresh")


def rate_limit(messages: DataFrame, agent: str, at: str, key: str, *, most: int = RATE_MESSAGES, seconds: int = RATE_SECONDS) -> DataFrame:
    """(agent, key, at, accepted): at most ``most`` accepted messages in any ``seconds``; rejected ones do not count.

    The rule depends on its own decisions, so each agent's messages are folded in order; the state is the times of its last accepted messages.
    """
    kinds = dict(messages.dtypes)
    rows = messages.select(F.col(agent).alias("agent"), F.col(key).alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("t"))

    def step(live: list, row: dict) -> tuple[list, dict]:
        live = [t for t in live if t >= row["t"] - seconds * 1_000_000]
        ok = len(live) < most
        return live + [row["t"]] if ok else live, row | {"accepted": ok}

    folded = ordered_fold(rows, ["agent"], ["t", "key"], list, step, f"agent {kinds[agent]}, key {kinds[key]}, t long, accepted boolean")
    return folded.select("agent", "key", F.timestamp_micros("t").alias("at"), "accepted")


def mentions(messages: DataFrame, *, key: str, sender: str, text: str) -> DataFrame:
    """(key, mentioner, mentioned): lowered names after an @."""
    names = F.regexp_extract_all(F.lower(text), F.lit(r"@(\w+)"), F.lit(1))
    return messages.select(F.col(key).alias("key"), F.lower(F.col(sender).cast("string")).alias("mentioner"), F.explode(names).alias("mentioned"))


def acknowledged(messages: DataFrame, *, key: str, sender: str, text: str, group: list[str] = ()) -> DataFrame:
    """Mentions with whether the mentioned one sends any of the next ten messages (of the group, where groups are named).

    Messages are numbered over ranges of the key; a mention looks for its name at the ten numbers that follow. ``key`` names a message of a group.
    """
    groups = {f"_g{i}": F.col(g) for i, g in enumerate(group)}
    rows = messages.select(F.col(key).alias("key"), F.lower(F.col(sender).cast("string")).alias("sender"), F.col(text).alias("text"), *[c.alias(g) for g, c in groups.items()])
    rows = positions(rows, list(groups), ["key"])
    names = F.regexp_extract_all(F.lower("text"), F.lit(r"@(\w+)"), F.lit(1))
    found = rows.select(*groups, "_position", "key", F.col("sender").alias("mentioner"), F.posexplode(names).alias("_nth", "mentioned"))
    sent = rows.select(*[F.col(g).alias(f"_{g}") for g in groups], F.col("_position").alias("_at"), F.col("sender").alias("_sender")).distinct()
    ahead = found.withColumn("_at", F.explode(F.sequence(F.col("_position") + 1, F.col("_position") + ACKNOWLEDGE_WITHIN)))
    same = (ahead["_at"] == sent["_at"]) & (ahead["mentioned"] == sent["_sender"])
    for g in groups:
        same = same & ahead[g].eqNullSafe(sent[f"_{g}"])
    met = ahead.join(sent, same, "left").groupBy(*groups, "_position", "_nth").agg(F.first("key").alias("key"), F.first("mentioner").alias("mentioner"), F.first("mentioned").alias("mentioned"), F.max(F.col("_sender").isNotNull()).alias("acknowledged"))
    return met.select("key", "mentioner", "mentioned", "acknowledged")


# How a vote is worded; the first pattern that matches counts.
VOTES = [r"i\s+vote\s+(?:for\s+)?(\w+)", r"my\s+vote[:\s]+(\w+)", r"\+1\s+(?:for\s+)?(\w+)", r"voting\s+(?:for\s+)?(\w+)"]


def votes(messages: DataFrame, *, key: str, sender: str, text: str) -> DataFrame:
    """(voter, choice, key): the last vote of each voter."""
    low = F.lower(text)
    choice = F.coalesce(*[F.nullif(F.regexp_extract(low, p, 1), F.lit("")) for p in VOTES])
    cast = messages.select(F.lower(F.col(sender).cast("string")).alias("voter"), choice.alias("choice"), F.col(key).alias("key")).filter("choice IS NOT NULL")
    return cast.groupBy("voter").agg(F.max(F.struct("key", "choice")).alias("v")).select("voter", "v.choice", "v.key")


def tally(cast: DataFrame) -> DataFrame:
    return cast.groupBy("choice").agg(F.count(F.lit(1)).alias("votes"))


# Claims that can be checked.
CLAIMS = [
    (r"(?:wasn't|was not|never was|have not been|haven't been)\s+@?mentioned", "mention_denial"),
    (r"no\s+one\s+(?:@?mentioned|tagged)\s+me", "mention_denial"),
    (r"(\d+)\s+votes?\s+(?:for|total)", "vote_count"),
    (r"(?:the\s+)?count\s+is\s+(\d+)", "vote_count"),
    (r"(?:no\s+one|nobody)\s+(?:responded|replied|answered)", "response_claim"),
]


def claims(messages: DataFrame, *, key: str, sender: str, text: str) -> DataFrame:
    """(key, claimant, kind): each kind of claim that a message makes."""
    low = F.lower(text)
    kinds = F.array_distinct(F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(k)) for p, k in CLAIMS])))
    return messages.select(F.col(key).alias("key"), F.lower(F.col(sender).cast("string")).alias("claimant"), F.explode(kinds).alias("kind"))


def audit_denials(found: DataFrame, mentioned: DataFrame) -> DataFrame:
    """Denials of having been mentioned, with whether an earlier message did mention the claimant."""
    first = mentioned.groupBy(F.col("mentioned").alias("claimant")).agg(F.min("key").alias("first_mention"))
    denials = found.filter("kind = 'mention_denial'").join(first, "claimant", "left")
    return denials.select("key", "claimant", F.coalesce(F.col("first_mention") < F.col("key"), F.lit(False)).alias("contradicted"))


# Labels of knowledge in messages.
LABELS = [
    (r"(?i)finding:[ \t]*([^\n]+)", "FINDING"), (r"(?i)decision:[ \t]*([^\n]+)", "DECISION"), (r"(?i)problem:[ \t]*([^\n]+)", "PROBLEM"), (r"(?i)solution:[ \t]*([^\n]+)", "SOLUTION"),
    (r"(?i)todo:[ \t]*([^\n]+)", "TODO"), (r"(?i)note:[ \t]*([^\n]+)", "FACT"), (r"(?i)insight:[ \t]*([^\n]+)", "INSIGHT"), (r"(?i)config(?:uration)?:[ \t]*([^\n]+)", "CONFIG"),
]


def knowledge(messages: DataFrame, *, key: str, text: str) -> DataFrame:
    """(key, category, content) of labelled statements of more than ten characters."""
    def labelled(pattern: str, kind: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda c: F.struct(F.lit(kind).alias("category"), F.trim(c).alias("content")))

    parts = [labelled(p, k) for p, k in LABELS]
    rows = messages.select(F.col(key).alias("key"), F.explode(F.concat(*parts)).alias("k")).select("key", "k.category", "k.content")
    return rows.filter(F.length("content") > 10)


def threads(messages: DataFrame, *, key: str = "id", parent: str = "parent_id", sender: str = "sender", rounds: int = 20) -> DataFrame:
    """(key, root, depth) by pointer doubling: after k rounds chains of 2^k messages are resolved. Members of a cycle keep the least pointer they reach; a missing parent ends a chain."""
    known = messages.select(F.col(key).alias("p"))
    start = messages.select(F.col(key).alias("id"), F.col(parent).alias("up")).join(known, F.col("up") == F.col("p"), "left")
    state = start.select("id", F.coalesce("p", "id").alias("at"), F.when(F.col("p").isNull(), 0).otherwise(1).cast("long").alias("depth"))
    size, done = 1, messages.count()
    while size < min(done, 1 << rounds):
        hop = state.select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("depth").alias("more"))
        state = state.join(hop, "at").select("id", F.col("next").alias("at"), (F.col("depth") + F.col("more")).alias("depth"))
        size *= 2
        if size > 64:
            state = materialize(state, "threads")
    return state.select("id", F.col("at").alias("root"), "depth")


def thread_summary(rooted: DataFrame, messages: DataFrame, *, key: str = "id", sender: str = "sender") -> DataFrame:
    """Messages, participants and greatest depth of each thread, and whether it is significant."""
    rows = rooted.join(messages.select(F.col(key).alias("id"), F.col(sender).alias("sender")), "id")
    out = rows.groupBy("root").agg(F.count(F.lit(1)).alias("messages"), F.countDistinct("sender").alias("participants"), F.max("depth").alias("depth"))
    return out.withColumn("significant", (F.col("depth") >= 3) & (F.col("messages") >= 5) & (F.col("participants") >= 2))


def baseline(messages: DataFrame, *, agent: str, order: str, text: str) -> DataFrame:
    """Mean characters and words of each agent's last hundred messages and its twenty most used words of four letters or more."""
    latest = messages.withColumn("n", F.row_number().over(Window.partitionBy(agent).orderBy(F.desc(order)))).filter(F.col("n") <= BASELINE_MESSAGES)
    size = latest.groupBy(agent).agg(F.avg(F.length(text)).alias("avg_chars"), F.avg(F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))).alias("avg_words"))
    words = latest.select(agent, F.explode(F.split(F.lower(text), WORD_BREAK)).alias("word")).filter(F.length("word") > 3).groupBy(agent, "word").agg(F.count(F.lit(1)).alias("c"))
    top = words.withColumn("r", F.row_number().over(Window.partitionBy(agent).orderBy(F.desc("c"), "word"))).filter(F.col("r") <= BASELINE_WORDS)
    return size.join(top.groupBy(agent).agg(F.array_sort(F.collect_list("word")).alias("top_words")), agent, "left")


def drift(messages: DataFrame, base: DataFrame, *, agent: str, text: str) -> DataFrame:
    """Adds drift: up to 0.3 each for unusual length and word count, 0.4 where under a tenth of the agent's usual words occur; drifted above one half."""
    rows = messages.join(base, agent)
    words = F.array_distinct(F.filter(F.split(F.lower(text), WORD_BREAK), lambda w: F.length(w) > 3))
    chars = F.abs(F.length(text) - F.col("avg_chars")) / F.greatest(F.col("avg_chars"), F.lit(1.0))
    count = F.abs(F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")) - F.col("avg_words")) / F.greatest(F.col("avg_words"), F.lit(1.0))
    top = F.coalesce("top_words", F.array().cast("array<string>"))
    overlap = F.size(F.array_intersect(words, top)) / F.greatest(F.size(top), F.lit(1))
    part = lambda r: F.when(r > 2, F.least(r / 5, F.lit(0.3))).otherwise(0.0)
    score = F.least(F.lit(1.0), part(chars) + part(count) + F.when(overlap < 0.1, 0.4).otherwise(0.0))
    return rows.withColumn("drift", score).withColumn("drifted", F.col("drift") > 0.5).drop("avg_chars", "avg_words", "top_words")


def next_query(log: DataFrame, *, user: str, query: str, order: list[str]) -> DataFrame:
    """(query, following, n): the most frequent successor of each query, ties to the smaller."""
    pairs = log.select(F.col(query).alias("query"), F.lead(query).over(Window.partitionBy(user).orderBy(*order)).alias("following")).filter("following IS NOT NULL")
    counted = pairs.groupBy("query", "following").agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("query").agg(F.min(F.struct((-F.col("n")).alias("m"), "following")).alias("b"))
    return best.select("query", "b.following", (-F.col("b.m")).alias("n"))


def budget_prefix(df: DataFrame, keys: list[str], order: list, size: str, budget: int) -> DataFrame:
    """Each group's rows in order until the first that would pass the budget, with ``used``, the sizes up to and with a row. Sizes are not negative; null sizes count 0."""
    placed = positions(df, keys, order, {"used": size})
    out = placed.withColumn("used", F.col("_before_used") + F.coalesce(F.col(size), F.lit(0))).filter(F.col("used") <= budget)
    return out.select(*[c for c in df.columns if c != "used"], "used")


def tiers(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """full for the first 30 % of each group's rows, brief for the next 40 %, else mention."""
    share = F.col("_position") / F.col("_count")
    return positions(df, keys, order).select(*[c for c in df.columns if c != "tier"], F.when(share < 0.3, "full").when(share < 0.7, "brief").otherwise("mention").alias("tier"))


def packed(text: Column, tier: Column) -> Column:
    """A text as its tier has it: whole, its first two sentences, or its first fifteen words."""
    sentences = F.array_join(F.slice(F.split(text, r"(?<=[.!?])\s+"), 1, 2), " ")
    return F.when(tier == "full", text).when(tier == "brief", sentences).otherwise(F.array_join(F.slice(F.split(text, r"\s+"), 1, 15), " "))


def hash_chain(messages: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """(keys, order, link): SHA-256 of the link before and the text, folded in order within each group."""
    kinds = dict(messages.dtypes)

    def step(link: str, row: dict) -> tuple[str, dict]:
        link = hashlib.sha256((link + (row[text] or "")).encode()).hexdigest()
        return link, {k: row[k] for k in (*keys, order)} | {"link": link}

    rows = messages.select(*keys, order, text)
    return ordered_fold(rows, keys, [order], str, step, ", ".join(f"{k} {kinds[k]}" for k in (*keys, order)) + ", link string")


def verify_chain(chain: DataFrame, messages: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """Adds whether each claimed link follows from the claimed one before it and the text."""
    rows = chain.join(messages.select(*keys, order, text), [*keys, order])
    before = F.coalesce(F.lag("link").over(Window.partitionBy(*keys).orderBy(order)), F.lit(""))
    return rows.withColumn("holds", F.sha2(F.concat(before, F.coalesce(F.col(text), F.lit(""))).cast("binary"), 256) == F.col("link")).drop(text)


def history(messages: DataFrame, keys: list[str], order: str, *, sender: str, text: str) -> DataFrame:
    """Adds messages, chars and by_sender: what each conversation held up to a message, the message included."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    own = Window.partitionBy(*keys, sender).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumn("messages", F.count(F.lit(1)).over(before)).withColumn("chars", F.sum(F.length(text)).over(before)).withColumn("by_sender", F.count(F.lit(1)).over(own))


def threads_about(messages: DataFrame, *, thread: str, sender: str, text: str, topic: str | None = None, participant: str | None = None) -> DataFrame:
    """The threads in which any message holds the topic or is by the participant."""
    wanted = F.lit(False)
    if topic:
        wanted = wanted | F.contains(F.lower(text), F.lit(topic.lower()))
    if participant:
        wanted = wanted | (F.lower(sender) == participant.lower())
    return messages.filter(wanted).select(thread).distinct()


def _vote(text: str) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(F.lower(text), p, 1), F.lit("")) for p in VOTES])


def timeline(messages: DataFrame, *, key: str, sender: str, text: str, chars: int = 20) -> DataFrame:
    """(key, kind, agent, detail): messages, mentions and votes; to be read in the order of the key."""
    agent = F.lower(F.col(sender).cast("string"))
    said = messages.select(F.col(key).alias("key"), F.lit("message").alias("kind"), agent.alias("agent"), F.substring(text, 1, chars).alias("detail"))
    named = mentions(messages, key=key, sender=sender, text=text).select("key", F.lit("mention").alias("kind"), F.col("mentioner").alias("agent"), F.col("mentioned").alias("detail"))
    voted = messages.select(F.col(key).alias("key"), F.lit("vote").alias("kind"), agent.alias("agent"), _vote(text).alias("detail")).filter("detail IS NOT NULL")
    return said.unionByName(named).unionByName(voted)


def agent_contexts(messages: DataFrame, *, key: str, sender: str, text: str) -> DataFrame:
    """(agent, messages, votes, made, received) of every sender: its messages and votes, and the mentions by and of it."""
    said = messages.groupBy(F.lower(F.col(sender).cast("string")).alias("agent")).agg(F.count(F.lit(1)).alias("messages"), F.count(_vote(text)).alias("votes"))
    named = mentions(messages, key=key, sender=sender, text=text)
    made = named.groupBy(F.col("mentioner").alias("agent")).agg(F.count(F.lit(1)).alias("made"))
    received = named.groupBy(F.col("mentioned").alias("agent")).agg(F.count(F.lit(1)).alias("received"))
    both = said.join(made, "agent", "left").join(received, "agent", "left")
    return both.select("agent", "messages", "votes", F.coalesce("made", F.lit(0)).alias("made"), F.coalesce("received", F.lit(0)).alias("received"))


def verify(claimed: DataFrame, messages: DataFrame, *, key: str, sender: str, text: str) -> DataFrame:
    """Claims (key, kind, subject, target, number, says) with verified and severity.

    Kinds: mention, presence and response (whether ``says`` is so), vote_count (``number`` voters in all), vote_target (the subject's last
    vote is ``target``). What happened is one row for each agent.
    """
    cast = votes(messages, key=key, sender=sender, text=text).select(F.col("voter").alias("agent"), "choice")
    present = messages.select(F.lower(F.col(sender).cast("string")).alias("agent"), F.lit(True).alias("present")).distinct()
    named = mentions(messages, key=key, sender=sender, text=text).select(F.col("mentioned").alias("agent"), F.lit(True).alias("mentioned")).distinct()
    facts = present.join(named, "agent", "full").join(cast, "agent", "full")
    total = cast.agg(F.count(F.lit(1)).alias("voters"))  # one row
    found = claimed.join(facts, F.lower("subject") == F.col("agent"), "left").join(F.broadcast(total), F.lit(True), "left")
    found = found.withColumn("present", F.coalesce("present", F.lit(False))).withColumn("mentioned", F.coalesce("mentioned", F.lit(False)))
    kind = F.col("kind")
    holds = F.when(kind == "mention", F.col("says") == F.col("mentioned")).when(kind == "vote_count", F.col("number") == F.col("voters")).when(kind == "vote_target", F.coalesce(F.col("choice") == F.lower("target"), F.lit(False))).otherwise(F.col("says") == F.col("present"))
    worse = F.when(kind == "mention", F.when(F.col("mentioned"), "CRITICAL").otherwise("WARNING")).when(kind == "vote_count", F.when(F.abs(F.col("number") - F.col("voters")) > 1, "CRITICAL").otherwise("ERROR"))
    worse = F.coalesce(worse, F.when((kind == "vote_target") & F.col("choice").isNotNull(), "ERROR").otherwise("WARNING"))
    return found.withColumn("verified", holds).withColumn("severity", F.when(F.col("verified"), "INFO").otherwise(worse)).select(*claimed.columns, "verified", "severity")

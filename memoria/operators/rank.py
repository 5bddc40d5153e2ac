"""Ranking: recall, BM25 and the stages that turn a lexical score into a final one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing, text
from ..scratch import materialize

# The constants of the ranking stages.
COVERAGE_FLOOR = 0.15
K1, B, BLEND = 1.5, 0.75, 0.4
LENGTH_K = 0.15
HEAT_HOURS, HEAT_DECAY, HEAT_CAP = 168, 24.0, 1.5
HALF_LIFE, NEUTRAL_DECAY, MAX_BOOST = 48.0, 0.2, 1.0
REJECTION, REJECTION_DAYS, REJECTION_WINDOW, NEGATION_FLOOR = 0.1, 60.0, 180, 0.2
SELECTION_WEIGHTS = {"ranking_promoted": 0.3, "curator_suggested": 0.5, "user_selected": 1.0}
UNKNOWN_SIGNAL = 0.3
AUTHORITY = {"memory_core": 1.2, "active_project": 1.1, "research": 1.15, "session_log": 1.0, "synapse": 1.05, "conversation": 1.0, "curation_report": 0.8}
CONVERGENCE = {2: 1.0, 3: 1.3, 4: 1.7, 5: 2.2}
RECENT = {"current", "latest", "now", "today", "recent", "status", "update"}
HISTORICAL = {"original", "first", "history", "foundation", "origin", "initial", "when", "earliest"}
DISCOVERY, HOP_DECAY = 1.3, 0.5
CODE_FILES = [".py", ".ipynb", ".ts", ".tsx", ".js", ".jsx", ".cpp", ".c", ".h", ".hpp", ".rs", ".go", ".java"]
CODE_WORDS, PYTHON_WORDS = {"python", "code", ".py", "py", "script", "scripts", "function", "module"}, {"python", ".py", "py"}
#: Factors of Python files, other code files and other files, for a query about Python and for one about code.
CODE_FACTORS = {True: (2.10, 0.35, 0.20), False: (1.55, 1.08, 0.72)}
PPR_WEIGHT, SEEDS = 0.3, 5


def recall(annotations: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, score, matched): log1p of the summed weights of the query's terms."""
    hits = annotations.filter(F.col("token").isin(terms))
    return hits.groupBy("doc_id").agg(F.log1p(F.sum("weight")).alias("score"), F.sort_array(F.collect_set("token")).alias("matched"))


def bm25_term(freq: Column, df: Column, n: Column, length: Column, avg_length: Column, k1: float = K1, b: float = B) -> Column:
    """What one term adds to the score of a document that holds it ``freq`` times."""
    idf = F.log((n - df + 0.5) / (df + 0.5) + 1)
    return idf * freq * (k1 + 1) / (freq + k1 * (1 - b + b * length / avg_length))


def bm25(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, bm25, matched, length) of the documents that hold a term.

    Words are counted inside each row, so no word is shuffled: a narrow table of lengths and frequencies is written,
    and its statistics are one small row.
    """
    def times(words: Column, term: str) -> Column:
        return F.size(F.filter(words, lambda w: w == F.lit(term))).cast("long")

    def counted(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("length"), *[times(words, t).alias(f"f{i}") for i, t in enumerate(terms)])

    keywords = F.filter(text.tokens(F.col("text")), text.is_keyword)
    rows = materialize(docs.select("doc_id", hashing.bound(keywords, counted).alias("c")).select("doc_id", "c.*").filter("length > 0"), "frequencies")
    freqs = [F.col(f"f{i}") for i in range(len(terms))]
    corpus = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("avg_length"), *[F.count_if(f > 0).alias(f"df{i}") for i, f in enumerate(freqs)])
    held = rows.filter(F.greatest(F.lit(0), F.lit(0), *freqs) > 0).crossJoin(F.broadcast(corpus))
    zero = F.lit(0.0)
    score, matched = zero, F.lit(0).cast("long")
    for i, f in enumerate(freqs):
        score = score + F.when(f > 0, bm25_term(f, F.col(f"df{i}"), F.col("n"), F.col("length"), F.col("avg_length"))).otherwise(zero)
        matched = matched + F.when(f > 0, 1).otherwise(0)
    return held.select("doc_id", score.alias("bm25"), matched.alias("matched"), "length")


def coverage(matched: Column, terms: int) -> Column:
    """Floor plus the rest times the matched share to the power of one (one term) or 1.5."""
    share = matched / F.lit(float(max(1, terms)))
    return COVERAGE_FLOOR + (1 - COVERAGE_FLOOR) * F.pow(share, F.lit(1.5 if terms > 1 else 1.0))


def blend(score: Column, lexical: Column) -> Column:
    return (1 - BLEND) * score + BLEND * lexical


def convergence(matches: Column) -> Column:
    """The factor for so many equal aspects."""
    out = F.lit(1.0)
    for n, w in CONVERGENCE.items():
        out = F.when(matches >= n, w).otherwise(out)
    return out


def length_norm(tokens: Column, chars: Column) -> Column:
    return 1 / (1 + F.log(F.greatest(tokens, F.lit(1)))) * 1 / (1 + LENGTH_K * F.log(F.greatest(chars, F.lit(1))))


def authority(source: Column, weights: dict[str, float] = AUTHORITY) -> Column:
    """The weight of the first key that the source holds, 1 for none."""
    out = F.lit(1.0)
    for key, w in reversed(weights.items()):
        out = F.when(F.contains(F.lower(source), F.lit(key)), w).otherwise(out)
    return out


def code_boost(path: Column, terms: list[str]) -> Column:
    """A factor by a file's extension, for queries about code; 1 for other queries and files without one."""
    asked = {t.lower().strip() for t in terms}
    if not asked & CODE_WORDS:
        return F.lit(1.0)
    python, code, other = CODE_FACTORS[bool(asked & PYTHON_WORDS)]
    extension = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.when(extension == ".py", python).when(extension.isin(CODE_FILES), code).when(extension != "", other).otherwise(1.0)


def graph_distance(results: DataFrame, links: DataFrame, *, seeds: int = SEEDS, start: DataFrame | None = None) -> DataFrame:
    """Results (id, score, explored) with hops, scores raised by the best path of at most two links from the ``seeds`` best, or from the few of ``start`` (id)."""
    first = topk(results.select("id", "score"), "score", "id", seeds).select("id") if start is None else start  # a handful
    start = first.select(F.col("id").alias("source_id"))
    one = links.join(F.broadcast(start), "source_id", "left_semi").groupBy(F.col("target_id").alias("id")).agg(F.max("strength").alias("strength"))
    second = links.select(F.col("source_id").alias("middle"), "target_id", F.col("strength").alias("more"))
    two = one.join(second, F.col("id") == F.col("middle")).groupBy(F.col("target_id").alias("id")).agg(F.max(F.round(F.col("strength") * F.col("more"), 9)).alias("strength"))
    near = one.withColumn("hops", F.lit(1)).unionByName(two.withColumn("hops", F.lit(2))).join(F.broadcast(first), "id", "left_anti")
    best = near.groupBy("id").agg(F.min(F.struct("hops", (-F.col("strength")).alias("s"))).alias("b")).select("id", "b.hops", (-F.col("b.s")).alias("strength"))
    found = results.join(best, "id", "left")
    boost = F.coalesce(graph_boost(F.col("strength"), F.col("hops"), F.col("explored")), F.lit(1.0))
    return found.withColumn("score", F.col("score") * boost).drop("strength", "explored")


def ppr_blend(results: DataFrame, mass: DataFrame, weight: float = PPR_WEIGHT) -> DataFrame:
    """Results (id, score), the score of those with PageRank mass (id, mass) blended with it, as a share of the greatest."""
    most = mass.agg(F.max("mass").alias("most"))  # one row
    found = results.join(mass, "id", "left").join(F.broadcast(most), F.lit(True), "left")
    share = F.col("mass") / F.greatest("most", F.lit(1e-9))
    return found.select("id", F.when(F.col("mass") > 0, (1 - weight) * F.col("score") + weight * share).otherwise(F.col("score")).alias("score"))


def temporal_intent(terms: list[str]) -> str:
    recent, old = len(RECENT & set(terms)), len(HISTORICAL & set(terms))
    return "recent" if recent > old else "historical" if old > recent else "neutral"


def temporal(age_hours: Column, intent: str) -> Column:
    """1 plus a boost for new (recent), old (historical) or, mildly, new (neutral) content."""
    fresh = F.pow(F.lit(2.0), -age_hours / HALF_LIFE)
    if intent == "recent":
        return 1 + MAX_BOOST * fresh
    if intent == "historical":
        return 1 + MAX_BOOST * (1 - fresh)
    return 1 + MAX_BOOST * NEUTRAL_DECAY * fresh


def hours_between(later: Column, earlier: Column) -> Column:
    """Hours from one time to another; times without a zone are taken in the session's."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 3.6e9


def topic_heat(log: DataFrame, as_of: Column, *, topic: str, weight: str, at: str) -> DataFrame:
    """(topic, heat): weights decayed by e^(-age / 24 h) over the window before ``as_of``."""
    age = hours_between(as_of, F.col(at))
    live = log.withColumn("age", age).filter(F.col("age").between(0, HEAT_HOURS))
    return live.groupBy(F.col(topic).alias("topic")).agg(F.sum(F.col(weight) * F.exp(-F.col("age") / HEAT_DECAY)).alias("heat"))


def selection_boost(log: DataFrame, *, key: str, signal: str, weights: dict[str, float] = SELECTION_WEIGHTS) -> DataFrame:
    """(key, boost): 1 + 0.3 log1p of the weighted number of selections."""
    w = F.lit(UNKNOWN_SIGNAL)
    for name, value in weights.items():
        w = F.when(F.col(signal) == name, value).otherwise(w)
    return log.groupBy(key).agg((1 + 0.3 * F.log1p(F.sum(w))).alias("boost"))


def negation(log: DataFrame, as_of: Column, *, key: str, at: str) -> DataFrame:
    """(key, penalty): rejections of the last 180 days, each 0.1 e^(-days / 60), down to a floor."""
    days = hours_between(as_of, F.col(at)) / 24
    live = log.withColumn("days", days).filter(F.col("days").between(0, REJECTION_WINDOW))
    return live.groupBy(key).agg(F.greatest(F.lit(NEGATION_FLOOR), 1 - F.sum(REJECTION * F.exp(-F.col("days") / REJECTION_DAYS))).alias("penalty"))


def graph_boost(strength: Column, hops: Column, explored: Column) -> Column:
    return (1 + strength * F.pow(F.lit(HOP_DECAY), hops - 1)) * F.when(explored, 1.0).otherwise(DISCOVERY)


def topk(df: DataFrame, score: str, key: str, n: int) -> DataFrame:
    """The ``n`` best rows, ties to the smaller key."""
    return df.orderBy(F.desc(score), key).limit(n)


def lexical(found: DataFrame, terms: list[str], *, source: str, limit: int) -> DataFrame:
    """The best ``limit`` of (doc_id, bm25, matched, length, chars, source) by BM25, coverage, length and authority."""
    score = blend(F.log1p("matched"), F.col("bm25")) * coverage(F.col("matched"), len(terms)) * length_norm(F.col("length"), F.col("chars")) * authority(F.col(source))
    return topk(found.select("doc_id", source, F.round(score, 6).alias("score"), "matched"), "score", "doc_id", limit)


def search(docs: DataFrame, terms: list[str], *, source: str = "source", limit: int = 20) -> DataFrame:
    """The lexical part of the ranking over texts: BM25, coverage, length and authority, best ``limit`` documents."""
    facts = docs.select("doc_id", source, F.length("text").alias("chars"))
    return lexical(bm25(docs, terms).join(facts, "doc_id"), terms, source=source, limit=limit)

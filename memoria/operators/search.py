"""One ranked search: recall over the annotations and the twelve stages that turn it into a final order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing
from ..scratch import materialize
from . import assembly, index, rank

# Fixed value: bits in which the fingerprint of a near document may differ.
NEAR_BITS = 6


@dataclass(frozen=True)
class Corpus:
    """What a search reads. Tables that are None leave their stages out.

    ``annotations`` (doc_id, token, weight), ``facts`` (doc_id, source, chars, path, at, author), ``aspects`` (doc_id and the
    five of index.ASPECTS), ``heat`` (topic, agent, weight, at), ``selections`` (doc_id, signal), ``rejections``
    (doc_id, at), ``links`` (source_id, target_id, strength), ``explored`` (doc_id), ``mass`` (doc_id, mass: PageRank).
    """

    annotations: DataFrame
    facts: DataFrame
    aspects: DataFrame | None = None
    heat: DataFrame | None = None
    selections: DataFrame | None = None
    rejections: DataFrame | None = None
    links: DataFrame | None = None
    explored: DataFrame | None = None
    mass: DataFrame | None = None


def is_file_lookup(terms: list[str]) -> bool:
    """Whether a query names a file: one or two terms, one with a dot, underscore or hyphen. Such a hit is precise already."""
    return 0 < len(terms) <= 2 and any(c in t for t in terms for c in "._-")


def _candidates(corpus: Corpus, terms: list[str]) -> DataFrame:
    """(doc_id, total, n, t0, t1, ...): for every annotated document its number of annotations, the weight of those that are asked for, and whether it has each term."""
    asked = F.col("token").isin(terms)
    flags = [F.max(F.col("token") == F.lit(t)).alias(f"t{i}") for i, t in enumerate(terms)]
    grouped = corpus.annotations.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(asked, F.col("weight"))), F.lit(0.0)).alias("total"), *flags)
    return materialize(grouped, "candidates")


def _heat_factor(log: DataFrame, terms: list[str], agent: str, as_of: Column, flags: list[Column]) -> tuple[DataFrame, Column]:
    """(one row of the terms' heats, the factor of a document that has some of them): up to the cap, by its share of the greatest heat."""
    mine = log.filter(F.col("topic").isin(terms) & ((F.col("agent") == agent) | (F.col("agent") == "*")))
    warm = rank.topic_heat(mine, as_of, topic="topic", weight="weight", at="at")
    row = warm.agg(*[F.coalesce(F.max(F.when(F.col("topic") == t, F.round("heat", 3))), F.lit(0.0)).alias(f"h{i}") for i, t in enumerate(terms)])
    heats = [F.col(f"h{i}") for i in range(len(terms))]
    most = F.greatest(F.lit(-1e300), F.lit(-1e300), *heats)
    held = sum((F.when(f, h).otherwise(0.0) for f, h in zip(flags, heats)), F.lit(0.0))
    return row, F.when(most > 0, 1 + (rank.HEAT_CAP - 1) * F.least(held / most, F.lit(1.0))).otherwise(1.0)


def _equal_aspects(aspects: DataFrame, asked: dict[str, Column | int]) -> DataFrame:
    """(doc_id, matches): aspects that equal the query's; a fingerprint within NEAR_BITS counts as one."""
    near = hashing.hamming(F.col("sem_hash"), F.lit(asked["sem_hash"]).cast("long")) <= NEAR_BITS
    equal = [near if c == "sem_hash" else F.col(c) == F.lit(asked[c]).cast("long") for c in index.ASPECTS]
    return aspects.select("doc_id", sum((F.when(e, 1).otherwise(0) for e in equal), F.lit(0)).alias("matches"))


def query_aspects(df: DataFrame) -> dict[str, int]:
    """The five aspects of a query, which is the one row of ``df`` (doc_id, text, source, lang)."""
    return index.aspects(df).select(*index.ASPECTS).first().asDict()


def ranked_search(corpus: Corpus, terms: list[str], *, as_of: Column, agent: str = "*", asked: dict[str, int] | None = None, limit: int = 10, fetch: int | None = None) -> DataFrame:
    """(doc_id, score, cross_agent): the ``limit`` best documents for the terms.

    Recall is log1p of the summed weights; ``fetch`` keeps that many of the best by it, None all. Then, in this order: coverage, topic
    heat, BM25 over annotations (not for file lookups), converging aspects, length, PageRank mass or else distance
    in the link graph from the five best of recall, temporal intent, selections, rejections, source authority and code
    intent; last, for a named agent, up to five documents of other authors are added. Scores are rounded to nine
    digits, ties go to the smaller id. Terms are lowered and counted once; without any there are no results, as for terms that no
    document has. Documents without facts take part with neutral ones; null weights count 0.
    """
    terms = list(dict.fromkeys(t.lower().strip() for t in terms if t and t.strip()))
    spark = corpus.annotations.sparkSession
    if not terms:
        return spark.createDataFrame([], f"doc_id {dict(corpus.annotations.dtypes)['doc_id']}, score double, cross_agent boolean")
    every = _candidates(corpus, terms)
    flags = [F.col(f"t{i}") for i in range(len(terms))]
    # One row each: the corpus, and the heats of the terms.
    stats = every.agg(F.avg("n").alias("avg_n"), *[F.count_if(f).alias(f"df{i}") for i, f in enumerate(flags)]).crossJoin(F.broadcast(corpus.facts.agg(F.count(F.lit(1)).alias("docs"))))
    some = F.lit(False)
    for f in flags:
        some = some | f
    found = every.filter(some).withColumn("score", F.log1p(F.greatest("total", F.lit(0.0))))
    if fetch is not None:
        found = rank.topk(found.withColumn("total", F.round("total", 9)), "total", "doc_id", fetch)
    seeds = rank.topk(found.select("doc_id", F.round("total", 9).alias("total")), "total", "doc_id", rank.SEEDS)

    facts = corpus.facts.select("doc_id", "source", "chars", "path", "at", "author")
    found = found.join(facts, "doc_id", "left").crossJoin(F.broadcast(stats))
    score = F.col("score") * rank.coverage(sum((F.when(f, 1).otherwise(0) for f in flags), F.lit(0)), len(terms))
    if corpus.heat is not None:
        heats, factor = _heat_factor(corpus.heat, terms, agent, as_of, flags)
        found, score = found.crossJoin(F.broadcast(heats)), score * factor
    if not is_file_lookup(terms):
        one = F.lit(1)
        lexical = sum((F.when(f, rank.bm25_term(one, F.col(f"df{i}"), F.col("docs"), F.col("n"), F.col("avg_n"))).otherwise(0.0) for i, f in enumerate(flags)), F.lit(0.0))
        score = rank.blend(score, lexical)
    if corpus.aspects is not None and asked:
        found = found.join(_equal_aspects(corpus.aspects, asked), "doc_id", "left")
        score = score * rank.convergence(F.coalesce("matches", F.lit(0)))
    score = score * rank.length_norm(F.col("n"), F.coalesce("chars", F.lit(0)))
    found = found.withColumn("score", score)
    if corpus.mass is not None:
        # Named apart, so that a corpus may call its ids what it likes.
        blended = rank.ppr_blend(found.select(F.col("doc_id").alias("id"), "score"), corpus.mass.select(F.col("doc_id").alias("id"), "mass"))
        found = found.drop("score").join(blended.withColumnRenamed("id", "doc_id"), "doc_id")
    elif corpus.links is not None:
        explored = corpus.explored.select("doc_id", F.lit(True).alias("explored")).distinct() if corpus.explored is not None else seeds.select("doc_id", F.lit(False).alias("explored")).limit(0)
        ids = found.join(explored, "doc_id", "left").select(F.col("doc_id").alias("id"), "score", F.coalesce("explored", F.lit(False)).alias("explored"))
        boosted = rank.graph_distance(ids, corpus.links, start=seeds.select(F.col("doc_id").alias("id"))).select(F.col("id").alias("doc_id"), "score")
        found = found.drop("score").join(boosted, "doc_id")

    score = F.col("score") * F.coalesce(rank.temporal(rank.hours_between(as_of, F.col("at")), rank.temporal_intent(terms)), F.lit(1.0))
    if corpus.selections is not None:
        found = found.join(rank.selection_boost(corpus.selections, key="doc_id", signal="signal"), "doc_id", "left")
        score = score * F.coalesce("boost", F.lit(1.0))
    if corpus.rejections is not None:
        found = found.join(rank.negation(corpus.rejections, as_of, key="doc_id", at="at"), "doc_id", "left")
        score = score * F.coalesce("penalty", F.lit(1.0))
    score = score * rank.authority(F.coalesce("source", F.lit(""))) * rank.code_boost(F.coalesce("path", F.lit("")), terms)
    found = found.select("doc_id", F.round(score, 9).alias("score"))
    if agent and agent != "*":
        found = assembly.inject_others(found, corpus.annotations, corpus.facts.select("doc_id", "author"), terms, agent)
    else:
        found = found.withColumn("cross_agent", F.lit(False))
    return rank.topk(found.select("doc_id", "score", "cross_agent"), "score", "doc_id", limit)

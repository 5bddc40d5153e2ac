"""What a disclosure session shows in each of its layers, and who of a search starts it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import COHORT, worst_state

# How many are shown in layers 1 to 3, and how much of each text. Layer 1 takes ten ends of links, two for each link.
LAYER_ONE_LINKS, LAYER_TWO, LAYER_THREE = 5, 5, 8
SUMMARY_CHARS, VERBATIM_CHARS = 200, 500
SHOWN = ["active", "soft_suppressed"]


def link_states(links: DataFrame) -> DataFrame:
    """(summary_id, state): the worst state of the links at either end of it."""
    ends = links.select(F.explode(F.array("source_id", "target_id")).alias("summary_id"), "link_state")
    return ends.groupBy("summary_id").agg(worst_state(F.col("link_state")).alias("state"))


def layer_zero(seeds: DataFrame, links: DataFrame, rejected: DataFrame) -> DataFrame:
    """(session, summary_id, score, state, place, cohort) of each session's seeds (session, summary_id, score), best first, in cohorts of three.

    Rejected ones (session, summary_id) and those once thought go; of the softly suppressed ones a half, by the SHA-256 of session and id, stays.
    """
    kept = seeds.join(rejected.select("session", "summary_id").distinct(), ["session", "summary_id"], "left_anti").join(link_states(links), "summary_id", "left")
    state = F.coalesce("state", F.lit("active"))
    digest = F.sha2(F.concat("session", F.col("summary_id").cast("string")).cast("binary"), 256)
    even = F.substring(digest, -1, 1).isin(*"02468ace")
    kept = kept.filter((state != "once_thought") & ((state != "soft_suppressed") | even)).withColumn("state", state)
    place = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("score"), "summary_id"))
    return kept.select("session", "summary_id", "score", "state", place.alias("place"), (F.floor((place - 1) / COHORT) + 1).cast("int").alias("cohort"))


def layer_candidates(asked: DataFrame, links: DataFrame, summaries: DataFrame, verbatim: DataFrame, rejected: DataFrame) -> DataFrame:
    """(session, layer, parent_id, summary_id, kind, preview, place) for the layers 1 to 3 that sessions open (session, layer, parent_id).

    Layer 1: both ends of the parent's five strongest links that are shown and explored or of shared annotations. Layer 2: five
    texts of the parent's source. Layer 3: the targets of its eight strongest unexplored links. Rejected ones and
    the parent itself are taken out afterwards, as a page that was cut before. Ties go to the smaller ids.
    """
    shown = links.filter(F.col("link_state").isin(SHOWN))
    gone = rejected.select("session", "summary_id").distinct()
    parts = asked.select("session", "layer", "parent_id").distinct()
    named = summaries.select(F.col("id").alias("summary_id"), F.substring(F.coalesce("content", F.lit("")), 1, SUMMARY_CHARS).alias("preview"))

    def best(found: DataFrame, most: int, *order: F.Column) -> DataFrame:
        return found.withColumn("place", F.row_number().over(Window.partitionBy("session", "layer", "parent_id").orderBy(*order))).filter(F.col("place") <= most)

    strongest = (F.desc("strength"), F.asc("source_id"), F.asc("target_id"))
    first = shown.filter("explored OR link_type = 'shared_annotation'")
    ends = first.select(F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("parent_id"), "source_id", "target_id", "strength")
    one = best(parts.filter("layer = 1").join(ends, "parent_id"), LAYER_ONE_LINKS, *strongest)
    one = one.select("session", "layer", "parent_id", F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("summary_id"), "place").filter("summary_id <> parent_id")
    one = one.groupBy("session", "layer", "parent_id", "summary_id").agg(F.min("place").alias("place"))
    one = one.join(gone, ["session", "summary_id"], "left_anti").join(named, "summary_id").select("session", "layer", "parent_id", "summary_id", F.lit("summary").alias("kind"), "preview", "place")

    sources = summaries.select(F.col("id").alias("parent_id"), "source")
    texts = verbatim.select(F.col("id").alias("text_id"), "source", F.substring(F.coalesce("content", F.lit("")), 1, VERBATIM_CHARS).alias("preview"))
    # The first five of a source are found once, however many sessions ask for them.
    texts = texts.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy("text_id"))).filter(F.col("place") <= LAYER_TWO)
    two = parts.filter("layer = 2").join(sources, "parent_id").join(texts, "source").select("session", "layer", "parent_id", F.col("text_id").alias("summary_id"), F.lit("verbatim").alias("kind"), "preview", "place")

    hidden = shown.filter("NOT explored").select(F.col("source_id").alias("parent_id"), "source_id", "target_id", "strength")
    three = best(parts.filter("layer = 3").join(hidden, "parent_id"), LAYER_THREE, *strongest).withColumnRenamed("target_id", "summary_id")
    three = three.join(gone, ["session", "summary_id"], "left_anti").join(named, "summary_id").select("session", "layer", "parent_id", "summary_id", F.lit("hidden_link").alias("kind"), "preview", "place")
    return one.unionByName(two).unionByName(three)

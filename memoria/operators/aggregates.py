"""Roll-ups, profiles and percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Dollars for a million input and output tokens, by price class; others cost what the default does.
PRICES = {"large": (15.0, 75.0), "medium": (3.0, 15.0), "small": (0.8, 4.0), "free": (0.0, 0.0)}
DEFAULT_PRICE = "medium"
ON_TRACK = 0.8


def column_profile(df: DataFrame) -> DataFrame:
    """A row for each column: non-null and distinct counts, share of nulls, least and greatest value, mean. One pass over the table."""
    numeric = {c for c, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")}
    parts = []
    for c in df.columns:
        mean = F.avg(c) if c in numeric else F.lit(None).cast("double")
        parts += [F.count(c).alias(f"{c}|n"), F.countDistinct(c).alias(f"{c}|d"), F.min(c).cast("string").alias(f"{c}|lo"), F.max(c).cast("string").alias(f"{c}|hi"), mean.alias(f"{c}|mean")]
    row = df.agg(F.count(F.lit(1)).alias("|rows"), *parts)
    fields = [
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}|n`").alias("non_null"), F.col(f"`{c}|d`").alias("distinct_values"),
                 F.when(F.col("`|rows`") > 0, 1 - F.col(f"`{c}|n`") / F.col("`|rows`")).alias("null_share"),
                 F.col(f"`{c}|lo`").alias("least"), F.col(f"`{c}|hi`").alias("greatest"), F.col(f"`{c}|mean`").alias("mean"))
        for c in df.columns
    ]
    return row.select(F.explode(F.array(*fields)).alias("p")).select("p.*")


def group_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def spread(df: DataFrame, columns: list[str]) -> DataFrame:
    """dimension, least, greatest, mean, spread and n for each of the columns."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("double").alias("v")) for c in columns])).alias("p")
    return df.select(pairs).select("p.*").groupBy("dimension").agg(F.min("v").alias("least"), F.max("v").alias("greatest"), F.avg("v").alias("mean"), (F.max("v") - F.min("v")).alias("spread"), F.count("v").alias("n"))


def cost(model: Column, input_tokens: Column, output_tokens: Column, prices: dict[str, tuple[float, float]] = PRICES, default: str = DEFAULT_PRICE) -> Column:
    """Dollars for a call, by the price of its model or the default's."""
    rate_in, rate_out = F.lit(prices[default][0]), F.lit(prices[default][1])
    for name, (i, o) in prices.items():
        rate_in, rate_out = F.when(model == name, i).otherwise(rate_in), F.when(model == name, o).otherwise(rate_out)
    return input_tokens / 1e6 * rate_in + output_tokens / 1e6 * rate_out


def usage_rollup(usage: DataFrame) -> DataFrame:
    """calls, tokens and cost in total, by agent and by model: one pass with grouping sets. ``level`` names the set."""
    usage = usage.withColumn("cost", cost(F.col("model"), F.col("input_tokens"), F.col("output_tokens")))
    grouped = usage.groupingSets([[], ["agent"], ["model"]], "agent", "model").agg(
        F.grouping_id("agent", "model").alias("g"), F.count(F.lit(1)).alias("calls"),
        F.sum("input_tokens").cast("double").alias("input_tokens"), F.sum("output_tokens").cast("double").alias("output_tokens"), F.sum("cost").alias("cost"),
    )
    level = F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "agent").otherwise("model")
    return grouped.select(level.alias("level"), F.coalesce("agent", "model", F.lit("*")).alias("name"), "calls", "input_tokens", "output_tokens", "cost")


def budget_status(usage: DataFrame, at: str, limit: float) -> DataFrame:
    """Cost of each month against a budget: on_track below 80 %, over above it, else warning."""
    priced = usage.withColumn("cost", cost(F.col("model"), F.col("input_tokens"), F.col("output_tokens")))
    months = priced.groupBy(F.date_format(at, "yyyy-MM").alias("month")).agg(F.sum("cost").alias("spent"))
    share = F.col("spent") / limit
    return months.select("month", "spent", share.alias("share"), F.when(share < ON_TRACK, "on_track").when(share <= 1, "warning").otherwise("over").alias("status"))


def agent_rollup(log: DataFrame, *, agent: str, action: str, at: str) -> DataFrame:
    """Actions, last activity and the sorted distinct actions of each agent."""
    return log.groupBy(F.col(agent).alias("agent")).agg(F.count(F.lit(1)).alias("actions"), F.max(at).alias("last_active"), F.array_join(F.sort_array(F.collect_set(action)), ",").alias("kinds"))


def freshness(log: DataFrame, as_of: Column, *, key: str, at: str) -> DataFrame:
    """Age, decay (age over a week, up to 1) and state of each key's last activity: decaying above 24 hours, aging above 4."""
    last = log.groupBy(F.col(key).alias("key")).agg(F.max(at).alias("last"))
    hours = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp"))) / 3.6e9
    return last.select("key", hours.alias("gap_hours"), F.least(F.lit(1.0), hours / 168).alias("decay"), F.when(hours > 24, "decaying").when(hours > 4, "aging").otherwise("fresh").alias("state"))


# Entries that the decay of a memory is measured over, the least that tell anything, and hours of a week.
DECAY_WINDOW, DECAY_LEAST, DECAY_HOURS = 50, 5, 168


def context_decay(log: DataFrame, as_of: Column, *, at: str, window: int = DECAY_WINDOW) -> DataFrame:
    """One row: entries looked at, their mean age and the newest one's in hours, decay (mean age over a week, up to 1) and health. Only the latest ``window`` count; under five give a healthy 0."""
    latest = log.select(F.col(at).alias("at")).filter("at IS NOT NULL").orderBy(F.desc("at")).limit(window)
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp"))) / 3.6e9
    row = latest.agg(F.count(F.lit(1)).alias("entries"), F.avg(age).alias("mean_age_hours"), F.min(age).alias("gap_hours"))
    few, gap = F.col("entries") < DECAY_LEAST, F.col("gap_hours")
    return row.select("entries", "mean_age_hours", "gap_hours", F.when(few, 0.0).otherwise(F.least(F.lit(1.0), F.col("mean_age_hours") / DECAY_HOURS)).alias("decay"), F.when(few, "healthy").when(gap > 24, "decaying").when(gap > 4, "aging").otherwise("healthy").alias("health"))


def quorum(votes: DataFrame, *, least: int = 2, ratio: float = 0.67) -> DataFrame:
    """(request, votes, approve_share, status) of (request, approve): pending below ``least`` votes, else by the share."""
    grouped = votes.groupBy("request").agg(F.count(F.lit(1)).alias("votes"), F.avg(F.col("approve").cast("double")).alias("approve_share"))
    s = F.col("approve_share")
    return grouped.withColumn("status", F.when(F.col("votes") < least, "PENDING").when(s >= ratio, "APPROVED").when(1 - s >= ratio, "REJECTED").otherwise("PENDING"))


def by_each(df: DataFrame, keys: list[str], *measures: Column) -> DataFrame:
    """(level, name, n, measures): the rows of each value of each key, in one pass of grouping sets."""
    level = F.coalesce(*[F.when(F.grouping(k) == 0, F.lit(k)) for k in keys])
    found = df.groupingSets([[k] for k in keys], *keys).agg(F.count(F.lit(1)).alias("n"), *measures, level.alias("level"))
    return found.select("level", F.coalesce(*keys).alias("name"), *[c for c in found.columns if c not in ("level", *keys)])


def tool_usage(calls: DataFrame) -> DataFrame:
    """Calls, failures and total time of each tool."""
    return calls.groupBy("tool").agg(F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("ok")).alias("failures"), F.sum("ms").alias("total_ms"))


def count_map(df: DataFrame, key: str, kind: str) -> DataFrame:
    """(key, counts): for each key a map from kind to the number of rows; rows are counted before they meet."""
    counted = df.groupBy(F.col(key).alias("key"), F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("kind", "n"))).alias("counts"))

"""Positions, running sums and percentiles within groups of any size, over ranges of the sort order.

A window sorts all rows of a group in one task. Here rows are dealt out by ranges of (group, order), so that a large
group spans many tasks; each range counts for itself, and the counts of the ranges before it are added afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize

#: Bits of a row's number within its range, in the ids that Spark gives: above them stands the range.
_ROW_BITS = 33


def positions(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, str | Column] | None = None) -> DataFrame:
    """``df`` with ``_position`` (from 0) and ``_count`` of each row in its group, and for each of ``sums`` its running total over the rows before (``_before_<name>``) and over the group (``_total_<name>``).

    ``order`` names columns, a descending one with a minus before it; it should tell rows of a group apart, and rows that it leaves equal keep some order, and many of them
    meet in one range. Null keys are a group like others; a null amount counts 0. No group is held in one task.
    An empty table stays empty. Columns of ``df`` keep their names, whatever they are, but for those of the result.
    """
    sums = sums or {}
    made = ["_position", "_count", *[f"_before_{k}" for k in sums], *[f"_total_{k}" for k in sums]]
    by, sort, amounts = [f"k{i}" for i in range(len(keys))], [f"o{i}" for i in range(len(order))], {k: f"a{i}" for i, k in enumerate(sums)}
    column = lambda c: F.col(f"`{c}`") if isinstance(c, str) else c
    row = F.struct(*[column(c) for c in df.columns if c not in made])
    rows = df.select(row.alias("row"), *[column(c).alias(k) for k, c in zip(by, keys)], *[column(c.removeprefix("-")).alias(o) for o, c in zip(sort, order)], *[F.coalesce(column(sums[k]), F.lit(0)).alias(a) for k, a in amounts.items()])
    directed = [*map(F.col, by), *[F.desc(o) if c.startswith("-") else F.asc(o) for o, c in zip(sort, order)]]
    ranged = rows.repartitionByRange(*directed).sortWithinPartitions(*directed).drop(*sort).withColumn("id", F.monotonically_increasing_id())
    # Written once: the ids would not be the same if the ranges were drawn again.
    ranged = materialize(ranged, "ranges").withColumn("range", F.shiftright("id", _ROW_BITS))
    chunks = ranged.groupBy(*by, "range").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"), *[F.sum(a).alias(a) for a in amounts.values()])
    # A row for each range that a group has part in.
    before = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = chunks.select(
        *[F.col(k).alias(f"at_{k}") for k in by], F.col("range").alias("at"), "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skipped"), F.sum("n").over(whole).alias("_count"),
        *[F.coalesce(F.sum(a).over(before), F.lit(0)).alias(f"skipped_{a}") for a in amounts.values()], *[F.sum(a).over(whole).alias(f"_total_{k}") for k, a in amounts.items()],
    )
    local = Window.partitionBy(*by, "range").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    for a in amounts.values():
        ranged = ranged.withColumn(f"local_{a}", F.coalesce(F.sum(a).over(local), F.lit(0)))
    same = F.col("range") == F.col("at")
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"at_{k}"))
    placed = ranged.join(offsets, same)
    return placed.select(
        "row.*", (F.col("skipped") + F.col("id") - F.col("first")).alias("_position"), "_count",
        *[(F.col(f"skipped_{a}") + F.col(f"local_{a}")).alias(f"_before_{k}") for k, a in amounts.items()], *[F.col(f"_total_{k}") for k in sums],
    )


def percentiles(df: DataFrame, value: str, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """For each group the value at position min(int(share * n), n - 1), from 0, of its sorted values, and n. Nulls do not count.

    Equal values are counted before anything is sorted, so a value in very many rows is one row; the distinct ones are
    placed over ranges.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_value")).agg(F.count(F.lit(1)).alias("_times"))
    placed = positions(counted, keys, ["_value"], {"times": "_times"})
    n, at = F.col("_total_times"), F.col("_before_times")
    picks = []
    for name, p in shares.items():
        spot = F.least(F.floor(n * p), n - 1)
        picks.append(F.max(F.when((at <= spot) & (spot < at + F.col("_times")), F.col("_value"))).alias(name))
    return placed.groupBy(*keys).agg(*picks, F.max("_total_times").alias("n"))

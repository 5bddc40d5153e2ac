"""Operator 2: size-balanced sharding by sampled splitters, in DataFrame operations only."""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialize

SHARDS = 24
#: Ranges for each shard; a window task sorts one range, so this bounds what a task holds.
RANGES_PER_SHARD = 32
#: Sampled keys for each range.
SAMPLES_PER_RANGE = 12
#: A group of equal texts stays in one shard up to this part of a shard's size.
WHOLE_GROUP = 0.05
_LOW = -(1 << 63)


def _splitters(keys: list[tuple[int, int, float]], ranges: int) -> list[tuple[int, int]]:
    """Weighted quantiles of sorted (hash, id, weight). A splitter begins at its hash's first id unless the hash spans several ranges."""
    total, seen, out = sum(k[2] for k in keys), 0.0, []
    for h, i, w in keys:
        if seen >= total * (len(out) + 1) / ranges and len(out) < ranges - 1:
            out.append((h, i))
        seen += w
    hot = {a[0] for a, b in zip(out, out[1:]) if a[0] == b[0]}
    return sorted({x for h, i in out for x in ([(h, i), (h, _LOW)] if h in hot else [(h, _LOW)])})


def _locate(splitters: list[tuple[int, int]]) -> F.Column:
    """The number of splitters at or below (h, id), by binary search within one expression."""
    if not splitters:
        return F.lit(0)
    bounds = ", ".join(f"struct({h}L, {i}L)".replace(f"{_LOW}L", "-9223372036854775807L - 1L") for h, i in splitters)
    n, steps = len(splitters), []
    step = 1 << (n.bit_length() - 1)
    while step:
        steps.append(str(step))
        step >>= 1
    return F.expr(
        f"aggregate(array({', '.join(steps)}), 0, (at, step) -> if(at + step <= {n} AND "
        f"struct(h, id) >= element_at(array({bounds}), least(at + step, {n})), at + step, at))"
    )


def shard_by_size(df: DataFrame, *, shards: int = SHARDS, text: str = "text", key: str = "doc_id", salt: int = 0) -> DataFrame:
    """Give every row of ``df`` a shard of nearly equal bytes and a gapless slot in it.

    Rows are ordered by (hash of the text, key), so equal texts lie together. Size-weighted key samples give
    quantile splitters that cut the order into many ranges (ranges that come out overfull are cut again). Exact
    byte totals of the ranges then place each range in the whole order, and a record's shard follows from the
    bytes before it; a group of equal texts up to WHOLE_GROUP of a shard is placed as one unit, larger groups are cut between records.
    Law: ``bytes``. Any two shards differ by at most one record or whole group at either end.

    Null text counts as no bytes (size 8) and its own group; null keys sort first; identical rows take
    consecutive slots; extra columns of ``df`` are ignored; an empty table gives no rows.
    """
    record = df.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col(text), F.lit(salt)).alias("h"),
        F.coalesce(F.col(key).cast("long"), F.lit(_LOW)).alias("id"),
    )
    record = materialize(record, "records")
    total = record.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()["b"]
    ranges = shards * RANGES_PER_SHARD
    splitters: list[tuple[int, int]] = []
    placed = record.withColumn("range", F.lit(0))
    sizes = {0: total}
    for attempt in range(4):
        # Densities rise with each attempt, and only overfull ranges are sampled again.
        mean = max(1.0, total / ranges)
        over = [r for r, b in sizes.items() if b > 3 * mean] if attempt else [0]
        if not over or not total:
            break
        rate = SAMPLES_PER_RANGE * ranges * 2**attempt / total
        chance = F.pmod(F.xxhash64("id", "h", F.lit(attempt + 1)), F.lit(1 << 30)) / float(1 << 30)
        sample = placed.filter(F.col("range").isin(over)).filter(chance < F.col("size") * rate).select("range", "h", "id", F.greatest(F.lit(1.0), F.col("size") * rate).alias("w"))
        drawn = sorted(tuple(x) for x in sample.collect())  # bounded: about SAMPLES_PER_RANGE keys for each range
        found = set(splitters)
        for r in over:
            mine = [x[1:] for x in drawn[bisect_left(drawn, (r,)) : bisect_left(drawn, (r + 1,))]]
            found.update(_splitters(mine, max(2, round(sizes[r] / mean))))
        if found == set(splitters):
            break
        splitters = sorted(found)
        placed = record.withColumn("range", _locate(splitters))
        sizes = dict(placed.groupBy("range").agg(F.sum("size")).collect())  # a row for each range

    begins, before = [], 0
    for r in range(len(splitters) + 1):
        begins.append(before)
        before += sizes.get(r, 0)
    spark = df.sparkSession
    offsets = spark.createDataFrame(list(enumerate(begins)), "range int, before long")
    # Only a hash that is itself a splitter with an id can be cut by a range's end: those totals are made exactly.
    cut = sorted({h for h, i in splitters if i != _LOW})
    cut_sizes = (
        record.join(F.broadcast(spark.createDataFrame([(h,) for h in cut], "h long")), "h").groupBy("h").agg(F.sum("size").alias("cut_size"))
        if cut else spark.createDataFrame([], "h long, cut_size long")
    )
    order = Window.partitionBy("range").orderBy("h", "id", "text_crc32")
    group = Window.partitionBy("range", "h")
    rows = (
        placed.join(F.broadcast(offsets), "range")
        .join(F.broadcast(cut_sizes), "h", "left")  # at most one row for each splitter
        .withColumn("rn", F.row_number().over(order))
        .withColumn("start", F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("group_size", F.coalesce("cut_size", F.sum("size").over(group)))
        .withColumn("group_start", F.min("start").over(group))
    )
    whole = F.col("group_size") <= WHOLE_GROUP * total / shards
    middle = F.when(whole, F.col("group_start") + F.col("group_size") / 2).otherwise(F.col("start") + F.col("size") / 2)
    rows = rows.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / max(1, total))).cast("int"))
    rows = materialize(rows.select("doc_id", "size", "text_crc32", "shard", "range", "rn"), "placed")
    # A row for each pair of range and shard: at most the ranges plus the shards.
    held = rows.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n"), F.min("rn").alias("first_rn"))
    held = held.withColumn("slots_before", F.sum("n").over(Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    return rows.join(F.broadcast(held.select("shard", "range", "first_rn", "slots_before")), ["shard", "range"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("slots_before") + F.col("rn") - F.col("first_rn")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_size(documents(spark, sf_dir))

"""Scans, joins and set operations in the shapes that the service asks for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def browse(df: DataFrame, order: list[str], *, where: Column | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """One page in a fixed order."""
    df = df.filter(where) if where is not None else df
    return df.orderBy(*order).offset(offset).limit(limit)


def browse_page(df: DataFrame, order: list[str], *, where: Column | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """The page's rows with ``total``, the rows that there are, and ``showing``, as in "21-40 of 300". The total is one row that is counted apart; a page past the end has no rows."""
    found = df.filter(where) if where is not None else df
    total = found.agg(F.count(F.lit(1)).alias("total"))
    page = browse(found, order, limit=limit, offset=offset).crossJoin(F.broadcast(total))
    last = F.least(F.lit(offset + limit).cast("long"), F.col("total"))
    return page.withColumn("showing", F.format_string("%d-%d of %d", F.lit(offset + 1), last, F.col("total")))


def like(column: Column, term: str) -> Column:
    """Substring test without regard to ASCII case; the term's own wildcards are ordinary characters."""
    fold = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.contains(fold(column), fold(F.lit(term)))


def search_tables(tables: dict[str, tuple[DataFrame, str]], term: str) -> DataFrame:
    """(table, column, key, value) of every text column of every table that holds a term. ``tables`` gives a frame and its key by name."""
    found = []
    for name, (df, key) in tables.items():
        columns = [c for c, t in df.dtypes if t == "string"]
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])
        hits = df.select(F.col(key).cast("string").alias("key"), F.explode(F.filter(pairs, lambda p: like(p["value"], term))).alias("p"))
        found.append(hits.select(F.lit(name).alias("table"), "p.column", "key", "p.value"))
    return reduce(DataFrame.unionByName, found)


def band_join(left: DataFrame, right: DataFrame, *, at_left: str, at_right: str, seconds: int, keys: list[str] = ()) -> DataFrame:
    """Pairs whose times differ by at most ``seconds``: rows meet in equal or neighbouring buckets, so the join is an equi-join."""
    bucket = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / seconds)
    a = left.withColumn("_bucket", F.explode(F.array(*[bucket(at_left) + d for d in (-1, 0, 1)])))
    b = right.withColumn("_bucket", bucket(at_right))
    near = F.abs(F.unix_micros(F.col(at_left).cast("timestamp")) - F.unix_micros(F.col(at_right).cast("timestamp"))) <= seconds * 1_000_000
    return a.join(b, ["_bucket", *keys]).filter(near).drop("_bucket")


def either_join(left: DataFrame, key: str, right: DataFrame, first: str, second: str) -> DataFrame:
    """Rows of ``right`` with either column equal to a key, once for each key: two equi-joins instead of one with OR."""
    one = left.join(right, left[key] == right[first])
    return one.union(left.join(right, left[key] == right[second])).distinct()


def compare(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Full outer comparison of two keyed tables: added, deleted, modified or unchanged."""
    a, b = left.select(key, F.col(value).alias("old")), right.select(key, F.col(value).alias("new"))
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "modified").otherwise("unchanged")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def keep_best(frames: list[DataFrame], keys: list[str], score: str) -> DataFrame:
    """The union of several results with each key's best score."""
    return reduce(DataFrame.unionByName, frames).groupBy(*keys).agg(F.max(score).alias(score))


def merge_ordered(first: Column, second: Column) -> Column:
    """Both arrays in order, each value once."""
    return F.array_distinct(F.concat(first, second))


def clean_float(column: Column) -> Column:
    """Null for what is not a finite number."""
    return F.when(F.isnan(column) | (F.abs(column) == float("inf")), F.lit(None)).otherwise(column)


def normal_path(column: Column) -> Column:
    return F.translate(column, "\\", "/")


def live(expires: Column, as_of: Column) -> Column:
    """Without an end, or with one still ahead."""
    return expires.isNull() | (expires > as_of)


def hot(df: DataFrame, as_of: Column, *, at: str, key: str, days: int = 30, most: int) -> DataFrame:
    """The rows of the last ``days``, the newest ``most`` of them."""
    return df.filter(F.col(at) >= as_of - F.expr(f"INTERVAL {days} DAYS")).orderBy(F.desc(at), F.desc(key)).limit(most)


def resurfaces(as_of: Column, due_at: Column, shown_at: Column, days: Column) -> Column:
    """Whether a reminder that is due has not been shown yet, or not for its interval."""
    since = (F.unix_micros(as_of) - F.unix_micros(shown_at.cast("timestamp"))) / 86_400_000_000
    return (due_at <= as_of) & F.coalesce(since >= days, F.lit(True))

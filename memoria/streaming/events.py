"""Event streams: the batch twins and their Structured Streaming forms."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.conversation import RATE_MESSAGES, RATE_SECONDS
from ..operators.fold import ordered_fold

LATE = "1 hour"


def read(spark: SparkSession, folder: str, schema: str, files: int = 1) -> DataFrame:
    """A stream of Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def sessions(events: DataFrame, *, key: str = "user_id", at: str = "ts", gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """(key, begin, end, n) of runs of events with gaps below ``gap``; batch, or with ``late`` a stream under that watermark. The end is also when a debounced action fires."""
    events = events.withColumn("_at", F.col(at).cast("timestamp"))
    if late:
        events = events.withWatermark("_at", late)
    grouped = events.groupBy(key, F.session_window("_at", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(key, F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n")


def heat(events: DataFrame, *, topic: str = "event_type", weight: str = "value", at: str = "ts", window: str = "1 day", slide: str | None = None, late: str | None = None) -> DataFrame:
    """(topic, begin, weight, n) over tumbling or sliding windows."""
    events = events.withColumn("_at", F.col(at).cast("timestamp"))
    if late:
        events = events.withWatermark("_at", late)
    grouped = events.groupBy(F.col(topic).alias("topic"), F.window("_at", window, slide or window).alias("w"))
    return grouped.agg(F.sum(weight).alias("weight"), F.count(F.lit(1)).alias("n")).select("topic", F.col("w.start").alias("begin"), "weight", "n")


_DECISION = "agent string, key long, at timestamp, accepted boolean"


def rate_limit(events: DataFrame, *, agent: str, key: str, at: str, most: int = RATE_MESSAGES, seconds: int = RATE_SECONDS) -> DataFrame:
    """Decisions of the sliding limiter on a stream: state is the times of an agent's accepted messages, ``most`` at most.

    Events of one micro-batch are taken in order of time; an agent's state goes after ``seconds`` of event time.
    """
    def decide(names: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        live = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["at", "key"])
        accepted = []
        for t in rows["at"].astype("datetime64[us]").astype("int64"):
            live = [x for x in live if x >= t - seconds * 1_000_000]
            accepted.append(len(live) < most)
            if accepted[-1]:
                live.append(int(t))
        state.update((live,))
        last = int(rows["at"].astype("datetime64[us]").astype("int64").max()) // 1000 + seconds * 1000
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"agent": names[0], "key": rows["key"], "at": rows["at"], "accepted": accepted})

    rows = events.select(F.col(agent).cast("string").alias("agent"), F.col(key).cast("long").alias("key"), F.col(at).cast("timestamp").alias("at")).withWatermark("at", LATE)
    return rows.groupBy("agent").applyInPandasWithState(decide, _DECISION, "live array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def cooldown(events: DataFrame, *, key: str = "path", at: str = "ts", ok: str = "ok", seconds: int = 30) -> DataFrame:
    """Batch: events of each key that come at least ``seconds`` after the last successful ingest of it. Only accepted and successful ones start a new rest."""
    kind = dict(events.dtypes)[key]
    rows = events.select(F.col(key).alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("t"), F.col(ok).alias("ok"))

    def step(last: list, row: dict) -> tuple[list, dict]:
        free = not last or row["t"] - last[0] >= seconds * 1_000_000
        return [row["t"]] if free and row["ok"] else last, {"key": row["key"], "t": row["t"], "accepted": free}

    out = ordered_fold(rows, ["key"], ["t"], list, step, f"key {kind}, t long, accepted boolean")
    return out.select("key", F.timestamp_micros("t").alias("ts"), "accepted")


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process what a stream has now and return it as a table; for tests and small jobs, the sink is in memory."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)

"""Small machines that fold the ordered rows of a key, run over a table or, with their state kept between micro-batches, over a stream.

A machine has ``step(row)``, which returns rows to emit, ``finish()`` for what is left when the key ends, ``save()`` (a
JSON text) and ``load(text)``. Rows are dicts with ``at`` in microseconds.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import _parse_datatype_string

from ..operators.rank import HEAT_DECAY, HEAT_HOURS

SECOND = 1_000_000
HOUR = 3600 * SECOND
LATE = "1 hour"

# When text is handed on.
LEAST_SENTENCE, FLUSH_MICROS, FLUSH_CHARS, FLUSH_WORDS = 4, 2 * SECOND, 20, 30
# How long a session lives from its start, and the deepest layer.
SESSION_MICROS, DEEPEST = HOUR, 3
# Rest after the last event of a path, and after it was taken in.
DEBOUNCE_MICROS, COOLDOWN_MICROS = 3 * SECOND, 30 * SECOND


def over_table(rows: DataFrame, order: list[str], machine: Callable[[], object], schema: str) -> DataFrame:
    """The machine over each key's rows (``key``, ``at`` timestamp, others) in the order of ``at`` and ``order``. A task holds one state, however long a key's run of rows is."""
    fields = to_arrow_schema(_parse_datatype_string(schema))
    rows = rows.withColumn("at", F.unix_micros(F.col("at").cast("timestamp"))).repartition("key").sortWithinPartitions("key", "at", *order)

    def run(batches):
        key, now = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if now is None or row["key"] != key:
                    out += [r | {"key": key} for r in now.finish()] if now is not None else []
                    key, now = row["key"], machine()
                out += [r | {"key": key} for r in now.step(row)]
            yield pa.RecordBatch.from_pylist(out, fields)
        if now is not None:
            yield pa.RecordBatch.from_pylist([r | {"key": key} for r in now.finish()], fields)

    return rows.mapInArrow(run, schema)


def over_stream(rows: DataFrame, order: list[str], machine: Callable[[], object], schema: str, *, live: int, late: str = LATE) -> DataFrame:
    """The machine over a stream with the same columns. A key's state ends ``live`` microseconds of event time after ``machine.since()``: what ``finish`` returns is emitted then.

    Rows of one micro-batch are taken in the order of ``at`` and ``order``; those that come later than the watermark are left out by Spark.
    """
    kinds = to_arrow_schema(_parse_datatype_string(schema))
    names = kinds.names

    def framed(key, made: list[dict]) -> pd.DataFrame:
        return pa.Table.from_pylist([r | {"key": key} for r in made], kinds).to_pandas()[names]

    def handle(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = machine()
        if state.exists:
            now.load(state.get[0])
        if state.hasTimedOut:
            state.remove()
            yield framed(keys[0], now.finish())
            return
        got = pd.concat(list(frames))
        got["at"] = got["at"].astype("datetime64[us]").astype("int64")
        made = []
        for row in got.sort_values(["at", *order], na_position="first").to_dict("records"):
            made += now.step({k: None if v is None or v is pd.NaT or isinstance(v, float) and math.isnan(v) else v for k, v in row.items()})
        state.update((now.save(),))
        state.setTimeoutTimestamp(max((now.since() + live) // 1000, state.getCurrentWatermarkMs() + 1))
        yield framed(keys[0], made)

    return rows.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late).groupBy("key").applyInPandasWithState(handle, schema, "saved string", "append", GroupStateTimeout.EventTimeTimeout)


# -- text that comes in pieces --------------------------------------------------------------------

_BOUNDARY = re.compile(r"(.*?[.!?])\s+(.*)", re.S)
SENTENCES = "key string, n long, kind string, content string"


class SentenceBuffer:
    """Pieces of a text become sentences as soon as they end; thinking blocks are dropped, also where they span pieces.

    A buffer of over 20 characters is handed on up to its last word two seconds after the last text, or at 30 words.
    Time is that of the pieces. ``finish`` hands on the rest and says that the text is done.
    """

    def __init__(self):
        self.buffer, self.thinking, self.said, self.last, self.n = "", False, None, 0, 0

    def save(self) -> str:
        return json.dumps([self.buffer, self.thinking, self.said, self.last, self.n])

    def load(self, text: str) -> None:
        self.buffer, self.thinking, self.said, self.last, self.n = json.loads(text)

    def since(self) -> int:
        return self.last

    def _emit(self, content: str | None, kind: str = "text") -> list[dict]:
        self.n += 1
        return [{"n": self.n, "kind": kind, "content": content}]

    def _flush(self, at: int) -> list[dict]:
        words, _, rest = self.buffer.lstrip().rpartition(" ")
        if not words:  # one word that may not be whole
            return []
        self.buffer = rest
        if not words.strip():
            return []
        self.said = at
        return self._emit(words.strip())

    def step(self, row: dict) -> list[dict]:
        at, piece = row["at"], row["text"]
        self.said, self.last = at if self.said is None else self.said, at
        if not piece:
            return []
        while piece:
            mark = "</think>" if self.thinking else "<think>"
            before, found, piece = piece.partition(mark)
            self.buffer += "" if self.thinking else before
            self.thinking ^= bool(found)
        if self.thinking:
            return []
        out = []
        while match := _BOUNDARY.match(self.buffer):
            sentence, self.buffer = match[1].strip(), match[2]
            if len(sentence) < LEAST_SENTENCE:
                self.buffer = f"{sentence} {self.buffer}"
                break
            out += self._emit(sentence)
            self.said = at
        if (len(self.buffer) > FLUSH_CHARS and at - self.said > FLUSH_MICROS) or len(self.buffer.split()) >= FLUSH_WORDS:
            out += self._flush(at)
        return out

    def finish(self) -> list[dict]:
        rest = self.buffer.strip()
        self.buffer = ""
        return (self._emit(rest) if rest else []) + self._emit(None, "done")


def _pieces(df: DataFrame, key: str, at: str, text: str, order: str) -> DataFrame:
    return df.select(F.col(key).cast("string").alias("key"), F.col(at).alias("at"), F.col(order).cast("long").alias("place"), F.col(text).alias("text"))


def sentences(df: DataFrame, *, key: str, at: str, text: str, order: str, live: str | None = None) -> DataFrame:
    """(key, n, kind, content) of each key's pieces in the order of time and ``order``; over a stream where ``live`` names seconds of silence after which a text is done. Null pieces are empty."""
    rows = _pieces(df, key, at, text, order)
    if live is None:
        return over_table(rows, ["place"], SentenceBuffer, SENTENCES)
    return over_stream(rows, ["place"], SentenceBuffer, SENTENCES, live=int(float(live) * SECOND))


# -- sessions that disclose in layers -------------------------------------------------------------

STEPS = "key string, at timestamp, summary_id long, response string, layer int, opened int, explored int, ignored int, rejected int, status string"


class DisclosureSession:
    """A session of an hour from its first event: each answer is taken at the current layer; an exploring one opens the next, down to the third.

    An answer after the hour is ``expired`` and changes nothing; one that is none of explore, ignore, reject is ``refused``, and ``start`` begins a session
    where there is none. An answer without a session is ``unknown``.
    """

    def __init__(self):
        self.began, self.layer, self.seen = None, 0, {"explore": [], "ignore": [], "reject": []}

    def save(self) -> str:
        return json.dumps([self.began, self.layer, self.seen])

    def load(self, text: str) -> None:
        self.began, self.layer, self.seen = json.loads(text)

    def since(self) -> int:
        return self.began if self.began is not None else 0

    def step(self, row: dict) -> list[dict]:
        at, response, who, opened = row["at"], row["response"], row["summary_id"], None
        layer = self.layer
        if self.began is not None and at - self.began > SESSION_MICROS and response == "start":
            self.__init__()
            layer = 0
        if response == "start":
            status = "open" if self.began is None else "running"
            self.began = at if self.began is None else self.began
            opened = 0 if status == "open" else None
        elif self.began is None:
            status = "unknown"
        elif at - self.began > SESSION_MICROS:
            status = "expired"
        elif response not in self.seen:
            status = "refused"
        else:
            status = "taken"
            if who is not None and who not in self.seen[response]:
                self.seen[response].append(int(who))
            if response == "explore":
                if self.layer < DEEPEST:
                    self.layer = opened = self.layer + 1
                else:
                    status = "deepest"
        counts = {f"{k}{'d' if k[-1] == 'e' else 'ed'}": len(v) for k, v in self.seen.items()}
        return [{"at": pd.Timestamp(at, unit="us", tz="UTC"), "summary_id": None if who is None else int(who), "response": response, "layer": layer, "opened": opened, "status": status, **counts}]

    def finish(self) -> list[dict]:
        return []


def disclosure(df: DataFrame, *, session: str, at: str, summary: str, response: str, stream: bool = False) -> DataFrame:
    """What each answer did to its session: its layer before, the layer that it opened (null: none), ids answered so far by kind, and a status. A session's state goes an hour after it began."""
    rows = df.select(F.col(session).cast("string").alias("key"), F.col(at).alias("at"), F.col(summary).cast("long").alias("summary_id"), F.col(response).alias("response"))
    if stream:
        return over_stream(rows, ["summary_id", "response"], DisclosureSession, STEPS, live=SESSION_MICROS)
    return over_table(rows, ["summary_id", "response"], DisclosureSession, STEPS)


# -- heat that fades ------------------------------------------------------------------------------

HEAT = "key string, as_of timestamp, heat double"


class Heat:
    """Weights that fade by e^(-age / 24 h), over the 168 hours before the end of the current one.

    One sum for each hour is kept, faded to the hour's end, so 168 numbers stand for any number of events. After
    each event, or run of events of an hour, the heat at the end of its hour is emitted.
    """

    def __init__(self):
        self.hours: dict[int, float] = {}
        self.latest = 0

    def save(self) -> str:
        return json.dumps([[[h, x] for h, x in self.hours.items()], self.latest])

    def load(self, text: str) -> None:
        hours, self.latest = json.loads(text)
        self.hours = {h: x for h, x in hours}

    def since(self) -> int:
        return (self.latest + 1) * HOUR

    def step(self, row: dict) -> list[dict]:
        hour = row["at"] // HOUR
        self.latest = max(self.latest, hour)
        end = self.latest + 1
        self.hours[hour] = self.hours.get(hour, 0.0) + (row["weight"] or 0.0) * math.exp(-((hour + 1) * HOUR - row["at"]) / HOUR / HEAT_DECAY)
        self.hours = {h: x for h, x in self.hours.items() if h >= end - HEAT_HOURS}
        heat = sum(x * math.exp(-(end - h - 1) / HEAT_DECAY) for h, x in self.hours.items())
        return [{"as_of": pd.Timestamp(end * HOUR, unit="us", tz="UTC"), "heat": heat}]

    def finish(self) -> list[dict]:
        return []


def heat(df: DataFrame, *, topic: str, at: str, weight: str, stream: bool = False) -> DataFrame:
    """(key, as_of, heat) after each event of a topic: what topic_heat gives at the end of the event's hour for the events so far."""
    rows = df.select(F.col(topic).cast("string").alias("key"), F.col(at).alias("at"), F.col(weight).cast("double").alias("weight"))
    if stream:
        return over_stream(rows, ["weight"], Heat, HEAT, live=HEAT_HOURS * HOUR)
    return over_table(rows, ["weight"], Heat, HEAT)


def heat_series(df: DataFrame, *, topic: str, at: str, weight: str, step_hours: int = 24) -> DataFrame:
    """(topic, as_of, heat) at every ``step_hours``: faded sums of each hour, counted once in their tasks, meet the few times that they are still warm at.

    Times run from the end of a topic's first step to that at which its last event has gone cold.
    """
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    rows = df.select(F.col(topic).alias("topic"), micros.alias("t"), F.col(weight).alias("w")).filter("t IS NOT NULL")
    # Hours end with an event on the hour; such an event is warm for an hour of age 168 more than those before it.
    rows = rows.withColumn("hour", F.ceil(F.col("t") / HOUR)).withColumn("edge", F.col("t") % HOUR == 0)
    fade = F.exp(-(F.col("hour") * HOUR - F.col("t")) / HOUR / HEAT_DECAY)
    faded = rows.groupBy("topic", "hour", "edge").agg(F.sum(F.col("w") * fade).alias("sum"))
    first, last = F.ceil(F.col("hour") / step_hours), F.floor((F.col("hour") + HEAT_HOURS - F.when(F.col("edge"), 0).otherwise(1)) / step_hours)
    warm = faded.filter(first <= last).select("topic", "hour", "sum", F.explode(F.sequence(first, last)).alias("k"))
    aged = F.exp(-(F.col("k") * step_hours - F.col("hour")) / HEAT_DECAY)
    found = warm.groupBy("topic", (F.col("k") * step_hours).alias("at_hour")).agg(F.sum(F.col("sum") * aged).alias("heat"))
    return found.select("topic", F.timestamp_micros(F.col("at_hour") * HOUR).alias("as_of"), "heat")


# -- files ----------------------------------------------------------------------------------------

GATE = "key string, at timestamp, hash string, decision string"


class FileGate:
    """Events of a path, taken in three seconds after the last of a run, unless it was taken in within 30 seconds before (``cooldown``) or its content is as it was (``unchanged``)."""

    def __init__(self):
        self.pending, self.hash, self.taken, self.ingested = None, None, None, None

    def save(self) -> str:
        return json.dumps([self.pending, self.hash, self.taken, self.ingested])

    def load(self, text: str) -> None:
        self.pending, self.hash, self.taken, self.ingested = json.loads(text)

    def since(self) -> int:
        return self.pending if self.pending is not None else 0

    def _fire(self) -> list[dict]:
        at, self.pending = self.pending + DEBOUNCE_MICROS, None
        if self.taken is not None and at - self.taken < COOLDOWN_MICROS:
            decision = "cooldown"
        elif self.ingested == self.hash:
            decision = "unchanged"
        else:
            decision, self.taken, self.ingested = "ingest", at, self.hash
        return [{"at": pd.Timestamp(at, unit="us", tz="UTC"), "hash": self.hash, "decision": decision}]

    def step(self, row: dict) -> list[dict]:
        out = self._fire() if self.pending is not None and row["at"] - self.pending >= DEBOUNCE_MICROS else []
        self.pending, self.hash = row["at"], row["hash"]
        return out

    def finish(self) -> list[dict]:
        return self._fire() if self.pending is not None else []


def file_gate(events: DataFrame, *, path: str = "path", at: str = "at", hash: str = "hash") -> DataFrame:
    """(key, at, hash, decision) of file events in a table, in the order of time for each path; of events at one time the greatest hash is the last."""
    rows = events.select(F.col(path).alias("key"), F.col(at).alias("at"), F.col(hash).alias("hash"))
    return over_table(rows, ["hash"], FileGate, GATE)


# Files that are watched, and how large they may be.
WATCHED, IGNORED, MOST_BYTES = ["*.md", "*.json", "*.txt"], ["*.tmp", "*.swp"], 5 << 20


def named(path: Column, patterns: list[str]) -> Column:
    """Whether a file's name fits a pattern: ``*.x`` by its end, ``.x`` by its beginning, else as a whole; case does not matter."""
    name = F.lower(F.regexp_extract(path, r"([^/\\]*)$", 1))
    out = F.lit(False)
    for p in (p.lower() for p in patterns):
        out = out | (F.endswith(name, F.lit(p[1:])) if p.startswith("*.") else F.startswith(name, F.lit(p)) if p.startswith(".") else name == p)
    return out


def watched(files: DataFrame, *, patterns: list[str] = WATCHED, ignored: list[str] = IGNORED, exclude: list[str] = (), most_bytes: int = MOST_BYTES) -> DataFrame:
    """Rows of a ``binaryFile`` table or stream that are watched, as events: path, at (its modification), hash, text. Empty, blank and large files, and those below an excluded folder, are none."""
    path = F.col("path")
    kept = files.filter(F.col("length").between(1, most_bytes) & named(path, patterns) & ~named(path, ignored))
    for folder in exclude:
        kept = kept.filter(~F.contains(F.lower(path), F.lit(f"/{folder.lower()}/")))
    text = kept.select("path", F.col("modificationTime").alias("at"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    return text.filter(F.trim(F.regexp_replace("text", r"\s+", " ")) != "").select("path", "at", F.sha2(F.col("text").cast("binary"), 256).alias("hash"), "text")


def watch(spark: SparkSession, folder: str, *, files: int = 100, **how) -> DataFrame:
    """A stream of the files that come into a folder or below it. A file stream takes each path once: later contents of a path come by sweeps (see tables.sweep), as events for ``file_gate``."""
    source = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files).load(folder)
    return watched(source, **how)


def ingest_stream(events: DataFrame, *, path: str = "path", at: str = "at", hash: str = "hash", late: str = "10 seconds") -> DataFrame:
    """``file_gate`` over a stream of events. A path's state is kept past its firing, since its cooldown and content outlast it."""
    kinds = to_arrow_schema(_parse_datatype_string(GATE))

    def framed(key, made: list[dict]) -> pd.DataFrame:
        return pa.Table.from_pylist([r | {"key": key} for r in made], kinds).to_pandas()[kinds.names]

    def handle(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        gate, made = FileGate(), []
        if state.exists:
            gate.load(state.get[0])
        if state.hasTimedOut:
            made = gate.finish()
        else:
            got = pd.concat(list(frames))
            got["at"] = got["at"].astype("datetime64[us]").astype("int64")
            for row in got.sort_values(["at", "hash"], na_position="first").to_dict("records"):
                made += gate.step(row)
        state.update((gate.save(),))
        if gate.pending is not None:
            state.setTimeoutTimestamp(max((gate.pending + DEBOUNCE_MICROS) // 1000, state.getCurrentWatermarkMs() + 1))
        yield framed(keys[0], made)

    rows = events.select(F.col(path).alias("key"), F.col(at).cast("timestamp").alias("at"), F.col(hash).alias("hash")).withWatermark("at", late)
    return rows.groupBy("key").applyInPandasWithState(handle, GATE, "saved string", "append", GroupStateTimeout.EventTimeTimeout)

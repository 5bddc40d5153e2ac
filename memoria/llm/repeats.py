"""Operator 10: long repeats by run-length compressed Burrows-Wheeler indexes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import Rolling, documents, materialize, may_hold, mix, pieces, signed

LENGTH = 400
#: Bytes of a passage: 51 words of prose have at least so many, in any language of the documents (240 is below 99.9 % of them).
PASSAGE = 240
#: Bytes of the seeds whose least hash names a string. Longer ones seldom recur outside true repeats.
SEED = 64
#: Starts that one segment may hold; longer runs are cut, and their parts still meet by their seed.
SEGMENT_STARTS = 1024
#: Bytes that one index holds, few enough that a core's cache holds its arrays.
INDEX_BYTES = 1 << 17
#: A seed with more distinct text than so many times that is cut by further seeds.
SEED_PARTS = 32


def _window_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` neighbours, by doubling."""
    held, size = x, 1
    while size < width:
        step = min(size, width - size)
        held = np.minimum(held[: len(held) - step], held[step:])
        size += step
    return held


def _seeds(roll: Rolling, n: int, level: int) -> np.ndarray:
    """A hash of the SEED bytes at each position; ``level`` picks another hash function."""
    at = np.arange(n - SEED + 1)
    return mix(roll(at, at + SEED) + np.uint64(level))


def segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, level: int = 0) -> tuple[np.ndarray, ...]:
    """Cut every row's string starts into segments whose strings share their least seed hash.

    Returns (row, first start, last start + 1, seed hash, whether the seed occurs more than once nearby), positions counted from the beginning of ``data``. Equal strings have equal least
    seeds wherever they stand, so they lie in segments of equal seed hash.
    """
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, bool))
    if len(data) < length:
        return none
    roll = Rolling(data)
    seeds = _seeds(roll, len(data), level)
    width = length - SEED + 1
    least = _window_minimum(seeds, width)
    # Starts whose whole string lies in its row.
    sizes = np.diff(offsets)
    rows = np.flatnonzero(sizes >= length)
    if not len(rows):
        return none
    begins, stops = offsets[rows], offsets[rows + 1] - length + 1
    valid = np.zeros(len(least) + 1, np.int8)
    np.add.at(valid, begins, 1)
    np.add.at(valid, np.minimum(stops, len(least)), -1)
    valid = np.cumsum(valid[:-1]).astype(bool)
    change = np.ones(len(least), bool)
    change[1:] = least[1:] != least[:-1]
    change[begins] = True
    edge = np.flatnonzero(change & valid)
    # A segment ends at the next change or where its row's starts end.
    at_row = rows[np.searchsorted(begins, edge, "right") - 1]
    stop = offsets[at_row + 1] - length + 1
    end = np.minimum(np.concatenate((edge[1:], [len(least)])), stop)
    parts = -(-(end - edge) // SEGMENT_STARTS)
    if parts.max() > 1:
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        edge2 = np.repeat(edge, parts) + k * SEGMENT_STARTS
        end = np.minimum(np.repeat(end, parts), edge2 + SEGMENT_STARTS)
        edge, at_row = edge2, np.repeat(at_row, parts)
    seed = least[edge]
    # A string that repeats within its segment brings its seed twice within the segment's bytes.
    cover = ~_window_minimum(~np.concatenate((np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64))), width)[: len(seeds)]
    mins = np.flatnonzero(seeds == cover)
    order = np.argsort(seeds[mins], kind="stable")
    value, where = seeds[mins][order], mins[order]
    near = (value[1:] == value[:-1]) & (np.diff(where) <= width + SEGMENT_STARTS)
    twice = np.isin(seed, value[1:][near])
    return at_row, edge, end, seed, twice


class RunLengthIndex:
    """A run-compressed Burrows-Wheeler transform of several texts, with its suffixes sampled at the ends of runs.

    ``heads`` are the rows of the transform that begin a run (of the bytes before the suffixes), ``symbols`` their
    bytes; ``first`` and ``last`` hold the text positions of the suffixes at both ends of each run, and
    ``first_match`` / ``last_match`` the lengths that they share with the suffix of the neighbouring run.
    """

    def __init__(self, texts: list[bytes]):
        self.lengths = np.array([len(t) for t in texts], np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        self.size = n = len(data)
        ends = np.cumsum(self.lengths)
        self.begins = ends - self.lengths
        owner = np.repeat(np.arange(len(texts)), self.lengths)
        left = ends[owner] - np.arange(n)  # bytes to the text's end
        order = self._sorted(data, left)
        # Equal suffixes of different texts may stand in any order: a neighbour shares all of them either way.
        before = np.where(order == self.begins[owner[order]], 256 + owner[order], data[order - 1]) if n else np.zeros(0, np.int64)
        head = np.concatenate(([True], before[1:] != before[:-1])) if n else np.zeros(0, bool)
        self.heads = np.flatnonzero(head)
        self.symbols = before[self.heads]
        tails = np.concatenate((self.heads[1:] - 1, [n - 1])) if n else self.heads
        self.first, self.last = order[self.heads], order[tails]
        shared = self._shared(data, left, self.last[:-1], self.first[1:])
        self.first_match = np.concatenate(([0], shared))[: len(self.first)]
        self.last_match = np.concatenate((shared, [0]))[: len(self.last)]

    @classmethod
    def _sorted(cls, data: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The suffixes in order, by doubling: each round sorts only those that are not yet told apart."""
        rank, depth, n = cls._first_ranks(data, left), 7, len(data)
        order = np.argsort(rank)
        slots, value = np.arange(n), rank[order]
        while len(slots):
            head = np.concatenate(([True], value[1:] != value[:-1]))
            rank[order[slots]] = slots[np.maximum.accumulate(np.where(head, np.arange(len(slots)), 0))]
            # Left are groups of several; those that end before the depth are equal and stay as they are.
            slots = slots[~(head & np.concatenate((head[1:], [True])))]
            slots = slots[left[order[slots]] >= depth]
            at = order[slots]
            value = rank[at] * (n + 1) + np.where(left[at] > depth, rank[np.minimum(at + depth, n - 1)] + 1, 0)
            depth *= 2
            by = np.argsort(value)
            order[slots], value = at[by], value[by]
        return order

    @staticmethod
    def _first_ranks(data: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Seven bytes as one number, nine bits each; past a text's end there is 0."""
        rank = np.zeros(len(data), np.int64)
        for k in range(7):
            symbol = np.zeros(len(data), np.int64)
            k = min(k, len(data))
            symbol[: len(data) - k] = data[k:].astype(np.int64) + 1
            symbol[left <= k] = 0
            rank = (rank << 9) | symbol
        return rank

    @staticmethod
    def _shared(data: np.ndarray, left: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix lengths of pairs of suffixes, by binary search over hashes."""
        if not len(a):
            return np.zeros(0, np.int64)
        roll = Rolling(data)
        low, high = np.zeros(len(a), np.int64), np.minimum(left[a], left[b])
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = roll(a, a + middle) == roll(b, b + middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def matching_statistics(self) -> np.ndarray:
        """For each position the length of the longest match that begins there and also begins elsewhere.

        Inside a run the match of a position with its neighbour is the preceding position's less one, so the
        sampled run ends carry all there is: a running maximum over the text streams it back.
        """
        reach = np.zeros(self.size, np.int64)
        np.maximum.at(reach, self.first, self.first + self.first_match)
        np.maximum.at(reach, self.last, self.last + self.last_match)
        position = np.arange(self.size)
        # Matches end with their text, so a reach never passes into the next one.
        return np.maximum(np.maximum.accumulate(np.maximum(reach, position)) - position, 0)


def repeated_starts(texts: list[bytes], counts: list[int], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each distinct text the ranges of starts whose ``length`` bytes occur again, in it or in another. A text that ``counts`` more than once repeats as a whole."""
    index = RunLengthIndex(texts)
    hit = index.matching_statistics() >= length
    out = []
    for begin, size, count in zip(index.begins.tolist(), index.lengths.tolist(), counts):
        if count > 1:
            out.append([(0, size - length + 1)])
            continue
        own = np.diff(np.concatenate(([0], hit[begin : begin + size].view(np.int8), [0])))
        out.append(list(zip(np.flatnonzero(own == 1).tolist(), np.flatnonzero(own == -1).tolist())))
    return out


SPANS = "array<struct<s: int, e: int>>"
#: Distinct bytes under one seed that a task indexes; a seed with more is cut again by other seeds, in tables of its own.
HOT_BYTES = 2 << 20
#: Times that such seeds are cut again in tables; what is then still under one seed is cut within its task.
LEVELS = 3


def _find(docs: DataFrame, length: int, index_bytes: int, level: int = 0) -> DataFrame:
    """(a, b, c, ranges) for the rows of ``docs`` (a string, b long, c long, n int, text) with strings that start elsewhere too.

    a, b and c name a row: rows that share them are equal and count each. ``n`` copies of a row stand for one.
    ``ranges`` holds the starts (from, to before) of the strings of ``length`` bytes.
    """
    spark = docs.sparkSession

    def cut(batches):
        for batch, data, offsets in pieces(batches, "text"):
            row, first, end, seed, twice = segments(data, offsets, length, level)
            if len(row):
                view = memoryview(data)
                body = np.fromiter((xxhash.xxh3_64_intdigest(view[x:y]) for x, y in zip(first.tolist(), (end + length - 1).tolist())), np.uint64, len(row))
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).take(at) for k in range(4)), pa.array((first - offsets[row]).astype(np.int32)), pa.array((end - first).astype(np.int32)), pa.array(signed(seed)), pa.array(signed(body)), pa.array(twice)],
                    ["a", "b", "c", "n", "first", "starts", "seed", "body", "twice"],
                )

    found = materialize(docs.select("a", "b", "c", "n", "text").mapInArrow(cut, "a string, b long, c long, n int, first int, starts int, seed long, body long, twice boolean"), "segments")
    seeds = found.groupBy("seed").agg(F.sum("n").alias("m"), F.max("twice").alias("again")).filter("m > 1 OR again").select("seed")
    held = materialize(found.join(seeds, "seed"), "candidates")
    distinct = materialize(held.groupBy("seed", "body", "starts").agg(F.sum("n").alias("n"), F.min(F.struct("a", "b", "c", "first")).alias("at")), "distinct")
    # A seed whose segments are all copies of one text needs no index: every start repeats.
    size = F.sum(F.col("starts") + length - 1)
    kinds = distinct.groupBy("seed").agg(F.when((F.count(F.lit(1)) == 1) & (F.min("n") > 1), "copies").when((size > HOT_BYTES) & F.lit(level < LEVELS), "hot").otherwise("index").alias("kind"), size.alias("bytes"))
    kinds = materialize(kinds, "kinds")
    totals = {r["kind"]: r["bytes"] for r in kinds.groupBy("kind").agg(F.sum("bytes").alias("bytes")).collect()}  # three rows at most
    distinct = distinct.join(kinds.select("seed", "kind"), "seed")
    marked = distinct.filter("kind = 'copies'").select("seed", "body", "starts", F.array(F.struct(F.lit(0).alias("s"), F.col("starts").alias("e"))).alias("ranges"))

    def texts(kind: str) -> DataFrame:
        """One text of each distinct segment."""
        wanted = distinct.filter(F.col("kind") == kind).select("at.a", "at.b", "at.c", F.struct(F.col("at.first").alias("first"), "starts", "seed", "body", F.least("n", F.lit(2)).cast("int").alias("n")).alias("piece"))
        wanted = materialize(wanted.groupBy("a", "b", "c").agg(F.collect_list("piece").alias("pieces")), "wanted")  # within one document
        some = may_hold(docs.select("a", "b", "c", "text"), wanted.select("b"), "b").filter("_may").drop("_may")
        wanted = wanted.select(F.col("a").alias("wanted_a"), F.col("b").alias("wanted_b"), F.col("c").alias("wanted_c"), "pieces")
        return some.join(wanted, F.expr("a <=> wanted_a AND b = wanted_b AND c = wanted_c")).select("a", "b", "c", "text", "pieces").mapInArrow(fetch, "seed long, body long, starts int, n int, bytes binary")

    def fetch(batches):
        last = None
        for batch, data, offsets in pieces(batches, "text"):
            names = [x.as_py() for x in pa.StructArray.from_arrays([batch.column(k) for k in range(3)], ["a", "b", "c"])]
            raw, out = data.tobytes(), {k: [] for k in ("seed", "body", "starts", "n", "bytes")}
            for name, begin, some in zip(names, offsets.tolist(), batch.column(4).to_pylist()):
                if name == last:  # a repeated row
                    continue
                last = name
                for p in some:
                    for k in ("seed", "body", "starts", "n"):
                        out[k].append(p[k])
                    out["bytes"].append(raw[begin + p["first"] : begin + p["first"] + p["starts"] + length - 1])
            yield pa.RecordBatch.from_pydict({"seed": pa.array(out["seed"], pa.int64()), "body": pa.array(out["body"], pa.int64()), "starts": pa.array(out["starts"], pa.int32()), "n": pa.array(out["n"], pa.int32()), "bytes": pa.array(out["bytes"], pa.binary())})

    def index(batches):
        held, size, seed = [], 0, None

        def finish():
            unique: dict[tuple, dict] = {}
            for g in held:  # a repeated row may bring its segments more than once
                unique.setdefault((g["seed"], g["body"], g["starts"]), g)
            group = list(unique.values())
            bodies, counts = [g["bytes"] for g in group], [g["n"] for g in group]
            ranges = repeated_starts(bodies, counts, length) if sum(map(len, bodies)) <= SEED_PARTS * index_bytes else _by_further_seeds(bodies, counts, length, index_bytes, level + 1)
            some = [(g, r) for g, r in zip(group, ranges) if r]
            return pa.RecordBatch.from_pydict({"seed": pa.array([g["seed"] for g, _ in some], pa.int64()), "body": pa.array([g["body"] for g, _ in some], pa.int64()), "starts": pa.array([g["starts"] for g, _ in some], pa.int32()), "ranges": pa.array([[{"s": a, "e": b} for a, b in r] for _, r in some], pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))})

        for batch in batches:
            for g in batch.to_pylist():
                if size >= index_bytes and g["seed"] != seed:
                    yield finish()
                    held, size = [], 0
                held.append(g)
                seed, size = g["seed"], size + len(g["bytes"])
        if held:
            yield finish()

    if "index" in totals:
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-totals["index"] // (SEED_PARTS * index_bytes)))
        grouped = texts("index").repartition(parts, "seed").sortWithinPartitions("seed", "body", "starts")
        marked = marked.union(materialize(grouped.mapInArrow(index, f"seed long, body long, starts int, ranges {SPANS}"), "ranges"))
    if "hot" in totals:
        again = texts("hot").select(F.col("seed").cast("string").alias("a"), F.col("body").alias("b"), F.col("starts").cast("long").alias("c"), "n", F.col("bytes").alias("text"))
        again = _find(materialize(again.dropDuplicates(["a", "b", "c"]), "hot"), length, index_bytes, level + 1)
        marked = marked.union(again.select(F.col("a").cast("long").alias("seed"), F.col("b").alias("body"), F.col("c").cast("int").alias("starts"), "ranges"))
    runs = held.join(marked, ["seed", "body", "starts"]).select("a", "b", "c", F.explode("ranges").alias("r"), "first")
    # Within one document; identical rows bring equal runs, which sets hold once.
    return runs.groupBy("a", "b", "c").agg(F.sort_array(F.collect_set(F.struct((F.col("first") + F.col("r.s")).alias("s"), (F.col("first") + F.col("r.e")).alias("e")))).alias("ranges"))


def _named(df: DataFrame, key: str, text: str) -> DataFrame:
    """``df`` as (row, text, a, b, c, n): all its columns in one struct, so that none can clash, and the names of its rows."""
    row = F.struct(*[F.col(f"`{x}`") for x in df.columns])
    return df.select(row.alias("row"), F.col(f"`{text}`").alias("text"), F.col(f"`{key}`").cast("string").alias("a"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("b"), F.lit(0).cast("long").alias("c"), F.lit(1).alias("n"))


def _with(rows: DataFrame, found: DataFrame, *columns: str) -> DataFrame:
    """The rows with ``columns`` of ``found``, by a and b; null where there is none. Rows without are not shuffled."""
    marked = may_hold(rows, found.select("b"), "b")
    found = found.select(F.col("a").alias("found_a"), F.col("b").alias("found_b"), *columns)
    some = marked.filter("_may").join(found, F.expr("a <=> found_a AND b = found_b"), "left").select(*rows.columns, *columns)
    return some.union(marked.filter("NOT _may").select(*rows.columns, *[F.lit(None).cast(found.schema[c].dataType).alias(c) for c in columns]))


def _spans(ranges: DataFrame, length: int, into: str = "spans") -> DataFrame:
    """Ranges of starts as the bytes that their strings cover."""
    covered = F.transform("ranges", lambda r: F.struct(r["s"].alias("s"), (r["e"] + F.lit(length - 1)).cast("int").alias("e")))
    return materialize(ranges.select("a", "b", covered.alias(into)), "runs")


def find_repeats(df: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = LENGTH, index_bytes: int = INDEX_BYTES, into: str = "spans") -> DataFrame:
    """For each row of ``df`` all its columns and ``into``: runs of bytes covered by a ``length``-byte string that also starts elsewhere (in order; they may touch or overlap; null or empty for none).

    Strings that are equal share their least seed hash, so starts are cut into segments by it; seeds that occur
    once drop out after a partial count. Of the others every distinct segment text goes into one index of its
    hash range, where a run-length BWT with sampled run ends yields matching statistics. Seeds with more distinct
    text than HOT_BYTES are cut again by other seed hashes, in tables, and copies collapse each time, so one
    passage in very many documents costs one copy. A seed with one distinct segment that occurs more than once
    is marked by its count alone.

    Null texts are empty. Documents under null or repeated keys count as documents of their own: rows with equal
    key and text get equal spans. Extra columns pass through whatever their names; one called ``into`` is replaced.
    A text is held whole in one task, with some 40 bytes of work space for each of its bytes.
    """
    rows = _named(df, key, text)
    found = _spans(_find(rows, length, index_bytes), length)
    return _with(rows.select("row", "a", "b"), found, "spans").select(*[F.col(f"row.`{c}`") for c in df.columns if c.lower() != into.lower()], F.col("spans").alias(into))


def _by_further_seeds(texts: list[bytes], counts: list[int], length: int, limit: int, level: int = 1) -> list[list[tuple[int, int]]]:
    """repeated_starts for more text than one index holds: segments are cut by another seed hash, and equal parts collapse into one."""
    groups: dict[int, dict[bytes, list]] = {}
    for t, text in enumerate(texts):
        data = np.frombuffer(text, np.uint8)
        _, first, end, seed, _ = segments(data, np.array([0, len(data)]), length, level)
        for a, b, s in zip(first.tolist(), end.tolist(), seed.tolist()):
            groups.setdefault(s, {}).setdefault(text[a : b + length - 1], []).append((t, a))
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    pending: list[list] = [[]]
    size = 0
    for group in groups.values():
        pending[-1] += group.items()
        size += sum(map(len, group))
        if size >= limit:
            pending.append([])
            size = 0
    for items in pending:
        if not items:
            continue
        own = [k for k, _ in items]
        many = [2 if len(at) > 1 or counts[at[0][0]] > 1 else 1 for _, at in items]
        if sum(map(len, own)) > SEED_PARTS * limit and level < 4:
            ranges = _by_further_seeds(own, many, length, limit, level + 1)
        else:
            ranges = repeated_starts(own, many, length)
        for (_, at), found in zip(items, ranges):
            for t, a in at:
                out[t] += [(a + s, a + e) for s, e in found]
    return out


def _merge(runs) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for r in runs:
        if out and r["s"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], r["e"])
        else:
            out.append([r["s"], r["e"]])
    return [tuple(x) for x in out]


def _kept(raw: bytes, a: int, b: int, spans: list[tuple[int, int]]) -> bytes:
    at, out = a, []
    for s, e in spans:
        out.append(raw[at : a + s])
        at = a + e
    return b"".join([*out, raw[at:b]])


def _size(spans: list[tuple[int, int]]) -> int:
    return sum(e - s for s, e in spans)


def repeat_report(df: DataFrame, *, length: int = LENGTH, passage: int = PASSAGE, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of what is kept, for each row of ``df``; n_passage counts the bytes that repeated strings of ``passage`` bytes cover.

    A repeated string of ``length`` bytes lies in runs of repeated strings of ``passage`` bytes (not the longer), so
    one index over all texts finds those, and a second one over nothing but the runs finds the others. Null and
    empty texts have no bytes; null or repeated doc_ids and extra columns do no harm; an empty table gives no rows.
    """
    if not 0 < passage <= length:
        raise ValueError("a passage must not be longer than the strings that are removed")
    rows = _named(df.select("doc_id", "text"), "doc_id", "text")
    short = _spans(_find(rows, passage, index_bytes), passage)

    def inner(batches):
        """The runs of at least ``length`` bytes, as texts of their own."""
        for batch, data, offsets in pieces(batches, "text"):
            raw, row, at, text = data.tobytes(), [], [], []
            for i, (begin, spans) in enumerate(zip(offsets.tolist(), batch.column(3).to_pylist())):
                for s, e in _merge(spans or ()):
                    if e - s >= length:
                        row.append(i)
                        at.append(s)
                        text.append(raw[begin + s : begin + e])
            some = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(some), batch.column(1).take(some), pa.array(at, pa.int64()), pa.array(text, pa.binary())], ["a", "b", "c", "text"])

    both = _with(rows.select("row", "text", "a", "b"), short, "spans")
    runs = both.filter("spans IS NOT NULL").select("a", "b", "text", "spans").mapInArrow(inner, "a string, b long, c long, text binary").withColumn("n", F.lit(1))
    long = _find(materialize(runs, "inner"), length, index_bytes)
    placed = F.transform("ranges", lambda r: F.struct((r["s"] + F.col("c")).cast("int").alias("s"), (r["e"] + F.col("c")).cast("int").alias("e")))
    long = _spans(long.withColumn("ranges", placed).groupBy("a", "b").agg(F.sort_array(F.flatten(F.collect_list("ranges"))).alias("ranges")), length, "removed")

    def report(batches):
        for batch, data, offsets in pieces(batches, "text"):
            raw, cuts = data.tobytes(), offsets.tolist()
            passages, removed = ([_merge(x or ()) for x in batch.column(k).to_pylist()] for k in (2, 3))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0),
                "n_bytes": pa.array(np.diff(offsets), pa.int64()),
                "n_removed": pa.array([_size(x) for x in removed], pa.int64()),
                "n_spans": pa.array([len(x) for x in removed], pa.int64()),
                "kept_sha256": [hashlib.sha256(_kept(raw, a, b, x)).hexdigest() for a, b, x in zip(cuts, cuts[1:], removed)],
                "n_passage": pa.array([_size(x) for x in passages], pa.int64()),
            })

    long = long.select(F.col("a").alias("long_a"), F.col("b").alias("long_b"), "removed")
    found = short.join(long, F.expr("a <=> long_a AND b = long_b"), "left").select("a", "b", "spans", "removed")
    found = _with(rows.select(F.col("row.doc_id").cast("long").alias("doc_id"), "text", "a", "b"), found, "spans", "removed")
    return found.select("doc_id", "text", "spans", "removed").mapInArrow(report, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage long")


def remove_repeats(df: DataFrame, *, key: str = "doc_id", text: str = "text", chars: str | None = "n_chars", length: int = LENGTH, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """The rows of ``df`` with the repeated runs cut out of their texts, and ``chars`` set anew where it is a column. Characters that a run's end would split go too.

    Null texts stay null, and a text that is one repeat becomes empty; rows are neither lost nor added, whatever their
    keys. Extra columns pass through whatever their names. An empty table gives an empty table.
    """
    rows = _named(df, key, text)
    found = _with(rows.select("row", "text", "a", "b"), _spans(_find(rows, length, index_bytes), length), "spans").select("row", "text", "spans")

    def cut(batches):
        for batch, data, offsets in pieces(batches, "text"):
            raw, cuts, old = data.tobytes(), offsets.tolist(), batch.column(1)
            kept = [_kept(raw, a, b, _merge(x)).decode(errors="ignore") if x else old[i].as_py() for i, (a, b, x) in enumerate(zip(cuts, cuts[1:], batch.column(2).to_pylist()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string())], ["row", "text"])

    out = found.mapInArrow(cut, StructType([found.schema["row"], StructField("text", StringType())]))

    def column(name: str) -> F.Column:
        if name == text:
            return F.col("text").alias(name)
        if name == chars:
            return F.coalesce(F.length("text").cast(df.schema[name].dataType), F.col(f"row.`{name}`")).alias(name)
        return F.col(f"row.`{name}`")

    return out.select(*[column(c) for c in df.columns])


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_report(documents(spark, sf_dir))

"""Operator 7: SentencePiece encoding and decoding over a relational lattice of pieces."""

from __future__ import annotations

import functools
import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rolling, documents, materialize, pieces

#: Units whose lattice is solved as tables: at most so many, the most frequent ones.
LEXICON = 150_000
#: A unit is counted where it occurs so often within one slice of text.
SLICE_COUNT = 3
#: Characters of a unit in the lattices; longer ones are merged one by one.
LONGEST_UNIT = 48
CACHE_UNITS = 1_000_000
_SPACE = "▁"
_NONE = np.int32(-(1 << 31) + 1)


class Model:
    """Pieces of a SentencePiece BPE model with byte fallback: hashes, ids, scores and bytes (the space mark as a space)."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(size)]
        byte = [sp.is_byte(i) for i in range(size)]
        names = [sp.id_to_piece(i) for i in range(size)]
        self.rows = [(names[i].replace(_SPACE, " "), i, float(sp.get_score(i))) for i in range(size) if not special[i] and not byte[i]]
        self.longest = max(len(p) for p, _, _ in self.rows)
        self.byte_id = np.zeros(256, np.int32)
        surface = [b""] * size
        for i in range(size):
            if byte[i]:
                self.byte_id[int(names[i][3:5], 16)] = i
                surface[i] = bytes([int(names[i][3:5], 16)])
        for p, i, _ in self.rows:
            surface[i] = p.encode()
        self.by_piece = {p.encode(): (s, i) for p, i, s in self.rows}
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_size = np.array([len(s) for s in surface], np.int64)
        self.surface_begin = np.cumsum(self.surface_size) - self.surface_size
        data = np.frombuffer(b"".join(p.encode() for p, _, _ in self.rows), np.uint8)
        ends = np.cumsum([len(p.encode()) for p, _, _ in self.rows])
        hashes = Rolling(data)(np.concatenate(([0], ends[:-1])), ends)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array([i for _, i, _ in self.rows], np.int32)[order]
        # Scores as dense ranks: only their order matters, and equal scores stay equal.
        scores = np.array([s for _, _, s in self.rows])[order]
        self.ranks = np.unique(scores, return_inverse=True)[1].astype(np.int32)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.hashes >> np.uint64(44)] = True
        inner = {c for p, _, _ in self.rows if len(p) > 1 for c in p}
        # Units end around ASCII characters that no longer piece holds.
        self.alone = np.array([b < 128 and chr(b) not in inner for b in range(256)])
        self.alone[32] = False

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Index of the piece with each hash, -1 for none."""
        out = np.full(len(hashes), -1, np.int32)
        maybe = np.flatnonzero(self.seen[hashes >> np.uint64(44)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
        same = self.hashes[at] == hashes[maybe]
        out[maybe[same]] = at[same]
        return out


@functools.lru_cache(maxsize=2)
def load(path: str) -> Model:
    return Model(path)


def prepared(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with the dummy prefix, a space before each that is not empty; the space mark in a text counts as a space."""
    raw = data.tobytes()
    mark = _SPACE.encode()
    if mark in raw:
        texts = [raw[a:b].replace(mark, b" ") for a, b in zip(offsets, offsets[1:])]
        data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    some = np.diff(offsets) > 0
    return np.insert(data, offsets[:-1][some], 32), offsets + np.concatenate(([0], np.cumsum(some)))


def unit_starts(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where units begin: parts of the texts that no merge can cross. A unit is a run of spaces with what follows it."""
    alone, space = model.alone[data], data == 32
    start = alone.copy()
    start[1:] |= alone[:-1] | (space[1:] & ~space[:-1])
    start[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(start)


# -- the lattice as tables ------------------------------------------------------------------------

def lattice(units: DataFrame, model: Model) -> DataFrame:
    """(unit, ids) for a table of distinct units: substrings of bounded length meet the piece table in an equi-join, a unit's
    edges are gathered, and a fold over them takes the best-scored merge at each step.

    The scores of this model rank merges, so the path that the library takes is the fold of best merges (ties: leftmost);
    a best-sum path over the same edges would be another one. Units with characters outside the table give no row.
    """
    spark = units.sparkSession
    table = spark.createDataFrame(model.rows, "piece string, id int, score double")
    k = LONGEST_UNIT + 1
    starts = units.select("unit", F.length("unit").alias("n")).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    spans = starts.withColumn("b", F.explode(F.sequence(F.col("a") + 1, F.least(F.col("n"), F.col("a") + model.longest))))
    spans = spans.withColumn("piece", F.expr("substring(unit, a + 1, b - a)"))
    edges = spans.join(F.broadcast(table), "piece")  # the table is a model file: its size is fixed
    found = edges.groupBy("unit", "n").agg(F.map_from_entries(F.collect_list(F.struct(F.expr(f"a * {k} + b"), F.struct("score", "id")))).alias("edges"))
    merge = f"""
        if(size(cuts) <= 2, cuts, transform(array(array_max(transform(sequence(1, size(cuts) - 2),
            i -> struct(edges[cuts[i - 1] * {k} + cuts[i + 1]].score AS s, -i AS i)))),
            best -> if(best.s IS NULL, cuts, filter(cuts, (c, j) -> j <> -best.i)))[0])"""
    found = found.withColumn("cuts", F.expr(f"aggregate(sequence(1, n), sequence(0, n), (cuts, step) -> {merge})"))
    found = found.withColumn("ids", F.expr(f"transform(sequence(1, size(cuts) - 1), i -> edges[cuts[i - 1] * {k} + cuts[i]].id)"))
    return found.filter("NOT exists(ids, i -> i IS NULL)").select("unit", "ids")


def lexicon(df: DataFrame, model_path: str, most: int = LEXICON) -> list[tuple[str, list[int]]]:
    """Ids of the most frequent units of ``df``, at most ``most``. Which units are here changes the work, not the results."""
    def count(batches):
        model = load(model_path)
        for _, data, offsets in pieces(batches, "text"):
            data, offsets = prepared(data, offsets)
            start = unit_starts(model, data, offsets)
            end = np.concatenate((start[1:], [len(data)]))
            if not len(start):
                continue
            _, first, n = np.unique(Rolling(data)(start, end), return_index=True, return_counts=True)
            keep = (n >= SLICE_COUNT) & (end[first] - start[first] <= LONGEST_UNIT)
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([raw[start[i] : end[i]].decode() for i in first[keep]], pa.string()), pa.array(n[keep], pa.int64())], ["unit", "n"])

    counts = df.select("text").mapInArrow(count, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "units")
    # Counts by quarter powers of two: a few hundred rows.
    shares = sorted(counts.groupBy(F.floor(F.log2("n") * 4).alias("size")).count().collect(), reverse=True)
    total, least = 0, 1 << 30
    for size, n in shares:
        if total + n > most:
            break
        total, least = total + n, size
    chosen = counts.filter(F.floor(F.log2("n") * 4) >= least).select("unit")
    return [(r[0], r[1]) for r in lattice(chosen, load(model_path)).collect()]  # at most ``most`` rows


# -- encoding -------------------------------------------------------------------------------------

class Encoder:
    """Ids of texts by their units: from the lexicon, else by the same lattice and merges in arrays, for many units at once."""

    def __init__(self, path: str, known: list[tuple[str, list[int]]] = ()):
        self.model = load(path)
        self.hashes, self.where = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.begin, self.pool = np.zeros(1, np.int64), np.zeros(0, np.int32)
        self.known = known
        self._begin_again()

    def _begin_again(self) -> None:
        self.hashes, self.where = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.begin, self.pool = np.zeros(1, np.int64), np.zeros(0, np.int32)
        if self.known:
            texts = [u.encode() for u, _ in self.known]
            ends = np.cumsum([len(t) for t in texts])
            hashes = Rolling(np.frombuffer(b"".join(texts), np.uint8))(np.concatenate(([0], ends[:-1])), ends)
            counts = np.array([len(i) for _, i in self.known])
            self._add(hashes, np.fromiter((x for _, i in self.known for x in i), np.int32, counts.sum()), counts)

    def _add(self, hashes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        base = len(self.begin) - 1
        self.begin = np.concatenate((self.begin, self.begin[-1] + np.cumsum(counts)))
        self.pool = np.concatenate((self.pool, ids))
        rank = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[rank])
        self.hashes, self.where = np.insert(self.hashes, at, hashes[rank]), np.insert(self.where, at, base + rank)

    def _learn(self, data: np.ndarray, roll: Rolling, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> None:
        head = (data & 0xC0) != 0x80
        before = np.concatenate(([0], np.cumsum(head)))
        at = np.flatnonzero(head)
        size = before[end] - before[start]
        for n in np.unique(size).tolist():
            some = np.flatnonzero(size == n)
            if n > LONGEST_UNIT:
                for i in some:
                    ids = self._merge_long(data[start[i] : end[i]].tobytes())
                    self._add(hashes[i : i + 1], np.array(ids, np.int32), np.array([len(ids)]))
                continue
            for k in range(0, len(some), max(1, 2_000_000 // (n + 1) ** 2)):
                part = some[k : k + max(1, 2_000_000 // (n + 1) ** 2)]
                cut = np.append(at, len(data))[before[start[part]][:, None] + np.arange(n + 1)]
                cut[:, n] = end[part]
                self._add(hashes[part], *self._merge(data, roll, cut))

    def _merge(self, data: np.ndarray, roll: Rolling, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and their number for each row, of units with equally many characters; ``cut`` has the characters' edges."""
        m, n = cut.shape[0], cut.shape[1] - 1
        a, b = np.triu_indices(n + 1, 1)
        near = b - a <= self.model.longest
        a, b = a[near], b[near]
        piece = np.full((m, n + 1, n + 1), -1, np.int32)
        piece[:, a, b] = self.model.lookup(roll(cut[:, a].ravel(), cut[:, b].ravel())).reshape(m, -1)
        rank = np.where(piece >= 0, self.model.ranks[piece], _NONE)
        alive = np.ones((m, n + 1), bool)
        rows, index = np.arange(m), np.arange(n + 1)
        while len(rows):
            live = alive[rows]
            before = np.maximum.accumulate(np.where(live, index, 0), 1)[:, :-2]
            after = np.minimum.accumulate(np.where(live, index, n)[:, ::-1], 1)[:, ::-1][:, 2:]
            score = np.where(live[:, 1:-1], rank[rows[:, None], before, after], _NONE)
            if not score.shape[1]:
                break
            best = score.argmax(1)
            merged = score[np.arange(len(rows)), best] != _NONE
            rows, best = rows[merged], best[merged]
            alive[rows, best + 1] = False
        row, edge = np.nonzero(alive)
        inside = row[1:] == row[:-1]
        row, a, b = row[:-1][inside], edge[:-1][inside], edge[1:][inside]
        found = piece[row, a, b]
        begin = cut[row, a]
        # A character without a piece is its bytes.
        count = np.where(found >= 0, 1, cut[row, b] - begin)
        total = np.cumsum(count)
        inner = np.arange(total[-1]) - np.repeat(total - count, count)
        ids = np.where(np.repeat(found, count) >= 0, self.model.ids[np.repeat(found, count)], self.model.byte_id[data[np.repeat(begin, count) + inner]])
        return ids, np.bincount(row, count, m).astype(np.int64)

    def _merge_long(self, unit: bytes) -> list[int]:
        """Best merges by a heap, for units of any length."""
        symbols: list[bytes | None] = [c.encode() for c in unit.decode(errors="surrogateescape")]
        n = len(symbols)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, int, bytes]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0:
                both = symbols[i] + symbols[j]
                if both in self.model.by_piece:
                    heapq.heappush(heap, (-self.model.by_piece[both][0], i, j, both))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if symbols[i] is None or symbols[j] is None or right[i] != j or symbols[i] + symbols[j] != both:
                continue
            symbols[i], symbols[j] = both, None
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        out: list[int] = []
        for s in symbols:
            if s is not None:
                out += [self.model.by_piece[s][1]] if s in self.model.by_piece else self.model.byte_id[list(s)].tolist()
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, number of ids of each row)."""
        data, offsets = prepared(data, offsets)
        start = unit_starts(self.model, data, offsets)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        end = np.concatenate((start[1:], [len(data)]))
        roll = Rolling(data)
        unique, index, back = np.unique(roll(start, end), return_index=True, return_inverse=True)
        if len(self.hashes) > CACHE_UNITS:
            self._begin_again()
        at = np.searchsorted(self.hashes, unique)
        new = np.ones(len(unique), bool)
        held = at < len(self.hashes)
        new[held] = self.hashes[at[held]] != unique[held]
        if new.any():
            some = index[new]
            self._learn(data, roll, start[some], end[some], unique[new])
            at = np.searchsorted(self.hashes, unique)
        where = self.where[at][back]
        begin = self.begin[where]
        count = self.begin[where + 1] - begin
        total = np.cumsum(count)
        ids = self.pool[np.repeat(begin - total + count, count) + np.arange(total[-1])]
        return ids, np.diff(np.concatenate(([0], total))[np.searchsorted(start, offsets)])


def decode(model: Model, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all rows, offsets): the pieces' bytes without each row's dummy prefix."""
    size = model.surface_size[ids]
    total = np.cumsum(size)
    data = model.surface[np.repeat(model.surface_begin[ids] - total + size, size) + np.arange(total[-1] if len(total) else 0)]
    ends = np.concatenate(([0], total))[np.concatenate(([0], np.cumsum(counts)))]
    some = np.diff(ends) > 0
    return np.delete(data, ends[:-1][some]), ends - np.concatenate(([0], np.cumsum(some)))


_ENCODERS: dict[int, Encoder] = {}


def _encoder(shared, path: str) -> Encoder:
    """One encoder for each worker process and lexicon."""
    key = shared.value[0]
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(path, shared.value[1])
    return _ENCODERS[key]


def _mapper(df: DataFrame, model_path: str, emit, schema: str) -> DataFrame:
    known = lexicon(df, model_path)
    shared = df.sparkSession.sparkContext.broadcast((hash((model_path, len(known), id(known))), known))

    def run(batches):
        words = _encoder(shared, model_path)
        for batch, data, offsets in pieces(batches, "text"):
            yield emit(words, batch, data, offsets, *words.encode(data, offsets))

    return df.mapInArrow(run, schema)


def encode_documents(df: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids for every whole text: the ids of the SentencePiece library with this model.

    Frequent units are solved as tables (``lattice``); the others, whose number has no bound, by the same lattice in
    the task that meets them, so no text is shuffled. Null and empty texts have no ids; keys pass
    through, null or repeated; extra columns are ignored. Decoding gives the text back, except that the space mark
    U+2581 comes back as a space.
    """
    def emit(words, batch, data, offsets, ids, counts):
        ends = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(ids, pa.int32()))], ["doc_id", "ids"])

    return _mapper(df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), model_path, emit, "doc_id long, ids array<int>")


def decode_documents(df: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of a table of doc_id and ids. Null ids give an empty text; ids outside the model are refused."""
    def run(batches):
        model = load(model_path)
        for batch in batches:
            lists = batch.column(1).fill_null(pa.scalar([], batch.column(1).type)) if batch.column(1).null_count else batch.column(1)
            counts = np.diff(lists.offsets.to_numpy())
            data, offsets = decode(model, lists.flatten().to_numpy().astype(np.int64), counts)
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([raw[a:b].decode(errors="replace") for a, b in zip(offsets, offsets[1:])], pa.string())], ["doc_id", "text"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def piece_report(df: DataFrame, model_path: str) -> DataFrame:
    """For each row of ``df``: doc_id, n_pieces, ids_crc32 (ids as little-endian unsigned 32-bit integers) and whether the decoded ids are the text again."""
    def emit(words, batch, data, offsets, ids, counts):
        ends = np.concatenate(([0], np.cumsum(counts))).tolist()
        view = memoryview(ids.astype("<u4").tobytes())
        text, cuts = decode(words.model, ids, counts)
        mark = _SPACE.encode()
        raw, back = data.tobytes(), text.tobytes()
        same = [raw[a:b].replace(mark, b" ") == back[c:d] for a, b, c, d in zip(offsets, offsets[1:], cuts, cuts[1:])]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array([zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(ends, ends[1:])], pa.int64()), pa.array(same)], ["doc_id", "n_pieces", "ids_crc32", "round_trip"])

    return _mapper(df.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model_path, emit, "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_report(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))

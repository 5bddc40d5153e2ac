"""Operator 1: benchmark passages in documents, by CGK embeddings, bit-sampling LSH and exact edit verification."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, documents, mix, packed, pieces, scratch_path, unpacked, words
from .files import read_file, write_file

#: Edits allowed, as a part of an item's characters.
EDIT_RATE = 0.1
TARGET_RECALL = 0.999
#: Shapes of windows: (bytes of an item from which on it holds, bytes that each of its words may stand for, steps of a walk, steps whose byte is
#: part of a key, whether windows begin at words only). A walk consumes about half a byte a step, and of an item with edits in a tenth of
#: its places some eight bytes in a row are always whole, however the edits lie: walks differ in how many bytes their keys take, so enough
#: of them find such places at words too. Items with few words are looked at from every byte, by shorter keys.
SHAPES = [(64, 12, 20, 10, True), (0, 0, 12, 9, False)]
#: Walks that are tried before the items of a shape go to the next one, and from the last one to plain edit distance.
MOST_WALKS = 32
#: Trial edits of each kind, of a block's own items, that tell how many walks are needed.
TRIALS = 400
KINDS = ["random", "substituted", "inserted", "deleted", "clustered"]
#: Benchmark bytes that one pass over the documents carries to every task.
BLOCK_BYTES = 4 << 20
_FILTER_BITS = 20
#: Buckets of an item's set of six-byte grams.
_GRAM_BUCKETS = 4096

#: ASCII letters lowered and white space made plain, byte for byte.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[SPACE] = 32


class Walk:
    """One CGK random walk: at each step the byte under the pointer is the output, and a random bit of (step, byte) moves the pointer on."""

    def __init__(self, seed: int, steps: int, sampled: int):
        table = mix(np.arange(steps * 256, dtype=np.uint64) + np.uint64(seed * 1_000_003 + 17)).reshape(steps, 256)
        self.move = (table & np.uint64(1)).astype(np.int32)
        order = np.argsort(mix(np.arange(steps, dtype=np.uint64) + np.uint64(seed * 31 + 5)))
        self.sampled = np.zeros(steps, bool)
        self.sampled[order[:sampled]] = True
        self.seed = np.uint64(seed + 1)

    def keys(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The sampled part of the embedding of the window at each start, hashed. ``data`` ends in as many spare bytes as there are steps."""
        at = starts.astype(np.int32)
        key = np.full(len(at), self.seed, np.uint64)
        for step, sampled in enumerate(self.sampled.tolist()):
            byte = data[at]
            if sampled:
                key *= np.uint64(0x9E3779B97F4A7C15)
                key += byte
            at += self.move[step][byte]
        return mix(key)


def anchors(data: np.ndarray, offsets: np.ndarray, at_words: bool) -> np.ndarray:
    """Where windows begin: at words, or at every byte but white space."""
    return words(data, offsets)[0] if at_words else np.flatnonzero(data != 32)


def edited(text: bytes, edits: int, random: np.random.Generator) -> bytes:
    """``text`` with so many random insertions, deletions and substitutions."""
    out = bytearray(text)
    for _ in range(edits):
        at, kind = int(random.integers(0, len(out) + 1)), int(random.integers(0, 3))
        letter = b"etaoinshrdlu "[int(random.integers(0, 13))]
        if kind == 0 or at == len(out):
            out.insert(at, letter)
        elif kind == 1 and len(out) > 1:
            del out[at]
        else:
            out[at] = letter
    return bytes(out)


def spread_edits(text: bytes, edits: int, kind: str, random: np.random.Generator) -> bytes:
    """``text`` with so many edits of one kind: at random places, evenly spaced, or (clustered) one after the other."""
    if kind == "random" or not edits:
        return edited(text, edits, random)
    out = bytearray(text)
    if kind == "clustered":
        at = int(random.integers(0, max(1, len(out) - edits)))
        out[at : at + edits] = b"#" * edits
        return bytes(out)
    for j in reversed(range(edits)):
        at = min(len(out) - 1, int((j + 0.5) * len(text) / edits))
        out[at : at + (kind != "inserted")] = b"" if kind == "deleted" else b"#"
    return bytes(out)


def walks_needed(texts: list[bytes], rate: float, shape: tuple[int, int, int, int, bool], recall: float = TARGET_RECALL) -> int:
    """How many walks find copies of the items with all the edits that are allowed, counted on trial edits of the items themselves; each kind of edits must reach the recall. 0: more than MOST_WALKS."""
    _, _, steps, sampled, at_words = shape
    random, by_size = np.random.default_rng(11), sorted(texts, key=len)
    # Short items are the harder ones: they are tried more often.
    chosen = [(by_size[int(len(texts) * (k / TRIALS) ** 2)], kind) for k in range(TRIALS) for kind in KINDS]
    pairs = [(t + bytes(steps + 1), b"\1 " + spread_edits(t, int(rate * len(t.decode(errors="replace"))), kind, random) + b" \1 " + bytes(steps + 1)) for t, kind in chosen]
    # All sides as one text each, so that a walk is one pass over all of them.
    keyed = []
    for side in zip(*pairs):
        data, sizes = np.frombuffer(b"".join(side), np.uint8), np.array([len(x) for x in side])
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        at = anchors(data, offsets, at_words)
        owner = np.searchsorted(offsets, at, "right") - 1
        inside = at < offsets[owner + 1] - steps - 1
        keyed.append((np.concatenate((data, np.zeros(steps + 1, np.uint8))), at[inside], owner[inside]))
    found = np.zeros(len(pairs), bool)
    for n in range(1, MOST_WALKS + 1):
        walk = Walk(n - 1, steps, sampled)
        names = [mix(walk.keys(data, at) ^ mix(owner.astype(np.uint64))) for data, at, owner in keyed]
        found[keyed[0][2][np.isin(names[0], names[1])]] = True
        if ((~found).reshape(TRIALS, len(KINDS)).sum(0) <= (1 - recall) * TRIALS).all():
            return n
    return 0


def edit_distance_within(item: str, text: str) -> tuple[int, int]:
    """(least edit distance between ``item`` and any part of ``text``, end of the first such part), by bit-parallel dynamic programming."""
    n = len(item)
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score, best, end = full, 0, n, n, 0
    for at, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        x = eq | minus
        d = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | ~(d | plus) & full
        down = plus & d
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up <<= 1
        down <<= 1
        plus = (down | ~(x | up)) & full
        minus = up & x & full
        if score < best:
            best, end = score, at
    return best, end


class Benchmark:
    """A block of items and the keys of the windows in them. ``walks``: how many of each shape."""

    def __init__(self, items: list[tuple[int, bytes]], rate: float = EDIT_RATE, walks: list[int] | None = None):
        self.ids = [i for i, _ in items]
        self.texts = [t for _, t in items]
        self.rate = rate
        self.chars = [t.decode(errors="replace") for t in self.texts]
        self.widest = [max(len(x.encode()) for x in c) for c in self.chars]
        self.grams = np.zeros((len(items), _GRAM_BUCKETS // 8), np.uint8)
        for k, t in enumerate(self.texts):
            row = np.zeros(_GRAM_BUCKETS, bool)
            row[_grams(np.frombuffer(t, np.uint8))] = True
            self.grams[k] = np.packbits(row)
        self.allowed = np.array([int(rate * len(c)) for c in self.chars], np.int64)
        #: Items too short for a single edit are looked up as they are, between word ends.
        self.whole = np.flatnonzero(self.allowed == 0).tolist()
        walks = walks or walks_of(items, rate)
        pad = bytes(_REACH)
        data = np.frombuffer(pad.join(self.texts) + pad, np.uint8)
        sizes = np.array([len(t) for t in self.texts])
        begin = np.concatenate(([0], np.cumsum(sizes + len(pad))))[:-1]
        self.tables = []
        shaped, self.plain = _by_shape(self.texts, rate, walks)
        for (_, _, steps, sampled, at_words), n, mine in zip(SHAPES, walks, shaped):
            owner, offset = [], []
            for k in mine:
                start = anchors(np.frombuffer(self.texts[k], np.uint8), np.array([0, sizes[k]]), at_words)
                owner.append(np.full(len(start), k))
                offset.append(start)
            if not owner:
                continue
            owner, offset = np.concatenate(owner), np.concatenate(offset)
            for seed in range(n):
                walk = Walk(seed, steps, sampled)
                key = walk.keys(data, begin[owner] + offset)
                order = np.argsort(key)
                seen = np.zeros(1 << _FILTER_BITS, bool)
                seen[key >> np.uint64(64 - _FILTER_BITS)] = True
                self.tables.append((at_words, walk, key[order], owner[order], offset[order], seen))

    def _alike(self, grams: np.ndarray, items: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Which windows have enough of their item's six-byte grams. An edit spoils those around the bytes of one character, so no true match is lost."""
        keep = np.zeros(len(items), bool)
        order = np.argsort(items, kind="stable")
        # Positions beside the data are those of a bucket that no item has.
        pad = max(map(len, self.texts)) + 4 * int(self.allowed.max(initial=0)) + 8
        grams = np.pad(grams.astype(np.uint16), pad, constant_values=_GRAM_BUCKETS)
        for part in np.split(order, np.flatnonzero(np.diff(items[order])) + 1):
            k = int(items[part[0]])
            size = len(self.texts[k])
            slack = int(self.allowed[k]) * (1 if len(self.chars[k]) == size else 4)  # in bytes
            least = size - 7 - int(self.allowed[k]) * (5 + self.widest[k])
            if least <= 0:
                keep[part] = True
                continue
            span, own = np.arange(-slack, size + slack, dtype=np.int32) + pad, np.append(np.unpackbits(self.grams[k]), np.uint8(0))
            for some in np.array_split(part, -(-len(part) * len(span) // 2_000_000)):
                at = where[some].astype(np.int32)[:, None] + span
                keep[some] = own[grams[at]].sum(1, dtype=np.int32) >= least
        return keep

    def search(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(row, item_id, edit distance, byte where the matched part ends) for each row and item within the edit rate."""
        data = _FOLD[data]
        raw = data.tobytes()
        spare = np.concatenate((data, np.zeros(_REACH, np.uint8)))
        grams = _grams(data)
        found: set[tuple[int, int, int]] = set()
        begins: dict[bool, tuple[np.ndarray, np.ndarray]] = {}
        for at_words, walk, keys, owner, offset, seen in self.tables:
            if at_words not in begins:
                at = anchors(data, offsets, at_words)
                begins[at_words] = at, np.searchsorted(offsets, at, "right") - 1
            starts, row = begins[at_words]
            if not len(starts):
                continue
            key = walk.keys(spare, starts)
            maybe = np.flatnonzero(seen[key >> np.uint64(64 - _FILTER_BITS)])
            low, high = np.searchsorted(keys, key[maybe]), np.searchsorted(keys, key[maybe], "right")
            count = high - low
            hit = np.repeat(maybe, count)
            if not len(hit):
                continue
            entry = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
            where = starts[hit] - offset[entry]
            near = self._alike(grams, owner[entry], where)
            hit, entry, where = hit[near], entry[near], where[near]
            # Windows of an item that begin close together are verified once.
            packed = np.unique(np.stack((row[hit], owner[entry], where >> 6), 1), axis=0)
            found.update(map(tuple, packed.tolist()))
        best: dict[tuple[int, int], tuple[int, int]] = {}
        # Stretches of text around the diagonals, those of one row and item that meet taken together.
        stretches: list[list[int]] = []
        for r, k, diagonal in sorted(found):
            begin, stop = int(offsets[r]), int(offsets[r + 1])
            size, slack = len(self.texts[k]), 2 * int(self.allowed[k]) + _REACH
            a, b = max(begin, (diagonal << 6) - slack), min(stop, ((diagonal + 1) << 6) + size + slack)
            if stretches and stretches[-1][:2] == [r, k] and a <= stretches[-1][3]:
                stretches[-1][3] = b
            else:
                stretches.append([r, k, a, b])
        for r, k, a, b in stretches:
            if best.get((r, k), (1, 0))[0] == 0:
                continue
            begin, allowed = int(offsets[r]), int(self.allowed[k])
            exact = raw.find(self.texts[k], a, b)
            if exact >= 0:
                best[r, k] = (0, exact + len(self.texts[k]) - begin)
                continue
            region = raw[a:b].decode(errors="replace")
            distance, end = edit_distance_within(self.chars[k], region)
            if distance <= allowed and distance < best.get((r, k), (1 << 30, 0))[0]:
                best[r, k] = (distance, a + len(region[:end].encode()) - begin)
        for k in self.plain:
            for r, (begin, stop) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                region = raw[begin:stop].decode(errors="replace")
                distance, end = edit_distance_within(self.chars[k], region)
                if distance <= int(self.allowed[k]):
                    best[r, k] = (distance, len(region[:end].encode()))
        for k in self.whole:
            at = raw.find(self.texts[k])
            while at >= 0:
                r = int(np.searchsorted(offsets, at, "right")) - 1
                stop, end = int(offsets[r + 1]), at + len(self.texts[k])
                edge = (at == offsets[r] or not raw[at - 1 : at].isalnum()) and (end == stop or not raw[end : end + 1].isalnum())
                if end <= stop and edge:
                    best[r, k] = (0, end - int(offsets[r]))
                    at = raw.find(self.texts[k], stop)
                else:
                    at = raw.find(self.texts[k], at + 1)
        for (r, k), (distance, end) in sorted(best.items()):
            yield r, self.ids[k], distance, end


def _grams(data: np.ndarray) -> np.ndarray:
    """The bucket of the six bytes at each position."""
    if len(data) < 8:
        data = np.concatenate((data, np.zeros(8, np.uint8)))
    n = len(data)
    x = np.ndarray((n - 7,), "<u8", np.ascontiguousarray(data), 0, (1,)) << np.uint64(16)
    return (x * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(52)).astype(np.int64)


#: Bytes that a window may reach past its begin.
_REACH = max(s[2] for s in SHAPES) + 1


def _by_shape(texts: list[bytes], rate: float, walks: list[int] | None = None) -> tuple[list[list[int]], list[int]]:
    """Positions of the items of each shape, the first that they fit and that has walks, and of those left for plain edit distance. Items without a single edit allowed are in neither."""
    out: list[list[int]] = [[] for _ in SHAPES]
    plain = []
    for k, t in enumerate(texts):
        if int(rate * len(t.decode(errors="replace"))):
            fit = [i for i, (size, word, *_) in enumerate(SHAPES) if len(t) >= size and len(t.split()) * word >= (len(t) if word else 0) and (walks is None or walks[i])]
            (out[fit[0]] if fit else plain).append(k)
    return out, plain


def walks_of(items: list[tuple[int, bytes]], rate: float) -> list[int]:
    """Walks of each shape for a block; 0 where a shape has no items or cannot reach the recall for them."""
    texts, walks = [t for _, t in items], [1] * len(SHAPES)
    for i, shape in enumerate(SHAPES):
        mine = _by_shape(texts, rate, walks)[0][i]
        walks[i] = walks_needed([texts[k] for k in mine], rate, shape) if mine else 0
    return walks


def _blocks(benchmark: DataFrame, item: str, text: str, rate: float) -> list[tuple[str, list[int]]]:
    """The items, folded, in files of bounded bytes in the shared folder: (path, walks of each shape). The driver holds one block at a time."""
    folder, out, held, size = scratch_path(benchmark.sparkSession, "benchmark"), [], [], 0
    folded = bytes(_FOLD)

    def write() -> None:
        path, _ = write_file(folder, f"block-{len(out):06d}", pickle.dumps(held))
        out.append((path, walks_of(held, rate)))

    for row in benchmark.select(F.col(f"`{item}`").cast("long"), F.col(f"`{text}`")).filter(F.col(f"`{text}`").rlike(r"\S")).toLocalIterator():
        held.append((row[0], row[1].encode().translate(folded).strip(b" ")))
        size += len(held[-1][1])
        if size >= BLOCK_BYTES:
            write()
            held, size = [], 0
    if held:
        write()
    return out


def contaminations(df: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", rate: float = EDIT_RATE) -> DataFrame:
    """A row for each document and benchmark item such that a part of the document is within the edit rate of the item: doc_id, item_id, edits, n_chars of the item, end (byte after the part).

    The CGK embedding of a window turns edits into few differing positions; keys sample positions of it. A key uses the embedding's
    first steps, so its cost does not depend on the items' sizes, and windows begin at every word of documents and items, for
    items that are short or have few words at every byte. Independent walks are added until edits at the limit of the block's own
    items, random, evenly spaced and clustered, are each found with the target recall; items for which no number of walks does that
    are compared by edit distance with every text. Where a key is shared, the item-sized window around it is verified by exact edit distance (characters; ASCII case
    and the kind of white space are ignored). Items too short for a single edit match as they are, between word ends.

    Null or blank documents and items match nothing; rows with equal doc_id each give their rows; items that repeat each count;
    extra columns are ignored; an empty benchmark finds nothing. The benchmark passes in blocks of BLOCK_BYTES, each of them one pass
    over the documents. A text is held whole in one task.
    """
    rows = df.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    schema = "doc_id long, item_id long, edits int, item_chars int, end long"
    out = None
    for path, walks in _blocks(benchmark, item, item_text, rate):
        found = rows.mapInArrow(_searcher(path, walks, rate, False), schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else rows.sparkSession.createDataFrame([], schema)


def _searcher(path: str, walks: list[int], rate: float, clean: bool):
    """Task code: hits of a block of items, or with ``clean`` the rows (all columns) that have none."""
    def run(batches):
        items = Benchmark(pickle.loads(read_file(path)), rate, walks)
        size = {i: len(c) for i, c in zip(items.ids, items.chars)}
        for batch, data, offsets in pieces(batches, "text"):
            hits = list(items.search(data, offsets))
            if clean:
                bad = {h[0] for h in hits}
                yield batch.take(pa.array([k for k in range(batch.num_rows) if k not in bad], pa.int64()))
            elif hits:
                rows = pa.array([h[0] for h in hits])
                ids = [h[1] for h in hits]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows).cast(pa.int64()), pa.array(ids, pa.int64()), pa.array([h[2] for h in hits], pa.int32()), pa.array([size[i] for i in ids], pa.int32()), pa.array([h[3] for h in hits], pa.int64())], ["doc_id", "item_id", "edits", "item_chars", "end"])
    return run


def decontaminate(df: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", rate: float = EDIT_RATE) -> DataFrame:
    """The rows of ``df`` whose text holds no benchmark item (see ``contaminations``). Rows with null or blank texts stay, as do all rows
    where the benchmark is empty; repeated rows and null keys count each; extra columns pass through whatever their names."""
    rows = df.select(packed(df), F.col(f"`{text}`").alias("text"))
    for path, walks in _blocks(benchmark, item, item_text, rate):
        rows = rows.mapInArrow(_searcher(path, walks, rate, True), rows.schema)
    return unpacked(rows, df.columns)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))

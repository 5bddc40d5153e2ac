"""Operator 4: token ids in directly addressable codes (DAC), one file for each run of documents."""

from __future__ import annotations

import codecs
import functools
import os
import sys
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Rolling, documents, materialize, pieces, scratch_path
from .files import read_file, write_file

END_ID = 2
MAGIC = b"DACTOK01"
#: Bits between two entries of a rank directory.
RANK_BITS = 512
#: Tokens after which a task begins another file.
FILE_TOKENS = 4_000_000
#: Words that a worker's cache holds before it starts afresh.
CACHE_WORDS = 1_000_000


# -- the format -----------------------------------------------------------------------------------

def dac_encode(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels of (low bytes, continuation bitmap, rank directory). Level k holds byte k of the ids that need it."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 255
        bitmap = np.packbits(more, bitorder="little")
        counts = np.add.reduceat(more.astype(np.uint32), np.arange(0, len(more), RANK_BITS)) if len(more) else np.zeros(0, np.uint32)
        levels.append(((rest & 255).astype(np.uint8), bitmap, np.concatenate(([0], np.cumsum(counts)))[:-1].astype(np.uint64) if len(counts) else np.zeros(0, np.uint64)))
        rest = rest[more] >> 8
        if not len(rest):
            return levels


class Dac:
    """Reads a file of this format. ``ids[i]`` costs one byte and one rank for each level: no block is decoded."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        docs, n_levels = np.frombuffer(data, np.uint64, 2, 8)
        at = 24
        sizes = np.frombuffer(data, np.uint64, int(n_levels), at)
        at += 8 * int(n_levels)
        self.doc_ids = np.frombuffer(data, np.int64, int(docs), at)
        at += 8 * int(docs)
        self.null_ids = np.frombuffer(data, np.uint8, int(docs), at).astype(bool)
        at += int(docs)
        self.ends = np.frombuffer(data, np.uint64, int(docs), at).astype(np.int64)
        at += 8 * int(docs)
        self.levels = []
        for n in sizes.astype(int):
            bits, ranks = -(-n // 8), -(-n // RANK_BITS)
            low = np.frombuffer(data, np.uint8, n, at)
            bitmap = np.frombuffer(data, np.uint8, bits, at + n)
            rank = np.frombuffer(data, np.uint64, ranks, at + n + bits)
            self.levels.append((low, bitmap, rank))
            at += n + bits + 8 * ranks

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for k, (low, bitmap, rank) in enumerate(self.levels):
            value |= int(low[i]) << (8 * k)
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_BITS
            head = bitmap[block * RANK_BITS // 8 : (i >> 3) + 1].copy()
            head[-1] &= (1 << (i & 7)) - 1
            i = int(rank[block]) + int(np.bitwise_count(head).sum())
        return value

    def all(self) -> np.ndarray:
        """Every id, level by level."""
        values = [low.astype(np.uint32) for low, _, _ in self.levels]
        for k in range(len(values) - 1, 0, -1):
            more = np.unpackbits(self.levels[k - 1][1], bitorder="little", count=len(values[k - 1])).astype(bool)
            values[k - 1][more] |= values[k] << np.uint32(8)
        return values[0]


def dac_file(doc_ids: list[int | None], ends: np.ndarray, ids: np.ndarray) -> bytes:
    levels = dac_encode(ids)
    head = [MAGIC, np.array([len(doc_ids), len(levels)] + [len(x[0]) for x in levels], np.uint64).tobytes()]
    known = np.array([x if x is not None else 0 for x in doc_ids], np.int64).tobytes()
    nulls = np.array([x is None for x in doc_ids], np.uint8).tobytes()
    return b"".join(head + [known, nulls, ends.astype(np.uint64).tobytes()] + [x.tobytes() for level in levels for x in level])


# -- encoding -------------------------------------------------------------------------------------

LETTER, NUMBER, WHITE, OTHER = range(4)


_WHITE = {9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}
_UNSEEN = 255
_KINDS = np.full(sys.maxunicode + 1, _UNSEEN, np.uint8)


def _classes(points: np.ndarray) -> np.ndarray:
    """The byte-level pattern's class of each code point, by its Unicode category; looked up once for each point."""
    out = _KINDS[points]
    for c in np.unique(points[out == _UNSEEN]).tolist():
        kind = unicodedata.category(chr(c))[0]
        _KINDS[c] = WHITE if c in _WHITE else LETTER if kind == "L" else NUMBER if kind == "N" else OTHER
    return _KINDS[points]


def _byte_classes(data: np.ndarray) -> np.ndarray:
    """The class of the character that each UTF-8 byte belongs to."""
    out = _classes(np.arange(128))[np.minimum(data, 127)]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        b = np.concatenate((data, np.zeros(3, np.uint8))).astype(np.uint32)
        first, x, y, z = (b[lead + k] for k in range(4))
        two, three = first < 0xE0, first < 0xF0
        point = np.where(two, (first & 31) << 6 | x & 63, np.where(three, (first & 15) << 12 | (x & 63) << 6 | y & 63, (first & 7) << 18 | (x & 63) << 12 | (y & 63) << 6 | z & 63))
        kind = _classes(point)
        out[lead], out[lead + 1] = kind, kind
        at = lead[~two]
        out[at + 2] = kind[~two]
        at = lead[~three]
        out[at + 3] = kind[~three]
    return out


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the byte-level pattern's matches (without contractions) in the concatenated texts, and whether each is white space only."""
    n = len(data)
    kind = _byte_classes(data)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    head = (data & 0xC0) != 0x80  # a character's first byte
    change = np.concatenate(([True], kind[1:] != kind[:-1])) | first[:n]
    starts = change.copy()
    # A run of white space before other text gives up its last character: a plain space to the word, any other as a match of its own.
    ahead = np.concatenate((change[1:], [True])) & ~first[1:]
    last = np.flatnonzero((kind == WHITE) & ahead)  # last byte of such a run
    for _ in range(3):
        last = np.where(head[last], last, last - 1)
    starts[last] = True
    plain = last[data[last] == 32]
    starts[plain + 1] = False
    at = np.flatnonzero(starts)
    white = kind[at] == WHITE
    white[np.searchsorted(at, plain)] = False
    return at, white


class WordEncoder:
    """Encodes texts word by word with the tokenizers library; each word is encoded once while the cache holds it.

    The byte-level tokenizer never merges across the matches of its own pattern, so a text's ids are its
    matches' ids in order. New words go to the library's model in batches, joined by line feeds, which are
    split off as pieces of their own. Texts with contractions or the special token go to the library whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.feed = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        # The byte-level alphabet: the visible Latin-1 characters stand for themselves, other bytes for code points from 256 on.
        seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = iter(range(256, 512))
        self.alphabet = "".join(chr(b) if b in seen else chr(next(other)) for b in range(256))
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.Split(self.alphabet[10], "isolated")
        self.clear()

    def clear(self) -> None:
        self.hashes, self.where = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.begin, self.pool = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _solid(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, batch: int = 256) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """(ids, numbers of ids) of words that hold no line feed."""
        size = ends - starts + 1
        total = np.cumsum(size)
        at = np.repeat(starts - total + size, size) + np.arange(total[-1]) if len(size) else np.zeros(0, np.int64)
        joined = data[np.minimum(at, len(data) - 1)]
        joined[total - 1] = 10
        text = codecs.charmap_decode(joined.tobytes(), "strict", self.alphabet)[0]
        cuts = [0, *total[batch - 1 :: batch].tolist()]
        if len(total) and cuts[-1] != total[-1]:
            cuts.append(int(total[-1]))
        encoded = self.model.encode_batch_fast([text[a:b] for a, b in zip(cuts, cuts[1:])], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in encoded]) if encoded else np.zeros(0, np.uint32)
        feeds = np.flatnonzero(ids == self.feed)
        if len(feeds) != len(starts):
            raise ValueError("words were not kept apart")
        return [ids[ids != self.feed]], [np.diff(feeds, prepend=-1) - 1]

    def _learn(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, white: np.ndarray) -> None:
        solid, blank = np.flatnonzero(~white), np.flatnonzero(white)
        ids, counts = self._solid(data, starts[solid], ends[solid])
        for e in self.tokenizer.encode_batch([data[starts[i] : ends[i]].tobytes().decode() for i in blank], add_special_tokens=False):
            ids.append(np.array(e.ids, np.uint32))
            counts.append(np.array([len(e.ids)]))
        order = np.concatenate((solid, blank))
        base = len(self.begin) - 1
        self.begin = np.concatenate((self.begin, self.begin[-1] + np.cumsum(np.concatenate(counts))))
        self.pool = np.concatenate((self.pool, *ids))
        hashes, where = hashes[order], base + np.arange(len(order))
        rank = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[rank])
        self.hashes, self.where = np.insert(self.hashes, at, hashes[rank]), np.insert(self.where, at, where[rank])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, number of ids of each row)."""
        n_rows = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n_rows, np.int64)
        raw = data.tobytes()
        starts, white = split_words(data, offsets)
        ends = np.concatenate((starts[1:], [len(data)]))
        hashes = Rolling(data)(starts, ends)
        unique, index, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) > CACHE_WORDS:
            self.clear()
        at = np.searchsorted(self.hashes, unique)
        new = np.ones(len(unique), bool)
        held = at < len(self.hashes)
        new[held] = self.hashes[at[held]] != unique[held]
        if new.any():
            some = index[new]
            self._learn(unique[new], data, starts[some], ends[some], white[some])
            at = np.searchsorted(self.hashes, unique)
        where = self.where[at][back]
        begin = self.begin[where]
        count = self.begin[where + 1] - begin
        total = np.cumsum(count)
        ids = self.pool[np.repeat(begin - total + count, count) + np.arange(total[-1])]
        before = np.concatenate(([0], total))
        per_row = np.diff(before[np.searchsorted(starts, offsets)])
        whole = [r for r in self._odd_rows(raw, offsets)]
        if whole:
            parts = np.split(ids, np.cumsum(per_row)[:-1])
            for r in whole:
                parts[r] = np.array(self.tokenizer.encode(raw[offsets[r] : offsets[r + 1]].decode(), add_special_tokens=False).ids, np.uint32)
                per_row[r] = len(parts[r])
            ids = np.concatenate(parts)
        return ids, per_row

    @staticmethod
    def _odd_rows(raw: bytes, offsets: np.ndarray) -> list[int]:
        """Rows that may hold a contraction or the special token's string."""
        rows = set()
        for mark in (b"'", b"<|"):
            at = raw.find(mark)
            while at >= 0:
                r = int(np.searchsorted(offsets, at, "right")) - 1
                rows.add(r)
                at = raw.find(mark, int(offsets[r + 1]))
        return sorted(rows)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process, so that its cache outlives a task."""
    return WordEncoder(path)


MANIFEST = "part int, seq int, path string, sha256 string, docs long, tokens long"


def write_tokens(df: DataFrame, folder: str, *, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID, files_tokens: int = FILE_TOKENS, partitions: int | None = None) -> DataFrame:
    """Encode every whole text in ascending key order into token files below ``folder``; returns the manifest, a row for each file.

    Documents are range-partitioned and sorted by key (ties: text, nulls first), so a task writes consecutive
    documents and holds ``files_tokens`` ids at a time. Null or empty texts are the end id alone.
    """
    def write(batches):
        words, part, seq = encoder(tokenizer), TaskContext.get().partitionId(), 0
        doc_ids, counts, held, size = [], [], [], 0

        def flush():
            nonlocal doc_ids, counts, held, size, seq
            path, digest = write_file(folder, f"tokens-{part:06d}-{seq:06d}.dac", dac_file(doc_ids, np.cumsum(np.concatenate(counts)), np.concatenate(held)))
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "path": [path], "sha256": [digest], "docs": [len(doc_ids)], "tokens": [size]})
            doc_ids, counts, held, size, seq = [], [], [], 0, seq + 1
            return row

        for batch, data, offsets in pieces(batches, "text"):
            ids, per_row = words.encode(data, offsets)
            ids = np.insert(ids, np.cumsum(per_row), np.uint32(end_id))
            per_row = per_row + 1
            doc_ids += batch.column(0).to_pylist()
            counts.append(per_row)
            held.append(ids)
            size += len(ids)
            if size >= files_tokens:
                yield flush()
        if doc_ids:
            yield flush()

    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(rows.mapInArrow(write, MANIFEST), "token-manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Documents of the files in a manifest: doc_id, start, n_tokens, ids_crc32 and the file that holds them."""
    # The manifest has a row for each file of millions of ids.
    before = F.sum("tokens").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.withColumn("before", F.coalesce(before, F.lit(0)))
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                dac = Dac(read_file(row["path"], row["sha256"]))
                ids = dac.all().astype("<u4")
                begins = np.concatenate(([0], dac.ends[:-1]))
                view = memoryview(ids.tobytes())
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(dac.doc_ids, pa.int64(), mask=dac.null_ids),
                    "start": pa.array(row["before"] + begins, pa.int64()),
                    "n_tokens": pa.array(dac.ends - begins, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(view[4 * s : 4 * e]) for s, e in zip(begins.tolist(), dac.ends.tolist())], pa.int64()),
                    "path": pa.array([row["path"]] * len(begins), pa.string()),
                })

    return files.repartition(n, "part", "seq").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, path string")


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = write_tokens(documents(spark, sf_dir), scratch_path(spark, "tokens"), tokenizer=public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(manifest).drop("path")

"""Shared helpers: scratch tables, flat text buffers and 64-bit hashing in numpy."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy pass works on; a single longer document makes its own pass.
CHUNK = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_MADE: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Set here only where unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = _MADE.setdefault("local", [f"file://{tempfile.mkdtemp(prefix='scratch-')}"])[0]
    return at.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the driver's process ends."""
    path = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    if "paths" not in _MADE:
        _MADE["paths"] = []
        atexit.register(clear_scratch)
    _MADE["paths"].append(path)
    return path


def clear_scratch() -> None:
    """Delete the scratch tables of this process; call it once results have been read."""
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    while _MADE.get("paths"):
        path = hadoop(_MADE["paths"].pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and lost executors cost no recomputation."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Words of 64 bits in a filter of ``may_hold``: at most so many rows are broadcast, whatever the data.
FILTER_WORDS = 1 << 16


def may_hold(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` with a column ``_may``: false only if no row of ``keys`` has the same ``key`` (null equals null).

    A one-hash Bloom filter as a table of FILTER_WORDS rows at most. A large ``keys`` fills it up, which
    costs later steps more rows but no result.
    """
    def spot(frame: DataFrame) -> F.Column:
        return F.pmod(F.xxhash64(frame[key].cast("string")), F.lit(FILTER_WORDS * 64))

    bits = keys.select(spot(keys).alias("_spot")).groupBy(F.expr("_spot div 64").alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_spot % 64 AS int))")).alias("_mask"))
    marked = df.withColumn("_spot", spot(df)).withColumn("_word", F.expr("_spot div 64"))
    marked = marked.join(F.broadcast(bits), "_word", "left")
    return marked.withColumn("_may", F.expr("coalesce(getbit(_mask, cast(_spot % 64 AS int)) = 1, false)")).drop("_spot", "_word", "_mask")


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    """A table of the data folder. Rows reach Python workers a few hundred at a time, so very long texts do not add up there."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def packed(df: DataFrame) -> F.Column:
    """All columns of ``df`` in one struct, so that no name among them can clash or be read as a path."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns again, from ``row``."""
    return df.select(*[F.col(f"row.`{c}`") for c in columns])


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about ``limit`` bytes in ``column`` (text or binary): (slice, its bytes, offsets of each row in them). Null counts as empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(batch.schema.get_field_index(column))
        text = pc.fill_null(text.cast(pa.large_binary()), b"")
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None else np.zeros(0, np.uint8)
        row = 0
        while row < len(text):
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
            yield batch.slice(row, end - row), data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
            row = end


def word_slices(raw: bytes, a: int, b: int, limit: int = CHUNK) -> Iterator[list[bytes]]:
    """The words of ``raw[a:b]`` (runs of other than ASCII white space), about ``limit`` bytes at a time. No word is cut."""
    while b - a > limit:
        cut = max(raw.rfind(c, a, a + limit) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if cut < 0:  # one word longer than that
            cut = min((x for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (x := raw.find(c, a + limit, b)) >= 0), default=b)
        yield raw[a:cut].split()
        a = min(cut + 1, b)
    yield raw[a:b].split()


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64 and of its inverse."""
    if len(_POWERS[0]) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        n = max(n, CHUNK + 4096)
        for k, base in enumerate((_BASE, inverse)):
            table = np.full(n, base, np.uint64)
            table[0] = 1
            _POWERS[k] = np.multiply.accumulate(table)
    return _POWERS[0], _POWERS[1]


class Rolling:
    """Hashes of any substring of ``data`` in constant time (polynomial modulo 2^64 over mixed bytes)."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of non-space bytes; runs end at row ends."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(solid & (np.concatenate(([True], ~solid[:-1])) | first[:-1]))
    ends = np.flatnonzero(solid & (np.concatenate((~solid[1:], [True])) | first[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)

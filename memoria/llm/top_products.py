"""Operator 13: exact top-k inner products over buckets of vectors of like length."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialize, scratch_path
from .files import read_file, write_file

TOP = 10
EVERY = 100
#: Whole steps that one unit of a component is cut into.
STEPS = 1024
#: Vectors of one bucket, and bytes of the buckets that one task holds at once.
BUCKET = 2048
HELD_BYTES = 32 << 20
#: Bytes of a block of queries, and of the longest vectors that give first thresholds.
BLOCK_BYTES = 4 << 20
SEED_BYTES = 2 << 20
#: Coordinates that coordinate pruning looks at.
FOCUS = 4
#: What rounding may add to a bound, relative to it. Bounds only leave out what is surely too small.
SLACK = 1e-9
#: Queries of a bucket whose candidates are counted in order to choose between the prunings.
TRIED = 12
MOST_LONG = (1 << 63) - 1


def products(vectors: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-numbered doubles: (vectors, queries), as doubles where those are exact, else as long or Python numbers. One beyond a long counts as the nearest long."""
    most = float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, vectors.shape[1])
    if most < 2.0**53:
        return vectors @ queries.T
    if most < 2.0**62:
        return vectors.astype(np.int64) @ queries.astype(np.int64).T
    whole = np.frompyfunc(int, 1, 1)
    return np.clip(whole(vectors).astype(object) @ whole(queries).astype(object).T, -MOST_LONG - 1, MOST_LONG)


def _length(v: np.ndarray) -> float:
    """Euclidean length, without overflow in between; at most the largest double."""
    most = float(np.abs(v).max(initial=0))
    return min(most * float(np.linalg.norm(v / most)), np.finfo(float).max) if most else 0.0


class Bucket:
    """Vectors of like length, longest first, with their directions sorted by each coordinate."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, lengths: np.ndarray):
        self.ids, self.vectors, self.lengths = ids, vectors, lengths
        self.longest = float(lengths[0])
        self._sorted: tuple[np.ndarray, np.ndarray] | None = None

    def sorted_directions(self) -> tuple[np.ndarray, np.ndarray]:
        """For each coordinate its values in order, and the rows they are of."""
        if self._sorted is None:
            unit = self.vectors / np.maximum(self.lengths, 1e-300)[:, None]
            order = np.argsort(unit, axis=0, kind="stable").T
            self._sorted = np.ascontiguousarray(np.take_along_axis(unit.T, order, 1)), np.ascontiguousarray(order)
        return self._sorted

    def by_length(self, least_length: float) -> int:
        """How many vectors are long enough; they come first."""
        return int(np.searchsorted(-self.lengths, -least_length * (1 - SLACK), "right"))

    def by_coordinates(self, direction: np.ndarray, cosine: float) -> np.ndarray:
        """Rows that may have at least ``cosine`` with ``direction``.

        A direction within the angle of ``cosine`` has each coordinate within cos(angle of the query's own + that
        angle) and cos(the difference). The coordinates in which the query stands out most bound best.
        """
        values, rows = self.sorted_directions()
        reach = np.arccos(np.clip(cosine * (1 - SLACK), -1, 1)) + 1e-7
        ranges = []
        for f in np.argpartition(-np.abs(direction), min(FOCUS, len(direction)) - 1)[:FOCUS].tolist():
            own = np.arccos(np.clip(direction[f], -1, 1))
            low = -1.0 if own + reach >= np.pi else np.cos(own + reach) - 1e-7
            high = 1.0 if reach >= own else np.cos(own - reach) + 1e-7
            a, b = np.searchsorted(values[f], low, "left"), np.searchsorted(values[f], high, "right")
            ranges.append((b - a, a, b, f, low, high))
        ranges.sort()
        _, a, b, f, _, _ = ranges[0]
        left = rows[f, a:b]
        unit = self.lengths
        for _, _, _, f, low, high in ranges[1:]:
            at = self.vectors[left, f] / np.maximum(unit[left], 1e-300)
            left = left[(at >= low - 1e-12) & (at <= high + 1e-12)]
        return np.sort(left)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Both in the wider of their types, each of which holds the whole numbers of a narrower one."""
    kinds = [np.dtype(np.float64), np.dtype(np.int64), np.dtype(object)]
    widest = kinds[max(kinds.index(x.dtype) for x in (a, b))]
    return np.concatenate([x if x.dtype == widest else x.astype(np.int64).astype(widest) for x in (a, b)])


class Best:
    """The ``top`` best answers of each query of a block so far: largest product first, ties by smaller id."""

    def __init__(self, query_ids: np.ndarray, thresholds: np.ndarray, top: int):
        self.query_ids, self.top = query_ids, top
        self.thresholds = thresholds.copy()
        self.found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.float64))] * len(query_ids)

    def add(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        """Products with query ``q``; the query's own row is no answer."""
        good = (ids != self.query_ids[q]) & (scores >= self.thresholds[q])
        if not good.any():
            return
        ids, scores = np.concatenate((self.found[q][0], ids[good])), _joined(self.found[q][1], scores[good])
        order = np.lexsort((ids, -scores))
        first = np.sort(np.unique(ids[order], return_index=True)[1])[: self.top]  # an id with several vectors counts once
        order = order[first]
        self.found[q] = ids[order], scores[order]
        if len(order) == self.top:
            least = float(scores[order[-1]])
            self.thresholds[q] = max(self.thresholds[q], least - abs(least) * SLACK)


def search_bucket(bucket: Bucket, queries: np.ndarray, sizes: np.ndarray, best: Best) -> None:
    """Let the vectors of a bucket that may be among a query's best take part.

    A query's threshold over its length and the bucket's greatest length is the cosine that a vector needs here.
    Over 1 the bucket is out. Under a cut, vectors are left out by length alone; from the cut on by coordinates.
    The cut is where, of a few queries over the range of cosines, coordinates begin to leave fewer numbers to look at.
    """
    need = best.thresholds / np.maximum(sizes, 1e-300)  # the length that a vector needs
    need[sizes == 0] = -np.inf
    cosine = need / max(bucket.longest, 1e-300)
    alive = np.flatnonzero(need * (1 - SLACK) <= bucket.longest)
    if not len(alive):
        return
    alive = alive[np.argsort(cosine[alive], kind="stable")]
    dim, n = queries.shape[1], len(bucket.ids)
    cut = np.inf
    sharp = alive[cosine[alive] > 0]
    for q in sharp[np.unique(np.linspace(0, len(sharp) - 1, min(TRIED, len(sharp))).astype(int))] if len(sharp) else ():
        left = len(bucket.by_coordinates(queries[q] / sizes[q], cosine[q]))
        # Rows picked one by one cost about four times what they cost in one product.
        if FOCUS * n / 4 + 4 * dim * left < dim * bucket.by_length(need[q]):
            cut = cosine[q]
            break
    plain = alive[cosine[alive] < cut]
    for k in range(0, len(plain), 64):
        some = plain[k : k + 64]
        first = bucket.by_length(need[some].min())
        scores = products(bucket.vectors[:first], queries[some])
        for j, q in enumerate(some.tolist()):
            best.add(q, bucket.ids[:first], scores[:, j])
    for q in alive[cosine[alive] >= cut].tolist():
        rows = bucket.by_coordinates(queries[q] / sizes[q], cosine[q])
        rows = rows[: np.searchsorted(rows, bucket.by_length(need[q]))]
        if len(rows):
            best.add(q, bucket.ids[rows], products(bucket.vectors[rows], queries[q : q + 1])[:, 0])


def _saved(*arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, *arrays)
    return out.getvalue()


def _loaded(path: str, digest: str) -> list[np.ndarray]:
    with np.load(io.BytesIO(read_file(path, digest))) as f:
        return [f[k] for k in f.files]


def top_products(df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", every: int = EVERY, top: int = TOP, steps: int = STEPS, bucket: int = BUCKET, block_bytes: int = BLOCK_BYTES, seed_bytes: int = SEED_BYTES) -> DataFrame:
    """query_id, rank, vec_id and score: for each row whose key is divisible by ``every`` its ``top`` largest inner products among all other rows, components being floor(steps * x).

    Rows are sorted by length into ranges, and a task holds the buckets of one range. The longest vectors of all, as
    many as ``seed_bytes`` hold, give each query a threshold that its answers are known to reach. Queries lie in
    blocks of ``block_bytes`` in files, those that need only short vectors first, and a task reads the blocks that
    its longest vector may serve. Each bucket is then pruned by length or by coordinates (see search_bucket), what
    remains is multiplied exactly, and answers raise the query's threshold for shorter buckets. Nothing is approximate.

    Vectors that are null or hold null or non-finite components take no part, nor do rows with a null key; zero
    vectors do. A query meets the vectors of its own number of components. Equal rows count once, and so does an
    answer whose key has several vectors, by its best product; a key never answers itself. Of equal vectors the ``top`` + 1
    smallest keys can matter. A score beyond a long counts as the nearest long. Ties go to the
    smaller key; extra columns are ignored; an empty table gives no rows.
    """
    spark = df.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))
    rows = rows.filter("vec_id IS NOT NULL AND x IS NOT NULL AND forall(x, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('infinity'))")

    def floored(batches):
        for batch in batches:
            x, n = batch.column(1), pa.compute.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            flat = np.floor(x.flatten().to_numpy() * steps) + 0.0  # no negative zero
            ends = np.cumsum(n)
            square = np.concatenate(([0.0], np.cumsum(flat * flat)))
            if np.isfinite(square[-1]) and square[-1] < 2.0**53:
                size = np.sqrt(square[ends] - square[ends - n])
            else:
                size = np.array([_length(flat[a:b]) for a, b in zip(ends - n, ends)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(flat)), pa.array(size), pa.array(n.astype(np.int32))], ["vec_id", "v", "size", "dim"])

    whole = "vec_id long, v array<double>, size double, dim int"
    rows = rows.mapInArrow(floored, whole).dropDuplicates(["vec_id", "v"])
    asked = materialize(rows.filter(F.pmod("vec_id", F.lit(every)) == 0), "asked")
    # The group limit runs before the shuffle: a vector in very many rows sends top + 1 of them from each task.
    alike = Window.partitionBy("dim", "v").orderBy("vec_id")
    rows = materialize(rows.withColumn("copy", F.row_number().over(alike)).filter(F.col("copy") <= top + 1).drop("copy"), "vectors")
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("dim").alias("bytes"), F.max("dim").alias("most")).first()
    if not totals["n"]:
        return spark.createDataFrame([], schema)

    # First thresholds, from the longest vectors of the largest number of components.
    width = 8 * max(1, totals["most"])
    seeds = rows.filter(F.col("dim") == totals["most"]).orderBy(F.desc("size"), "vec_id").limit(max(top + 1, seed_bytes // width)).select("vec_id", "v").collect()
    folder = scratch_path(spark, "queries")
    seed = write_file(folder, "longest", _saved(np.array([r[0] for r in seeds], np.int64), np.array([r[1] for r in seeds], np.float64).reshape(len(seeds), -1)))
    seeded = totals["most"]

    def threshold(batches):
        ids, vectors = _loaded(*seed)
        for batch in batches:
            need = np.full(batch.num_rows, -np.inf)
            same = np.flatnonzero(batch.column(3).to_numpy() == seeded)
            q_ids, sizes = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            if len(same):
                queries = batch.column(1).take(pa.array(same)).flatten().to_numpy().reshape(len(same), -1)
                for k in range(0, len(same), 64):
                    best = Best(q_ids[same[k : k + 64]], np.full(len(same[k : k + 64]), -np.inf), top)
                    scores = products(vectors, queries[k : k + 64])
                    for j in range(scores.shape[1]):
                        best.add(j, ids, scores[:, j])
                    need[same[k : k + 64]] = best.thresholds.astype(np.float64)
            length = np.where(sizes > 0, need / np.maximum(sizes, 1e-300), -np.inf)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(need), pa.array(length)], ["vec_id", "v", "size", "dim", "threshold", "need"])

    per_block = max(64, block_bytes // width)
    asked = materialize(asked.mapInArrow(threshold, f"{whole}, threshold double, need double"), "thresholds")
    count = asked.count()
    ranged = asked.repartitionByRange(max(1, -(-count // per_block)), "dim", "need", "vec_id").sortWithinPartitions("dim", "need", "vec_id")

    def save(batches):
        """Blocks of queries of one number of components as files; the table says what a block needs at least."""
        from pyspark import TaskContext

        held, made, dim = [], 0, None

        def finish():
            ids, vectors, sizes, thresholds, need = (np.concatenate(x) for x in zip(*held))
            path, digest = write_file(folder, f"block-{TaskContext.get().partitionId()}-{made}", _saved(ids, vectors, sizes, thresholds))
            return pa.RecordBatch.from_pydict({"dim": pa.array([vectors.shape[1]], pa.int32()), "need": [float(need.min())], "path": [path], "digest": [digest]})

        for batch in batches:
            dims = batch.column(3).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(dims)) + 1).tolist(), len(dims)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and (dims[a] != dim or sum(len(x[0]) for x in held) >= per_block):
                    yield finish()
                    held, made = [], made + 1
                dim = dims[a]
                part = batch.slice(a, b - a)
                held.append((part.column(0).to_numpy(), part.column(1).flatten().to_numpy().reshape(b - a, -1), *(part.column(k).to_numpy() for k in (2, 4, 5))))
        if held:
            yield finish()

    # A line for each block: a query in some thousands of rows and a block in thousands of queries.
    blocks = materialize(ranged.mapInArrow(save, "dim int, need double, path string, digest string"), "blocks").collect()
    listed = write_file(folder, "blocks", repr([tuple(r) for r in sorted(blocks, key=lambda r: (r["dim"], r["need"]))]).replace("-inf", "float('-inf')").encode())

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-8 * totals["bytes"] // HELD_BYTES))
    parts = max(1, min(parts, -(-totals["n"] // bucket)))
    sorted_rows = rows.withColumn("order", -F.col("size")).repartitionByRange(parts, "dim", "order", "vec_id").sortWithinPartitions("dim", "order", "vec_id").drop("order")

    def search(batches):
        lines = eval(read_file(*listed), {"float": float})  # noqa: S307 - written above
        held, size, dim = [], 0, None

        def finish():
            ids, vectors, lengths = (np.concatenate(x) for x in zip(*held))
            own = [Bucket(ids[k : k + bucket], vectors[k : k + bucket], lengths[k : k + bucket]) for k in range(0, len(ids), bucket)]
            for block_dim, need, path, digest in lines:
                if block_dim != dim or need * (1 - SLACK) > own[0].longest:
                    continue
                q_ids, queries, sizes, thresholds = _loaded(path, digest)
                best = Best(q_ids, thresholds, top)
                for b in own:
                    search_bucket(b, queries, sizes, best)
                for q, (near, scores) in zip(q_ids.tolist(), best.found):
                    if len(near):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), q)), pa.array(near), pa.array(scores.astype(np.int64))], ["query_id", "vec_id", "score"])

        for batch in batches:
            dims = batch.column(3).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(dims)) + 1).tolist(), len(dims)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and (dims[a] != dim or size >= HELD_BYTES):
                    yield from finish()
                    held, size = [], 0
                dim = dims[a]
                part = batch.slice(a, b - a)
                vectors = part.column(1).flatten().to_numpy().reshape(b - a, -1)
                held.append((part.column(0).to_numpy(), vectors, part.column(2).to_numpy()))
                size += vectors.nbytes
        if held:
            yield from finish()

    found = sorted_rows.mapInArrow(search, "query_id long, vec_id long, score long").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op13_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(documents(spark, sf_dir, "embeddings"))


OP13_SQL = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

"""Operator 6: maximum inner product search by anisotropic quantisation, four-bit table scans and exact reranking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialize

TOP = 20
#: Vectors that training holds at most.
MAX_TRAINING = 6000
CENTRES = 16
#: Dimensions of a subspace, each coded in four bits.
SUBSPACE = 2
#: Inner products relative to the norm above which a match counts in the quantiser's weights.
RELEVANT = 0.2
#: Distinct vectors of one block that are scored exactly for each query.
RERANK = 256
#: Rows of a block of vectors, and of a block of queries: a task scans one pair of blocks.
BLOCK = 8192
QUERY_BLOCK = 4096
SWEEPS = 2
ROUNDS = 4


class AnisotropicQuantiser:
    """Product codebooks that weigh the residual along a vector ``eta`` times as much as that across it."""

    def __init__(self, x: np.ndarray, seed: int = 5):
        self.dim = x.shape[1]
        self.parts = -(-self.dim // SUBSPACE)
        self.eta = max(1.0, (self.dim - 1) * RELEVANT**2 / (1 - RELEVANT**2))
        x = self._padded(x)
        r = np.random.default_rng(seed)
        picks = x[r.integers(0, len(x), CENTRES)].reshape(CENTRES, self.parts, SUBSPACE)
        self.books = picks.transpose(1, 0, 2) + r.normal(0, 1e-4, (self.parts, CENTRES, SUBSPACE))
        for k in range(ROUNDS + 4):
            codes = self.encode(x[:, : self.dim], plain=k < 4)
            self._refit(x, codes, 1.0 if k < 4 else self.eta)

    def _padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(np.asarray(x, np.float64), ((0, 0), (0, self.parts * SUBSPACE - x.shape[1])))

    def encode(self, x: np.ndarray, plain: bool = False) -> np.ndarray:
        """Codes by coordinate descent on the anisotropic loss, from the nearest centres."""
        x = self._padded(x)
        unit = (x / np.maximum(1e-30, np.linalg.norm(x, axis=1, keepdims=True))).reshape(len(x), self.parts, SUBSPACE)
        x = x.reshape(len(x), self.parts, SUBSPACE)
        codes = np.empty((len(x), self.parts), np.uint8)
        squares, along = [], []
        for s in range(self.parts):
            residual = x[:, s, None, :] - self.books[s][None]
            squares.append((residual**2).sum(2))
            along.append((residual * unit[:, s, None, :]).sum(2))
            codes[:, s] = squares[s].argmin(1)
        if plain:
            return codes
        rows = np.arange(len(x))
        total = sum(along[s][rows, codes[:, s]] for s in range(self.parts))
        for _ in range(SWEEPS):
            for s in range(self.parts):
                rest = total - along[s][rows, codes[:, s]]
                cost = squares[s] + (self.eta - 1) * (rest[:, None] + along[s]) ** 2
                codes[:, s] = cost.argmin(1)
                total = rest + along[s][rows, codes[:, s]]
        return codes

    def _refit(self, x: np.ndarray, codes: np.ndarray, eta: float) -> None:
        """The codebooks that minimise the loss for given codes: one linear system for all centres."""
        slots = (codes + np.arange(self.parts) * CENTRES).astype(np.int64)
        size = self.parts * CENTRES * SUBSPACE
        unit = x / np.maximum(1e-30, np.linalg.norm(x, axis=1, keepdims=True))
        gram, right = np.zeros((size, size)), np.zeros(size)
        for k in range(0, len(x), 1024):
            at = (slots[k : k + 1024, :, None] * SUBSPACE + np.arange(SUBSPACE)).reshape(-1, self.parts * SUBSPACE)
            design = np.zeros((len(at), size))
            np.put_along_axis(design, at, unit[k : k + 1024], 1)
            gram += (eta - 1) * design.T @ design
            right += np.bincount(at.ravel(), (eta * x[k : k + 1024]).ravel(), size)
        counts = np.bincount(slots.ravel(), minlength=self.parts * CENTRES)
        gram[np.diag_indices(size)] += np.repeat(counts, SUBSPACE) + 1e-3
        right += 1e-3 * self.books.ravel()
        self.books = np.linalg.solve(gram, right).reshape(self.parts, CENTRES, SUBSPACE)

    def pack(self, codes: np.ndarray) -> np.ndarray:
        """Two four-bit codes in a byte, subspace pairs first: the layout of a scan."""
        if codes.shape[1] % 2:
            codes = np.pad(codes, ((0, 0), (0, 1)))
        return np.ascontiguousarray((codes[:, ::2] | codes[:, 1::2] << 4).T)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Inner products of each query with both centres that a packed byte names: (pairs, queries, 256)."""
        q = self._padded(queries).reshape(len(queries), self.parts, SUBSPACE)
        single = np.einsum("qsd,scd->sqc", q, self.books)
        if self.parts % 2:
            single = np.concatenate((single, np.zeros((1, *single.shape[1:]))))
        return (single[1::2, :, :, None] + single[::2, :, None, :]).reshape(-1, len(queries), 256).astype(np.float32)


def search_block(quantiser: AnisotropicQuantiser, ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, top: int = TOP, rerank: int = RERANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, vector id, exact score) of each query's nearest in one block, itself left out; ties go to the smaller id.

    Equal vectors are scanned once; of each the ``top`` + 1 smallest ids can matter.
    """
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    distinct, back = np.unique(vectors, axis=0, return_inverse=True)
    back = back.ravel()
    by = np.argsort(back, kind="stable")
    begin = np.searchsorted(back[by], np.arange(len(distinct) + 1))
    packed = quantiser.pack(quantiser.encode(distinct))
    exact = distinct.astype(np.float64)
    found: tuple[list, list, list] = ([], [], [])
    for k in range(0, len(queries), 64):
        q = queries[k : k + 64].astype(np.float64)
        table = quantiser.tables(q)
        approximate = np.zeros((len(q), len(distinct)), np.float32)
        for part, code in zip(table, packed):
            approximate += part[:, code]
        if len(distinct) > rerank:
            some = np.argpartition(-approximate, rerank, axis=1)[:, :rerank]
        else:
            some = np.broadcast_to(np.arange(len(distinct)), (len(q), len(distinct)))
        for i in range(len(q)):
            scores = exact[some[i]] @ q[i]
            best = np.argsort(-scores, kind="stable")[: top + 1]
            # Vectors that tie with the last one stay in: their ids decide.
            best = np.flatnonzero(scores >= scores[best[-1]])
            own_ids, own_scores = [], []
            for b in best:
                a, e = begin[some[i][b]], begin[some[i][b] + 1]
                mine = ids[by[a : min(e, a + top + 1)]]
                own_ids.append(mine)
                own_scores.append(np.full(len(mine), scores[b]))
            near, score = np.concatenate(own_ids), np.concatenate(own_scores)
            keep = near != query_ids[k + i]
            near, score = near[keep], score[keep]
            first = np.lexsort((near, -score))[:top]
            for held, values in zip(found, (np.full(len(first), query_ids[k + i]), near[first], score[first])):
                held.append(values)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)


def nearest(df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", every: int = 20, top: int = TOP, rerank: int = RERANK, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score of the ``top`` largest inner products for each row whose key is divisible by ``every``.

    Codebooks are fitted on at most MAX_TRAINING vectors; every vector is coded and scanned. A task scans one
    block of vectors for one block of queries with four-bit tables and returns its ``top`` after exact
    scoring in double precision, so a query's answer is merged from a few rows for each block.

    Rows with a null key, and vectors that are null, zero, of another length than most, or hold null or
    non-finite components take no part. Of rows with an equal key and vector one counts. Ties go to the smaller
    key; extra columns are ignored; an empty table gives no rows.
    """
    spark = df.sparkSession
    v = F.col(vector)
    rows = df.select(F.col(key).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))
    good = F.col("vec_id").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    rows = materialize(rows.filter(good).dropDuplicates(), "vectors")
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    dim, total = sizes["n"], sizes["count"]
    rows = rows.filter(F.size("v") == dim)
    sample = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, 1.2 * MAX_TRAINING / total)) + 1)
    sample = np.array([r[0] for r in sample.orderBy(F.xxhash64("vec_id")).limit(MAX_TRAINING).select("v").collect()] or [r[0] for r in rows.limit(CENTRES).select("v").collect()])
    quantiser = AnisotropicQuantiser(sample)

    asked = rows.filter(F.pmod("vec_id", F.lit(every)) == 0)
    blocks = max(1, -(-total // block), min(12, total // 256))
    query_blocks = max(1, -(-asked.count() // query_block))
    spot = lambda n: F.pmod(F.xxhash64("vec_id", F.lit(n)), F.lit(n)).cast("int")
    grid = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.select("vec_id", "v", F.lit(0).alias("asked"), spot(blocks).alias("b"), grid(query_blocks).alias("q"))
    queries = asked.select("vec_id", "v", F.lit(1).alias("asked"), grid(blocks).alias("b"), spot(query_blocks).alias("q"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks * query_blocks)
    both = candidates.union(queries).repartition(parts, "b", "q").sortWithinPartitions("b", "q")

    def scan(batches):
        current, held = None, []

        def finish():
            ids, vectors, is_query = (np.concatenate(x) for x in zip(*held))
            c, q = ~is_query, is_query
            if not (c.any() and q.any()):
                return pa.RecordBatch.from_pydict({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
            found = search_block(quantiser, ids[c], vectors[c], ids[q], vectors[q], top, rerank)
            return pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], ["query_id", "vec_id", "score"])

        for batch in batches:
            ids = batch.column(0).to_numpy()
            vectors = batch.column(1).flatten().to_numpy().reshape(-1, dim)
            is_query = batch.column(2).to_numpy() == 1
            pairs = batch.column(3).to_numpy().astype(np.int64) << 32 | batch.column(4).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(pairs)) + 1).tolist(), len(pairs)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if pairs[a] != current:
                    if held:
                        yield finish()
                    current, held = pairs[a], []
                held.append((ids[a:b], vectors[a:b], is_query[a:b]))
        if held:
            yield finish()

    found = both.mapInArrow(scan, "query_id long, vec_id long, score double").distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(documents(spark, sf_dir, "embeddings"))

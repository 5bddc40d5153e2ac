"""Operator 5: toxicity by subword-bag embeddings and a linear softmax, trained jointly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Rolling, documents, pieces, words
from .quality import held_out

#: Labelled rows that training holds at most, and the bytes of their whole texts for each label.
MAX_TOXIC = 2500
MAX_CLEAN = 3500
MAX_BYTES = 32 << 20
GRAMS = (3, 4, 5, 6)
BUCKETS = 1 << 18
DIMENSIONS = 6
EPOCHS = 7
THRESHOLD = 0.5
#: Texts (and part of all training texts) that must hold an n-gram before it gets a vector; rarer ones only say which text it is.
MIN_TEXTS = 4
MIN_SHARE = 0.003
SHRINK = 0.2
#: Factor on a text's mean embedding, so that single words in long texts count.
SHARPNESS = 30.0

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[48:58] = _LETTER[128:] = True


def word_bag(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row and distinct-word number of each occurrence; bucket of each n-gram of the distinct words, where each word's begin).

    Words are runs of letters and digits, lowered; n-grams carry the word's edges.
    """
    folded = _FOLD[data]
    folded = np.where(_LETTER[folded], folded, np.uint8(32))
    starts, ends, row = words(folded, offsets)
    if not len(starts):
        return row, row, np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, first, number = np.unique(Rolling(folded)(starts, ends), return_index=True, return_inverse=True)
    starts, size = starts[first], ends[first] - starts[first]
    # The distinct words once more, each between two edges.
    room = size + 2
    begin = np.cumsum(room) - room
    text = np.full(int(room.sum()), 60, np.uint8)
    text[np.repeat(begin + 1 - np.cumsum(size) + size, size) + np.arange(size.sum())] = folded[np.repeat(starts - np.cumsum(size) + size, size) + np.arange(size.sum())]
    text[begin + room - 1] = 62
    word = np.repeat(np.arange(len(room)), room)
    roll, at = Rolling(text), np.arange(len(text))
    left = np.repeat(begin + room, room) - at
    owners, buckets = [], []
    for n in GRAMS:
        some = at[left >= n]
        owners.append(word[some])
        buckets.append(roll(some, some + n) >> np.uint64(46))
    # The whole word is a gram too, so that every word has one.
    owners.append(np.arange(len(room)))
    buckets.append(roll(begin, begin + room) * np.uint64(3) >> np.uint64(46))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return row, number, np.concatenate(buckets)[order].astype(np.int64), np.searchsorted(owner[order], np.arange(len(room)))


class ToxicityModel:
    """Embeddings E of n-gram buckets and a softmax W over a text's mean word vector; a word's vector is the mean of its n-grams'."""

    def __init__(self, texts: list[bytes], toxic: np.ndarray, seed: int = 11):
        r = np.random.default_rng(seed)
        self.bias = 0.0
        self.grams = np.zeros(BUCKETS, np.float32)
        if not len(texts) or not 0 < toxic.sum() < len(toxic):
            return
        held = np.zeros(BUCKETS, np.int32)
        for text in texts:
            held[np.unique(word_bag(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[2])] += 1
        common = held >= max(MIN_TEXTS, MIN_SHARE * len(texts))
        e = r.normal(0, 0.01, (BUCKETS, DIMENSIONS)).astype(np.float32) * common[:, None]
        w = r.normal(0, 0.5, (DIMENSIONS, 2))
        b = np.zeros(2)
        squares_e, squares_w = np.full((BUCKETS, DIMENSIONS), 1e-6, np.float32), np.full((DIMENSIONS, 2), 1e-6)
        steps = np.zeros(BUCKETS, np.int32)
        # Both classes weigh the same.
        weight = np.where(toxic == 1, 0.5 / toxic.mean(), 0.5 / (1 - toxic.mean()))
        target = np.stack((1 - toxic, toxic), 1)
        for epoch in range(EPOCHS):
            rate = 0.1 * (1 - epoch / EPOCHS) + 0.01
            for part in np.array_split(r.permutation(len(texts)), max(1, len(texts) // 64)):
                data = np.frombuffer(b"".join(texts[i] for i in part), np.uint8)
                offsets = np.concatenate(([0], np.cumsum([len(texts[i]) for i in part])))
                row, number, bucket, begin = word_bag(data, offsets)
                if not len(row):
                    continue
                n_grams = np.diff(np.append(begin, len(bucket)))
                vectors = np.add.reduceat(e[bucket], begin) / n_grams[:, None]
                n_words = np.maximum(1, np.bincount(row, minlength=len(part)))
                h = np.stack([np.bincount(row, vectors[number, k], len(part)) for k in range(DIMENSIONS)], 1) / n_words[:, None] * SHARPNESS
                z = h @ w + b
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                d = (p - target[part]) * weight[part][:, None] / len(part)
                dh = d @ w.T / n_words[:, None] * SHARPNESS
                dw, db = h.T @ d + 1e-4 * w, d.sum(0)
                dv = np.stack([np.bincount(number, dh[row, k], len(begin)) for k in range(DIMENSIONS)], 1) / n_grams[:, None]
                of = np.repeat(np.arange(len(begin)), n_grams)
                used, back = np.unique(bucket, return_inverse=True)
                de = np.stack([np.bincount(back, dv[of, k], len(used)) for k in range(DIMENSIONS)], 1)
                de *= common[used, None]
                squares_e[used] += de**2
                new = e[used] - rate * de / np.sqrt(squares_e[used])
                # Group-lasso proximal step in units of the gradients' own noise: n-grams without a steady direction stay at zero.
                steps[used] += 1
                norm = np.sqrt((new**2).sum(1)) + 1e-12
                e[used] = new * np.maximum(0, 1 - rate * SHRINK * np.sqrt(DIMENSIONS / steps[used]) / norm)[:, None]
                squares_w += dw**2
                w -= rate * dw / np.sqrt(squares_w)
                b -= 0.1 * rate * db
        # A two-class softmax depends on the difference of its logits alone, which is linear in the n-grams.
        self.grams = (e @ (w[:, 1] - w[:, 0]) * SHARPNESS).astype(np.float32)
        self.bias = float(b[1] - b[0])

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        row, number, bucket, begin = word_bag(data, offsets)
        n = len(offsets) - 1
        z = np.full(n, self.bias)
        if len(row):
            word = np.add.reduceat(self.grams[bucket], begin) / np.diff(np.append(begin, len(bucket)))
            z += np.bincount(row, word[number], n) / np.maximum(1, np.bincount(row, minlength=n))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(df: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Fit on a bounded sample of labelled rows that are not held out."""
    marks = labels.filter("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~held_out("doc_id", 5, 0))
    totals = dict(marks.groupBy("toxic").count().collect())  # two rows
    parts = []
    for kind, most in ((1, MAX_TOXIC), (0, MAX_CLEAN)):
        some = marks.filter(F.col("toxic") == kind)
        if totals.get(kind, 0) > most:
            some = some.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * most / totals[kind] * 1.1))
        parts.append(some.orderBy(F.xxhash64("doc_id")).limit(most))
    wanted = parts[0].union(parts[1])
    rows = df.select("doc_id", "text").join(F.broadcast(wanted), "doc_id").filter(F.length("text") > 0)
    # Rows leave the sample where their texts are more than training holds; texts are never cut, and the first row always stays.
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("used", F.sum(F.octet_length("text").cast("long")).over(order)).withColumn("place", F.count(F.lit(1)).over(order))
    held = rows.filter((F.col("used") <= MAX_BYTES) | (F.col("place") == 1)).select("text", "toxic").toPandas()
    return ToxicityModel([t.encode() for t in held["text"]], held["toxic"].to_numpy(np.float64))


def toxicity_scores(df: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``df`` (doc_id, text).

    The model is the subword-bag classifier of this module: unseen spellings share their n-grams' vectors.
    Training holds MAX_TOXIC and MAX_CLEAN labelled rows; every whole text is scored. Null and empty texts score
    the model's bias; null doc_ids are not held out; with labels of one class only the score is one half;
    repeated rows repeat; extra columns are ignored.
    """
    model = train(df, labels)

    def run(batches):
        for batch, data, offsets in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(data, offsets), pa.float64())], ["doc_id", "score"])

    scored = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))

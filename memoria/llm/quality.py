"""Operator 3: quality classifier by positive-unlabelled learning with the non-negative risk."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rolling, documents, packed, pieces, unpacked, words

#: Rows that training holds at most: trusted positives, and unlabelled texts.
MAX_POSITIVES = 20_000
MAX_UNLABELLED = 30_000
THRESHOLD = 0.7
#: Part of the trusted positives that may score below the threshold.
CALIBRATED = 0.005
HIDDEN = 16
EPOCHS = 40

_UPPER, _LOWER, _DIGIT, _BLANK, _FEED, _HIGH, _STOP, _MARK, _BAR, _BANG = range(10)
_KIND = np.full(256, _MARK, np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = _UPPER, _LOWER, _DIGIT, _HIGH
_KIND[[9, 32]], _KIND[[10, 13]] = _BLANK, _FEED
_KIND[[ord(c) for c in ".,;:'\"-()?"]] = _STOP
_KIND[ord("|")], _KIND[ord("!")] = _BAR, _BANG
FEATURES = 10 + 14


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES numbers for each text, all of them shares or logarithms of counts over the whole text."""
    rows = len(offsets) - 1
    sizes = np.diff(offsets)
    out = np.zeros((rows, FEATURES), np.float32)
    owner = np.repeat(np.arange(rows), sizes)
    kinds = np.bincount(owner * 10 + _KIND[data], minlength=rows * 10).reshape(rows, 10) if len(data) else np.zeros((rows, 10))
    out[:, :10] = kinds / np.maximum(1, sizes)[:, None]
    starts, ends, row = words(data, offsets)
    if not len(starts):
        return out
    count = np.bincount(row, minlength=rows)
    some = np.maximum(1, count)
    roll = Rolling(data)
    hashes = roll(starts, ends)
    share = lambda mask: np.bincount(row, mask, rows) / some
    before = np.concatenate(([False], (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])))
    pair = np.concatenate(([0], hashes[1:] * np.uint64(3) + hashes[:-1])).astype(np.uint64)
    # Distinct words and repeated neighbours, row by row after one sort.
    for column, values in ((10, hashes), (11, pair)):
        order = np.lexsort((values, row))
        new = np.concatenate(([True], (values[order][1:] != values[order][:-1]) | (row[order][1:] != row[order][:-1])))
        out[:, column] = np.bincount(row[order], new, rows) / some
    size = ends - starts
    out[:, 12] = share(before)
    out[:, 13] = np.bincount(row, size, rows) / some / 10
    first, last = _KIND[data[starts]], _KIND[data[ends - 1]]
    out[:, 14] = share(last == _MARK)
    out[:, 15] = share(last == _BANG)
    out[:, 16] = share(last == _STOP)
    out[:, 17] = share(first == _UPPER)
    second = _KIND[data[np.minimum(starts + 1, ends - 1)]]
    out[:, 18] = share((first == _UPPER) & (second == _UPPER) & (size > 1))
    out[:, 19] = share((size == 1) & (first == _BAR))
    out[:, 20] = share(size > 20)
    out[:, 21] = np.log1p(count) / 10
    out[:, 22] = np.bincount(row, size.astype(np.float64) ** 2, rows) / some / 100
    out[:, 23] = np.log1p(np.bincount(owner, _KIND[data] == _FEED, rows)) / 5
    return out


def feature_table(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    def run(batches):
        for batch, data, offsets in pieces(batches, "text"):
            x = features(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * FEATURES, pa.int32()), pa.array(x.ravel()))], ["doc_id", "x"])

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, x array<float>")


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The largest share of positives that the scores' distributions allow: the least ratio of unlabelled to positive mass above any threshold that half of the positives pass."""
    if not len(positive) or not len(unlabelled):
        return 0.5
    cuts = np.quantile(positive, np.linspace(0.002, 0.5, 100))
    p = np.array([(positive >= c).mean() for c in cuts])
    u = np.array([(unlabelled >= c).mean() for c in cuts])
    return float(np.clip((u / p).min(), 0.05, 0.98))


class Network:
    """One hidden layer, trained with Adam."""

    def __init__(self, inputs: int, hidden: int = HIDDEN, seed: int = 7):
        r = np.random.default_rng(seed)
        self.w = [r.normal(0, inputs**-0.5, (inputs, hidden)), np.zeros(hidden), r.normal(0, hidden**-0.5, hidden), np.zeros(1)]
        self.m, self.v, self.t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.maximum(0, x @ self.w[0] + self.w[1])
        return h @ self.w[2] + self.w[3], h

    def step(self, x: np.ndarray, h: np.ndarray, d: np.ndarray, rate: float, decay: float = 1e-4) -> None:
        dh = np.outer(d, self.w[2]) * (h > 0)
        self.t += 1
        for k, g in enumerate((x.T @ dh, dh.sum(0), h.T @ d, d.sum(keepdims=True))):
            g = g + decay * self.w[k]
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            self.w[k] -= rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def pu_gradient(zp: np.ndarray, zu: np.ndarray, prior: float) -> np.ndarray:
    """The derivative by the scores (positives, then unlabelled) of prior * R_p+ + max(0, R_u- - prior * R_p-) with the logistic loss; where the bracket is negative, that of the bracket with its sign reversed."""
    bracket = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    sp, su = prior * _sigmoid(zp) / len(zp), _sigmoid(zu) / len(zu)
    return np.concatenate((sp - prior / len(zp) - sp, su)) if bracket >= 0 else np.concatenate((sp, -su))


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Minimise the non-negative risk of ``pu_gradient``."""
    net, r = Network(positive.shape[1], seed=seed), np.random.default_rng(seed)
    batches = max(8, min(60, len(unlabelled) // 256))
    for epoch in range(epochs):
        ps, us = np.array_split(r.permutation(len(positive)), batches), np.array_split(r.permutation(len(unlabelled)), batches)
        for a, b in zip(ps, us):
            if not len(a) or not len(b):
                continue
            x = np.concatenate((positive[a], unlabelled[b]))
            z, h = net.forward(x)
            net.step(x, h, pu_gradient(z[: len(a)], z[len(a) :], prior), 0.01 * 0.5 ** (epoch / 15))
    return net


class QualityModel:
    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray):
        both = np.concatenate((positive, unlabelled)) if len(positive) + len(unlabelled) else np.zeros((1, FEATURES), np.float32)
        self.mean, self.scale = both.mean(0), both.std(0) + 1e-3
        self.net, self.prior, self.shift = None, 0.5, 0.0
        if len(positive) and len(unlabelled):
            p, u = self._unit(positive), self._unit(unlabelled)
            # First networks, with the labels taken as they are, rank the texts that they were not fitted to; these estimate the prior.
            sides = [(p[k::2], u[k::2]) for k in (0, 1)]
            priors = []
            for fitted, other in (sides, sides[::-1]):
                first = fit_pu(*fitted, 0.5, epochs=10)
                priors.append(estimate_prior(first.forward(other[0])[0], first.forward(other[1])[0]))
            self.prior = float(np.mean(priors))
            self.net = fit_pu(p, u, self.prior)
            # A low estimate of the prior lowers all scores alike: trusted positives set the level.
            level = np.quantile(self.net.forward(p)[0], CALIBRATED)
            self.shift = float(max(0.0, np.log(THRESHOLD / (1 - THRESHOLD)) + 0.05 - level))

    def _unit(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, higher for texts like the positives. Without training data every score is one half."""
        return _sigmoid(self.net.forward(self._unit(x))[0] + self.shift) if self.net else np.full(len(x), 0.5)


def _sample(docs: DataFrame, most: int, salt: int) -> np.ndarray:
    """Features of at most ``most`` rows, chosen by a hash of doc_id. Only about so many texts are looked at."""
    n = docs.select("doc_id").count()
    if n > most:
        docs = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 20)) < int((1 << 20) * most / n))
    rows = feature_table(docs).orderBy(F.xxhash64("doc_id", F.lit(salt))).limit(most).select("x").toPandas()
    return np.array(rows["x"].tolist(), np.float32).reshape(-1, FEATURES)


def held_out(key: str, parts: int, part: int) -> F.Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % parts == part, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """Fit on documents (doc_id, text): positives are the rows labelled 1, the unlabelled are any rows. Rows that are held out take no part."""
    open_rows = docs.select("doc_id", "text").filter(~held_out("doc_id", 4, 2))
    good = labels.filter("quality = 1").select("doc_id").distinct()
    return QualityModel(_sample(open_rows.join(good, "doc_id", "left_semi"), MAX_POSITIVES, 1), _sample(open_rows, MAX_UNLABELLED, 2))


def quality_scores(df: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``df`` (doc_id, text).

    Trusted positives and unlabelled web text train a small network on whole-text statistics by the
    non-negative unbiased risk; the class prior is estimated from the same two samples, never from negatives.
    Training holds MAX_POSITIVES and MAX_UNLABELLED rows at most; every row is scored. Null and empty texts
    have zero features and a score like any other; null doc_ids are not held out; without any positive the
    score is one half; repeated rows repeat; extra columns are ignored.
    """
    model = train(df, labels)

    def run(batches):
        for batch, data, offsets in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(features(data, offsets)), pa.float64())], ["doc_id", "score"])

    scored = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def keep_quality(df: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df``, all columns, whose text scores at least ``threshold``. Null and empty texts have a score like any other; null
    and repeated doc_ids do no harm; extra columns pass through whatever their names; without any positive, or in an empty table, every score
    is one half. A text is held whole in one task."""
    model = train(df, labels)

    def run(batches):
        for batch, data, offsets in pieces(batches, "text"):
            yield batch.take(pa.array(np.flatnonzero(model.score(features(data, offsets)) >= threshold)))

    rows = df.select(packed(df), "text")
    return unpacked(rows.mapInArrow(run, rows.schema), df.columns)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))

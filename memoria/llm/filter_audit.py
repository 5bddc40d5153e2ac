"""Operator 11: what each filter of a chain removes, keeps and repeats, for every order of the chain."""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, pieces, word_slices

#: The five filters, in the order of their bits in a mask.
LETTERS = "ABCDE"
_UPPER, _MARK, _FOLLOWS = np.zeros(256, np.int64), np.zeros(256, np.int64), np.zeros(256, np.int64)
_UPPER[65:91] = 1
_MARK[list(b"#$%&*|")] = 1
#: Bytes that continue a code point.
_FOLLOWS[0x80:0xC0] = 1


def _counted(table: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each row ``table`` marks."""
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(table[data], out=sums[1:])
    return np.diff(sums[offsets])


def text_failures(df: DataFrame, *, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """id, part, mask and key for each row: bits of the filters A to D that its text fails, and the SHA-256 of the text.

    A: under 100 words; B: under 80 % distinct words; C: over 10 % of the code points are A-Z; D: holds one of
    ``#$%&*|``. Words are runs of other than ASCII white space. Null texts and parts are empty; an empty text
    fails A alone. Long texts are split a slice at a time, so only their distinct words are held.
    """

    def score(batches):
        for batch, data, offsets in pieces(batches, "text"):
            raw, cuts = data.tobytes(), offsets.tolist()
            size = np.diff(offsets)
            upper, mark = _counted(_UPPER, data, offsets), _counted(_MARK, data, offsets)
            points = size - _counted(_FOLLOWS, data, offsets)
            total, distinct, digests = [], [], []
            for a, b in zip(cuts, cuts[1:]):
                n, seen = 0, set()
                for words in word_slices(raw, a, b):
                    n += len(words)
                    seen.update(words)
                total.append(n)
                distinct.append(len(seen))
                digests.append(hashlib.sha256(raw[a:b]).digest())
            total, distinct = np.array(total, np.int64), np.array(distinct, np.int64)
            mask = (total < 100) | (100 * distinct < 80 * total) << 1 | (100 * upper > 10 * points) << 2 | (mark > 0) << 3
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(mask.astype(np.int32)), pa.array(digests, pa.binary())], ["id", "part", "mask", "key"])

    rows = df.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).alias("text"))
    return rows.mapInArrow(score, "id long, part string, mask int, key binary")


def outcome_histogram(failures: DataFrame, labels: DataFrame, *, copy_bit: int = 4) -> DataFrame:
    """part, mask, n, good and toxic: documents of each mask in each part, with bit ``copy_bit`` set for those whose text a smaller id also has.

    ``labels`` (doc_id, quality, toxic) marks documents; ids that it names more than once count as marked where any
    row says so. A null id is no copy of anything, nor is a repeated row of an id that comes first; rows without a
    label are neither good nor toxic. Copies meet as counts, never as rows: of each text only its count and least
    id for each part, mask and label move on.
    """
    marks = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(F.max(F.expr("coalesce(quality = 1, false)")).alias("good"), F.max(F.expr("coalesce(toxic = 1, false)")).alias("toxic"))
    named = failures.filter("id IS NOT NULL").join(marks, F.expr("id = labelled"), "left")
    named = named.select("id", "part", "mask", "key", F.expr("coalesce(good, false)").alias("good"), F.expr("coalesce(toxic, false)").alias("toxic"))
    named = named.groupBy("id", "part", "mask", "key", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))
    nameless = failures.filter("id IS NULL").select("id", "part", "mask", "key", F.lit(False).alias("good"), F.lit(False).alias("toxic"), F.lit(1).cast("long").alias("n"))
    copies = named.union(nameless).groupBy("key", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.expr("if(id IS NULL, n, 0L)")).alias("nameless"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("least")
    )
    # A few rows for each text: one for each part and label.
    copies = copies.withColumn("first", F.min("least.id").over(Window.partitionBy("key")))
    copies = copies.withColumn("stay", F.expr("nameless + if(least.id = first, least.n, 0L)"))
    outcomes = F.array(F.struct(F.col("mask"), F.col("stay").alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(1 << copy_bit)).alias("mask"), (F.col("n") - F.col("stay")).alias("n")))
    each = copies.select("part", "good", "toxic", F.explode(outcomes).alias("o")).filter("o.n > 0")
    return each.groupBy("part", F.col("o.mask").alias("mask")).agg(F.sum("o.n").alias("n"), F.sum(F.expr("if(good, o.n, 0L)")).alias("good"), F.sum(F.expr("if(toxic, o.n, 0L)")).alias("toxic"))


def incidence(letters: str = LETTERS) -> tuple[list[tuple[str, int, int]], dict[str, np.ndarray]]:
    """The (order, step, filter) of each column, and for each outcome a 0/1 matrix of masks by columns."""
    bits = {c: 1 << k for k, c in enumerate(letters)}
    columns, one, before = [], [], []
    for order in itertools.permutations(letters):
        for k, c in enumerate(order):
            columns.append(("".join(order), k + 1, letters.index(c)))
            one.append(bits[c])
            before.append(sum(bits[x] for x in order[:k]))
    one, before, mask = np.array(one), np.array(before), np.arange(1 << len(letters))[:, None]
    fails, gone = mask & one > 0, mask & before > 0
    return columns, {k: v.astype(np.int64) for k, v in {"kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone, "unique_fails": mask == one}.items()}


def filter_interactions(histogram: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row for each part, order of ``letters`` and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``histogram`` (part, mask, n, good, toxic) has a row for each mask of a part. The masks of a part become one row
    of integers, which products with the incidence matrices turn into all outcomes at once; zeros included. Nothing
    comes of an empty histogram.
    """
    columns, outcomes = incidence(letters)
    orders, steps, of = [c[0] for c in columns], np.array([c[1] for c in columns], np.int32), np.array([c[2] for c in columns])
    size = 1 << len(letters)
    rows = histogram.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # one for each mask

    def product(batches):
        for batch in batches:
            for part, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = np.zeros((3, size), np.int64)
                for c in cells:
                    h[:, c["mask"]] = c["n"], c["good"], c["toxic"]
                made = {k: h[0] @ m for k, m in outcomes.items()}
                made["good_lost"], made["toxic_lost"] = h[1:] @ outcomes["removed"]
                by = np.zeros(len(letters), np.int64)
                np.add.at(by, of, made["removed"])
                made["shapley"] = by[of]
                yield pa.RecordBatch.from_pydict({"part": pa.array([part] * len(of), pa.string()), "filter_order": orders, "step": steps, **made})

    return rows.mapInArrow(product, "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long")


def audit_filters(df: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """All orders of the five filters A to E over ``df``, part by part; extra columns are ignored, and an empty table gives no rows."""
    return filter_interactions(outcome_histogram(text_failures(df, key=key, text=text, part=part), labels))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH letters(f, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (
  SELECT filter_order, CAST(s AS INT) AS step, bits[s] AS own, list_sum(bits[1:s]) - bits[s] AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS s)),
texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents),
masks AS (
  SELECT part, doc_id,
    (CASE WHEN len(words) < 100 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END) AS mask
  FROM texts),
marks AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
cells AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM masks LEFT JOIN marks USING (doc_id) GROUP BY part, mask),
counted AS (
  SELECT part, filter_order, step, own,
    CAST(sum(CASE WHEN mask & (own | before) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN mask & own > 0 AND mask & before > 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN mask = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM counted
"""

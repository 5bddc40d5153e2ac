"""Operator 12: how the sources of a language differ in their words, by corrections to a baseline of zero counts."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialize, pieces, word_slices

#: Documents of a language that a term needs.
LEAST_DOCUMENTS = 3
#: Whole of which a share counts parts.
SCALE = 1_000_000_000
#: Ranks of the terms that are reported.
TOP_TERMS = 200
#: Terms that a task holds before it hands its counts on.
HELD_TERMS = 1 << 18
#: Each byte as it stands in a term: letters lower, other ASCII a space.
_TERM = np.full(256, 32, np.uint8)
_TERM[97:123] = _TERM[65:91] = np.arange(97, 123)
_TERM[128:] = np.arange(128, 256)


def term_counts(df: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", held_terms: int = HELD_TERMS) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (rows that hold it). Nulls read as empty; terms are runs of A-Z, a-z and non-ASCII characters, of which A-Z are lowered.

    Each task counts in place and hands on a row for each term that it has met, at most ``held_terms`` at a time; a
    partial count meets its like in an ordinary aggregate by all three columns.
    """

    def count(batches):
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush():
            out = {k: [] for k in ("lang", "source", "term", "n", "docs")}
            for (a, b), (n, docs) in held.items():
                out["lang"] += [a] * len(n)
                out["source"] += [b] * len(n)
                out["term"] += n.keys()
                out["n"] += n.values()
                out["docs"] += [docs[t] for t in n]
            held.clear()
            table = pa.RecordBatch.from_pydict({"lang": pa.array(out["lang"], pa.string()), "source": pa.array(out["source"], pa.string()), "term": pa.array(out["term"], pa.binary()).cast(pa.string()), "n": pa.array(out["n"], pa.int64()), "docs": pa.array(out["docs"], pa.int64())})
            for k in range(0, table.num_rows, 1 << 14):
                yield table.slice(k, 1 << 14)

        size = 0
        for batch, data, offsets in pieces(batches, "text"):
            raw, cuts = _TERM[data].tobytes(), offsets.tolist()
            for group, a, b in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), cuts, cuts[1:]):
                n, docs = held.setdefault(group, (Counter(), Counter()))
                before, seen = len(n), set()
                for words in word_slices(raw, a, b):
                    n.update(words)
                    seen.update(words)
                docs.update(seen)
                size += len(n) - before
            if size >= held_terms:
                yield from flush()
                size = 0
        yield from flush()

    empty = F.lit("")
    rows = df.select(F.coalesce(F.col(lang).cast("string"), empty).alias("lang"), F.coalesce(F.col(source).cast("string"), empty).alias("source"), F.col(text).alias("text"))
    counted = rows.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: str, total: str) -> F.Column:
    """1 + floor(SCALE * (count + 1) / (total + v)) in whole numbers."""
    return F.expr(f"1L + (({count} + 1) * CAST({SCALE} AS DECIMAL(10, 0))) div ({total} + v)")


def _gap(p: str, q: str) -> str:
    """floor((p - q)^2 / q); shares are at most SCALE + 1, so the square fits a long."""
    return f"((({p}) - ({q})) * (({p}) - ({q})) div ({q}))"


def divergences(df: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: part ``pair`` measures each source of a language against each other one, part ``term`` ranks the terms it uses more than its language does.

    A pair of sources starts at the value that all v terms would give if neither source held any of them. A posting
    of a term in one source corrects that for each partner; postings of equal count are corrected together. Where
    both sources hold a term, their two single corrections are replaced by the value of the pair. So the work
    follows the postings, not sources times sources times terms. Values are whole numbers throughout; ones beyond a
    long raise an error.

    Rows with a null text, language or source count under the empty string; a group without terms has a share of
    its own, and a language without kept terms gives pairs of value 0 and no terms. Repeated rows are documents of
    their own. Ties are ranked by item in the order of UTF-8 bytes. An empty table gives no rows; extra columns are ignored.
    """
    empty = F.lit("")
    by_term = Window.partitionBy("lang", "term")
    kept = term_counts(df, text=text, lang=lang, source=source)
    kept = kept.withColumn("in_lang", F.sum("docs").over(by_term)).withColumn("total", F.sum("n").over(by_term)).withColumn("first", F.row_number().over(by_term.orderBy("source")))
    kept = materialize(kept.filter(F.col("in_lang") >= least).select("lang", "source", "term", "n", "total", "first"), "postings")
    sizes = kept.groupBy("lang").agg(F.sum(F.expr("if(first = 1, 1L, 0L)")).alias("v"), F.sum("n").alias("lang_total"))
    held = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_total"))
    groups = df.select(F.coalesce(F.col(lang).cast("string"), empty).alias("lang"), F.coalesce(F.col(source).cast("string"), empty).alias("source")).distinct()
    groups = groups.join(sizes, "lang", "left").join(held, ["lang", "source"], "left").fillna(0, ["v", "lang_total", "group_total"])
    # Without a kept term there is no share; nothing reads it.
    groups = materialize(groups.withColumn("zero", F.when(F.col("v") > 0, _share("0", "group_total"))), "groups")
    kept = kept.join(groups, ["lang", "source"]).select("lang", "source", "term", _share("n", "group_total").alias("p"), _share("total", "lang_total").alias("q"), "zero")
    kept = materialize(kept, "shares")

    partner = groups.select("lang", F.col("source").alias("other"), F.col("zero").alias("other_zero"))
    none = f"{_gap('zero', 'other_zero')}"
    base = groups.join(partner, "lang").filter("source != other").select("lang", "source", "other", F.expr(f"if(v = 0, 0L, v * {none})").alias("value"))
    # Postings of one source: p against the other's zero count, and the other way round.
    alike = kept.groupBy("lang", "source", "p", "zero").agg(F.count(F.lit(1)).alias("m"))
    single = alike.join(partner, "lang").filter("source != other").groupBy("lang", "source", "other").agg(
        F.expr(f"sum(m * ({_gap('p', 'other_zero')} - {none}))").alias("there"), F.expr(f"sum(m * ({_gap('other_zero', 'p')} - {_gap('other_zero', 'zero')}))").alias("back"))
    # Terms that both hold.
    right = kept.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("r"), F.col("zero").alias("other_zero"))
    there = f"{_gap('p', 'r')} - {_gap('p', 'other_zero')} - {_gap('zero', 'r')} + {none}"
    back = f"{_gap('r', 'p')} - {_gap('r', 'zero')} - {_gap('other_zero', 'p')} + {_gap('other_zero', 'zero')}"
    common = kept.join(right, ["lang", "term"]).filter("source < other").groupBy("lang", "source", "other").agg(F.expr(f"sum({there})").alias("there"), F.expr(f"sum({back})").alias("back"))
    both = single.union(common).select("lang", F.explode(F.array(F.struct("source", "other", F.col("there").alias("value")), F.struct(F.col("other").alias("source"), F.col("source").alias("other"), F.col("back").alias("value")))).alias("x"))
    pairs = base.union(both.select("lang", "x.source", "x.other", "x.value")).groupBy("lang", "source", F.col("other").alias("item")).agg(F.sum("value").alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = kept.filter("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(_gap("p", "q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    out = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair")).select(*out).union(terms.withColumn("part", F.lit("term")).select(*out))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(documents(spark, sf_dir))


OP12_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
tokens AS (
  SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM docs),
vocabulary AS (SELECT lang, term, count(*) AS total FROM tokens GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
sizes AS (SELECT lang, count(*) AS v, sum(total) AS lang_total FROM vocabulary GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM tokens JOIN vocabulary USING (lang, term) GROUP BY lang, source, term),
totals AS (SELECT lang, source, sum(n) AS group_total FROM counts GROUP BY lang, source),
shares AS (
  SELECT g.lang, g.source, w.term, coalesce(c.n, 0) AS n,
    1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1)) // (coalesce(t.group_total, 0) + s.v) AS p,
    1 + (CAST(1000000000 AS HUGEINT) * (w.total + 1)) // (s.lang_total + s.v) AS q
  FROM groups g JOIN vocabulary w USING (lang) JOIN sizes s USING (lang) LEFT JOIN totals t USING (lang, source) LEFT JOIN counts c USING (lang, source, term)),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // q AS BIGINT) AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""

"""An inverted index kept as tables: postings bucketed by token, and merges that rewrite only the segments that changed."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import materialize
from . import index, rank

SEGMENTS, BUCKETS = 16, 32
_MODE = "spark.sql.sources.partitionOverwriteMode"


@contextmanager
def _dynamic(spark: SparkSession):
    """Overwrites replace only the partitions that they bring rows for."""
    before = spark.conf.get(_MODE)
    spark.conf.set(_MODE, "dynamic")
    try:
        yield
    finally:
        spark.conf.set(_MODE, before)


class StoredIndex:
    """Three tables below ``folder``, all partitioned by the segment of a document's id.

    ``postings`` (doc_id, token, freq, first_pos, length): a row for each keyword of a document, in ``buckets`` by
    token, so that a search opens the files of its own terms alone. ``entries`` (doc_id, source, chars, length,
    hash): a row for each document. ``manifest`` (docs, worded, words, checksum): what a segment holds, a row for each.

    Each merge is a whole that may be repeated: it writes the new content of the segments that it touches aside, puts it in
    place table by table, the manifest last, and gives the same tables when it is run again after a failure.
    """

    def __init__(self, spark: SparkSession, name: str, folder: str, *, segments: int = SEGMENTS, buckets: int = BUCKETS):
        self.spark, self.name, self.folder, self.segments, self.buckets = spark, name, folder.rstrip("/"), segments, buckets
        columns = {
            "postings": "doc_id BIGINT, token STRING, freq BIGINT, first_pos INT, length BIGINT, segment INT",
            "entries": "doc_id BIGINT, source STRING, chars BIGINT, length BIGINT, hash STRING, segment INT",
            "manifest": "docs BIGINT, worded BIGINT, words BIGINT, checksum BIGINT, segment INT",
        }
        for table, schema in columns.items():
            bucketed = f"CLUSTERED BY (token) INTO {buckets} BUCKETS" if table == "postings" else ""
            spark.sql(f"CREATE TABLE IF NOT EXISTS {self._named(table)} ({schema}) USING parquet PARTITIONED BY (segment) {bucketed} LOCATION '{self.folder}/{table}'")
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{table}")
            if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):  # an index that is opened again
                spark.catalog.recoverPartitions(self._named(table))

    def _named(self, table: str) -> str:
        return f"{self.name}_{table}"

    def table(self, table: str) -> DataFrame:
        return self.spark.table(self._named(table))

    def _segment(self, key: str = "doc_id") -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.segments)).cast("int")

    def drop(self) -> None:
        """Forget the tables; their files stay."""
        for table in ("postings", "entries", "manifest"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self._named(table)}")

    def _write(self, table: str, rows: DataFrame, touched: list[int]) -> None:
        """Let ``rows`` be all that the touched segments hold."""
        order = self.table(table).columns
        if table == "postings":  # one task for each bucket of a segment, so one file
            rows = rows.repartition("segment", F.pmod(F.hash("token"), F.lit(self.buckets)))
        else:
            rows = rows.repartition("segment")
        with _dynamic(self.spark):
            rows.select(*order).write.insertInto(self._named(table), overwrite=True)
        # A segment without rows is not overwritten: it goes.
        filled = {r[0] for r in self.table(table).filter(F.col("segment").isin(touched)).select("segment").distinct().collect()}  # at most one for each segment
        fresh = {r[0] for r in rows.select("segment").distinct().collect()}
        for segment in sorted(filled - fresh):
            self.spark.sql(f"ALTER TABLE {self._named(table)} DROP IF EXISTS PARTITION (segment = {segment})")

    def merge(self, changes: DataFrame, deleted: DataFrame | None = None) -> None:
        """Put in the documents of ``changes`` (doc_id, text, source), new or in place of older ones, and take out those of ``deleted`` (doc_id).

        Only changed texts are read and cut into words; other documents of a touched segment are carried over as
        postings. A document that is deleted and changed at once stays, changed. Of several rows of one doc_id the one with the greatest
        text and source counts; rows with a null doc_id are left out; a null text is empty.
        """
        changes = changes.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.struct(F.coalesce("text", F.lit("")).alias("text"), "source")).alias("r"))
        changes = materialize(changes.select("doc_id", "r.text", "r.source", self._segment().alias("segment")), "changes")
        gone = changes.select("doc_id", "segment")
        if deleted is not None:
            gone = gone.union(deleted.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), self._segment()).distinct())
        gone = materialize(gone.distinct(), "gone")
        touched = sorted(r[0] for r in gone.select("segment").distinct().collect())  # at most one for each segment
        if not touched:
            return
        there = F.col("segment").isin(touched)
        order = self.table("postings").columns
        kept = lambda table: self.table(table).filter(there).join(gone.select("doc_id"), "doc_id", "left_anti")
        postings = materialize(kept("postings").select(*order).union(index.token_counts(changes).withColumn("segment", self._segment()).select(*order)), "postings")
        lengths = postings.groupBy("doc_id").agg(F.max("length").alias("length"))
        entries = changes.join(lengths, "doc_id", "left").select("doc_id", "source", F.length("text").cast("long").alias("chars"), F.coalesce("length", F.lit(0)).alias("length"), F.sha2(F.col("text").cast("binary"), 256).alias("hash"), "segment")
        order = self.table("entries").columns
        parts = {"postings": postings, "entries": materialize(kept("entries").select(*order).union(entries.select(*order)), "entries")}
        parts["manifest"] = _summed(parts["entries"])
        for table, rows in parts.items():
            self._write(table, rows, touched)

    def sync(self, docs: DataFrame) -> DataFrame:
        """Make the index that of ``docs`` (doc_id, text, source): documents with another text or source are merged in, those that are gone taken out.

        Returns (segment, status): merged, or unchanged for segments whose files were not touched.
        """
        state = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.struct(F.coalesce("text", F.lit("")).alias("text"), "source")).alias("r")).select("doc_id", "r.text", "r.source")
        known = self.table("entries").select(F.col("doc_id").alias("known_id"), F.col("hash").alias("known_hash"), F.col("source").alias("known_source"))
        now = state.withColumn("hash", F.sha2(F.col("text").cast("binary"), 256))
        fresh = now.join(known, F.col("doc_id") == F.col("known_id"), "left").filter("known_id IS NULL OR hash <> known_hash OR NOT source <=> known_source").select("doc_id", "text", "source")
        fresh = materialize(fresh, "fresh")
        lost = materialize(known.join(state.select("doc_id"), F.col("known_id") == F.col("doc_id"), "left_anti").select(F.col("known_id").alias("doc_id")), "lost")
        touched = fresh.select(self._segment().alias("segment")).union(lost.select(self._segment())).distinct().withColumn("status", F.lit("merged"))
        touched = materialize(touched, "touched")
        self.merge(fresh, lost)
        every = self.spark.range(self.segments).select(F.col("id").cast("int").alias("segment"))
        return every.join(touched, "segment", "left").select("segment", F.coalesce("status", F.lit("unchanged")).alias("status"))

    def postings(self, terms: list[str]) -> DataFrame:
        """Postings of the terms: only their buckets are opened."""
        return self.table("postings").filter(F.col("token").isin(terms))

    def lookup(self, ids: list[int]) -> DataFrame:
        """Entries of a few documents by id: only their segments are opened. For many ids join ``entries`` by segment and id."""
        if not ids:
            return self.table("entries").limit(0)
        of = self.spark.createDataFrame([(int(i),) for i in ids], "doc_id long").select(self._segment())
        return self.table("entries").filter(F.col("segment").isin([r[0] for r in of.collect()]) & F.col("doc_id").isin(ids))

    def bm25(self, terms: list[str]) -> DataFrame:
        """(doc_id, bm25, matched, length), as over the texts themselves. Statistics come from the manifest and the matching postings."""
        hits = self.postings(terms)
        counts = hits.groupBy("token").agg(F.count(F.lit(1)).alias("df"))  # a row for each term
        corpus = self.table("manifest").agg(F.coalesce(F.sum("worded"), F.lit(0)).alias("n"), (F.sum("words") / F.sum("worded")).alias("avg_length"))
        scored = hits.join(F.broadcast(counts), "token").crossJoin(F.broadcast(corpus))
        part = rank.bm25_term(F.col("freq"), F.col("df"), F.col("n"), F.col("length"), F.col("avg_length"))
        return scored.groupBy("doc_id").agg(F.sum(part).alias("bm25"), F.count(F.lit(1)).alias("matched"), F.max("length").alias("length"))

    def search(self, terms: list[str], limit: int = 20) -> DataFrame:
        """The ``limit`` best documents of the lexical pipeline, as rank.search finds them over the texts."""
        facts = self.table("entries").select("doc_id", "source", "chars")
        return rank.lexical(self.bm25(terms).join(facts, "doc_id"), terms, source="source", limit=limit)


def _summed(entries: DataFrame) -> DataFrame:
    """What each segment holds."""
    return entries.groupBy("segment").agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.col("length") > 0).alias("worded"), F.sum("length").alias("words"), F.bit_xor(F.xxhash64("doc_id", "hash", "source")).alias("checksum"))

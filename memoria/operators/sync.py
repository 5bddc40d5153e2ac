"""Comparing states: manifests, segments, schemas and key-value memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .relational import compare


def manifest(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """(key, hash): SHA-256 of the given columns of each row."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])
    return df.select(key, F.sha2(text.cast("binary"), 256).alias("hash"))


def manifest_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return compare(old, new, key, "hash")


def segment_checksum(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(segment, rows, last, checksum): SHA-256 over name, row count and greatest key of each table."""
    out = None
    for name, (df, key) in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("rows"), F.max(key).cast("long").alias("last")).select(F.lit(name).alias("segment"), "rows", "last")
        row = row.withColumn("checksum", F.sha2(F.concat_ws(":", "segment", "rows", F.coalesce("last", F.lit(0))).cast("binary"), 256))
        out = row if out is None else out.unionByName(row)
    return out


def changed_segments(current: DataFrame, known: DataFrame) -> DataFrame:
    """Segments to export again: new ones and those with another checksum."""
    return current.join(known.select("segment", "checksum"), ["segment", "checksum"], "left_anti")


def schema_columns(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(table, position, column, type, nullable) of the given frames, from their schemas alone."""
    rows = [(t, i, f.name, f.dataType.simpleString(), f.nullable) for t, df in tables.items() for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "table string, position int, column string, type string, nullable boolean")


def schema_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(table, column, change, migration) between two outputs of ``schema_columns``: tables and columns added, dropped or altered."""
    a = old.select("table", "column", F.col("type").alias("old_type"), F.col("nullable").alias("old_null"))
    b = new.select("table", "column", F.col("type").alias("new_type"), F.col("nullable").alias("new_null"))
    gone, fresh = old.select("table").distinct().withColumn("in_old", F.lit(True)), new.select("table").distinct().withColumn("in_new", F.lit(True))
    rows = a.join(b, ["table", "column"], "full_outer").join(gone, "table", "left").join(fresh, "table", "left")
    change = (
        F.when(F.col("in_old").isNull(), "table_added").when(F.col("in_new").isNull(), "table_dropped")
        .when(F.col("old_type").isNull(), "column_added").when(F.col("new_type").isNull(), "column_dropped")
        .when(F.col("old_type") != F.col("new_type"), "type_changed").when(F.col("old_null") != F.col("new_null"), "nullability_changed")
    )
    q = lambda c: F.concat(F.lit("`"), F.col(c), F.lit("`"))
    alter = F.concat(F.lit("ALTER TABLE "), q("table"))
    migration = (
        F.when(F.col("change") == "column_added", F.concat(alter, F.lit(" ADD COLUMN "), q("column"), F.lit(" "), F.col("new_type")))
        .when(F.col("change") == "column_dropped", F.concat(alter, F.lit(" DROP COLUMN "), q("column")))
        .when(F.col("change") == "type_changed", F.concat(alter, F.lit(" ALTER COLUMN "), q("column"), F.lit(" TYPE "), F.col("new_type")))
        .when(F.col("change") == "nullability_changed", F.concat(alter, F.lit(" ALTER COLUMN "), q("column"), F.when(F.col("new_null"), " DROP NOT NULL").otherwise(" SET NOT NULL")))
        .when(F.col("change") == "table_dropped", F.concat(F.lit("DROP TABLE "), q("table")))
        .otherwise(F.concat(F.lit("CREATE TABLE "), q("table"), F.lit(" (see its columns)")))
    )
    return rows.withColumn("change", change).filter("change IS NOT NULL").select("table", "column", "change", migration.alias("migration"))


def upsert(memory: DataFrame, changes: DataFrame, keys: list[str] = ("scope", "key"), at: str = "updated") -> DataFrame:
    """Latest row of each key; of equal times the change wins."""
    both = memory.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    fields = [c for c in memory.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*fields), F.struct(at, "_new")).alias("r"))
    return best.select(*[c if c in keys else F.col(f"r.{c}").alias(c) for c in memory.columns])


def lookup(memory: DataFrame, scope: Column | str, prefix: str = "") -> DataFrame:
    """A scope's rows whose key begins with a prefix."""
    return memory.filter((F.col("scope") == scope) & F.startswith("key", F.lit(prefix))).orderBy("key")


def sync_merge(mine: DataFrame, theirs: DataFrame, key: str = "id", at: str = "updated", value: str = "content") -> DataFrame:
    """Newest wins for each entry of two copies: key, value, at and whether the copies conflicted at one time."""
    a = mine.select(key, F.col(value).alias("v1"), F.col(at).alias("t1"))
    b = theirs.select(key, F.col(value).alias("v2"), F.col(at).alias("t2"))
    rows = a.join(b, key, "full_outer")
    first = F.col("t2").isNull() | (F.col("t1") >= F.col("t2"))
    conflict = (F.col("t1") == F.col("t2")) & (F.col("v1") != F.col("v2"))
    return rows.select(key, F.when(first, F.col("v1")).otherwise(F.col("v2")).alias(value), F.when(first, F.col("t1")).otherwise(F.col("t2")).alias(at), F.coalesce(conflict, F.lit(False)).alias("conflict"))


def effective_date(metadata: Column, path: Column, content: Column, created: Column) -> Column:
    """A document's own date: from its metadata, its path, the head of its content, else when it came in."""
    found = [F.get_json_object(metadata, f"$.{k}") for k in ("handoff_date", "session_date", "modified_at")]
    dated = lambda c: F.nullif(F.regexp_extract(c, r"(\d{4})-(\d{2})-(\d{2})", 0), F.lit(""))
    return F.coalesce(*found, dated(path), dated(F.substring(content, 1, 300)), created.cast("string"))


def knowledge_query(entries: DataFrame, *, source: str | None = None, category: str | None = None, confidence: float = 0.0, topics: list[str] = (), term: str | None = None, as_of: Column | None = None) -> DataFrame:
    """Entries by a conjunction of filters, most confident and newest first, ties by id."""
    if source:
        entries = entries.filter(F.lower("source") == source.lower())
    if category:
        entries = entries.filter(F.col("category") == category.upper())
    if topics:
        entries = entries.filter(F.arrays_overlap("topics", F.array(*map(F.lit, topics))))
    if term:
        entries = entries.filter(F.contains(F.lower("content"), F.lit(term.lower())))
    if as_of is not None:
        entries = entries.filter(F.col("expires").isNull() | (F.col("expires") > as_of))
    return entries.filter(F.col("confidence") >= confidence).orderBy(F.desc("confidence"), F.desc("updated"), "id")


def latest_changes(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Each key's last row; for logs whose keys have few rows."""
    return log.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))).filter("_n = 1").drop("_n")


def catalog(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows, columns): one count for each table."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows", F.lit(len(df.columns)).cast("long").alias("columns"))
        out = row if out is None else out.unionByName(row)
    return out


def run_sql(spark: SparkSession, tables: dict[str, DataFrame], statement: str) -> DataFrame:
    """A statement of the user's over the given tables, each named in braces."""
    return spark.sql(statement, **tables)

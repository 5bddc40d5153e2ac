"""Readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """A table of few files dealt out by key where its scan has fewer tasks than there are cores; larger tables stay as they are read.

    What is later grouped by the key, alone or with other columns, needs no further shuffle then.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def chat_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``AGENT: message`` of text files: agent, content, and the file that holds them. Other lines are left out."""
    lines = spark.read.text(path).withColumn("file", F.col("_metadata.file_path"))
    parts = F.regexp_extract("value", r"^([A-Za-z][\w-]*):\s*(.*)$", 1), F.regexp_extract("value", r"^([A-Za-z][\w-]*):\s*(.*)$", 2)
    return lines.select("file", F.upper(parts[0]).alias("agent"), parts[1].alias("content")).filter("agent <> ''")


# The layouts of a group chat, tried in this order.
CHAT_LAYOUTS = [r"(?m)^\*\*([A-Za-z][\w-]*):?\*\*:?\s*(.+)$", r"(?m)^([A-Z][A-Z0-9_-]*):\s*(.+)$", r"(?m)^\[([A-Za-z][\w-]*)\]\s*(.+)$"]


def group_chat(df: DataFrame, key: str, text: str) -> DataFrame:
    """Messages of group chats in the first layout that a text shows, else its paragraphs: key, position, agent, content."""
    found = [(F.regexp_extract_all(F.col(text), F.lit(p), F.lit(1)), F.regexp_extract_all(F.col(text), F.lit(p), F.lit(2))) for p in CHAT_LAYOUTS]
    paragraphs = F.filter(F.transform(F.split(text, "\n\n"), lambda x: F.trim(x)), lambda x: x != "")
    messages = F.transform(paragraphs, lambda x: F.struct(F.lit("UNKNOWN").alias("agent"), x.alias("content")))
    for agents, contents in reversed(found):
        pairs = F.zip_with(agents, contents, lambda a, c: F.struct(F.upper(a).alias("agent"), F.trim(c).alias("content")))
        messages = F.when(F.size(agents) > 0, pairs).otherwise(messages)
    return df.select(key, F.posexplode(messages).alias("position", "m")).select(key, "position", "m.agent", "m.content")


def sweep(spark: SparkSession, root: str, *, pattern: str = "*", exclude: list[str] = (), most_bytes: int = 5 << 20) -> DataFrame:
    """Files below ``root``: path, size, modified and SHA-256, without empty or too large files and excluded folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    files = files.filter(F.col("length").between(1, most_bytes))
    for name in exclude:
        files = files.filter(~F.contains("path", F.lit(f"/{name}/")))
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("hash"))


def changed_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose (path, hash) is not known yet."""
    return files.join(known, ["path", "hash"], "left_anti")


def route(df: DataFrame, path: str, routes: dict[str, str], default: str) -> DataFrame:
    """``source`` of a path: the route whose key stands deepest in it, ties to the longer key."""
    low = F.lower(F.translate(F.col(path), "\\", "/"))
    spots = [F.struct(F.locate(k.lower(), low).alias("at"), F.lit(len(k)).alias("n"), F.lit(v).alias("source")) for k, v in routes.items()]
    best = F.array_max(F.filter(F.array(*spots), lambda s: s["at"] > 0)) if spots else F.lit(None)
    return df.withColumn("source", F.coalesce(best["source"], F.lit(default)) if spots else F.lit(default))


def export(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Write a table as csv, json (a line for each row), parquet or a Markdown table (text lines, header first in each file)."""
    if kind == "markdown":
        cells = [F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("")) for c in df.columns]
        df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value")).write.mode("overwrite").text(path)
    elif kind == "csv":
        df.write.mode("overwrite").option("header", "true").csv(path)
    elif kind in ("json", "parquet"):
        df.write.mode("overwrite").option("compression", "zstd" if kind == "parquet" else "none").format(kind).save(path)
    else:
        raise ValueError(f"no format {kind}")


def author(path: Column) -> Column:
    """Who a file's name says it is by: what stands before the first underscore of its stem, in capitals; empty for none."""
    return F.upper(F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), r"(?:^|/)([A-Za-z0-9-]+)_[^/]*$", 1))

"""Links that follow from where, by whom and when documents were made, and reads of the knowledge graph."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How strong a link of each type is.
STRENGTHS = {"same_project": 0.7, "same_author": 0.5, "session_adjacent": 0.4, "referenced_in": 0.8, "curator_linked": 0.9}
# Folders below which a project lies two levels down, what links look back on, and the edges that one read returns.
PROJECT_ROOTS = ["PROJECTS", "00_ACTIVE", "01_RESEARCH"]
REFERENCED_RECENT, LEAST_NAME, MOST_EDGES, SESSION_SECONDS = 200, 6, 50, 300


def project_path(path: Column) -> Column:
    """The folder of a path's project, two levels below a project root; null for none."""
    found = F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), rf"^((?:[^/]*/)*?(?:{'|'.join(PROJECT_ROOTS)})/[^/]*/[^/]*)(?:/|$)", 1)
    return F.nullif(found, F.lit(""))


def peers(docs: DataFrame, kind: str, class_key: Column) -> DataFrame:
    """(doc_id, link_type, class, n_links, strength): documents that share a class, each with the number of its links; no pair is listed.

    Class sizes are partial aggregates, so a class with a third of all rows costs a join that can be split.
    """
    named = docs.select("doc_id", class_key.alias("class")).filter("class IS NOT NULL")
    size = named.groupBy("class").agg((F.count(F.lit(1)) - 1).alias("n_links"))
    return named.join(size.filter("n_links > 0"), "class").select("doc_id", F.lit(kind).alias("link_type"), "class", "n_links", F.lit(STRENGTHS[kind]).alias("strength"))


def session_adjacent(docs: DataFrame, *, key: str, agent: str, at: str, seconds: int = SESSION_SECONDS) -> DataFrame:
    """(key, n_links, strength): how many other rows of the same agent lie within ``seconds``.

    Rows go to time slots and, as guests, to the slots next to theirs, so no agent's rows meet in one task.
    """
    t = F.unix_micros(F.col(at).cast("timestamp"))
    width = seconds * 1_000_000
    rows = docs.select(F.col(key).alias("key"), F.col(agent).alias("agent"), t.alias("t"), F.floor(t / width).alias("slot"))
    dealt = rows.withColumn("in", F.explode(F.array(F.col("slot") - 1, F.col("slot"), F.col("slot") + 1)))
    near = Window.partitionBy("agent", "in").orderBy("t").rangeBetween(-width, width)
    counted = dealt.withColumn("n_links", F.count(F.lit(1)).over(near) - 1).filter("in = slot AND n_links > 0")
    return counted.select("key", "n_links", F.lit(STRENGTHS["session_adjacent"]).alias("strength"))


def referenced(docs: DataFrame, files: DataFrame, *, key: str, text: str, file_key: str, path: str, recent: int = REFERENCED_RECENT) -> DataFrame:
    """(source_id, target_id, strength): documents whose text names one of the ``recent`` files with the greatest keys, by file name or by its words.

    The names make one pattern; what a text holds of it is joined back to the files by equality.
    """
    name = F.lower(F.regexp_extract(F.replace(F.col(path), F.lit("\\"), F.lit("/")), r"([^/]*)$", 1))
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    some = files.orderBy(F.desc(file_key)).limit(recent).select(F.col(file_key).alias("target_id"), F.explode(F.array_distinct(F.array(name, F.replace(stem, F.lit("_"), F.lit(" ")), F.replace(stem, F.lit("-"), F.lit(" "))))).alias("name"))
    rows = some.filter(F.length("name") >= LEAST_NAME).collect()  # three names for each of at most ``recent`` files
    if not rows:
        return docs.sparkSession.createDataFrame([], f"source_id {dict(docs.dtypes)[key]}, target_id {dict(files.dtypes)[file_key]}, strength double")
    pattern = r"\b(?:" + "|".join(sorted({re.escape(r["name"]) for r in rows}, key=lambda x: (-len(x), x))) + r")\b"
    held = docs.select(F.col(key).alias("source_id"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0)))).alias("name"))
    names = docs.sparkSession.createDataFrame(rows, some.schema)
    found = held.join(F.broadcast(names), "name").filter("source_id <> target_id").select("source_id", "target_id").distinct()
    return found.withColumn("strength", F.lit(STRENGTHS["referenced_in"]))


def curator_links(requests: DataFrame, documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """(source_id, target_id, strength): requested links between known documents, clamped to 0 and 1; of repeated ones the strongest counts."""
    known = documents.select(F.col(key).alias("known"))
    rows = requests.join(known, F.col("source_id") == F.col("known"), "left_semi").join(known, F.col("target_id") == F.col("known"), "left_semi")
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("strength", F.lit(STRENGTHS["curator_linked"]))))
    return rows.groupBy("source_id", "target_id").agg(F.max(clamped).alias("strength"))


def merge_annotations(known: DataFrame, new: DataFrame) -> DataFrame:
    """The new annotations (doc_id, token, …) whose token the document does not have yet."""
    return new.join(known.select("doc_id", "token"), ["doc_id", "token"], "left_anti")


# -- the knowledge graph --------------------------------------------------------------------------

def domain_filter(results: DataFrame, nodes: DataFrame, domain: str, *, metadata: str = "metadata") -> DataFrame:
    """The results of a domain: as their metadata say, else as the node of their file says."""
    own, path = F.lower(F.get_json_object(metadata, "$.domain")), F.concat(F.lit("file:"), F.replace(F.get_json_object(metadata, "$.filepath"), F.lit("\\"), F.lit("/")))
    known = nodes.select(F.col("id").alias("file_id"), F.lower("domain").alias("file_domain"))
    found = results.join(known, path == F.col("file_id"), "left").filter((F.coalesce(own, F.lit("")) == domain.lower()) | (F.col("file_domain") == domain.lower()))
    return found.select(*results.columns)


def file_children(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(file_id, type, children, edges): children of each file by type, and the edges that touch the file or any child."""
    files = nodes.filter("type = 'file'").select(F.col("id").alias("file_id"))
    held = edges.filter("type = 'contains'").select(F.col("source_id").alias("file_id"), F.col("target_id").alias("id")).join(files, "file_id", "left_semi").distinct()
    ends = edges.select(F.xxhash64("source_id", "target_id", "type").alias("edge"), F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("id"))
    touched = held.unionByName(files.withColumn("id", F.col("file_id"))).join(ends, "id").groupBy("file_id").agg(F.countDistinct("edge").alias("edges"))
    counted = held.join(nodes.select("id", "type"), "id").groupBy("file_id", "type").agg(F.count(F.lit(1)).alias("children"))
    return counted.join(touched, "file_id").select("file_id", "type", "children", "edges")


def postings(nodes: DataFrame) -> DataFrame:
    """(token, id): the words of each node's id, name and summary."""
    words = F.array_distinct(F.split(F.lower(F.concat_ws(" ", "id", "name", "summary")), r"[^\p{L}\p{N}]+"))
    return nodes.select("id", F.explode(words).alias("token")).filter("token <> ''")


def node_search(nodes: DataFrame, edges: DataFrame, query: str, *, kind: str | None = None, most: int = 20) -> DataFrame:
    """(id, type, parent): nodes that hold any word of the query, and the file of each: its container, else the file named after the second part of its id."""
    terms = [t for t in re.split(r"\s+", query.lower()) if t]
    hits = postings(nodes).filter(F.col("token").isin(terms)).select("id").distinct()
    found = nodes.join(hits, "id", "left_semi").filter(F.lit(True) if kind is None else F.col("type") == kind).orderBy("id").limit(most).select("id", "type")
    container = edges.filter("type = 'contains'").groupBy(F.col("target_id").alias("id")).agg(F.min("source_id").alias("container"))
    stems = nodes.filter("type = 'file'").groupBy(F.regexp_extract("name", r"^(.*?)\.", 1).alias("stem")).agg(F.min("id").alias("named"))
    out = found.join(container, "id", "left").withColumn("stem", F.try_element_at(F.split("id", ":"), F.lit(2))).join(stems, "stem", "left")
    return out.select("id", "type", F.when(F.col("type") == "file", F.col("id")).otherwise(F.coalesce("container", "named")).alias("parent"))


def expand(links: DataFrame, nodes: DataFrame, most: int = MOST_EDGES) -> DataFrame:
    """(node, neighbor, strength, rank): the strongest edges of the given nodes (node), ``most`` each."""
    out = links.join(nodes.select(F.col("node").alias("source_id")), "source_id", "left_semi")
    order = Window.partitionBy("source_id").orderBy(F.desc("strength"), "target_id")
    ranked = out.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= most)
    return ranked.select(F.col("source_id").alias("node"), F.col("target_id").alias("neighbor"), "strength", "rank")


def story_graph(results: DataFrame, annotations: DataFrame, *, most: int = 5) -> DataFrame:
    """(kind, source, target, weight): edges from a query to its results (doc_id, agent, score), from these to their heaviest keywords and to their agents."""
    doc = F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))
    ranked = annotations.join(results.select("doc_id"), "doc_id", "left_semi").withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("weight"), "token"))).filter(F.col("r") <= most)
    return (
        results.select(F.lit("result").alias("kind"), F.lit("query").alias("source"), doc.alias("target"), F.col("score").alias("weight"))
        .unionByName(ranked.select(F.lit("keyword").alias("kind"), doc.alias("source"), F.concat(F.lit("keyword:"), "token").alias("target"), "weight"))
        .unionByName(results.select(F.lit("agent").alias("kind"), doc.alias("source"), F.concat(F.lit("agent:"), "agent").alias("target"), F.lit(1.0).alias("weight")))
    )

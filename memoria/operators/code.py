"""Source files: shorter forms of code, what a project's files define and import, and the sizes of stored tables."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import compress

# Lines around a match, and what is shown of code without structure.
CONTEXT_LINES, NO_STRUCTURE = 5, 1000
QUOTES = ['"""', "'''"]


def _count(text: Column, part: str) -> Column:
    """How often a part occurs, without overlap."""
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part))


def code_lines(files: DataFrame, *, key: str = "path", text: str = "content") -> DataFrame:
    """(key, n, line): a row for each line of each file, n from 0."""
    return files.select(F.col(key).alias("key"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("n", "line"))


def _joined(lines: DataFrame) -> DataFrame:
    """(key, text): the lines of each file in order. A file's lines are bounded by its size."""
    rows = lines.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("n", "line"))).alias("l"))
    return rows.select("key", F.array_join(F.col("l.line"), "\n").alias("text"))


def strip_python(files: DataFrame, *, key: str = "path", text: str = "content") -> DataFrame:
    """(key, text): files without comments, docstrings and blank lines.

    A line with triple quotes goes. Outside a docstring it opens one, but for one whose first kind of quotes stands on it twice;
    inside, it closes it. So each such line turns the state over or resets it, and a line is inside if the state
    was turned an odd number of times since the last reset. What follows a # goes, also inside other quotes.
    """
    lines = code_lines(files, key=key, text=text)
    line = F.col("line")
    marked = F.contains(line, F.lit(QUOTES[0])) | F.contains(line, F.lit(QUOTES[1]))
    twice = F.when(F.contains(line, F.lit(QUOTES[0])), _count(line, QUOTES[0])).otherwise(_count(line, QUOTES[1])) == 2
    before = Window.partitionBy("key").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    turns = lines.withColumn("marked", marked).withColumn("reset", marked & twice)
    turns = turns.withColumn("turned", F.coalesce(F.sum(F.when(F.col("marked") & ~F.col("reset"), 1).otherwise(0)).over(before), F.lit(0)))
    at_reset = F.coalesce(F.max(F.when(F.col("reset"), F.col("turned"))).over(before), F.lit(0))
    code = F.rtrim(F.regexp_replace("line", r"\s+$", ""))
    code = F.when(F.contains(code, F.lit("#")), F.regexp_replace(F.substring_index(code, "#", 1), r"\s+$", "")).otherwise(code)
    kept = turns.withColumn("inside", (F.col("turned") - at_reset) % 2 == 1).filter("NOT marked AND NOT inside").select("key", "n", code.alias("line")).filter("line <> ''")
    return files.select(F.col(key).alias("key")).join(_joined(kept), "key", "left").select("key", F.coalesce("text", F.lit("")).alias("text"))


def strip_javascript(text: Column) -> Column:
    """A text without line and block comments, tidied."""
    return compress.strip(F.regexp_replace(F.regexp_replace(text, r"(?m)//.*$", ""), r"(?s)/\*.*?\*/", ""))


def strip_code(files: DataFrame, *, key: str = "path", text: str = "content") -> DataFrame:
    """(key, text): Python and JavaScript files without comments, others tidied. Keys are paths and name a file each."""
    path = F.col(key)
    python = strip_python(files.filter(F.endswith(path, F.lit(".py"))), key=key, text=text)
    body = F.coalesce(F.col(text), F.lit(""))
    others = files.filter(~F.endswith(path, F.lit(".py"))).select(path.alias("key"), F.when(F.endswith(path, F.lit(".js")), strip_javascript(body)).otherwise(compress.strip(body)).alias("text"))
    return python.unionByName(others)


def code_structure(files: DataFrame, *, key: str = "path", text: str = "content") -> DataFrame:
    """(key, text): the class and function lines of Python files, and the lines after each up to one that holds a whole docstring; the first 1000 characters where there is none."""
    lines = code_lines(files, key=key, text=text)
    stripped = F.trim(F.regexp_replace("line", r"^\s+", ""))
    opens = F.startswith(stripped, F.lit("class ")) | F.startswith(stripped, F.lit("def "))
    closes = ~opens & ((_count(F.col("line"), QUOTES[0]) == 2) | (_count(F.col("line"), QUOTES[1]) == 2))
    before = Window.partitionBy("key").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("event", F.when(opens, True).when(closes, False))
    kept = lines.withColumn("inside", F.coalesce(F.last("event", ignorenulls=True).over(before), F.lit(False))).filter(F.coalesce("event", F.lit(False)) | F.col("inside"))
    found = files.select(F.col(key).alias("key"), F.col(text).alias("body")).join(_joined(kept.select("key", "n", "line")), "key", "left")
    return found.select("key", F.coalesce("text", F.substring(F.coalesce("body", F.lit("")), 1, NO_STRUCTURE)).alias("text"))


def line_context(files: DataFrame, query: str, *, key: str = "path", text: str = "content", around: int = CONTEXT_LINES) -> DataFrame:
    """(key, text): lines that hold the query, in any case, with five lines about them; skipped lines are counted. Files without a match give their summary."""
    near = Window.partitionBy("key").orderBy("n").rowsBetween(-around, around)
    lines = code_lines(files, key=key, text=text).withColumn("hit", F.contains(F.lower("line"), F.lit(query.lower())))
    shown = lines.withColumn("near", F.max("hit").over(near)).filter("near")
    last = F.coalesce(F.lag("n").over(Window.partitionBy("key").orderBy("n")), F.lit(-2))
    note = F.concat(F.lit("\n... (skipped "), (F.col("n") - last - 1).cast("string"), F.lit(" lines) ...\n\n"), F.col("line"))
    shown = shown.select("key", "n", F.when(F.col("n") == last + 1, F.col("line")).otherwise(note).alias("line"))
    found = files.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body")).join(_joined(shown), "key", "left")
    return found.select("key", F.coalesce("text", compress.summary(F.col("body"))).alias("text"))


# -- projects -------------------------------------------------------------------------------------

# Kinds of files by extension, how notes are marked, and how many a summary takes.
KINDS = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".json": "json", ".md": "markdown", ".txt": "text", ".yaml": "yaml", ".yml": "yaml", ".html": "html", ".css": "css"}
TODO = r"(?:#|//|/\*)\s*TODO[:\s]*(.+?)(?:\*/|\n|$)"
BLOCKER = r"(?:#|//|/\*)\s*(?:FIXME|HACK|BUG|XXX)[:\s]*(.+?)(?:\*/|\n|$)"
NOTE_CHARS, FILE_NOTES, PROJECT_TODOS, PROJECT_BLOCKERS = 100, 10, 20, 10
JS_FUNCTIONS = [r"const\s+(\w+)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>", r"const\s+(\w+)\s*=\s*function", r"function\s+(\w+)\s*\("]
JS_IMPORTS = [r"import\s+.*?from\s+['\"]([^'\"]+)['\"]", r"require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)"]
ELEMENTS = T.StructType([T.StructField("elements", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("line", T.IntegerType())]))), T.StructField("imports", T.ArrayType(T.StringType()))])


def python_elements(text: str) -> tuple[list[dict], list[str]]:
    """Functions and classes with their lines, and imported modules; of code that does not parse, those at the beginning of lines."""
    try:
        nodes = list(ast.walk(ast.parse(text)))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        at = lambda m: text.count("\n", 0, m.start()) + 1
        found = [{"name": m[2], "kind": "class" if m[1] == "class" else "function", "line": at(m)} for m in re.finditer(r"^(def|class)\s+(\w+)\s*[:(]", text, re.M)]
        return found, sorted({(m[1] or m[2]).split(".")[0] for m in re.finditer(r"^(?:from\s+(\S+)\s+)?import\s+(\S+)", text, re.M)})
    kinds = {ast.FunctionDef: "function", ast.ClassDef: "class"}
    found = [{"name": x.name, "kind": kinds[type(x)], "line": x.lineno} for x in nodes if type(x) in kinds]
    imports = [a.name for x in nodes if isinstance(x, ast.Import) for a in x.names] + [x.module for x in nodes if isinstance(x, ast.ImportFrom) and x.module]
    return found, sorted(set(imports))


def script_elements(text: str) -> tuple[list[dict], list[str]]:
    """The same for JavaScript and TypeScript, by patterns; a function is named once for each place."""
    spots = {(m.start(1), m[1], "function") for p in JS_FUNCTIONS for m in re.finditer(p, text)} | {(m.start(1), m[1], "class") for m in re.finditer(r"class\s+(\w+)", text)}
    found = [{"name": name, "kind": kind, "line": text.count("\n", 0, at) + 1} for at, name, kind in sorted(spots)]
    return found, sorted({m[1] for p in JS_IMPORTS for m in re.finditer(p, text)})


@F.pandas_udf(ELEMENTS)
def _elements(kind: pd.Series, text: pd.Series) -> pd.DataFrame:
    made = [python_elements(t) if k == "python" else script_elements(t) for k, t in zip(kind, text)]
    return pd.DataFrame({"elements": [m[0] for m in made], "imports": [m[1] for m in made]})


def file_summaries(files: DataFrame, *, path: str = "path", text: str = "content") -> DataFrame:
    """(path, kind, lines, elements, imports, dependencies, todos, blockers, description) of each file. Only code passes through Python, a batch at a time."""
    body = F.coalesce(F.col(text), F.lit(""))
    suffix = F.lower(F.regexp_extract(F.col(path), r"(\.[^./\\]+)$", 1))
    rows = files.select(F.col(path).alias("path"), body.alias("text"), F.coalesce(F.element_at(F.create_map(*map(F.lit, [x for kv in KINDS.items() for x in kv])), F.nullif(suffix, F.lit(""))), F.lit("unknown")).alias("kind"))
    code = F.col("kind").isin("python", "javascript", "typescript")
    none = F.from_json(F.lit('{"elements": [], "imports": []}'), ELEMENTS)
    rows = rows.filter(code).withColumn("e", _elements("kind", "text")).unionByName(rows.filter(~code).withColumn("e", none))
    keys = lambda name: F.json_object_keys(F.get_json_object("text", f"$.{name}"))
    empty = F.array().cast("array<string>")
    needs = F.when(F.col("kind") == "json", F.slice(F.concat(F.coalesce(keys("dependencies"), empty), F.coalesce(keys("devDependencies"), empty)), 1, 20)).otherwise(empty)
    notes = lambda p: F.slice(F.transform(F.regexp_extract_all("text", F.lit(f"(?i){p}"), F.lit(1)), lambda x: F.substring(F.trim(x), 1, NOTE_CHARS)), 1, FILE_NOTES)
    of = lambda kind: F.size(F.filter("e.elements", lambda x: x["kind"] == kind))
    lines = F.size(F.split("text", "\n"))
    name = F.regexp_extract("path", r"([^/\\]*)$", 1)
    described = F.concat_ws(" - ", name, F.when(of("class") > 0, F.concat(of("class").cast("string"), F.lit(" class(es)"))), F.when(of("function") > 0, F.concat(of("function").cast("string"), F.lit(" function(s)"))), F.concat(lines.cast("string"), F.lit(" lines")))
    return rows.select("path", "kind", lines.cast("long").alias("lines"), "e.elements", "e.imports", needs.alias("dependencies"), notes(TODO).alias("todos"), notes(BLOCKER).alias("blockers"), described.alias("description"))


def import_graph(summaries: DataFrame) -> DataFrame:
    """(path, module, target): imports that name a file of the project. A Python module a.b is a/b.py or a/b/__init__.py below any folder, a script's relative import a file beside it, with or without extension."""
    own = summaries.select("path", "kind", F.explode("imports").alias("module"))
    folder = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    stem = F.regexp_replace(F.regexp_replace("path", r"\.[^./]+$", ""), r"/__init__$", "")
    python = own.filter("kind = 'python'").withColumn("wanted", F.replace("module", F.lit("."), F.lit("/")))
    # Every tail of a file's path is a name that it may be imported by.
    parts = F.split(stem, "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))
    named = summaries.filter("kind = 'python'").select(F.col("path").alias("target"), F.explode(tails).alias("wanted"))
    found = python.join(named, "wanted").filter("path <> target").select("path", "module", "target")
    scripts = own.filter("kind <> 'python' AND startswith(module, './')").withColumn("wanted", F.concat(folder, F.regexp_replace(F.substr("module", F.lit(3)), r"\.(m?jsx?|tsx?)$", "")))
    beside = summaries.filter("kind IN ('javascript', 'typescript')").select(F.col("path").alias("target"), stem.alias("wanted"))
    return found.unionByName(scripts.join(beside, "wanted").select("path", "module", "target")).distinct()


def project_summary(summaries: DataFrame, *, project: Column) -> DataFrame:
    """(project, files, lines, kinds, functions, classes, dependencies, todos, blockers) of each project, which ``project`` names for a path. Notes come in the order of the paths."""
    rows = summaries.withColumn("project", project)
    count = lambda kind: F.sum(F.size(F.filter("elements", lambda x: x["kind"] == kind))).cast("long")
    totals = rows.groupBy("project").agg(F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines"), count("function").alias("functions"), count("class").alias("classes"), F.array_sort(F.flatten(F.collect_set("dependencies"))).alias("dependencies"))
    totals = totals.withColumn("dependencies", F.array_distinct("dependencies"))
    kinds = rows.groupBy("project", "kind").agg(F.count(F.lit(1)).alias("n")).groupBy("project").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("kinds"))
    out = totals.join(kinds, "project")
    for name, most in (("todos", PROJECT_TODOS), ("blockers", PROJECT_BLOCKERS)):
        first = rows.select("project", "path", F.posexplode(name).alias("at", "note")).withColumn("r", F.row_number().over(Window.partitionBy("project").orderBy("path", "at"))).filter(F.col("r") <= most)
        listed = first.groupBy("project").agg(F.sort_array(F.collect_list(F.struct("r", "note"))).alias("l")).select("project", F.col("l.note").alias(name))
        out = out.join(listed, "project", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out


# -- sizes ----------------------------------------------------------------------------------------

def table_sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, files, bytes, rows, columns, row_bytes): what the files of each table hold, from their names and footers; no column is read. Tables without files are left out."""
    out = None
    for name, df in tables.items():
        files = df.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("b")).groupBy("f").agg(F.max("b").alias("b"), F.count(F.lit(1)).alias("n"))
        row = files.agg(F.count(F.lit(1)).alias("files"), F.sum("b").alias("bytes"), F.sum("n").alias("rows")).filter("files > 0")
        row = row.select(F.lit(name).alias("table"), "files", "bytes", "rows", F.lit(len(df.columns)).alias("columns"), F.round(F.col("bytes") / F.col("rows"), 2).alias("row_bytes"))
        out = row if out is None else out.unionByName(row)
    return out


def size_label(size: Column) -> Column:
    """Bytes as people read them."""
    units = [("GB", 1 << 30), ("MB", 1 << 20), ("KB", 1 << 10)]
    out = F.concat(size.cast("string"), F.lit(" B"))
    for unit, n in reversed(units):
        out = F.when(size >= n, F.format_string(f"%.1f {unit}", size / n)).otherwise(out)
    return out


def folder_sizes(spark: SparkSession, root: str) -> DataFrame:
    """(folder, files, bytes, label) of every folder below ``root`` that holds files, from their listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    by = files.groupBy(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
    return by.select("folder", "files", "bytes", size_label(F.col("bytes")).alias("label"))

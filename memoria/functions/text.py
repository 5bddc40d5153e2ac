"""Tokens, summaries and quality rules as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import bound

# Words that are never keywords.
STOPWORDS = """
the and for are but not you all can had her was one our out has have been from this that with they will each make like
long look many some than them then into just over such take also back come could does even find here know more most much
must need next only other said same should show since still sure tell their there these thing think those time upon very
want well were what when which while who whom would your about above after again along being below between both during
every given going great however itself might never often perhaps quite rather really right seems shall something through
under until using where without because before data none null true false error info type value result results status
unknown undefined default output input
""".split()

# Short words that messages are compared without.
MESSAGE_STOPWORDS = """
the a an and or but is are was were been be have has had do does did will would could should may might must can to of in
on at by for with from as i you he she it we they
""".split()

# Lengths of keywords and the number that a document keeps.
MIN_KEYWORD, MAX_KEYWORD, MAX_ANNOTATIONS = 3, 40, 25

# What a text is taken to want; the first pattern that matches counts.
INTENTS = {
    "question": [r"\?$", r"^(what|how|why|when|where|who|which|can|could|would|is|are|do|does)"],
    "request": [r"^(please|can you|could you|would you|i need|i want)"],
    "bug_report": [r"(bug|error|issue|problem|broken|not working|fails|crash)"],
    "feature": [r"(feature|add|implement|create|build|make|new)"],
    "task": [r"(task|todo|action|priority|deadline)"],
    "update": [r"(update|status|progress|report|summary)"],
}

WORD_BREAK = r"[^\p{L}\p{N}_]+"
WORD = "^[A-Za-z_][A-Za-z0-9_]*$"


def tokens(text: Column) -> Column:
    """Lowered words of ASCII letters, digits and underscores; words with other letters are left out whole."""
    return F.transform(F.filter(F.split(text, WORD_BREAK), lambda w: w.rlike(WORD)), lambda w: F.lower(w))


def message_keywords(text: Column) -> Column:
    """Distinct words of more than two characters that are not short function words."""
    words = F.array_distinct(F.split(F.lower(text), WORD_BREAK))
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(MESSAGE_STOPWORDS))


def is_keyword(token: Column) -> Column:
    return F.length(token).between(MIN_KEYWORD, MAX_KEYWORD) & ~token.isin(STOPWORDS)


def _wants(low: Column, pattern: str) -> Column:
    """Whether a pattern is found in a text: plain words are looked for as such, and what is bound to an end there alone. A match is not longer than its pattern."""
    if words := re.fullmatch(r"\(([\w |]+)\)", pattern):
        return reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in words[1].split("|")])
    simple = not re.search(r"[*+{]", pattern)
    if pattern.startswith("^") and simple:
        return F.left(low, F.lit(len(pattern))).rlike(pattern)
    if pattern.endswith("$") and simple:
        return F.right(low, F.lit(len(pattern) + 2)).rlike(pattern)  # a line may end after it
    return low.rlike(pattern)


def intents_of(low: Column) -> Column:
    """Names of the intents whose patterns match a lowered text."""
    return F.array_compact(F.array(*[F.when(reduce(Column.__or__, [_wants(low, p) for p in patterns]), F.lit(name)) for name, patterns in INTENTS.items()]))


def intents(text: Column) -> Column:
    """Names of the intents whose patterns match the lowered text."""
    return bound(F.lower(text), intents_of)


def summary(text: Column, most: int = 300) -> Column:
    """The text up to ``most`` characters, cut after its last sentence end or word past the half."""
    cut = F.substring(text, 1, most)
    last = lambda mark: F.when(F.locate(mark, cut) > 0, most + 1 - F.locate(mark, F.reverse(cut))).otherwise(0)
    out = F.concat(F.trim(cut), F.lit("..."))
    out = F.when(last(" ") - 1 > most // 2, F.concat(F.trim(F.substring(cut, F.lit(1), last(" ") - 1)), F.lit("..."))).otherwise(out)
    for mark in ("?", "!", "."):
        out = F.when(last(mark) - 1 > most // 2, F.trim(F.substring(cut, F.lit(1), last(mark)))).otherwise(out)
    return F.when(F.length(text) <= most, F.trim(text)).otherwise(out)


# Marks of content that is not prose.
BASE64 = "(?:[A-Za-z0-9+/]{4}){10,}={0,2}"
CONTROL = "[\\x00-\\x08\\x0e-\\x1f]"
JSON_BLOB = r'^\s*\{\s*"[^"]+"\s*:'
NOTEBOOK = r'(?i)(cell_type|execution_count|outputs|metadata)\s*[":]'
LICENSE = (
    r"(?i)(Licensed under the|Apache License|MIT License|BSD License|GNU General Public|Permission is hereby granted|"
    r"SPDX-License-Identifier|Copyright \(c\)\s*\d{4}|All rights reserved\.?|THIS SOFTWARE IS PROVIDED)"
)
IMPORT_LINE = r"^\s*(import |from \w+ import |#include |using |require)"
CONFIG_LINE = r"""^\s*[\w.-]+\s*[:=]\s*[\w"'{}\[\]]+\s*$"""
MIN_USEFUL, MIN_DENSITY, MIN_PLAIN = 20, 0.30, 0.50


def garbage_reason(text: Column) -> Column:
    """The first rule by which a text is not worth keeping; null for useful text."""
    trimmed = F.trim(text)
    lines = F.split(trimmed, "\n")
    share = lambda pattern: F.size(F.filter(lines, lambda x: x.rlike(pattern))) / F.greatest(F.size(lines), F.lit(1))
    words = F.filter(F.split(F.lower(trimmed), r"\s+"), lambda w: w != "")
    plain = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}\s]", ""))
    rules = [
        ("too_short", F.coalesce(F.length(trimmed), F.lit(0)) < MIN_USEFUL),
        ("base64", text.rlike(BASE64)),
        ("control", text.rlike(CONTROL)),
        ("json", text.rlike(JSON_BLOB)),
        ("notebook", text.rlike(NOTEBOOK) & (F.length(text) - F.length(F.replace(text, F.lit("{"), F.lit(""))) > 1)),
        ("license", text.rlike(LICENSE)),
        ("imports", (F.size(lines) >= 3) & (share(IMPORT_LINE) > 0.6)),
        ("config", (F.size(lines) >= 3) & (share(CONFIG_LINE) > 0.7)),
        ("repetitive", (F.size(words) >= 8) & (F.size(F.array_distinct(words)) / F.size(words) < MIN_DENSITY)),
        ("symbols", plain / F.length(text) < MIN_PLAIN),
    ]
    out = F.lit(None).cast("string")
    for name, rule in reversed(rules):
        out = F.when(rule, F.lit(name)).otherwise(out)
    return out


def text_info(text: Column) -> dict[str, Column]:
    """Counts of a text by name."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    lines = F.split(text, "\n")
    paragraphs = F.filter(F.split(text, "\n\n"), lambda p: F.trim(p) != "")
    return {
        "chars": F.length(text).cast("long"),
        "words": F.size(words).cast("long"),
        "lines": F.size(lines).cast("long"),
        "paragraphs": F.size(paragraphs).cast("long"),
        "unique_words": F.size(F.array_distinct(F.transform(words, lambda w: F.lower(w)))).cast("long"),
        "tokens_estimate": F.floor(F.length(text) / 4).cast("long"),
    }


def chunk_text(text: str, most: int = 100_000) -> list[str]:
    """Pieces of at most ``most`` characters, cut before a blank line, a line feed or a space that is not in the first half; line feeds at a cut go. The pieces of a text without line feeds make up the text."""
    out = []
    while len(text) > most:
        at = next((p for p in (text.rfind(mark, 0, most) for mark in ("\n\n", "\n", " ")) if p >= most // 2), most)
        out.append(text[:max(at, 1)])
        text = text[max(at, 1) :].lstrip("\n")
    return [*out, text] if text or not out else out


@F.udtf(returnType=T.StructType([T.StructField("n", T.IntegerType()), T.StructField("chunk", T.StringType())]))
class Chunks:
    """The pieces of a text as rows, for a lateral join: ``n`` from 0. A null text has none."""

    def eval(self, text: str, most: int):
        for n, chunk in enumerate(chunk_text(text, most) if text is not None else ()):
            yield n, chunk


def chunks(df: DataFrame, text: str, most: int = 100_000) -> DataFrame:
    """``df`` with n and chunk, a row for each piece of a text; rows with a null text go."""
    return df.lateralJoin(Chunks(F.col(text).outer(), F.lit(most)))


# Control characters that chat input loses, and its length.
CHAT_CONTROL, CHAT_LENGTH = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", 2000


def clean_chat(text: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, CHAT_CONTROL, "")), 1, CHAT_LENGTH)


def generated_date(*texts: Column) -> Column:
    """The first ISO date in the given columns, as a date."""
    found = [F.nullif(F.regexp_extract(t, r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")) for t in texts]
    return F.try_to_date(F.coalesce(*found), "yyyy-MM-dd")

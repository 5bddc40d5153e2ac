"""Shorter texts: what a query is about, summaries, white space; texts to be spoken."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sizes that decide what is kept.
SHORT_PARAGRAPH, LONG_TEXT, FALLBACK_PARAGRAPHS = 200, 10_000, 3

# Marks that are not read aloud, in order; @ stands for the flag that lets ^ match at each line.
SPOKEN = [
    (r"(?s)<think>.*?</think>", ""), (r"<[^>]+>", ""), (r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*]+)\*", "$1"), (r"`([^`]+)`", "$1"),
    (r"@^#{1,6}\s+", ""), (r"@^>\s+", ""), (r"@^[-*+]\s+", ""), (r"@^\d+\.\s+", ""), (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (r"---+", ""), ("—", ", "), (r"\s+", " "),
]


def strip(text: Column) -> Column:
    """At most one blank line in a row, and no blanks at line ends."""
    lines = F.split(F.regexp_replace(text, r"\n{3,}", "\n\n"), "\n")
    return F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, r"\s+$", "")), "\n")


def relevant(text: Column, query: str) -> Column:
    """The paragraphs that hold the query; the first three where none does."""
    paragraphs = F.split(text, "\n\n")
    found = F.filter(paragraphs, lambda p: F.contains(F.lower(p), F.lit(query.lower())))
    return F.array_join(F.when(F.size(found) > 0, found).otherwise(F.slice(paragraphs, 1, FALLBACK_PARAGRAPHS)), "\n\n")


def summary(text: Column) -> Column:
    """The first paragraph and all short ones."""
    paragraphs = F.split(text, "\n\n")
    rest = F.filter(F.slice(paragraphs, F.lit(2), F.greatest(F.size(paragraphs) - 1, F.lit(0))), lambda p: F.length(p) < SHORT_PARAGRAPH)
    return F.array_join(F.concat(F.slice(paragraphs, 1, 1), rest), "\n\n")


def compress(text: Column, query: str | None = None, method: str = "auto") -> Column:
    """relevant, summary, strip or auto: by the query where there is one, else by the size."""
    if method == "auto" and not query:
        return F.when(F.length(text) > LONG_TEXT, summary(text)).otherwise(strip(text))
    made = {"summary": summary, "strip": strip}
    return relevant(text, query) if query and method in ("auto", "relevant") else made[method](text) if method in made else text


def speech(text: Column, names: dict[str, str] | None = None) -> Column:
    """A text as it is read aloud, without marks; ``names`` says how words are pronounced."""
    for pattern, by in SPOKEN[:2] + [(rf"\b{n}\b", by) for n, by in (names or {}).items()] + SPOKEN[2:]:
        text = F.regexp_replace(text, pattern.replace("@", "(?md)", 1) if pattern[0] == "@" else pattern, by)
    return F.trim(text)


def strip_thinking(buffer: Column) -> tuple[Column, Column]:
    """(a buffer without its thinking blocks, whether one is still open)."""
    clean = F.regexp_replace(buffer, r"(?s)<think>.*?</think>", "")
    opened = F.contains(clean, F.lit("<think>"))
    return F.when(opened, F.trim(F.regexp_replace(clean, r"(?s)<think>(?!.*<think>).*$", ""))).otherwise(clean), opened


def sentences(text: Column) -> Column:
    """Parts that end in a full stop, question or exclamation mark and white space."""
    return F.split(text, r"(?<=[.!?])\s+")

"""Named text commands as column expressions, with ``command:argument`` chains."""

from __future__ import annotations

import html
import json
import textwrap
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _lines(c: Column) -> Column:
    return F.split(c, "\n")


def _join(c: Column, by: str = "\n") -> Column:
    return F.array_join(c, by)


def _per_line(make: Callable[[Column], Column]) -> Callable:
    return lambda c, a=None: _join(F.transform(_lines(c), make))


def _python(function: Callable[[str, str | None], str]) -> Callable:
    """A command that no expression has, in Arrow batches."""
    def command(c: Column, a: str | None = None) -> Column:
        @F.pandas_udf("string")
        def run(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: None if t is None else function(t, a))
        return run(c)
    return command


def _parts(c: Column) -> Column:
    return F.filter(F.split(c, r"[\s_-]+"), lambda w: w != "")


def _capital(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))


def snake(c: Column, a: str | None = None) -> Column:
    out = F.regexp_replace(c, r"[\s-]+", "_")
    out = F.regexp_replace(out, r"([A-Z]+)([A-Z][a-z])", "$1_$2")
    return F.lower(F.regexp_replace(out, r"([a-z\d])([A-Z])", "$1_$2"))


def pascal(c: Column, a: str | None = None) -> Column:
    return _join(F.transform(_parts(c), _capital), "")


def camel(c: Column, a: str | None = None) -> Column:
    p = pascal(c)
    return F.concat(F.lower(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))


def slug(c: Column, a: str | None = None) -> Column:
    out = F.regexp_replace(F.lower(F.trim(c)), r"[^\w\s-]", "")
    return F.trim(F.regexp_replace(out, r"[-\s]+", "-"), F.lit("-"))


def _pad(fill: Callable) -> Callable:
    return lambda c, a=None: F.when(F.length(c) >= int(a), c).otherwise(fill(c, int(a), " "))


def _truncate(c: Column, a: str | None = None) -> Column:
    n = int(a or 80)
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, n - 3), F.lit("...")))


def _number(c: Column, a: str | None = None) -> Column:
    lines = _lines(c)
    width = F.length(F.size(lines).cast("string"))
    return _join(F.transform(lines, lambda x, i: F.concat(F.lpad((i + 1).cast("string"), width, F.lit(" ")), F.lit("  "), x)))


def _replaced(*pairs: tuple[str, str]) -> Callable:
    def command(c: Column, a: str | None = None) -> Column:
        for old, new in pairs:
            c = F.replace(c, F.lit(old), F.lit(new))
        return c
    return command


def _found(pattern: str) -> Callable:
    return lambda c, a=None: _join(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)))


def _bytes(c: Column) -> Column:
    return F.encode(c, "UTF-8")


def _base64_decode(c: Column) -> Column:
    return F.decode(F.unbase64(F.rpad(c, (F.ceil(F.length(c) / 4) * 4).cast("int"), F.lit("="))), "UTF-8")


_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
URL = r"https?://[^\s<>\"']+"
IP = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"

#: Commands by name; each takes (column, argument).
COMMANDS: dict[str, Callable] = {
    "base64-encode": lambda c, a=None: F.translate(F.base64(_bytes(c)), "\r\n", ""),  # base64 breaks lines after 76 characters
    "base64-decode": lambda c, a=None: _base64_decode(F.regexp_replace(c, r"\s", "")),
    "hex-encode": lambda c, a=None: F.lower(F.hex(_bytes(c))),
    "hex-decode": lambda c, a=None: F.decode(F.unhex(F.replace(F.trim(c), F.lit(" "), F.lit(""))), "UTF-8"),
    "url-encode": lambda c, a=None: _replaced(("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/"))(F.url_encode(c)),
    "url-decode": lambda c, a=None: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))),
    "html-encode": _replaced(("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")),
    "html-decode": _python(lambda t, a: html.unescape(t)),
    "binary-encode": lambda c, a=None: _join(F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.lpad(F.bin(F.ascii(x)), 8, "0")), " "),
    "binary-decode": _python(lambda t, a: "".join(chr(int(x, 2)) for x in t.split())),
    "md5": lambda c, a=None: F.md5(_bytes(c)),
    "sha1": lambda c, a=None: F.sha1(_bytes(c)),
    "sha256": lambda c, a=None: F.sha2(_bytes(c), 256),
    "sha512": lambda c, a=None: F.sha2(_bytes(c), 512),
    "upper": lambda c, a=None: F.upper(c),
    "lower": lambda c, a=None: F.lower(c),
    "title": _python(lambda t, a: t.title()),
    "swapcase": lambda c, a=None: _join(F.transform(F.split(c, ""), lambda x: F.when(x == F.upper(x), F.lower(x)).otherwise(F.upper(x))), ""),
    "camel": camel,
    "snake": snake,
    "kebab": lambda c, a=None: F.replace(snake(c), F.lit("_"), F.lit("-")),
    "pascal": pascal,
    "slug": slug,
    "sort": lambda c, a=None: _join(F.array_sort(_lines(c))),
    "sort-reverse": lambda c, a=None: _join(F.sort_array(_lines(c), asc=False)),
    "unique": lambda c, a=None: _join(F.array_distinct(_lines(c))),
    "reverse": lambda c, a=None: _join(F.reverse(_lines(c))),
    "count": lambda c, a=None: F.when(c == "", F.lit("0")).otherwise(F.size(_lines(c)).cast("string")),
    "number": _number,
    "grep": lambda c, a: _join(F.filter(_lines(c), lambda x: x.rlike(a))),
    "grep-v": lambda c, a: _join(F.filter(_lines(c), lambda x: ~x.rlike(a))),
    "head": lambda c, a=None: _join(F.slice(_lines(c), 1, int(a or 10))),
    "tail": lambda c, a=None: _join(F.reverse(F.slice(F.reverse(_lines(c)), 1, int(a or 10)))),
    "trim-lines": _per_line(lambda x: F.trim(x)),
    "remove-empty": lambda c, a=None: _join(F.filter(_lines(c), lambda x: F.trim(x) != "")),
    "trim": lambda c, a=None: F.regexp_replace(c, r"^\s+|\s+$", ""),
    "squeeze": lambda c, a=None: F.trim(F.regexp_replace(c, "[ \\t]+", " ")),
    "wrap": _python(lambda t, a: textwrap.fill(t, int(a or 80))),
    "indent": lambda c, a=None: _join(F.transform(_lines(c), lambda x: F.concat(F.lit(" " * int(a or 4)), x))),
    "dedent": _python(lambda t, a: textwrap.dedent(t)),
    "truncate": _truncate,
    "pad-left": _pad(F.lpad),
    "pad-right": _pad(F.rpad),
    "json-escape": _python(lambda t, a: json.dumps(t)[1:-1]),
    "json-unescape": lambda c, a=None: F.from_json(F.concat(F.lit('["'), c, F.lit('"]')), "array<string>")[0],
    "backslash-escape": _replaced(("\\", "\\\\"), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")),
    "backslash-unescape": _replaced(("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r"), ("\\\\", "\\")),
    "json-pretty": _python(lambda t, a: json.dumps(json.loads(t), indent=2)),
    "json-minify": _python(lambda t, a: json.dumps(json.loads(t), separators=(",", ":"))),
    "json-keys": lambda c, a=None: _join(F.array_sort(F.json_object_keys(c))),
    "rot13": lambda c, a=None: F.translate(c, _LOWER + _UPPER, _LOWER[13:] + _LOWER[:13] + _UPPER[13:] + _UPPER[:13]),
    "reverse-text": lambda c, a=None: F.reverse(c),
    "repeat": lambda c, a=None: F.repeat(c, int(a or 2)),
    "length": lambda c, a=None: F.length(c).cast("string"),
    "words": lambda c, a=None: F.size(F.filter(F.split(c, r"\s+"), lambda x: x != "")).cast("string"),
    "chars": lambda c, a=None: F.length(F.regexp_replace(c, "[ \n]", "")).cast("string"),
    "lines-count": lambda c, a=None: F.size(_lines(c)).cast("string"),
    "remove-punct": lambda c, a=None: F.translate(c, _PUNCTUATION, ""),
    "remove-digits": lambda c, a=None: F.regexp_replace(c, r"\p{Nd}", ""),
    "remove-whitespace": lambda c, a=None: F.regexp_replace(c, r"\s+", ""),
    "extract-emails": _found(EMAIL),
    "extract-urls": _found(URL),
    "extract-ips": _found(IP),
    "extract-digits": _found(r"\d+"),
}


def apply(column: Column, chain: str) -> Column:
    """A comma-separated chain of commands, each with an argument after a colon where it takes one."""
    for part in filter(None, (x.strip() for x in chain.split(","))):
        name, _, argument = part.partition(":")
        if name not in COMMANDS:
            raise ValueError(f"no command {name}; there are {', '.join(sorted(COMMANDS))}")
        column = COMMANDS[name](column, argument) if argument else COMMANDS[name](column)
    return column


def register(name: str, command: Callable) -> None:
    """Add a command of (column, argument) to the registry."""
    COMMANDS[name] = command

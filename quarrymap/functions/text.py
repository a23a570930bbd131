"""Column expressions over source text, questions and loosely typed lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of secrets, and of the words of a question.
SECRET_PATTERNS = [
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    r"(?i)api[_-]?key\s*=\s*['\"][A-Za-z0-9_\-]{20,}",
    r"(?i)secret\s*=\s*['\"][^'\"]{12,}",
]
#: Not part of the faithful detector: a quoted token of 40 hexadecimal digits.
TOKEN_PATTERN = r"(?i)token\s*=\s*['\"][0-9a-f]{40}['\"]"
TERM_PATTERN = r"([A-Za-z_][A-Za-z0-9_\./-]*)"


def line_count(source: Column) -> Column:
    newlines = F.length(source) - F.length(F.replace(source, F.lit("\n"), F.lit("")))
    return (newlines + F.when((source != "") & ~source.endswith("\n"), 1).otherwise(0)).cast("int")


def slice_lines(lines: Column, start: Column, end: Column) -> Column:
    """Lines start..end (from 1, inclusive) joined; past the end is ignored."""
    return F.array_join(F.slice(lines, F.greatest(start, F.lit(1)), F.greatest(end - start + 1, F.lit(0))), "\n")


def looks_like_secret(source: Column) -> Column:
    found = source.rlike(SECRET_PATTERNS[0])
    for pattern in SECRET_PATTERNS[1:]:
        found = found | source.rlike(pattern)
    return found


def query_terms(question: Column) -> dict[str, Column]:
    """Path, symbol and concept terms of a question; repeated terms stay."""
    words = F.regexp_extract_all(question, F.lit(TERM_PATTERN), F.lit(1))
    return {
        "path_terms": F.filter(words, lambda t: t.contains("/") | t.endswith(".py")),
        "symbol_terms": F.filter(words, lambda t: t.contains("_") | t.rlike("^[A-Z]")),
        "concept_terms": F.transform(F.filter(words, lambda t: F.length(t) > 3), F.lower),
    }


def string_list(json: Column) -> Column:
    """A JSON value as trimmed non-empty strings: a list item by item, a scalar as one, null as none."""
    value = F.trim(json)
    items = F.from_json(value, "array<string>")
    scalar = F.when(value.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")).otherwise(value)
    raw = F.when(value.isNull() | (value == "null"), F.array().cast("array<string>")).when(value.startswith("["), F.coalesce(items, F.array().cast("array<string>"))).otherwise(F.array(scalar))
    return F.filter(F.transform(raw, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))

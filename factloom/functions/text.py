"""String expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Characters taken as blanks around ids and names.
BLANKS = " \t\n\r\f\v 　"


def trim_blanks(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def clean_id(c: Column) -> Column:
    """An id for comparison: trimmed, lower case, null if nothing is left."""
    t = F.lower(trim_blanks(c))
    return F.when(F.length(t) > 0, t)


def suffixes(name: Column) -> Column:
    """All proper suffixes of a dotted, slashed or coloned name, after each separator.

    Turns the lookup "qualified name ends in .x" into an equi-join on exploded suffixes.
    """
    parts = F.split(F.regexp_replace(name, r"::|[./]", "\u0001"), "\u0001")
    marks = F.regexp_extract_all(name, F.lit(r"(::|[./])"), F.lit(1))
    joined = lambda i: F.aggregate(
        F.sequence(i + 1, F.size(parts) - 1),
        F.element_at(parts, i + 1),
        lambda acc, j: F.concat(acc, F.element_at(marks, j), F.element_at(parts, j + 1)),
    )
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.when(i + 1 > F.size(parts) - 1, F.element_at(parts, F.size(parts))).otherwise(joined(i)))).otherwise(F.array().cast("array<string>"))


def identifier_words(name: Column) -> Column:
    """The lower-case words of an identifier in snake, kebab or camel case."""
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 0)

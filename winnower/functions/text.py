"""Column builders over text; all stay in generated code, none is a UDF."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLAGS = "(?isuU)"  # ignore case, dot matches all, Unicode case and classes


EXOTIC = "[\u0130\u0131\u017f\u212a]"  # letters outside ASCII that equal ASCII ones when case is ignored


CLASSES = tuple("sSdDwWbB")  # escapes of one letter


def literal(pattern: str) -> str:
    """The longest run of characters that every match of a pattern holds, in lower case; empty if none is certain."""
    runs, run, i = [], "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "|":
            return ""
        if c in "([":  # groups and classes promise nothing
            close, depth, j = ")]"["([".index(c)], 1, i + 1
            if c == "[":  # a closing bracket that comes first stands for itself
                j += pattern[j : j + 1] == "^"
                j += pattern[j : j + 1] == "]"
            while j < len(pattern) and depth:
                j += pattern[j] == "\\"
                escaped = pattern[j - 1 : j] == "\\"
                depth += 0 if escaped else (c == "(" and pattern[j : j + 1] == "(") - (pattern[j : j + 1] == close)
                j += 1
            runs, run, i = [*runs, run], "", j
        elif c == "\\":
            if pattern[i + 1 : i + 2] not in CLASSES and pattern[i + 1 : i + 2].isalnum():
                return ""
            known = pattern[i + 1 : i + 2] not in CLASSES
            runs, run = (runs, run + pattern[i + 1 : i + 2]) if known else ([*runs, run], "")
            i += 2
        elif c in "?*{":  # what is before it may be missing
            runs, run = [*runs, run[:-1]], ""
            i = pattern.find("}", i) + 1 if c == "{" else i + 1
        elif c in ".^$+":
            runs, run = [*runs, run], ""
            i += 1
        else:
            run, i = run + c, i + 1
    best = max([*runs, run], key=len).lower()
    return "" if any(c.isalpha() and not c.isascii() for c in best) else best


def matches(text: Column, pattern: str, low: Column | None = None) -> Column:
    """Whether a pattern is found. low: the text in lower case, or null where that isn't enough to tell, for a cheap test first."""
    found, part = text.rlike(FLAGS + pattern), literal(pattern)
    return found if low is None or not part else F.coalesce(F.contains(low, F.lit(part)), F.lit(True)) & found


def lowered(text: Column) -> Column:
    """The text in lower case for the cheap test of matches; null where a letter outside ASCII could stand for one in it."""
    return F.when(~text.rlike(EXOTIC), F.lower(text))


def matches_any(text: Column, patterns: Sequence[str], low: Column | None = None) -> Column:
    return any_of([matches(text, p, low) for p in patterns])


def nonblank(text: Column) -> Column:
    return text.rlike(r"(?U)\S")


def first_hit(text: Column, patterns: Sequence[str], low: Column | None = None) -> Column:
    """The first pattern in list order that is found; null if none."""
    if not patterns:
        return F.lit(None).cast("string")
    return F.coalesce(*(F.when(matches(text, p, low), F.lit(p)) for p in patterns))


def all_hits(text: Column, patterns: Sequence[str], low: Column | None = None) -> Column:
    """All patterns that are found, in list order."""
    none = F.array().cast("array<string>")
    if not patterns:
        return none
    return F.filter(F.array(*(F.when(matches(text, p, low), F.lit(p)) for p in patterns)), lambda x: x.isNotNull())


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is worked out once for a row: no filter or projection on it is moved below this step."""
    return df.select("*", F.inline_outer(F.array(F.struct(value.alias(name)))))


def preview(text: Column, length: int = 80) -> Column:
    """The first characters, with dots if there are more, line feeds shown and carriage returns dropped."""
    short = F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).otherwise(text)
    return F.replace(F.replace(short, F.lit("\n"), F.lit("↵")), F.lit("\r"), F.lit(""))


def any_of(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def starts_with_any(text: Column, prefixes: Sequence[str]) -> Column:
    return any_of([text.startswith(p) for p in prefixes])

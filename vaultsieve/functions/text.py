"""Column functions on text that Spark has no single function for."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def character_counts(text: Column) -> Column:
    """How often each of a text's different characters stands in it, by first occurrence."""
    kinds = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    return F.transform(kinds, lambda c: F.length(text) - F.length(F.replace(text, c, F.lit(""))))


def entropy_of_counts(counts: Column, n: Column) -> Column:
    """Shannon entropy in bits per character of counts whose sum is n; 0 for none."""
    return F.when(n == 0, 0.0).otherwise(F.aggregate(counts, F.lit(0.0), lambda acc, x: acc - x / n * F.log2(x / n)))


def entropy(text: Column) -> Column:
    """Shannon entropy in bits per character; 0 for the empty string, null for null."""
    return entropy_of_counts(character_counts(text), F.length(text))


def strip(text: Column) -> Column:
    """Without white space of any script at either end, and without the four separator characters."""
    bare = F.ascii(text).between(33, 126) & F.ascii(F.right(text, F.lit(1))).between(33, 126)  # most texts, which need no search for their ends
    return F.when(bare, text).otherwise(F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))


def any_of(tests: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def matches_any(text: Column, patterns: Iterable[str]) -> Column:
    return any_of(text.rlike(p) for p in patterns)


def contains_any(text: Column, parts: Iterable[str]) -> Column:
    return any_of(text.contains(p) for p in parts)


def starts_any(text: Column, parts: Iterable[str]) -> Column:
    return any_of(text.startswith(p) for p in parts)


def spelled(pattern: str) -> str:
    """The pattern with ranges of letters and digits spelled out: the JVM looks single characters up in one table, ranges are tested one after another."""
    for first, last in ("AZ", "az", "09"):
        pattern = pattern.replace(f"{first}-{last}", "".join(map(chr, range(ord(first), ord(last) + 1))))
    return pattern


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def before_first(text: Column, part: Column) -> Column:
    """What stands before the first occurrence; null if there is none."""
    return F.when(F.instr(text, part) > 0, F.substring(text, F.lit(1), F.instr(text, part) - 1))


def after_first(text: Column, part: Column) -> Column:
    return F.when(F.instr(text, part) > 0, F.substring(text, F.instr(text, part) + F.length(part), F.length(text)))


def glob(pattern: str) -> str:
    """The anchored regular expression of a file-name glob in which * crosses slashes; a case-sensitive match."""
    out, at = "", 0
    while at < len(pattern):
        c = pattern[at]
        at += 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in pattern[at + 1 :]:
            end = pattern.index("]", at + 1)
            inner = pattern[at:end].replace("\\", "\\\\")
            out += "[" + ("^" + inner[1:] if inner.startswith("!") else inner) + "]"
            at = end + 1
        else:
            out += "\\" + c if not (c.isalnum() or c == "_" or ord(c) > 127) else c
    return f"(?s)^(?:{out})$"

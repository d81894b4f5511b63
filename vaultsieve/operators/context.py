"""The lines around a line, names before a token, and kinds of files and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultsieve.functions import constants as C
from vaultsieve.functions.text import before_first, contains_any, matches_any, starts_any, strip
from vaultsieve.operators.paths import file_name, suffix


def contexts(files: DataFrame, around: int = 3, keep: str | None = None) -> DataFrame:
    """file, lines to one row per line: file, line_no, line, before, after, total_lines.

    Within the file's row: no window, no shuffle. keep is a cheap pattern: other lines are dropped before rows are made,
    so that contexts are copied for few lines only.
    """
    at = F.sequence(F.lit(1), F.size("lines"))
    row = lambda i: F.struct(
        i.cast("long").alias("line_no"),
        F.get("lines", i - 1).alias("line"),
        F.slice("lines", F.greatest(i - around, F.lit(1)), i - F.greatest(i - around, F.lit(1))).alias("before"),
        F.slice("lines", i + 1, F.lit(around)).alias("after"),
        F.size("lines").cast("long").alias("total_lines"),
    )
    rows = F.when(F.size("lines") > 0, F.transform(F.filter(at, lambda i: F.get("lines", i - 1).rlike(keep)) if keep else at, row))
    return files.select("file", F.inline_outer(rows)).where("line_no is not null")


def full_context() -> Column:
    return F.array_join(F.concat("before", F.array("line"), "after"), "\n")


def has_match(text: Column, pattern: str) -> Column:
    return F.regexp_instr(text, F.lit(pattern)) > 0


def variable_name(line: Column, token: Column) -> Column:
    """The name that the line gives the token, by the first of the ordered patterns that hits before its first occurrence; null without one."""
    prefix = before_first(line, token)
    return F.coalesce(*[F.when(prefix.rlike(f"(?U){p}"), F.regexp_extract(prefix, f"(?U){p}", 1)) for p in C.NAME_PATTERNS])


def is_comment(line: Column) -> Column:
    return starts_any(strip(line), C.COMMENT_STARTS)


def file_type(path: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in C.LANGUAGES.items() for x in pair]), suffix(path))


def is_test_file(path: Column) -> Column:
    return F.coalesce(matches_any(path, [f"(?i){p}" for p in C.TEST_PATHS]), F.lit(False))


def is_config_file(path: Column) -> Column:
    name = file_name(path)
    return F.coalesce(suffix(path).isin(*C.CONFIG_EXTENSIONS) | (suffix(path) == ".env") | name.startswith(".env") | contains_any(F.lower(name), C.CONFIG_NAMES), F.lit(False))


def is_risky_file(path: Column) -> Column:
    return F.coalesce(suffix(path).isin(*C.RISKY_EXTENSIONS), F.lit(False))


def is_safe_context(text: Column) -> Column:
    return matches_any(text, [f"(?U){p}" for p in C.SAFE_CONTEXT])


def is_risky_context(text: Column) -> Column:
    return matches_any(text, [f"(?U){p}" for p in C.RISKY_CONTEXT])

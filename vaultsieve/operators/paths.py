"""Which paths are scanned: default names and globs, and ordered ignore patterns of which the last match wins."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from vaultsieve.functions import constants as C
from vaultsieve.functions.text import any_of, glob


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def suffix(path: Column) -> Column:
    """The last extension in lower case; a leading dot starts no extension."""
    return F.lower(F.regexp_extract(file_name(path), r"[^.].*?(\.[^.]+)$", 1))


def has_ignored_name(path: Column, names: Iterable[str] = C.IGNORED_NAMES) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(n) for n in names]))


def matches_ignored_glob(path: Column, globs: Iterable[str] = C.IGNORED_GLOBS) -> Column:
    return any_of(file_name(path).rlike(glob(g)) for g in globs)


def is_scanned(path: Column, extra: str = "") -> Column:
    """By default names and globs, and those of a comma-separated list."""
    more = [p.strip() for p in extra.split(",") if p.strip()]
    names, globs = [*C.IGNORED_NAMES, *(p for p in more if "*" not in p)], [*C.IGNORED_GLOBS, *(p for p in more if "*" in p)]
    return ~(has_ignored_name(path, names) | matches_ignored_glob(path, globs))


def is_entered(path: Column, extra: str = "") -> Column:
    """Whether a folder may hold files that are scanned: ignored names leave out all below them, globs only files."""
    return ~has_ignored_name(path, [*C.IGNORED_NAMES, *(p for p in map(str.strip, extra.split(",")) if p and "*" not in p)])


def within_size(length: Column, most: int = 10 * 1024 * 1024) -> Column:
    return length <= most


def matches_pattern(relative: Column, pattern: str, is_dir: bool = False) -> Column:
    """One ignore pattern: a leading slash anchors it, else it may start at any depth."""
    target = F.concat(relative, F.lit("/")) if is_dir else relative
    core = pattern.lstrip("/").rstrip("/")
    hit = target.rlike(glob(core))
    return hit if pattern.startswith("/") else hit | target.rlike(glob(f"**/{core}"))


def passes_patterns(relative: Column, patterns: Iterable[str]) -> Column:
    """Skipped directories and extensions go first; then each pattern that matches overrules those before it."""
    decided = F.lit(None).cast("boolean")
    for pattern in patterns:
        if pattern and not pattern.startswith("#"):
            raw = pattern.removeprefix("!")
            decided = F.when(matches_pattern(relative, raw), F.lit(raw != pattern)).otherwise(decided)
    skipped = F.arrays_overlap(F.split(relative, "/"), F.array(*[F.lit(d) for d in C.SKIPPED_DIRS])) | suffix(relative).isin(*C.SKIPPED_EXTENSIONS)
    return F.when(skipped, False).otherwise(F.coalesce(decided, F.lit(True)))

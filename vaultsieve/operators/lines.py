"""Lines of texts, with limits on bytes and a test for binary content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: All line ends that a text has, and those of a file reader.
ANY_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
FILE_END = r"\r\n|\n|\r"


def split_lines(text: Column, ends: str = ANY_END) -> Column:
    """Lines without their ends; an end at the very end opens no further line."""
    parts = F.split(text, ends, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def number_lines(texts: DataFrame, text_col: str, ends: str = ANY_END) -> DataFrame:
    """One row per line: other columns, line_no (from 1), line."""
    rest = [c for c in texts.columns if c != text_col]
    return texts.select(*rest, F.posexplode(split_lines(F.col(text_col), ends)).alias("at", "line")).select(*rest, (F.col("at") + 1).cast("long").alias("line_no"), "line")


def lines_within(text: Column, max_bytes: int) -> Column:
    """Leading lines whose UTF-8 bytes, line ends as one byte each, stay within the limit; the first line beyond it and all after go."""
    lines = split_lines(text, FILE_END)
    costs = F.transform(lines, lambda x: F.octet_length(x) + 1)
    open_end = F.when(text.rlike(r"(?s)[\n\r]$"), 0).otherwise(1)
    # (bytes so far, lines so far that are within the limit); once beyond it, no later sum is within.
    state = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n"))
    end = F.aggregate(costs, state, lambda s, c: F.struct((s["sum"] + c).alias("sum"), (s["n"] + (s["sum"] + c <= max_bytes).cast("int")).alias("n")))
    return F.when(F.octet_length(text) == 0, F.array().cast("array<string>")).otherwise(F.slice(lines, F.lit(1), F.when(end["sum"] - open_end <= max_bytes, F.size(lines)).otherwise(end["n"])))


def looks_binary(content: Column) -> Column:
    """Whether the first 1,024 bytes hold a zero byte, or over 30 % bytes that are neither printable ASCII nor common control characters."""
    sample = F.decode(F.substring(content, 1, 1024), "ISO-8859-1")
    odd = F.regexp_count(sample, F.lit(r"[^\x20-\x7e\t\n\r\f\x08]"))
    return (F.length(sample) > 0) & (sample.contains("\x00") | (odd / F.length(sample) > 0.30))

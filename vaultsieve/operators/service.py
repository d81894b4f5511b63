"""Requests in batches: limits, prompts for a second opinion, and reading its answers. The calls themselves are the caller's."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultsieve.functions.text import strip
from vaultsieve.operators.report import redacted

#: Names that a line gives a value, in order of precedence; other rules than those of the features. Fixed values.
NAMES = (r"(\w+)\s*=\s*['\"]", r"(\w+)\s*:\s*\w+\s*=\s*['\"]", r"const\s+(\w+)\s*=", r"let\s+(\w+)\s*=", r"var\s+(\w+)\s*=", r"(\w+)\s*:\s*['\"]", r'"(\w+)":\s*["\']')


def request_errors(requests: DataFrame, most_files: int = 100, most_bytes: int = 10 * 1024 * 1024) -> DataFrame:
    """request, filename, content to request, filename, error: too many files, a name that repeats, a file that is too large; no row if all is well."""
    per = requests.groupBy("request").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most_files).select("request", F.lit(None).cast("string").alias("filename"), F.lit("413 too many files").alias("error"))
    twice = requests.groupBy("request", "filename").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("request", "filename", F.lit("400 duplicate filename").alias("error"))
    large = requests.where(F.octet_length("content") > most_bytes).select("request", "filename", F.lit("413 file too large").alias("error"))
    return per.unionByName(twice).unionByName(large)


def batch_summary(requests: DataFrame, findings: DataFrame) -> DataFrame:
    """One row per request: files, findings, and a map of the findings' number by file."""
    found = findings.groupBy("request", "filename").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence") > 0.8).alias("sure"))
    every = requests.select("request", "filename").join(found, ["request", "filename"], "left").na.fill(0, ["n", "sure"])
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("filename", "n"))))
    return every.groupBy("request").agg(F.count(F.lit(1)).alias("total_files"), F.sum("n").alias("total_findings"), F.sum("sure").alias("high_confidence_findings"), entries.alias("results"))


def may_name(line: Column, pattern: str) -> Column:
    """Whether the line holds the words and marks that the pattern can't do without: a cheap test before it."""
    quoted = [line.contains("'") | line.contains('"')] if "['\"]" in pattern or "[\"\']" in pattern else []
    return reduce(lambda a, b: a & b, [*quoted, *(line.contains(x) for x in re.findall("const|let|var|[=:]", pattern))])


def whole_words(pattern: str) -> str:
    """The same matches in a time that grows with the line only: a word is tried from its start and given back never, since a shorter one is followed by a word character, which is no mark and no space."""
    return (r"(?<!\w)" if pattern.startswith(r"(\w+)") else "") + pattern.replace(r"\w+", r"\w++").replace(r"\s*", r"\s*+")


def prompt_name(line: Column) -> Column:
    def by(flags: str) -> Column:
        return F.coalesce(*[F.when(may_name(line, p), F.nullif(F.regexp_extract(line, flags + whole_words(p), 1), F.lit(""))) for p in NAMES])

    # In ASCII, classes of any script hold what the plain ones hold, which are tested faster.
    return F.when(F.octet_length(line) == F.length(line), by("")).otherwise(by("(?U)"))


def prompt() -> Column:
    """For one finding with its context; the token is redacted, its line is marked."""
    shown = F.array_join(F.concat(F.slice("before", F.greatest(F.size("before") - 2, F.lit(1)), F.lit(3)), F.array(F.concat(F.lit(">>> "), "line")), F.slice("after", 1, 3)), "\n")
    return F.concat(
        F.lit("TOKEN: "), F.coalesce(redacted(F.col("token")), F.lit("***")), F.lit("\nTYPE: "), F.col("type"), F.lit("\nVARIABLE: "), F.coalesce(prompt_name(F.col("line")), F.lit("unknown")),
        F.lit("\nFILE: "), F.coalesce("file", F.lit("unknown")), F.lit("\nCONTEXT:\n"), shown, F.lit("\nReal secret or false positive? Answer in JSON."),
    )


def prompt_batches(findings: DataFrame, group: str, order: list[str], size: int = 5) -> DataFrame:
    """Prompts of `size` findings each within a group, in order: group, batch, prompts."""
    at = F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1
    made = findings.withColumn("at", at).withColumn("batch", F.floor(F.col("at") / size))
    return made.groupBy(group, "batch").agg(F.array_sort(F.collect_list(F.struct("at", "prompt"))).alias("all")).select(group, "batch", F.col("all.prompt").alias("prompts"))


def answer(content: Column) -> dict[str, Column]:
    """is_secret, confidence, reasoning of one answer: JSON, in a code fence or not; else words that deny it; else a secret of confidence one half."""
    text = strip(content)
    inner = F.when(text.contains("```json"), F.substring_index(F.get(F.split(text, "```json"), F.lit(1)), "```", 1)).when(text.contains("```"), F.get(F.split(text, "```"), F.lit(1))).otherwise(text)
    json = F.from_json(F.when(F.try_parse_json(inner).isNotNull(), inner), "is_secret boolean, confidence double, reasoning string")
    good = F.coalesce(strip(inner).startswith("{") & F.try_parse_json(inner).isNotNull(), F.lit(False))
    low = F.lower(inner)
    return {
        "is_secret": F.when(good, F.coalesce(json["is_secret"], F.lit(True))).otherwise(~(low.contains("false positive") | low.contains("not a secret"))),
        "confidence": F.when(good, F.coalesce(json["confidence"], F.lit(0.5))).otherwise(0.5),
        "reasoning": F.when(good, F.coalesce(json["reasoning"], F.lit("No explanation provided"))).otherwise(F.left(inner, F.lit(200))),
    }


def batch_answers(content: Column, count: Column) -> Column:
    """Answers of a batch as an array of `count` (is_secret, confidence): a longer one is cut, a shorter or unreadable one filled up with secrets of confidence one half."""
    none = F.struct(F.lit(True).alias("is_secret"), F.lit(0.5).alias("confidence"))
    read = F.from_json(content, "array<struct<is_secret:boolean,confidence:double>>")
    known = F.transform(F.coalesce(read, F.array().cast("array<struct<is_secret:boolean,confidence:double>>")), lambda x: F.struct(F.coalesce(x["is_secret"], F.lit(True)).alias("is_secret"), F.coalesce(x["confidence"], F.lit(0.5)).alias("confidence")))
    return F.slice(F.concat(known, F.array_repeat(none, F.greatest(count - F.size(known), F.lit(0)))), F.lit(1), count)


def requests_in_window(events: DataFrame, seconds: int, client: str = "user_id", at: str = "ts") -> DataFrame:
    """events with in_window: the client's events in the window before and at each. Exact for a limiter as long as none is refused; the streaming limiter keeps the exact state."""
    t = F.unix_micros(F.col(at).cast("timestamp"))
    w = Window.partitionBy(client).orderBy(t).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return events.withColumn("in_window", F.count(F.lit(1)).over(w))

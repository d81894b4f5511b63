"""Redaction, gates, summaries and texts of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultsieve.functions.constants import SEVERITIES
from vaultsieve.functions.text import strip


def redacted(token: Column) -> Column:
    """Ends of the token, fewer the shorter it is; null for null or blank."""
    n = F.length(token)
    ends = lambda k: F.concat(F.left(token, F.lit(k)), F.lit("..."), F.right(token, F.lit(k)))
    return F.when(token.isNull() | (strip(token) == ""), None).when(n < 8, "[REDACTED]").when(n == 8, ends(1)).when(n <= 10, ends(2)).otherwise(ends(4))


def redact(findings: DataFrame, snippets: bool = False) -> DataFrame:
    """token in redacted form; on request also within snippets, which else carry the line as it is."""
    out = findings
    if snippets:
        out = out.withColumn("snippet", F.when(redacted(F.col("token")).isNull(), F.col("snippet")).otherwise(F.replace("snippet", "token", redacted(F.col("token")))))
    return out.withColumn("token", redacted(F.col("token")))


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.lower(severity)).cast("int") - 1


def fails(findings: DataFrame, at: str) -> DataFrame:
    """One row: whether any finding is at the severity or above; none never fails."""
    level = at.lower()
    if level != "none" and level not in SEVERITIES:
        raise ValueError(f"not a severity: {at}")
    worst = F.max(severity_rank(F.col("severity")))
    return findings.agg((F.lit(False) if level == "none" else F.coalesce(worst >= SEVERITIES.index(level), F.lit(False))).alias("failed"))


def counts() -> list[Column]:
    return [F.count(F.lit(1)).alias("total_findings"), F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "high").alias("high")]


def finding_text() -> Column:
    place = F.when(F.col("file").isNotNull() & (F.col("line_no") > 0), F.concat_ws(":", "file", F.col("line_no").cast("string"))).otherwise("text")
    return F.concat(F.lit("["), F.upper("severity"), F.lit("] "), F.col("type"), F.lit(" at "), place, F.lit(" (evidence: "), F.col("evidence"), F.lit(")"))


def as_json(findings: DataFrame, include_token: bool = False) -> Column:
    names = [n for n in ("type", "snippet", "evidence", "file", "line_no", "entropy", "severity", "confidence", "token") if n in findings.columns and (include_token or n != "token")]
    return F.to_json(F.struct(*names), {"ignoreNullFields": "false"})


def response() -> list[Column]:
    """A service's view of findings."""
    return [F.col("type").alias("secret_type"), F.coalesce(redacted(F.col("token")), F.lit("***")).alias("token_redacted"), F.col("line_no"), F.coalesce("snippet", F.lit("")).alias("snippet"), "severity", F.coalesce("confidence", F.lit(0.5)).alias("confidence")]

"""Calibration, routing, fusion and combination of model scores, and what is said of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOW, HIGH, STAGE_B = 0.15, 0.85, 0.35
WEIGHTS = (0.6, 0.4)


def platt(raw: Column, a: float, b: float) -> Column:
    return raw if a == 0 and b == 0 else 1 / (1 + F.exp(a * raw + b))


def route(p: Column, low: float = LOW, high: float = HIGH) -> Column:
    return F.when(p < low, "safe").when(p > high, "blocked").otherwise("review")


def verdict(p: Column, low: float = LOW, high: float = HIGH) -> dict[str, Column]:
    """Whether it is a secret (review counts as one), the confidence in that, and the route."""
    return {"is_secret": p >= low, "ml_confidence": F.when(p < low, 1 - p).otherwise(p), "routing": route(p, low, high)}


def fused(original: Column, ml: Column, evidence: Column) -> Column:
    """Missing or zero confidences count as one half."""
    known = F.coalesce(F.nullif(original, F.lit(0.0)), F.lit(0.5))
    return F.when(evidence == "regex", 0.6 * known + 0.4 * ml).otherwise(0.3 * known + 0.7 * ml)


def weighted(a: Column, b: Column, weights: tuple[float, float] = WEIGHTS) -> Column:
    total = F.when(a.isNotNull(), weights[0]).otherwise(0.0) + F.when(b.isNotNull(), weights[1]).otherwise(0.0)
    return F.when(total > 0, (F.coalesce(a, F.lit(0.0)) * weights[0] + F.coalesce(b, F.lit(0.0)) * weights[1]) / total).otherwise(0.5)


def soft(a: Column, b: Column) -> Column:
    known = F.filter(F.array(a, b), lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known)).otherwise(0.5)


def hard(a: Column, b: Column, threshold: float = 0.5) -> Column:
    """A tie counts against."""
    known = F.filter(F.array(a, b), lambda x: x.isNotNull())
    yes = F.size(F.filter(known, lambda x: x >= threshold))
    return F.when(F.size(known) == 0, 0.5).when(yes * 2 > F.size(known), 1.0).otherwise(0.0)


def surest(a: Column, b: Column) -> Column:
    """The score farther from one half; the first on a tie."""
    return F.when(b.isNull() & a.isNull(), 0.5).when(a.isNull(), b).when(b.isNull() | (F.abs(a - 0.5) >= F.abs(b - 0.5)), a).otherwise(b)


def two_stage(a: Column, b: Column, low: float = LOW, high: float = HIGH, cut: float = STAGE_B) -> dict[str, Column]:
    sure = (a < low) | (a > high)
    return {"stage": F.when(a < low, "A_reject").when(a > high, "A_accept").otherwise("B"), "is_secret": F.when(sure, a > high).otherwise(b >= cut), "score": F.when(sure, a).otherwise(b)}


def lazy_two_stage(rows: DataFrame, score_b, low: float = LOW, high: float = HIGH, cut: float = STAGE_B) -> DataFrame:
    """rows with score_a; score_b, a function of a DataFrame that adds that column, runs on the ambiguous rows alone."""
    sure = (F.col("score_a") < low) | (F.col("score_a") > high)
    first = rows.where(sure).withColumn("is_secret", F.col("score_a") > high).withColumn("stage", F.lit("A"))
    second = score_b(rows.where(~sure)).withColumn("is_secret", F.col("score_b") >= cut).withColumn("stage", F.lit("B"))
    return first.unionByName(second.drop("score_b"))


def decision_path(confidence: Column) -> Column:
    return F.when(confidence > HIGH, "high_confidence").when(confidence < LOW, "low_confidence").otherwise("ambiguous")


def explanation(is_secret: Column, confidence: Column) -> Column:
    """Over feature columns as the feature operator names them."""
    yes = [(F.col("var_contains_secret"), F.lit("variable name suggests secret")), (F.col("file_is_config"), F.lit("found in config file")), (F.col("token_entropy") > 4.0, F.concat(F.lit("high entropy ("), F.format_number("token_entropy", 2), F.lit(")"))), (F.col("file_extension_risk") == 2, F.lit("high-risk file type"))]
    no = [(F.col("var_contains_safe"), F.lit("variable name suggests safe content")), (F.col("context_mentions_git"), F.lit("git-related context")), (F.col("context_mentions_hash"), F.lit("hash/checksum context")), (F.col("context_mentions_test"), F.lit("test/mock context")), (F.col("file_is_test"), F.lit("test file"))]
    join = lambda of: F.concat_ws(", ", *[F.when(test.cast("boolean"), what) for test, what in of])
    reasons = F.coalesce(F.nullif(F.when(is_secret, join(yes)).otherwise(join(no)), F.lit("")), F.lit("based on overall context"))
    return F.concat(F.when(is_secret, "likely secret").otherwise("likely not a secret"), F.format_string(" (%d%% confidence): ", F.round(confidence * 100).cast("int")), reasons)


def verified(findings: DataFrame, threshold: float = 0.5, low: float = LOW, high: float = HIGH, all_findings: bool = False) -> DataFrame:
    """Findings with a calibrated score p: signature findings stay as they are (unless all are to be judged), others stay if they are secrets of enough fused confidence and become hybrid evidence. A missing score leaves its finding unverified."""
    judged = F.lit(True) if all_findings else F.col("evidence") != "regex"
    both = fused(F.col("confidence"), verdict(F.col("p"), low, high)["ml_confidence"], F.col("evidence"))
    keep = ~judged | F.col("p").isNull() | ((F.col("p") >= low) & (both >= threshold))
    scored = judged & F.col("p").isNotNull()
    return findings.where(keep).withColumns({"confidence": F.when(scored, both).otherwise(F.col("confidence")), "evidence": F.when(scored, "hybrid").otherwise(F.col("evidence"))})

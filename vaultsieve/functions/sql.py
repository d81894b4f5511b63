"""The library from SQL: functions that are expressions of Spark's own, which the optimizer sees through, and views of the fixed values.

register(spark) makes these known to a session:

* token_entropy(t), entropy_confidence(e), looks_secret(t), redact_token(t), is_skipped_line(line), decision_path(p): scalars.
* findings(line): the findings of a line as an array; rows by SELECT file, f.* FROM (SELECT *, findings(line) AS found FROM lines), LATERAL inline(found) AS f.
* signatures (severity, type, confidence, pattern), ignored_names (pattern): temporary views.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from vaultsieve.functions import constants as C
from vaultsieve.operators.detect import HEADS
from vaultsieve.operators.scoring import HIGH, LOW


def _text(value: str) -> str:
    """A raw string literal; text with both kinds of quotes is joined from pieces."""
    if '"' not in value:
        return f'r"{value}"'
    if "'" not in value:
        return f"r'{value}'"
    return "concat_ws('\"', " + ", ".join(f'r"{part}"' for part in value.split('"')) + ")"


_STRIP = r'''regexp_replace({}, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", '')'''


def _found(base: int, kind: str, evidence: str, severity: str, sure: float | None, tokens: str) -> str:
    """An array of findings, one for each of the tokens."""
    value = f"{sure!r}D" if sure is not None else "CAST(NULL AS DOUBLE)"
    return f"transform({tokens}, (x, i) -> named_struct('seq', {base} + i, 'type', '{kind}', 'evidence', '{evidence}', 'severity', '{severity}', 'sure', {value}, 'token', x))"


def _signatures() -> list[tuple[str, str, float, str]]:
    return [(tier, name, C.CONFIDENCE[tier], p) for tier, of in (("critical", C.CRITICAL), ("high", C.HIGH)) for name, p in of.items()]


def scalars() -> dict[str, tuple[str, str, str]]:
    """Arguments, type and body of each function, in the order of their needs."""
    hits = ", ".join(_found(1000 * i, name, "regex", tier, sure, f"regexp_extract_all(s, {_text(p)}, 0)") for i, (tier, name, sure, p) in enumerate(_signatures()))
    finding = "ARRAY<STRUCT<seq INT, type STRING, evidence STRING, severity STRING, sure DOUBLE, token STRING>>"
    tokens = f"filter(regexp_extract_all(regexp_replace(s, {_text(C.URL)}, ' '), {_text(C.TOKEN)}, 0), x -> {{looks}})"
    # A function's body can't call another function on a lambda's argument, so the test is written into it.
    looks = (
        "length({t}) >= 20 AND (({t} rlike r'\\p{{Ll}}')::int + ({t} rlike r'\\p{{Lu}}')::int + ({t} rlike r'\\p{{Nd}}')::int + ({t} rlike r'[^\\p{{L}}\\p{{N}}]')::int) >= 2 AND ({t} rlike r'\\p{{Nd}}' OR {t} rlike r'[^\\p{{L}}\\p{{N}}]') "
        "AND NOT ({t} rlike r'\\p{{Ll}}' AND NOT {t} rlike r'\\p{{Lu}}' AND NOT {t} rlike r'\\p{{Nd}}') AND size(filter(array_distinct(split({t}, '')), c -> c != '')) > 3 AND {entropy} >= 4.0D"
    )
    entropy = "CASE WHEN length({t}) = 0 THEN 0D ELSE aggregate(transform(filter(array_distinct(split({t}, '')), c -> c != ''), c -> (length({t}) - length(replace({t}, c, ''))) / length({t})), 0D, (a, p) -> a - p * log2(p)) END"
    sure = "CASE WHEN {e} IS NULL THEN 0.6D ELSE 0.6D + (greatest(least({e}, 5.5D), 4.0D) - 4.0D) * (0.2D / 1.5D) END"
    ends = lambda k: f"concat(left(t, {k}), '...', right(t, {k}))"
    of = lambda t: looks.format(t=t, entropy=entropy.format(t=t))
    every = tokens.replace("{looks}", of("x"))
    return {
        "token_entropy": ("t STRING", "DOUBLE", entropy.format(t="t")),
        "entropy_confidence": ("e DOUBLE", "DOUBLE", sure.format(e="e")),
        "looks_secret": ("t STRING", "BOOLEAN", of("t")),
        "redact_token": ("t STRING", "STRING", f"CASE WHEN t IS NULL OR {_STRIP.format('t')} = '' THEN NULL WHEN length(t) < 8 THEN '[REDACTED]' WHEN length(t) = 8 THEN {ends(1)} WHEN length(t) <= 10 THEN {ends(2)} ELSE {ends(4)} END"),
        "is_skipped_line": ("line STRING", "BOOLEAN", f"{_STRIP.format('line')} = '' OR startswith({_STRIP.format('line')}, '#') OR startswith({_STRIP.format('line')}, '/*#')"),
        "decision_path": ("p DOUBLE", "STRING", f"CASE WHEN p > {HIGH}D THEN 'high_confidence' WHEN p < {LOW}D THEN 'low_confidence' ELSE 'ambiguous' END"),
        "signature_findings": ("s STRING", finding, f"CASE WHEN s rlike {_text(HEADS)} THEN concat({hits}) ELSE CAST(array() AS {finding}) END"),
        "candidate_findings": ("s STRING", finding, "concat(" + _found(100_000, "ENTROPY_CANDIDATE", "entropy", "info", None, every) + ", " + _found(200_000, "ML_CANDIDATE", "ml", "critical", None, f"filter(regexp_extract_all(s, {_text(C.ASSIGNMENT)}, 1), v -> NOT array_contains({every}, v))") + ")"),
        "findings": (
            "line STRING", "ARRAY<STRUCT<seq INT, type STRING, evidence STRING, severity STRING, confidence DOUBLE, entropy DOUBLE, token STRING>>",
            "transform(CASE WHEN is_skipped_line(line) THEN NULL WHEN size(signature_findings({0})) > 0 THEN signature_findings({0}) WHEN {0} rlike {1} THEN NULL ELSE candidate_findings({0}) END, ".format(_STRIP.format("line"), _text(C.ARMOUR_BODY))
            + "f -> named_struct('seq', f.seq, 'type', f.type, 'evidence', f.evidence, 'severity', f.severity, 'confidence', coalesce(f.sure, {0}), 'entropy', {1}, 'token', f.token))".format(sure.format(e=f"({entropy.format(t='f.token')})"), entropy.format(t="f.token")),
        ),
    }


def register(spark: SparkSession) -> list[str]:
    """Make the functions and views known to the session; their names."""
    made = scalars()
    for name, (arguments, kind, body) in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    spark.createDataFrame(_signatures(), "severity string, type string, confidence double, pattern string").createOrReplaceTempView("signatures")
    spark.createDataFrame([(p,) for p in (*C.IGNORED_NAMES, *C.IGNORED_GLOBS)], "pattern string").createOrReplaceTempView("ignored_names")
    return [*made, "signatures", "ignored_names"]

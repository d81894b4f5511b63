"""Line-level detection, all in one row: signatures, entropy candidates, assignments to credential-like names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultsieve.functions import batches
from vaultsieve.functions import constants as C
from vaultsieve.functions.text import contains_any, entropy, strip
from vaultsieve.sources.package import ship

#: A cheap test that every signature passes; most lines fail it, so the sixteen patterns are not tried.
HEADS = r"AKIA|A3T|AGPA|AIDA|AROA|AIPA|ANPA|ANVA|ASIA|gh[pousr]_|github_pat_|xox|[rs]k_|sk-|AIza|npm_|pypi-|-----BEGIN|hooks\.slack|discord\.com|SG\.|SK|dapi|hvs\."
#: What every match of a signature holds one of.
PARTS = {
    "AWS_ACCESS_KEY_ID": ("AKIA", "A3T", "AGPA", "AIDA", "AROA", "AIPA", "ANPA", "ANVA", "ASIA"), "GITHUB_PAT": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_"), "SLACK_TOKEN": ("xox",), "STRIPE_KEY": ("sk_", "rk_"),
    "OPENAI_API_KEY": ("sk-",), "ANTHROPIC_API_KEY": ("sk-ant-api03-",), "GCP_API_KEY": ("AIza",), "NPM_TOKEN": ("npm_",), "PYPI_TOKEN": ("pypi-",), "PRIVATE_KEY": ("-----BEGIN ",), "SLACK_WEBHOOK": ("https://hooks.slack.com/",),
    "DISCORD_WEBHOOK": ("https://discord.com/",), "SENDGRID_API_KEY": ("SG.",), "TWILIO_API_KEY": ("SK",), "DATABRICKS_TOKEN": ("dapi",), "HASHICORP_VAULT_TOKEN": ("hvs.",),
}
#: Bits per character from which a token looks like a secret; more than three characters could give.
SECRET_BITS = 4.0
_FINDING = "array<struct<seq:int,type:string,evidence:string,severity:string,sure:double,token:string>>"


def is_skipped(stripped: Column) -> Column:
    """Blank lines and comments; lines that start with two slashes are scanned."""
    return (stripped == "") | stripped.startswith("#") | stripped.startswith("/*#")


def is_mixed(token: Column) -> Column:
    """Length and character kinds of a secret, which are tested before entropy, the costly part."""
    lower, upper, digit, special = (token.rlike(p) for p in (r"\p{Ll}", r"\p{Lu}", r"\p{Nd}", r"[^\p{L}\p{N}]"))
    kinds = sum((x.cast("int") for x in (upper, digit, special)), lower.cast("int"))
    return (F.length(token) >= 20) & (kinds >= 2) & (digit | special) & ~(lower & ~upper & ~digit)


def looks_like_secret(token: Column, threshold: float = SECRET_BITS) -> Column:
    distinct = F.size(F.filter(F.array_distinct(F.split(token, "")), lambda c: c != ""))
    return is_mixed(token) & (distinct > 3) & (entropy(token) >= threshold)


def entropy_confidence(value: Column) -> Column:
    return F.when(value.isNull(), 0.6).otherwise(0.6 + (F.greatest(F.least(value, F.lit(5.5)), F.lit(4.0)) - 4.0) * (0.2 / 1.5))


def _finding(base: int, kind: str, evidence: str, severity: str, confidence: float | None = None):
    """A function of a token and its place among its pattern's matches that makes a finding; without a confidence of its own, it follows from the entropy later."""

    def make(token: Column, at: Column) -> Column:
        return F.struct((F.lit(base) + at).alias("seq"), F.lit(kind).alias("type"), F.lit(evidence).alias("evidence"), F.lit(severity).alias("severity"), F.lit(confidence).cast("double").alias("sure"), token.alias("token"))

    return make


def signature_findings(stripped: Column) -> Column:
    tiers = [("critical", C.CRITICAL), ("high", C.HIGH)]
    patterns = [(tier, name, pattern) for tier, of in tiers for name, pattern in of.items()]
    none = F.array().cast(_FINDING)
    found = [F.when(contains_any(stripped, PARTS[name]), F.transform(F.regexp_extract_all(stripped, F.lit(p), F.lit(0)), _finding(1000 * i, name, "regex", tier, C.CONFIDENCE[tier]))).otherwise(none) for i, (tier, name, p) in enumerate(patterns)]
    return F.when(contains_any(stripped, sorted({x for parts in PARTS.values() for x in parts})), F.concat(*found)).otherwise(none)


def mixed_tokens(stripped: Column) -> Column:
    """Tokens that look like secrets if their entropy does, after URLs are cut."""
    return F.filter(F.regexp_extract_all(F.regexp_replace(stripped, C.URL, " "), F.lit(C.TOKEN), F.lit(0)), is_mixed)


def candidate_findings(stripped: Column, tokens: Column) -> Column:
    """Entropy candidates, then assigned values that are not among them; a value that is assigned twice counts twice."""
    values = F.filter(F.regexp_extract_all(stripped, F.lit(C.ASSIGNMENT), F.lit(1)), lambda v: ~F.array_contains(tokens, v))
    return F.concat(F.transform(tokens, _finding(100_000, "ENTROPY_CANDIDATE", "entropy", "info")), F.transform(values, _finding(200_000, "ML_CANDIDATE", "ml", "critical")))


def scan_lines(lines: DataFrame, once: bool = False) -> DataFrame:
    """Findings of lines: all columns of `lines` and seq, type, evidence, severity, confidence, entropy, token, snippet.

    A line with a signature gives no candidates, nor does a line of an armoured key's body. seq is the order of emission
    in the line. No shuffle: a line's findings are an array in its own row, exploded at the end (by an outer generator, as
    the optimizer would else evaluate the array a second time, in a filter below). Entropies are taken in batches.
    once: of findings of one type and token in a line only the first.
    """
    ship(lines.sparkSession)
    kept = lines.withColumn("stripped", strip(F.col("line"))).where(~is_skipped(F.col("stripped")))
    kept = kept.withColumn("hits", signature_findings(F.col("stripped")))
    kept = kept.withColumn("mixed", F.when((F.size("hits") > 0) | F.col("stripped").rlike(C.ARMOUR_BODY), None).otherwise(mixed_tokens(F.col("stripped"))))
    kept = kept.withColumn("tokens", F.array_compact(F.zip_with("mixed", batches.entropies(F.col("mixed")), lambda t, e: F.when(e >= SECRET_BITS, t))))
    kept = kept.withColumn("found", F.when(F.size("hits") > 0, F.col("hits")).when(F.col("tokens").isNotNull(), candidate_findings(F.col("stripped"), F.col("tokens"))))
    if once:
        kept = kept.withColumn("found", F.filter("found", lambda x, i: ~F.exists(F.slice("found", F.lit(1), i), lambda y: (y["type"] == x["type"]) & (y["token"] == x["token"]))))
    kept = kept.select(*lines.columns, F.substring("stripped", 1, 200).alias("snippet"), F.inline_outer("found")).where("seq is not null")
    kept = kept.withColumn("entropy", batches.entropy(F.col("token")))
    return kept.select(*lines.columns, "seq", "type", "evidence", "severity", F.coalesce("sure", entropy_confidence(F.col("entropy"))).alias("confidence"), "entropy", "token", "snippet")

"""Synthetic training records from a range of numbers: kinds by weights, values by digests of the number and a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of positives and negatives with their weights, languages and their line forms.
POSITIVES = {"aws_access_key": 0.2, "github_token": 0.2, "stripe_live_key": 0.15, "generic_entropy": 0.3, "password": 0.15}
NEGATIVES = {"git_sha": 0.25, "uuid": 0.2, "sha256": 0.15, "placeholder": 0.15, "version": 0.1, "test_key": 0.15}
NAMES = {1: ("api_key", "client_secret", "auth_token", "db_password"), 0: ("commit_sha", "request_id", "checksum", "sample_value")}
LANGUAGES = {"python": ("config/settings.py", '{n} = "{t}"'), "javascript": ("src/index.js", "const {n} = '{t}';"), "yaml": ("deploy/values.yaml", '{n}: "{t}"'), "shell": ("scripts/run.sh", "export {n}={t}"), "go": ("cmd/main.go", '{n} := "{t}"')}


def _chance(key: Column, what: str, seed: int) -> Column:
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f"|{what}|{seed}"))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def _pick(chance: Column, weights: dict[str, float]) -> Column:
    total, bound, out = sum(weights.values()), 0.0, F.lit(list(weights)[-1])
    steps = []
    for kind, weight in list(weights.items())[:-1]:
        bound += weight / total
        steps.append((kind, bound))
    for kind, cut in reversed(steps):
        out = F.when(chance < cut, kind).otherwise(out)
    return out


def records(spark: SparkSession, n: int, positives: float = 0.4, seed: int = 42, partitions: int | None = None) -> DataFrame:
    """n records; about `positives` of them have label 1. No state between rows: any number of partitions gives the same."""
    rows = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    key = F.col("id")
    hexes = F.md5(F.concat(key.cast("string"), F.lit(f"|hex|{seed}")))
    mixed = F.translate(hexes, "0123456789abcdef", "aB3dE5gH7jK9mN2p")
    label = (_chance(key, "label", seed) < positives).cast("int")
    kind = F.when(label == 1, _pick(_chance(key, "kind", seed), POSITIVES)).otherwise(_pick(_chance(key, "kind", seed), NEGATIVES))
    token = (
        F.when(kind == "aws_access_key", F.concat(F.lit("AKIA"), F.upper(F.left(hexes, F.lit(16)))))
        .when(kind == "github_token", F.concat(F.lit("ghp_"), mixed, F.left(mixed, F.lit(4))))
        .when(kind == "stripe_live_key", F.concat(F.lit("sk_live_"), F.left(mixed, F.lit(24))))
        .when(kind == "password", F.concat(F.lit("Tr0ub4dor&"), F.left(hexes, F.lit(6))))
        .when(kind == "git_sha", F.concat(hexes, F.left(hexes, F.lit(8))))
        .when(kind == "uuid", F.concat_ws("-", F.substring(hexes, 1, 8), F.substring(hexes, 9, 4), F.concat(F.lit("4"), F.substring(hexes, 14, 3)), F.concat(F.lit("a"), F.substring(hexes, 18, 3)), F.substring(hexes, 21, 12)))
        .when(kind == "sha256", F.sha2(hexes, 256))
        .when(kind == "placeholder", F.concat(F.lit("YOUR_KEY_HERE_"), F.left(hexes, F.lit(4))))
        .when(kind == "version", F.concat(F.lit("v1."), (key % 30).cast("string"), F.lit("."), (key % 7).cast("string")))
        .when(kind == "test_key", F.concat(F.lit("sk_test_"), F.left(mixed, F.lit(24))))
        .otherwise(mixed)
    )
    choose = lambda of, what: F.get(F.array(*[F.lit(x) for x in of]), F.floor(_chance(key, what, seed) * len(of)).cast("int"))
    name = F.when(label == 1, choose(NAMES[1], "name")).otherwise(choose(NAMES[0], "name"))
    language = _pick(_chance(key, "language", seed), dict.fromkeys(LANGUAGES, 1.0))
    made = rows.select("id", label.alias("label"), kind.alias("kind"), token.alias("token"), name.alias("name"), language.alias("language"))
    forms = F.create_map(*[F.lit(x) for k, v in LANGUAGES.items() for x in (k, v[1])])
    places = F.create_map(*[F.lit(x) for k, v in LANGUAGES.items() for x in (k, v[0])])
    line = F.replace(F.replace(F.element_at(forms, F.col("language")), F.lit("{n}"), F.col("name")), F.lit("{t}"), F.col("token"))
    return made.select(
        "id", "token", line.alias("line_content"), F.array(F.concat(F.lit("# "), "language")).alias("context_before"), F.array(F.lit("")).alias("context_after"), "label",
        F.element_at(places, F.col("language")).alias("file_path"), F.when(F.col("label") == 1, F.col("kind")).alias("secret_type"), F.when(F.col("label") == 0, F.col("kind")).alias("negative_type"),
    )

"""Queries on scorers and the training life cycle, over labelled candidates of the derived corpus."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultsieve.operators import dataset, features, scorers, training
from vaultsieve.plans.q_features import CAND, candidates
from vaultsieve.plans.q_score import W, scores
from vaultsieve.plans.registry import query
from vaultsieve.plans.stand_ins import STUMPS, Absent, Picky

#: Rounds and depth of the queries' models.
ROUNDS, DEPTH, FOLDS = 8, 4, 3
#: Features that models of the token alone look at, without vendors' prefixes, which are what the label is made of.
COLUMNS = [c for c in features.ORDER[:23] if c not in ("vendor_prefix_boost", "known_secret_prefix", "regex_match_type")]


def labelled(spark, sf, columns: list[str] | None = None) -> DataFrame:
    """id, label, features of every candidate: the label is whether a signature found it, but for one in sixteen, by a digest of the place, that is turned over."""
    found = candidates(spark, sf)
    rows = features.with_features(found.select("file", "line_no", "line", "before", "after", "total_lines", "type", "token", "seq", "evidence"))
    digest = F.md5(F.concat_ws("|", "file", F.col("line_no").cast("string"), "seq", "token"))
    noisy = F.conv(F.substring(digest, 1, 1), 16, 10).cast("int") == 0
    label = (F.col("evidence") == "regex") != noisy
    return rows.select(digest.alias("id"), label.cast("long").alias("label"), *(columns or features.ORDER))


_SCORERS = {"absent": Absent(), "length": STUMPS["length"], "entropy": STUMPS["entropy"], "picky": Picky()}
_SQL = (
    f"{CAND}, p AS (SELECT *, CASE WHEN n <= 36 THEN 0.25::DOUBLE ELSE 0.75::DOUBLE END AS a, CASE WHEN ent <= 4.2 THEN 0.1::DOUBLE ELSE 0.95::DOUBLE END AS b, CASE WHEN n % 2 = 0 THEN 0.6::DOUBLE END AS c FROM cand)"
)


@query(
    "v_scorers",
    f"{_SQL} SELECT file, line_no, token, CAST(CASE WHEN c IS NULL THEN 2 ELSE 1 END AS BIGINT) AS n_failures, 'FileNotFoundError: model is not there' AS absent, CASE WHEN c IS NULL THEN 'not finite' END AS picky, "
    "round(CASE WHEN c IS NULL THEN (0.3::DOUBLE * a + 0.2::DOUBLE * b) / 0.5::DOUBLE ELSE (0.3::DOUBLE * a + 0.2::DOUBLE * b + 0.1::DOUBLE * c) / 0.6::DOUBLE END, 6) AS weighted, round(list_avg([x for x in [a, b, c] if x IS NOT NULL]), 6) AS soft, "
    "CASE WHEN len([x for x in [a, b, c] if x >= 0.5]) * 2 > (CASE WHEN c IS NULL THEN 2 ELSE 3 END) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hard FROM p",
)
def v_scorers(spark, sf):
    """Four scorers over all candidates, of which one always fails and one has no score for some rows: the others go on."""
    rows = features.base(candidates(spark, sf)).select("file", "line_no", "token", *[features.ratios()[c].alias(c) for c in ("token_length", "token_entropy")])
    made = scorers.with_scores(rows, _SCORERS, ["token_length", "token_entropy"])
    weights = {"absent": 0.4, "length": 0.3, "entropy": 0.2, "picky": 0.1}
    return made.select(
        "file", "line_no", "token", F.size("failures").cast("long").alias("n_failures"), F.col("failures.absent").alias("absent"), F.col("failures.picky").alias("picky"),
        F.round(scorers.combined(weights), 6).alias("weighted"), F.round(scorers.combined(weights, how="soft"), 6).alias("soft"), scorers.combined(weights, how="hard").alias("hard"),
    )


@query(
    "v_unverified",
    f"{_SQL}, f AS (SELECT p.*, g.evidence, g.confidence FROM p JOIN findings g ON p.file = g.file AND p.line_no = g.line_no AND p.type = g.type AND p.token = g.token) SELECT evidence, routing, CAST(count(*) AS BIGINT) AS n, round(sum(combined), 4) AS combined FROM ("
    "SELECT evidence, CASE WHEN c IS NULL THEN 'unverified' ELSE 'review' END AS routing, CASE WHEN c IS NULL THEN confidence WHEN evidence = 'regex' THEN 0.6::DOUBLE * confidence + 0.4::DOUBLE * 0.6::DOUBLE ELSE 0.3::DOUBLE * confidence + 0.7::DOUBLE * 0.6::DOUBLE END AS combined FROM (SELECT DISTINCT ON (file, line_no, type, token) * FROM f)) GROUP BY ALL",
)
def v_unverified(spark, sf):
    """One call from findings to verdicts, by a scorer that has none for some: those keep their own confidence, unverified. A line's repeated findings count once."""
    found = candidates(spark, sf, once=True)
    made = scorers.verdicts(found, {"absent": Absent(), "picky": Picky()}, mode="soft")
    return made.groupBy("evidence", "routing").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("combined"), 4).alias("combined"))


@query("t_early_stop")
def t_early_stop(spark, sf):
    """round, loss (of rows that were learned from), validation_loss, best: boosting that stops when rows that it doesn't see gain no more."""
    rows = dataset.folds(labelled(spark, sf, COLUMNS), 5, ["label"], "id")
    vectors = training.assembled(rows, COLUMNS, ("fold",))
    made = training.early_stopped(vectors, F.col("fold") == 0, rounds=40, depth=DEPTH, step=0.4)
    vectors.unpersist()
    return spark.createDataFrame([(*x, x[0] == made.rounds) for x in made.losses], "round int, loss double, validation_loss double, best boolean")  # one row a round


@query("t_cross_validated")
def t_cross_validated(spark, sf):
    """Folds of all candidates at their own thresholds, and a last row (fold null) of the model of all rows at their mean."""
    rows = labelled(spark, sf, COLUMNS).persist()
    made = training.cross_validated(dataset.folds_in_place(rows, FOLDS, ["label"], "id"), FOLDS, "id", COLUMNS, ROUNDS, DEPTH)
    rows.unpersist()
    return made.folds.unionByName(made.total)


@query(
    "t_fold_reports",
    f"{W}, b AS (SELECT id % 5 AS fold, score, sum(label)::DOUBLE AS p, count(*)::DOUBLE AS n FROM s GROUP BY 1, 2), c AS (SELECT fold, score, sum(p) OVER d AS tp, sum(n) OVER d AS y, sum(p) OVER (PARTITION BY fold) AS pos, sum(n) OVER (PARTITION BY fold) AS tot FROM b WINDOW d AS (PARTITION BY fold ORDER BY score DESC)), "
    "m AS (SELECT *, tp / y AS precision, tp / pos AS recall, 2 * (tp / y) * (tp / pos) / (tp / y + tp / pos + 1e-10) AS f1 FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY (precision >= 0.95)::INT DESC, CASE WHEN precision >= 0.95 THEN recall ELSE f1 END DESC, score) AS r FROM m) "
    "SELECT CAST(fold AS BIGINT) AS fold, score AS threshold, CAST(tp AS BIGINT) AS tp, CAST(y - tp AS BIGINT) AS fp, CAST(tot - pos - y + tp AS BIGINT) AS tn, CAST(pos - tp AS BIGINT) AS fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM k WHERE r = 1",
)
def t_fold_reports(spark, sf):
    """The folds' thresholds and counts, on stored scores."""
    rows = scores(spark, sf).select((F.col("id") % 5).alias("fold"), "label", "score")
    made = training.fold_reports(rows)
    return made.select("fold", "threshold", "tp", "fp", "tn", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("t_two_stages")
def t_two_stages(spark, sf):
    """Candidates by stage, verdict and label: the first stage sees the token's features, the second those of the rows that the first leaves open."""
    rows = dataset.folds(labelled(spark, sf), 3, ["label"], "id").persist()
    model = training.two_stages(rows, F.col("fold") == 0, rounds=ROUNDS, depth=DEPTH)
    made = training.routed(rows, model, ("label",)).groupBy("stage", "is_secret", "label").agg(F.count(F.lit(1)).alias("n")).collect()  # twelve rows at most
    rows.unpersist()
    return spark.createDataFrame(made, "stage string, is_secret boolean, label long, n long")


@query("t_importance")
def t_importance(spark, sf):
    """Every feature's importance over all candidates, its share and whether it says so much that it may be a leak. Each half of the candidates is judged by a model of the other half; all 65 features take part, those that the label is made of too."""
    vectors = training.assembled(labelled(spark, sf), keep=("id",))
    rows = dataset.folds_in_place(vectors, 2, ["label"], "id")
    models = training.side_by_side(spark, 2, lambda fold: scorers.flat(training.boosted(rows.where(F.col("fold") != fold), ROUNDS, DEPTH, 0.3)))
    plain = rows.withColumn("x", vector_to_array("features")).select("id", "fold", "label", *[F.get("x", F.lit(i)).alias(c) for i, c in enumerate(features.ORDER)])
    made = training.importance(plain, models, "id").collect()  # one row a feature
    vectors.unpersist()
    return spark.createDataFrame(made, "feature string, importance double, share double, warning boolean")


@query("t_focal")
def t_focal(spark, sf):
    """feature, weight of a linear scorer under the focal loss, over features that are scaled to a mean of 0 and a deviation of 1; the offset has no feature."""
    rows = labelled(spark, sf, COLUMNS)
    one = rows.agg(*[f(c).alias(f"{n}_{c}") for c in COLUMNS for n, f in (("m", F.avg), ("d", F.stddev_pop))]).first()
    scaled = rows.select("label", *[((F.col(c) - F.lit(one[f"m_{c}"])) / F.lit(one[f"d_{c}"] or 1.0)).alias(c) for c in COLUMNS])
    weight, offset = training.focal_fit(scaled, COLUMNS)
    return spark.createDataFrame([*zip(COLUMNS, weight.tolist(), strict=True), (None, offset)], "feature string, weight double")  # one row a feature


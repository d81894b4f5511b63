"""Curves, thresholds, metrics and acceptance of scored rows: columns label (0, 1) and score.

Curves are over distinct scores, which are grouped first, by an aggregate that combines before its shuffle. Running sums
are taken in ranges of the score, to which the totals of the ranges before are added, so no task sorts all scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultsieve.functions.constants import AGGREGATE, CALIBRATION, CATEGORY_WEIGHTS, PER_TYPE, ROUTING, STRESS

#: Ranges of scores, of about as many distinct ones, and the error of their bounds' ranks.
RANGES, ERROR = 256, 0.001


def cumulative(rows: DataFrame, ranges: int = RANGES) -> DataFrame:
    """score, p, n (positives and negatives of that score), tp, fp (of that score and higher ones), positives, negatives."""
    by = rows.groupBy("score").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
    bounds = sorted(set(by.stat.approxQuantile("score", [i / ranges for i in range(1, ranges)], ERROR)))
    by = by.withColumn("range", F.size(F.filter(F.array(*[F.lit(float(x)) for x in bounds]), lambda x: x <= F.col("score"))) if bounds else F.lit(0))
    totals = by.groupBy("range").agg(F.sum("p").alias("range_p"), F.sum("n").alias("range_n"))
    # One row for each range.
    down, whole = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    before = [F.coalesce(F.sum(f"range_{x}").over(down), F.lit(0)).alias(f"before_{x}") for x in ("p", "n")]
    totals = totals.select("range", *before, F.sum("range_p").over(whole).alias("positives"), F.sum("range_n").over(whole).alias("negatives"))
    within = Window.partitionBy("range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    made = by.select("score", "p", "n", "range", F.sum("p").over(within).alias("run_p"), F.sum("n").over(within).alias("run_n")).join(F.broadcast(totals), "range")
    return made.select("score", "p", "n", (F.col("run_p") + F.col("before_p")).alias("tp"), (F.col("run_n") + F.col("before_n")).alias("fp"), "positives", "negatives")


def curve(rows: DataFrame) -> DataFrame:
    """score, tp, fp, positives, negatives, precision, recall of the rule `at least score`, one row per distinct score. Rows without a score take no part."""
    made = cumulative(rows.where(F.col("score").isNotNull())).drop("p", "n")
    return made.withColumns({"precision": F.col("tp") / (F.col("tp") + F.col("fp")), "recall": F.when(F.col("positives") > 0, F.col("tp") / F.col("positives")).otherwise(0.0)})


def f1(precision: Column, recall: Column) -> Column:
    return 2 * precision * recall / (precision + recall + 1e-10)


def _best(value: Column, among: Column | None = None) -> Column:
    """The score of the highest value, the lowest score of equals."""
    rank = F.struct(value.alias("v"), (-F.col("score")).alias("s"))
    return -F.max(F.when(among, rank) if among is not None else rank)["s"]


def threshold(rows: DataFrame, precision: float = 0.95) -> DataFrame:
    """One row: the score of best recall at that precision, or else of best F1."""
    return curve(rows).agg(F.coalesce(_best(F.col("recall"), F.col("precision") >= precision), _best(f1(F.col("precision"), F.col("recall")))).alias("threshold"))


def dual_thresholds(rows: DataFrame, recall: float = 0.98, precision: float = 0.95) -> DataFrame:
    """One row: low (best precision at that recall), high (best recall at that precision), optimal (best F1). If low is not below high, both take their defaults."""
    made = curve(rows).agg(
        F.coalesce(_best(F.col("precision"), F.col("recall") >= recall), F.lit(0.15)).alias("low"),
        F.coalesce(_best(F.col("recall"), F.col("precision") >= precision), F.lit(0.85)).alias("high"),
        _best(f1(F.col("precision"), F.col("recall"))).alias("optimal"),
    )
    return made.select(F.when(F.col("low") >= F.col("high"), 0.15).otherwise(F.col("low")).alias("low"), F.when(F.col("low") >= F.col("high"), 0.85).otherwise(F.col("high")).alias("high"), "optimal")


def confusion(predicted: Column) -> list[Column]:
    label, yes = F.col("label") == 1, predicted
    return [F.count_if(label & yes).alias("tp"), F.count_if(~label & yes).alias("fp"), F.count_if(~label & ~yes).alias("tn"), F.count_if(label & ~yes).alias("fn")]


def metrics(rows: DataFrame, at: float = 0.5, by: list[str] | None = None) -> DataFrame:
    made = rows.groupBy(*(by or [])).agg(*confusion(F.col("score") >= at))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    made = made.withColumns({"accuracy": safe(tp + tn, tp + fp + tn + fn), "precision": safe(tp, tp + fp), "recall": safe(tp, tp + fn)})
    return made.withColumn("f1", safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def auc(rows: DataFrame) -> DataFrame:
    """One row: the chance that a positive scores above a negative, ties half; null without both."""
    by = cumulative(rows.where(F.col("score").isNotNull()))
    return by.agg((F.sum(F.col("p") * (F.col("negatives") - F.col("fp") + F.col("n") / 2)) / F.nullif(F.max("positives") * F.max("negatives"), F.lit(0))).alias("auc"))


def correlations(rows: DataFrame, columns: list[str], label: str, warn: float = 0.3) -> DataFrame:
    """feature, r (the size of its correlation with the label), warning (r above `warn`): sums and products of all columns in one pass. A feature that doesn't vary has no row."""
    one = rows.agg(*[F.abs(F.covar_pop(c, label) / F.nullif(F.stddev_pop(c) * F.stddev_pop(label), F.lit(0.0))).alias(c) for c in columns])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("r")) for c in columns]))).where("r is not null and not isnan(r)").withColumn("warning", F.col("r") > warn)


def brier(score: Column) -> Column:
    return F.avg((score - F.col("label")) * (score - F.col("label")))


def top_errors(rows: DataFrame, at: float, k: int, key: str) -> DataFrame:
    """The k false positives of highest and the k false negatives of lowest score, with all their number; long tokens are cut."""
    kind = F.when((F.col("label") == 0) & (F.col("score") >= at), "fp").when((F.col("label") == 1) & (F.col("score") < at), "fn")
    wrong = rows.withColumn("kind", kind).where("kind is not null")
    counted = wrong.groupBy("kind").agg(F.count(F.lit(1)).alias("total"))
    kinds = [wrong.where(F.col("kind") == name).orderBy(order, key).limit(k) for name, order in (("fp", F.desc("score")), ("fn", F.asc("score")))]
    return kinds[0].unionByName(kinds[1]).join(F.broadcast(counted), "kind").withColumn("token", F.when(F.length("token") > 20, F.concat(F.left("token", F.lit(20)), F.lit("..."))).otherwise(F.col("token")))


def grid(rows: DataFrame, thresholds: list[float], configs: dict[str, Column], precision: float = 0.9, recall: float = 0.9) -> DataFrame:
    """Metrics of every configuration and threshold in one pass over the rows, best first: those that reach both targets, then by F1. Thresholds become counters of the aggregate; rows are not multiplied."""
    sums = {f"{c}_{i}_{j}": F.sum(F.when((score >= t) & (F.col("label") == y), 1).otherwise(0)) for c, score in configs.items() for i, t in enumerate(thresholds) for j, y in enumerate((0, 1))}
    one = rows.agg(F.sum("label").alias("positives"), *[v.alias(k) for k, v in sums.items()])
    cells = F.array(*[F.struct(F.lit(c).alias("config"), F.lit(t).alias("threshold"), F.col(f"{c}_{i}_1").alias("tp"), F.col(f"{c}_{i}_0").alias("fp")) for c in configs for i, t in enumerate(thresholds)])
    made = one.select("positives", F.inline(cells))
    made = made.withColumns({"precision": F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0), "recall": F.when(F.col("positives") > 0, F.col("tp") / F.col("positives")).otherwise(0.0)})
    return made.withColumns({"f1": f1(F.col("precision"), F.col("recall")), "on_target": (F.col("precision") >= precision) & (F.col("recall") >= recall)}).drop("positives")


def mean_differences(rows: DataFrame, features: list[str], group: Column, k: int = 20) -> DataFrame:
    """feature, mean_a, mean_b, difference: the k features whose means differ most between rows of the group and others."""
    one = rows.agg(*[F.avg(F.when(group, F.col(f))).alias(f"a_{f}") for f in features], *[F.avg(F.when(~group, F.col(f))).alias(f"b_{f}") for f in features])
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"a_{f}").alias("mean_a"), F.col(f"b_{f}").alias("mean_b")) for f in features])
    return one.select(F.inline(cells)).withColumn("difference", F.col("mean_a") - F.col("mean_b")).orderBy(F.desc(F.abs("difference")), "feature").limit(k)


def categories(criteria: DataFrame, needed: dict[str, int] | None = None) -> DataFrame:
    """criteria (category, name, value, low, high) to one row per category: passed, total, enough (whether all of its criteria pass, or as many as `needed` says) and weight. A criterion of several rows passes if all of them do; a missing value fails."""
    passed = F.coalesce((F.col("low").isNull() | (F.col("value") >= F.col("low"))) & (F.col("high").isNull() | (F.col("value") <= F.col("high"))), F.lit(False)) & F.col("value").isNotNull()
    each = criteria.groupBy("category", "name").agg(F.bool_and(passed).alias("passed"))
    by = each.groupBy("category").agg(F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("total"))
    enough = F.col("passed") == F.col("total")
    for category, count in (needed or {}).items():
        enough = F.when(F.col("category") == category, F.col("passed") >= count).otherwise(enough)
    weight = F.element_at(F.create_map(*[F.lit(x) for pair in CATEGORY_WEIGHTS.items() for x in pair]), F.col("category"))
    return by.withColumns({"enough": enough, "weight": weight})


def acceptance(criteria: DataFrame, needed: dict[str, int] | None = None, least: float = 0.85) -> DataFrame:
    """criteria (category, name, value, low, high) to one row: weighted_score, critical_failure and decision.

    A category adds its weight times the share of its criteria that pass. GO takes a sum of `least`, and that no
    criterion of the aggregate metrics fails.
    """
    by = categories(criteria, needed)
    score = F.round(F.sum(F.col("weight") * F.col("passed") / F.col("total")), 6)
    critical = F.coalesce(F.bool_or((F.col("category") == "aggregate_metrics") & (F.col("passed") < F.col("total"))), F.lit(False))
    return by.agg(score.alias("weighted_score"), critical.alias("critical_failure")).withColumn("decision", F.when((F.col("weighted_score") >= least) & ~F.col("critical_failure"), "GO").otherwise("NO-GO"))


def release_criteria(rows: DataFrame, importance: float, at: float = 0.5, low: float = 0.15, high: float = 0.85) -> DataFrame:
    """All criteria of the five categories, as acceptance() takes them, of rows with label, score, type (of the secret), stress (the stress test that a row is of, or null) and variant (of what the stress test varies).

    One pass over the rows for all counts (by ten bins of the score for the calibration), and the curve for the area under
    it. Variances are of the recalls of a stress test's variants.
    """
    label, yes, score = F.col("label") == 1, F.col("score") >= at, F.col("score")
    n = lambda test: F.count_if(test).cast("double")
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(0.0))
    recall, precision = (lambda of: ratio(n(of & label & yes), n(of & label))), (lambda of: ratio(n(of & label & yes), n(of & yes)))
    every, whole = F.lit(True), F.count(F.lit(1)).cast("double")
    bins = lambda of: sum((F.abs(F.coalesce(F.sum(F.when(of & (F.least(F.floor(score * 10), F.lit(9)) == i), score - F.col("label"))), F.lit(0.0))) for i in range(10)), F.lit(0.0))
    sure, stress = (score < low) | (score > high), lambda name: F.col("stress") == name
    one = {
        ("aggregate_metrics", "precision"): precision(every), ("aggregate_metrics", "recall"): recall(every), ("aggregate_metrics", "f1_score"): ratio(2 * n(label & yes), n(label) + n(yes)),
        ("calibration", "ece"): ratio(bins(every), whole), ("calibration", "brier_score"): brier(score), ("calibration", "high_confidence_accuracy"): ratio(n(sure & (yes == label)), n(sure)), ("calibration", "max_feature_importance"): F.lit(float(importance)),
        ("stage_routing", "stage_a_reject_rate"): ratio(n(score < low), whole), ("stage_routing", "stage_a_accept_rate"): ratio(n(score > high), whole), ("stage_routing", "stage_b_rate"): ratio(n(~sure), whole),
        ("stage_routing", "stage_a_reject_fn_rate"): ratio(n((score < low) & label), n(score < low)), ("stage_routing", "stage_a_accept_fp_rate"): ratio(n((score > high) & ~label), n(score > high)),
    }
    for kind in PER_TYPE:
        one[kind, "recall"], one[kind, "precision"] = recall(F.col("type") == kind), precision((F.col("type") == kind))
    of = {"precision": precision, "recall": recall, "accuracy": lambda t: ratio(n(t & (yes == label)), n(t)), "stage_a_reject_rate": lambda t: ratio(n(t & (score < low)), n(t)), "ece": lambda t: ratio(bins(t), n(t))}
    for name, (metric, _, _) in STRESS.items():
        if metric in of:
            one["stress_tests", name] = of[metric](stress(name))
    names = {pair: f"m{i}" for i, pair in enumerate(one)}
    row = rows.agg(*[v.alias(names[k]) for k, v in one.items()])
    # A row for each variant, then one for each test.
    by = rows.where("stress is not null").groupBy("stress", "variant").agg(recall(every).alias("recall")).groupBy("stress").agg(F.var_pop("recall").alias("value"))
    area = cumulative(rows.where("score is not null")).agg(F.sum(F.col("p") / F.nullif(F.col("positives"), F.lit(0)) * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("value"))
    cell = lambda category, name, value, bounds: F.struct(F.lit(category).alias("category"), F.lit(name).alias("name"), value.cast("double").alias("value"), F.lit(bounds[0]).cast("double").alias("low"), F.lit(bounds[1]).cast("double").alias("high"))
    fixed = {("aggregate_metrics", k): (AGGREGATE[k], None) for k in ("precision", "recall", "f1_score")} | {("calibration", k): v for k, v in CALIBRATION.items()} | {("stage_routing", k): v for k, v in ROUTING.items()}
    cells = [cell(*k, F.col(names[k]), v) for k, v in fixed.items()]
    cells += [cell("per_type_metrics", kind, F.col(names[kind, m]), (need, None)) for kind, needs in PER_TYPE.items() for m, need in zip(("recall", "precision"), needs, strict=True)]
    cells += [cell("stress_tests", k, F.col(names["stress_tests", k]), v[1:]) for k, v in STRESS.items() if ("stress_tests", k) in names]
    made = row.select(F.inline(F.array(*cells)))
    made = made.unionByName(area.select(F.inline(F.array(cell("aggregate_metrics", "auprc", F.col("value"), (AGGREGATE["auprc"], None))))))
    for name, (metric, *bounds) in STRESS.items():
        if metric == "variance":
            made = made.unionByName(by.where(F.col("stress") == name).agg(F.max("value").alias("value")).select(F.inline(F.array(cell("stress_tests", name, F.coalesce("value", F.lit(0.0)), bounds)))))
    return made


def aggregate_criteria() -> dict[str, float]:
    return dict(AGGREGATE)

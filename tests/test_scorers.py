"""Scorers over batches, their failures, and the training life cycle on candidates of the derived corpus."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from vaultsieve.operators import dataset, features, models, scorers, training
from vaultsieve.plans import registry  # noqa: F401, I001  it imports the others in order
from vaultsieve.plans import q_train

DATA = "/root/testdata/sf0.001"
FEW = ["token_length", "token_entropy", "digit_ratio", "special_char_ratio"]


@pytest.fixture(scope="module")
def rows(spark):
    made = dataset.folds(q_train.labelled(spark, DATA), 3, ["label"], "id").cache()
    assert made.count() > 300 and 0.1 < made.agg(F.avg("label")).first()[0] < 0.9
    return made


@pytest.fixture(scope="module")
def vectors(rows):
    return VectorAssembler(inputCols=FEW, outputCol="features").transform(rows)


@pytest.mark.parametrize("forest", [False, True])
def test_flat_trees_equal_the_model(rows, forest):
    model = models.trees(FEW, rounds=7, depth=4, forest=forest).fit(rows)
    flat = scorers.flat(model)
    both = scorers.with_scores(models.scored(model, rows, "want"), {"trees": flat}, FEW)
    worst = both.agg(F.max(F.abs(F.col("scores.trees") - F.col("want"))), F.count_if(F.col("scores.trees").isNull()), F.count_if(F.size("failures") > 0)).first()
    assert worst[0] < 1e-9 and worst[1] == worst[2] == 0
    assert both.columns == [*rows.columns, "want", "scores", "failures"] and both.count() == rows.count()


def failing():
    """Scorers that fail in different ways, which travel by value."""

    def fails(matrix):
        raise RuntimeError("no such model")

    def short(matrix):
        return np.ones(max(0, len(matrix) - 1))

    def odd(matrix):
        return np.where(matrix[:, 0] % 2 == 1, np.nan, 0.25)

    return fails, short, odd


def test_failures_are_data_and_weights_scale_up(spark):
    fails, short, odd = failing()
    made = spark.createDataFrame([(i, float(i), None) for i in range(10)], "id long, a double, b double").repartition(2)
    found = scorers.with_scores(made, {"fails": fails, "short": short, "odd": odd, "blank": lambda m: m[:, 1]}, ["a", "b"])
    found = found.withColumn("p", scorers.combined({"fails": 0.6, "odd": 0.4})).withColumn("none", scorers.combined({"fails": 1.0, "short": 1.0}))
    for r in found.collect():
        assert r.scores["fails"] is None and r.failures["fails"] == "RuntimeError: no such model"
        assert r.scores["short"] is None and "scores for" in r.failures["short"]
        assert r.scores["odd"] == (None if r.id % 2 else 0.25) and r.failures.get("odd") == ("not finite" if r.id % 2 else None)
        assert r.scores["blank"] is None and r.p == (None if r.id % 2 else 0.25) and r.none is None
    assert scorers.with_scores(made.where("false"), {"odd": odd}, ["a"]).count() == 0


def test_combinations_of_three(spark):
    cases = [{"a": 0.2, "b": 0.9, "c": None}, {"a": None, "b": None, "c": None}, {"a": 0.5, "b": 0.5, "c": 0.1}, {"a": 0.9, "b": 0.1, "c": 0.5}]
    made = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, scores map<string,double>")
    w = {"a": 1.0, "b": 2.0, "c": 1.0}
    got = made.select("i", *[scorers.combined(w, how=h).alias(h) for h in ("weighted", "soft", "hard", "surest")]).orderBy("i").collect()
    assert [round(x, 6) for x in got[0][1:]] == [round(2.0 / 3, 6), 0.55, 0.0, 0.9]
    assert list(got[1][1:]) == [None] * 4
    assert [round(x, 6) for x in got[2][1:]] == [0.4, round(1.1 / 3, 6), 1.0, 0.1] and got[3].surest == 0.9


def test_one_call_from_findings_to_verdicts(spark):
    from vaultsieve.plans.q_features import candidates

    found = candidates(spark, DATA).limit(300)
    made = scorers.verdicts(found, {"fails": failing()[0], "fixed": q_train.STUMPS["length"]})
    assert made.where("p is null or is_secret is null or ml_confidence is null").count() == 0 and made.count() == 300
    lost = scorers.verdicts(found, {"fails": failing()[0]})
    assert lost.where("routing = 'unverified' and combined = confidence and is_secret is null").count() == 300
    scorers.register("lowest", lambda by: F.array_min(F.map_values("scores")))
    try:
        assert scorers.verdicts(found, {"fixed": q_train.STUMPS["length"]}, mode="lowest").where("p is not null").count() == 300
    finally:
        del scorers.MODES["lowest"]
    with pytest.raises(ValueError, match="no mode"):
        scorers.verdicts(found, {}, mode="nothing")


def test_early_stop_keeps_the_best_round(vectors):
    stopped = training.early_stopped(vectors.select("label", "features", "fold"), F.col("fold") == 0, rounds=25, depth=3, step=0.4)
    losses = [x[2] for x in stopped.losses]
    assert stopped.rounds < 25 and losses[stopped.rounds - 1] == min(losses) and len(stopped.model.roots) == stopped.rounds
    assert [x[0] for x in stopped.losses] == list(range(1, len(losses) + 1)) and stopped.losses[0][1] > stopped.losses[-1][1]


def test_folds_are_fitted_on_the_others_and_refitted(rows):
    made = training.cross_validated(rows.select("id", "fold", "label", *FEW), 3, "id", FEW, rounds=3, depth=3)
    folds = {r.fold: r for r in made.folds.collect()}
    assert set(folds) == {0, 1, 2} and made.threshold == pytest.approx(sum(r.threshold for r in folds.values()) / 3)
    sizes = {r.fold: r["count"] for r in rows.groupBy("fold").count().collect()}
    scores = {r.id: r for r in made.scores.collect()}
    assert len(scores) == sum(sizes.values())
    for fold, r in folds.items():
        here = [x for x in scores.values() if x.fold == fold]
        yes = [x for x in here if x.score >= r.threshold]
        assert len(here) == sizes[fold] and (r.tp, r.fp) == (sum(x.label for x in yes), sum(1 - x.label for x in yes)) and r.tp + r.fp + r.tn + r.fn == len(here)
    # A fold's scores are those of a model of the other folds.
    part, _ = training.balance(training.assembled(rows.where("fold != 1"), FEW))
    want = training.boosted(part, 3, 3, 0.1, weight=True).transform(training.assembled(rows.where("fold = 1"), FEW, ("id",))).select("id", vector_to_array("probability")[1].alias("p"))
    assert max(abs(r.p - scores[r.id].score) for r in want.collect()) < 1e-9
    assert len(made.model.roots) == 3


def test_fold_reports_at_their_own_thresholds(spark):
    made = [(f, int(i % 3 == f), i / 10) for f in (0, 1) for i in range(10)] + [(2, 1, 0.5), (2, 0, 0.5), (2, 1, None)]
    found = {r.fold: r for r in training.fold_reports(spark.createDataFrame(made, "fold long, label long, score double"), 0.5).collect()}
    for f in (0, 1):
        best = None
        for t in sorted({s for g, _, s in made if g == f}):
            yes = [y for g, y, s in made if g == f and s >= t]
            recall = sum(yes) / sum(y for g, y, _ in made if g == f)
            if sum(yes) / len(yes) >= 0.5 and (best is None or recall > best[0]):
                best = (recall, t)
        assert best is None or (found[f].recall, found[f].threshold) == pytest.approx(best)
    assert (found[2].tp, found[2].fp, found[2].tn, found[2].fn) == (1, 1, 0, 0)


def test_two_stages_route_as_their_scores_say(rows):
    model = training.two_stages(rows, F.col("fold") == 0, rounds=3, depth=3, least=20)
    assert model.first.feature.max() < len(features.TOKEN_ONLY) and model.low < model.high
    found = {r.id: r for r in training.routed(rows, model, ("id", "label")).collect()}
    plain = rows.select("id", *features.ORDER).toPandas().set_index("id")
    a = model.first(plain.to_numpy(float)[:, : len(features.TOKEN_ONLY)])
    b = model.second(plain.to_numpy(float))
    for i, x, y in zip(plain.index, a, b, strict=True):
        want = ("A_reject", x, False) if x < model.low else ("A_accept", x, True) if x > model.high else ("B", y, y >= model.cut)
        assert found[i].stage == want[0] and found[i].score == pytest.approx(want[1]) and found[i].is_secret == want[2]


def test_importance_finds_the_leak(spark):
    made = spark.range(400).selectExpr("id", "cast(id % 2 as int) as label", "cast(id % 2 as double) as leak", "cast(id % 7 as double) as noise", "1.0D as flat").coalesce(1)
    found = {r.feature: r for r in training.importance(made, lambda m: np.where(m[:, 0] > 0.5, 0.9, 0.1), "id", ["leak", "noise", "flat"]).collect()}
    assert found["leak"].warning and found["leak"].share == 1.0 and found["noise"].importance == found["flat"].importance == 0.0
    none = training.importance(made, lambda m: np.full(len(m), 0.5), "id", ["leak", "noise"]).collect()
    assert all(r.share == 0 and not r.warning for r in none)
    assert training.importance(made.where("false"), lambda m: m[:, 0], "id", ["leak"]).count() == 0


def test_focal_slopes_and_curvatures():
    z, y, e = np.linspace(-6, 6, 41), np.arange(41) % 2, 1e-5
    for gamma, alpha in ((2.0, 0.25), (1.0, 0.5), (0.0, 0.5)):
        up, here, down = (training.focal(z + d, y, gamma, alpha) for d in (e, 0, -e))
        assert np.allclose((up[0] - down[0]) / 2 / e, here[1], atol=1e-8) and np.allclose((up[1] - down[1]) / 2 / e, here[2], atol=1e-8)


@pytest.mark.parametrize("gamma", [2.0, 0.0])
def test_focal_fit_equals_slow_descent(spark, gamma):
    r = np.random.default_rng(4)
    x = r.normal(size=(300, 3))
    y = (x @ [1.0, -2.0, 0.5] + r.normal(size=300) > 0.3).astype(int)
    made = spark.createDataFrame([(int(b), *map(float, a)) for a, b in zip(x, y, strict=True)], "label int, a double, b double, c double").repartition(3)
    weight, offset = training.focal_fit(made, ["a", "b", "c"], gamma, 0.25)
    w, full = np.zeros(4), np.column_stack([x, np.ones(300)])
    for _ in range(60_000):
        w -= 1.5 * (training.focal(full @ w, y, gamma, 0.25)[1] @ full + np.array([1, 1, 1, 1e-9]) * w) / 300
    assert np.abs(np.append(weight, offset) - w).max() < 1e-6
    scored = scorers.with_scores(made, {"focal": training.Linear(weight, offset)}, ["a", "b", "c"])
    assert scored.agg(F.avg(((F.col("scores.focal") >= 0.5).cast("int") == F.col("label")).cast("double"))).first()[0] > 0.8

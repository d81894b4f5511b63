"""Folds without a shuffle, and cross-validation over different vectors only."""

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from vaultsieve.operators import dataset, training
from vaultsieve.plans import registry  # noqa: I001  it imports the others in order
from vaultsieve.plans import q_train

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("n", "k"), [(1000, 3), (1001, 7), (5, 8), (0, 3)])
def test_folds_in_place_equal_folds(spark, n, k):
    rows = spark.range(n).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 11 % 2).alias("label"))
    made = dataset.folds_in_place(rows, k, ["label"], "key")
    order = lambda x: sorted(map(repr, x.select("key", "label", "fold").collect()))
    assert order(made) == order(dataset.folds(rows, k, ["label"], "key"))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


@pytest.mark.parametrize("pieces", [100_000, 50])
def test_equal_rows_count_as_often_as_they_are(spark, monkeypatch, pieces):
    """pieces: as many as there are rows, or fewer, so that one stands for several."""
    monkeypatch.setattr(training, "PIECES", pieces)
    rows = spark.range(900).selectExpr("concat('k', id) as id", "id % 3 as fold", "cast(pmod(xxhash64(id), 100) < 5 + 13 * pmod(id, 5) + 7 * pmod(id, 4) as long) as label", "cast(id % 5 as double) as a", "cast(id % 4 as double) as b").persist()
    made = training.cross_validated(rows, 3, "id", ["a", "b"], rounds=3, depth=3)
    scores = {r.id: r.score for r in made.scores.collect()}
    for fold in range(3):
        part, _ = training.balance(training.assembled(rows.where(F.col("fold") != fold), ["a", "b"]))
        want = training.boosted(part, 3, 3, 0.1, weight=True).transform(training.assembled(rows.where(F.col("fold") == fold), ["a", "b"], ("id",)))
        assert max(abs(r.p - scores[r.id]) for r in want.select("id", vector_to_array("probability")[1].alias("p")).collect()) < 1e-9
    want = {r.fold: r for r in training.fold_reports(made.scores).collect()}
    assert {r.fold: r for r in made.folds.collect()} == want
    total = made.total.first()
    assert total.fold is None and total.threshold == made.threshold and total.tp + total.fn == rows.where("label = 1").count() and total.fp + total.tn == rows.where("label = 0").count()


def test_candidates_features_are_taken_once(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(q_train, "labelled", lambda *a, f=q_train.labelled: calls.append(f(*a)) or calls[-1])
    made = registry.QUERIES["t_cross_validated"](spark, DATA)
    # What is returned are local rows: nothing is taken from candidates again.
    assert len(calls) == 1 and "InMemory" not in (plan := made._jdf.queryExecution().executedPlan().toString()) and "parquet" not in plan.lower()
    rows = made.orderBy("fold").collect()
    assert [r.fold for r in rows] == [None, 0, 1, 2] and rows[0].threshold == pytest.approx(sum(r.threshold for r in rows[1:]) / 3)
    assert rows[0].tp + rows[0].fp + rows[0].tn + rows[0].fn == calls[0].count() == sum(r.tp + r.fp + r.tn + r.fn for r in rows[1:])

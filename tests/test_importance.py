"""Importance over all rows and all features, however rows are dealt to tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vaultsieve.operators import features, training
from vaultsieve.plans import registry  # noqa: I001  it imports the others in order
from vaultsieve.plans import q_train

DATA = "/root/testdata/sf0.001"


def by(place):
    """A scorer that travels by value."""
    return lambda matrix: np.where(matrix[:, place] > 0.5, 0.9, 0.1)


def test_values_are_exchanged_over_all_rows(spark):
    """A feature that is the same within each task, and a table that is dealt otherwise."""
    made = spark.range(400).selectExpr("id", "cast(id >= 200 as int) as label", "cast(id >= 200 as double) as site", "cast(id % 7 as double) as noise")
    sorted_, mixed = made.repartitionByRange(2, "site"), made.repartition(5, "id")
    assert {r.n for r in sorted_.groupBy(F.spark_partition_id()).agg(F.countDistinct("site").alias("n")).collect()} == {1}
    one, two = ({r.feature: r.importance for r in training.importance(x, by(0), "id", ["site", "noise"]).collect()} for x in (sorted_, mixed))
    assert one["site"] == pytest.approx(two["site"]) and one["noise"] == two["noise"] == 0
    # Each row takes the value of the row before it in the digests' order, the first that of the last.
    order = [r[:2] for r in made.select("label", "site", F.xxhash64("id").alias("h")).withColumn("range", F.shiftrightunsigned("h", 56)).orderBy("range", "h").collect()]
    loss = lambda x, y: -np.log(np.where(np.array(y) > 0, p := np.where(np.array(x) > 0.5, 0.9, 0.1), 1 - p)).mean()
    label, site = zip(*order, strict=True)
    assert one["site"] == pytest.approx(loss(np.roll(site, 1), label) - loss(site, label))


def test_folds_have_their_own_scorers(spark):
    made = spark.range(300).selectExpr("id", "id % 2 as fold", "cast(id % 3 = 0 as int) as label", "cast(id % 3 = 0 as double) as a", "cast(id % 3 = 0 as double) as b")
    found = {r.feature: r.importance for r in training.importance(made, [by(0), by(1)], "id", ["a", "b"]).collect()}
    assert found["a"] > 0 and found["b"] > 0


def test_all_features_and_all_candidates_take_part(spark, monkeypatch):
    seen = {}

    def spied(rows, model, key, columns=features.ORDER, dominance=0.8, f=training.importance):
        seen["rows"] = rows.select("id").distinct().count()
        return f(rows, model, key, columns, dominance)

    monkeypatch.setattr(training, "importance", spied)
    found = registry.QUERIES["t_importance"](spark, DATA).collect()
    assert {r.feature for r in found} == set(features.ORDER) and seen["rows"] == q_train.labelled(spark, DATA).count()
    assert sum(r.share for r in found) == pytest.approx(1) and any(r.importance > 0 for r in found)

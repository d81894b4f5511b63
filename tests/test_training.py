import pytest
from pyspark.sql import functions as F

from vaultsieve.operators import dataset, evaluation, features, generate, models, scoring


@pytest.fixture(scope="module")
def records(spark):
    return generate.records(spark, 2000).cache()


def test_generated_records_have_shares_forms_and_repeat(spark, records):
    share = records.agg(F.avg("label")).first()[0]
    assert 0.35 < share < 0.45
    assert records.where(~F.col("line_content").contains(F.col("token"))).count() == 0
    again = generate.records(spark, 2000, partitions=7)
    assert records.exceptAll(again).count() == 0 and records.select("id").distinct().count() == 2000
    assert {r[0] for r in records.select("secret_type").distinct().collect()} == {None, *generate.POSITIVES}


def test_splits_are_disjoint_and_truncated(records):
    parts = dataset.split(records, {"train": 0.7, "val": 0.15, "test": 0.15}, ["label"], "id")
    assert parts.count() == 2000
    by = {(r.label, r.split): r["count"] for r in parts.groupBy("label", "split").count().collect()}
    for label in (0, 1):
        n = sum(v for (k, _), v in by.items() if k == label)
        assert by[label, "train"] == int(n * 0.7) and by[label, "train"] + by[label, "val"] == int(n * (0.7 + 0.15))


def test_columns_of_any_name_pass_a_split(records):
    odd = records.withColumns({"n": F.lit(1), "place": F.lit(1), "prefix": F.lit("x"), "before": F.lit(0)})
    assert dataset.folds(odd, 3, ["label"], "id").select("n", "place", "prefix", "before", "fold").count() == 2000


def test_folds_differ_by_one_at_most(records):
    for label in (0, 1):
        sizes = [r["count"] for r in dataset.folds(records, 7, ["label"], "id").where(F.col("label") == label).groupBy("fold").count().collect()]
        assert len(sizes) == 7 and max(sizes) - min(sizes) <= 1


def test_noise_spares_known_tokens(records):
    flipped = dataset.noisy(records, "id", 0.3).where("flipped")
    assert flipped.count() > 100 and flipped.where(F.col("token").startswith("AKIA")).count() == 0


def test_training_beats_chance_and_calibrates(spark, records):
    rows = records.withColumnRenamed("line_content", "line").withColumnsRenamed({"context_before": "before", "context_after": "after", "file_path": "file"}).withColumn("type", F.lit("ENTROPY_CANDIDATE"))
    rows = features.with_features(rows.select("id", "label", "token", "line", "before", "after", "file", "type"), record=True)
    parts = dataset.split(rows, {"train": 0.6, "cal": 0.2, "test": 0.2}, ["label"], "id").cache()
    model = models.trees(rounds=5, depth=3).fit(parts.where("split = 'train'"))
    a, b = models.platt(models.scored(model, parts.where("split = 'cal'")))
    assert a < 0
    test = models.scored(model, parts.where("split = 'test'")).withColumn("score", scoring.platt(F.col("score"), a, b))
    assert evaluation.auc(test).first()[0] > 0.9
    assert len(models.importances(model, k=5)) == 5


def test_thresholds_collapse_ties_and_fall_back(spark):
    rows = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1)], "label long, score double")
    assert [tuple(r)[:3] for r in evaluation.curve(rows).orderBy("score").collect()] == [(0.1, 2, 2), (0.5, 2, 1), (0.9, 1, 1)]
    assert evaluation.auc(rows).first()[0] == pytest.approx(0.625)
    assert tuple(evaluation.dual_thresholds(rows).first()) == (0.5, 0.85, 0.5)


def test_acceptance(spark):
    rows = [("aggregate_metrics", "p", 0.9, 0.88, None), ("per_type_metrics", "a", 0.1, 0.5, None), ("per_type_metrics", "b", 0.9, 0.5, None), ("stress_tests", "c", 0.9, 0.5, None), ("calibration", "d", 0.05, None, 0.1), ("stage_routing", "e", 0.3, 0.2, 0.45)]
    table = spark.createDataFrame(rows, "category string, name string, value double, low double, high double")
    # A category counts by the share of its criteria that pass: half of the types here.
    assert tuple(evaluation.acceptance(table).first()) == (0.875, False, "GO")
    assert tuple(evaluation.acceptance(table, least=0.9).first())[2] == "NO-GO"
    by = {r.category: r for r in evaluation.categories(table).collect()}
    assert not by["per_type_metrics"].enough and by["per_type_metrics"].passed == 1 and by["stress_tests"].enough
    assert {r.category: r.enough for r in evaluation.categories(table, {"per_type_metrics": 1}).collect()}["per_type_metrics"]
    worse = table.withColumn("value", F.when(F.col("name") == "p", 0.5).otherwise(F.col("value")))
    assert evaluation.acceptance(worse, {"per_type_metrics": 1}, least=0.5).first().decision == "NO-GO"
    both = spark.createDataFrame([("per_type_metrics", "a", 0.9, 0.8, None), ("per_type_metrics", "a", 0.7, 0.8, None), ("per_type_metrics", "b", None, 0.8, None)], "category string, name string, value double, low double, high double")
    assert tuple(evaluation.categories(both).first())[1:3] == (0, 2)


def test_splits_that_a_stratum_leaves_empty_stop_it(spark):
    ratios = {"train": 0.65, "val": 0.1, "cal": 0.1, "test": 0.15}
    rows = spark.createDataFrame([(i, i % 2, None if i < 5 else "llm") for i in range(400)], "id long, label int, source string")
    with pytest.raises(ValueError, match=r"Stratum '0_unknown' \(3 records\) produced an empty 'cal' split"):
        dataset.checked_split(rows, ratios, ["label", "source"], "id")
    assert dataset.checked_split(rows.where("source is not null"), ratios, ["label", "source"], "id").groupBy("label", "source", "split").count().count() == 8
    with pytest.raises(ValueError, match="Ratios sum"):
        dataset.checked_split(rows, {"train": 0.8, "val": 0.2, "test": 0.0}, ["label"], "id")


def test_messages_on_types(spark):
    lines = ['{"token": 5, "line_content": "l", "context_before": "b", "context_after": [], "label": 1}', '{"token": "t", "line_content": null, "context_before": [], "context_after": {}, "label": 1.0}', '{"token": "t", "line_content": "l", "context_before": [1], "context_after": [], "label": true}', "{}", "[]", "{", "", None, '{"token": "t", "line_content": "l", "context_before": [], "context_after": [], "label": 2}']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, t string")
    found = {r.i: r.e for r in rows.select("i", dataset.text_errors(F.col("t"), F.col("i")).alias("e")).collect()}
    assert found[0] == ["Line 0: 'token' must be a string", "Line 0: 'context_before' must be a list"]
    assert found[1] == ["Line 1: 'line_content' must be a string", "Line 1: 'context_after' must be a list", "Line 1: 'label' must be 0 or 1"]
    assert found[2] == [] and len(found[3]) == 5 and all("Missing required field" in x for x in found[3])
    assert all(found[i] == [f"Line {i}: not a JSON object"] for i in (4, 5, 6, 7)) and found[8] == ["Line 8: 'label' must be 0 or 1"]


def test_two_stages_cross_validation_and_averages(spark, records):
    rows = records.limit(600).withColumnRenamed("line_content", "line").withColumnsRenamed({"context_before": "before", "context_after": "after", "file_path": "file"}).withColumn("type", F.lit("ENTROPY_CANDIDATE"))
    rows = features.with_features(rows.select("id", "label", "token", "line", "before", "after", "file", "type"), record=True)
    parts = dataset.folds(rows, 2, ["label"], "id").cache()
    folds = models.cross_validated(parts, 2, rounds=2).orderBy("fold").collect()
    assert [r.fold for r in folds] == [0, 1] and all(r.f1 > 0.7 and 0 <= r.threshold <= 1 for r in folds)
    first, second = models.two_stages(parts, rounds=2)
    both = models.average([second, models.trees(rounds=5, depth=3, forest=True).fit(parts)], parts)
    assert evaluation.auc(both).first()[0] > 0.9 and set(both.columns) == {*parts.columns, "score"}
    routed = scoring.lazy_two_stage(models.scored(first, parts, "score_a"), lambda part: models.scored(second, part, "score_b"))
    assert routed.count() == 600 and {r[0] for r in routed.select("stage").distinct().collect()} <= {"A", "B"}

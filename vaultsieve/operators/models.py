"""Training and using classifiers with Spark ML: boosted trees, calibration, two stages, cross-validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultsieve.operators import evaluation
from vaultsieve.operators.features import ORDER, TOKEN_ONLY


def trees(columns: Sequence[str] = ORDER, rounds: int = 40, depth: int = 6, step: float = 0.1, forest: bool = False, weight: str | None = None) -> Pipeline:
    """An unfitted scorer over feature columns."""
    more = {"weightCol": weight} if weight else {}
    model = RandomForestClassifier(labelCol="label", numTrees=rounds, maxDepth=depth, seed=42, **more) if forest else GBTClassifier(labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=step, seed=42, **more)
    return Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="features"), model])


def scored(model: PipelineModel, rows: DataFrame, name: str = "score") -> DataFrame:
    drop = [c for c in ("features", "rawPrediction", "probability", "prediction") if c not in rows.columns]
    return model.transform(rows).withColumn(name, vector_to_array("probability")[1]).drop(*drop)


def average(models: Sequence[PipelineModel], rows: DataFrame) -> DataFrame:
    for i, model in enumerate(models):
        rows = scored(model, rows, f"score_{i}")
    names = [f"score_{i}" for i in range(len(models))]
    return rows.withColumn("score", sum((F.col(n) for n in names[1:]), F.col(names[0])) / len(names)).drop(*names)


def platt(rows: DataFrame) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(a * score + b)), fitted on label and score."""
    pipe = Pipeline(stages=[VectorAssembler(inputCols=["score"], outputCol="one"), LogisticRegression(featuresCol="one", labelCol="label")]).fit(rows.select("label", "score"))
    fitted = pipe.stages[-1]
    return -float(fitted.coefficients[0]), -float(fitted.intercept)


def importances(model: PipelineModel, columns: Sequence[str] = ORDER, k: int = 20) -> list[tuple[str, float]]:
    """The k features of most importance: as many numbers as there are features."""
    found = sorted(zip(columns, model.stages[-1].featureImportances.toArray().tolist(), strict=True), key=lambda x: -x[1])
    return found[:k]


def two_stages(rows: DataFrame, low: float = 0.15, high: float = 0.85, least: int = 100, rounds: int = 20) -> tuple[PipelineModel, PipelineModel]:
    """A first stage on token features, and a second on all features of the rows that the first leaves open (of all rows, if those are few)."""
    first = trees(TOKEN_ONLY, rounds).fit(rows)
    open_rows = scored(first, rows, "score_a").where(F.col("score_a").between(low, high)).drop("score_a")
    return first, trees(ORDER, rounds).fit(open_rows if open_rows.count() >= least else rows)


def cross_validated(rows: DataFrame, k: int, columns: Sequence[str] = ORDER, rounds: int = 10) -> DataFrame:
    """fold, threshold, precision, recall, f1 of each of the k folds (column fold), each scored by a model of the others."""
    out = None
    for fold in range(k):
        model = trees(columns, rounds).fit(rows.where(F.col("fold") != fold))
        part = scored(model, rows.where(F.col("fold") == fold)).select("label", "score")
        at = float(evaluation.threshold(part).first()[0])
        made = part.agg(*evaluation.confusion(F.col("score") >= at))
        made = made.select(F.lit(fold).alias("fold"), F.lit(at).alias("threshold"), (F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))).alias("precision"), (F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))).alias("recall"))
        out = made if out is None else out.unionByName(made)
    return out.withColumn("f1", evaluation.f1(F.col("precision"), F.col("recall")))

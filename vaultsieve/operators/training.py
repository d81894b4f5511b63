"""The training life cycle over labelled feature rows: early stop, folds side by side and a refit, two stages, permutation importance, and a fit of the focal loss.

Rows have the columns label (0, 1), the features, and those named in each function. What comes to the driver is the
size of a model or of a table of rounds, folds or features, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vaultsieve.operators import evaluation, scorers
from vaultsieve.operators.features import ORDER, TOKEN_ONLY
from vaultsieve.sources.package import ship

A = TypeVar("A")
VALIDATING = "_validating"


def assembled(rows: DataFrame, columns: Sequence[str] = ORDER, keep: Sequence[str] = ()) -> DataFrame:
    """label, the columns to keep, and one vector of all features; kept in memory, from which lost parts are made anew."""
    made = VectorAssembler(inputCols=list(columns), outputCol="features").transform(rows)
    return made.select(F.col("label").cast("double").alias("label"), *keep, "features").persist()


def side_by_side(session: SparkSession, count: int, work: Callable[[int], A]) -> list[A]:
    """work(0) to work(count - 1), whose jobs share the cluster."""
    with ThreadPool(max(1, count)) as pool:
        return pool.map(inheritable_thread_target(session)(work), range(count))


def balance(rows: DataFrame, count: Column | None = None) -> tuple[DataFrame, float]:
    """rows with `weight`: positives count as often as negatives outnumber them. count: how many rows a row stands for."""
    count = F.lit(1) if count is None else count
    one = rows.agg(F.sum(F.col("label") * count).alias("p"), F.sum(count).alias("n")).first()
    times = (one["n"] - one["p"]) / one["p"] if one["p"] else 1.0
    return rows.withColumn("weight", F.when(F.col("label") == 1, times).otherwise(1.0) * count), times


def boosted(rows: DataFrame, rounds: int, depth: int, step: float, weight: bool = False, vector: str = "features", **more):
    weights = {"weightCol": "weight"} if weight else {}
    return GBTClassifier(featuresCol=vector, labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=step, seed=42, **weights, **more).fit(rows)


# Early stop.


@dataclass
class Stopped:
    """A model of its best rounds, and for each round the loss on rows that it learned from and on those that it didn't."""

    model: scorers.Flat
    rounds: int
    losses: list[tuple[int, float, float]]


def early_stopped(vectors: DataFrame, validating: Column, rounds: int = 500, depth: int = 6, step: float = 0.05, tolerance: float = 0.0) -> Stopped:
    """Boosted trees that stop growing when the rows under `validating`, which they don't learn from, gain less than the tolerance by a round. The model is cut to the round of the least loss there, the first of equals."""
    rows = vectors.withColumn(VALIDATING, validating)
    model = boosted(rows, rounds, depth, step, validationIndicatorCol=VALIDATING, validationTol=tolerance)
    by = [model.evaluateEachIteration(rows.where(F.col(VALIDATING) == side)) for side in (False, True)]
    losses = [(i + 1, float(a), float(b)) for i, (a, b) in enumerate(zip(*by, strict=True))]
    best = min(losses, key=lambda x: (x[2], x[0]))[0]
    return Stopped(scorers.flat(model).first(best), best, losses)


# Cross-validation.


def fold_reports(scored: DataFrame, precision: float = 0.95, count: Column | None = None) -> DataFrame:
    """fold, threshold, tp, fp, tn, fn, precision, recall, f1 of (fold, label, score) rows: each fold at its own threshold, of best recall at that precision or else of best F1 (the lowest of equals). count: how many rows a row stands for.

    All folds in one go: counts by fold and score, then running sums within each fold.
    """
    count = F.lit(1) if count is None else count
    by = scored.where("score is not null").groupBy("fold", "score").agg(F.sum(F.col("label") * count).cast("long").alias("p"), F.sum(count).cast("long").alias("n"))
    down = Window.partitionBy("fold").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    made = by.select("fold", "score", F.sum("p").over(down).alias("tp"), F.sum("n").over(down).alias("yes"))
    whole = by.groupBy("fold").agg(F.sum("p").alias("positives"), F.sum("n").alias("rows"))
    made = made.join(F.broadcast(whole), "fold")
    made = made.withColumns({"precision": F.col("tp") / F.col("yes"), "recall": F.when(F.col("positives") > 0, F.col("tp") / F.col("positives")).otherwise(0.0)})
    made = made.withColumn("f1", evaluation.f1(F.col("precision"), F.col("recall")))
    row = F.struct(F.col("score").alias("threshold"), F.col("tp"), (F.col("yes") - F.col("tp")).alias("fp"), (F.col("rows") - F.col("positives") - F.col("yes") + F.col("tp")).alias("tn"), (F.col("positives") - F.col("tp")).alias("fn"), "precision", "recall", "f1")
    rank = lambda v: F.struct(v.alias("v"), (-F.col("score")).alias("s"), row.alias("row"))
    best = made.groupBy("fold").agg(F.coalesce(F.max(F.when(F.col("precision") >= precision, rank(F.col("recall")))), F.max(rank(F.col("f1")))).alias("best"))
    return best.select("fold", "best.row.*")


@dataclass
class CrossValidated:
    """A model of all rows, the mean of the folds' thresholds, the folds' reports, the report of that model at that threshold on all rows (fold null), and every row's score by the model that didn't see it, which is taken when it is asked for."""

    model: scorers.Flat
    threshold: float
    folds: DataFrame
    total: DataFrame
    scores: DataFrame


#: Parts, about, that all rows are cut into where many are equal, and rows of a task that fits.
PIECES, ROWS_A_TASK = 100_000, 50_000


def cross_validated(rows: DataFrame, k: int, key: str, columns: Sequence[str] = ORDER, rounds: int = 100, depth: int = 6, step: float = 0.1, precision: float = 0.95) -> CrossValidated:
    """k folds (column fold, 0 to k - 1), fitted side by side over one table of vectors that is kept in memory, each with its own class balance; then a fit of all rows.

    Rows of one label and vector are one row with their number in each fold, so that rows are read once and what is fitted
    and scored grows with the different ones.
    """
    spark = rows.sparkSession
    ship(spark)
    here = [F.count_if(F.col("fold") == i) for i in range(k)]
    vectors = assembled(rows.groupBy("label", *columns).agg(F.array(*here).alias("n")), columns, ("n",))
    whole = F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)
    size = vectors.agg(F.count(F.lit(1)).alias("different"), F.coalesce(F.sum(whole), F.lit(0)).alias("rows")).first()
    # Spark ML looks for cuts among a sample of its rows, so one that stands for many goes as several, and as each of its rows where these are few.
    most = max(1, size["rows"] // PIECES)
    tasks = max(spark.sparkContext.defaultParallelism, (size["different"] + size["rows"] // most) // ROWS_A_TASK)
    dealt = vectors.coalesce(tasks)

    def fitted(fold: int):
        count = whole - (F.get("n", F.lit(fold)) if fold < k else F.lit(0))
        part, _ = balance(dealt.withColumn("count", count).where("count > 0"), F.col("count"))
        pieces = F.ceil(F.col("count") / most).cast("int")
        part = part.select("label", "features", (F.col("weight") / pieces).alias("weight"), F.explode(F.array_repeat(F.lit(0), pieces)).alias("piece")).drop("piece")
        return scorers.flat(boosted(part, rounds, depth, step, weight=True))

    *folds, model = side_by_side(spark, k + 1, fitted)
    # A row for each fold, label and different score; fold k is all rows by the last model.
    by = scored_groups(dealt, [*folds, model]).groupBy("fold", "label", "score").agg(F.sum("n").alias("n")).persist()
    reports = fold_reports(by.where(F.col("fold") < k), precision, F.col("n"))
    table = spark.createDataFrame(reports.orderBy("fold").collect(), reports.schema)  # one row a fold
    threshold = float(table.agg(F.avg("threshold")).first()[0] or 0.5)
    n = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    label, yes = F.col("label") == 1, F.col("score") >= threshold
    total = by.where(F.col("fold") == k).agg(F.lit(threshold).alias("threshold"), n(label & yes).alias("tp"), n(~label & yes).alias("fp"), n(~label & ~yes).alias("tn"), n(label & ~yes).alias("fn"))
    ratio = lambda other: F.col("tp") / F.greatest(F.col("tp") + F.col(other), F.lit(1))
    total = total.withColumns({"precision": ratio("fp"), "recall": ratio("fn")}).withColumn("f1", evaluation.f1(F.col("precision"), F.col("recall"))).select(F.lit(None).cast("long").alias("fold"), "*")
    total = spark.createDataFrame(total.collect(), total.schema)
    by.unpersist()
    vectors.unpersist()
    single = VectorAssembler(inputCols=list(columns), outputCol="features").transform(rows).select(F.col("label").cast("double").alias("label"), key, "fold", "features")
    return CrossValidated(model, threshold, table, total, scored_by(single, folds, key))


def scored_groups(vectors: DataFrame, models: Sequence[scorers.Scorer]) -> DataFrame:
    """fold, label, score, n: of vectors with their numbers by fold (n), those of each fold by its model, and all by the last model as a fold of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            label, count, matrix = batch.column(0).to_numpy(), *(np.stack(batch.column(i).to_numpy(zero_copy_only=False)) for i in (1, 2))
            for i, model in enumerate(models):
                n = count[:, i] if i < len(models) - 1 else count.sum(axis=1)
                if len(at := np.flatnonzero(n)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i)), pa.array(label[at]), pa.array(model(matrix[at])), pa.array(n[at])], names=["fold", "label", "score", "n"])

    rows = vectors.select(F.col("label").cast("long").alias("label"), "n", vector_to_array("features").alias("x"))
    return rows.mapInArrow(run, "fold long, label long, score double, n long")


def scored_by(vectors: DataFrame, folds: Sequence[scorers.Scorer], key: str) -> DataFrame:
    """key, fold, label, score: each row by its fold's scorer."""
    kind = dict(vectors.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold, score = batch.column(1).to_numpy(), np.full(batch.num_rows, np.nan)
            matrix = np.stack(batch.column(3).to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros((0, 0))
            for i, scorer in enumerate(folds):
                if (here := fold == i).any():
                    score[here] = scorer(matrix[here])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(score)], names=[key, "fold", "label", "score"])

    rows = vectors.select(key, F.col("fold").cast("long").alias("fold"), F.col("label").cast("long").alias("label"), vector_to_array("features").alias("x"))
    return rows.mapInArrow(run, f"`{key}` {kind}, fold long, label long, score double")


# Two stages.


@dataclass
class TwoStages:
    """A first scorer of token features with its bounds, and a second one of all features, for the rows between them, with its cut."""

    first: scorers.Flat
    second: scorers.Flat
    low: float
    high: float
    cut: float
    open_rows: int

    def __call__(self, matrix: np.ndarray) -> np.ndarray:
        """stage (0 rejects, 1 accepts, 2: the second) and score of each row, as one number: 2 * stage + score would mix them, so two columns."""
        a = self.first(matrix[:, : len(TOKEN_ONLY)])
        open_ = (a >= self.low) & (a <= self.high)
        score = a.copy()
        if open_.any():
            score[open_] = self.second(matrix[open_])
        return np.stack([np.where(open_, 2, (a > self.high).astype(int)), score], axis=1)


def two_stages(rows: DataFrame, validating: Column, rounds: int = 20, depth: int = 5, step: float = 0.1, least: int = 100, recall: float = 0.98, precision: float = 0.95) -> TwoStages:
    """Both stages over one assembled vector, of which the first sees a slice. The bounds come from rows under `validating`, which neither stage learns from; the second stage learns from rows between them, or from all if those are fewer than `least`, and so does its cut."""
    ship(rows.sparkSession)
    vectors = assembled(rows.withColumn(VALIDATING, validating), ORDER, (VALIDATING,))
    sliced = VectorSlicer(inputCol="features", outputCol="token_features", indices=list(range(len(TOKEN_ONLY)))).transform(vectors)
    first = boosted(sliced.where(~F.col(VALIDATING)), rounds, depth, step, vector="token_features")
    score = vector_to_array("probability")[1].alias("score")
    seen = first.transform(sliced).select("label", VALIDATING, "features", score).persist()
    bounds = evaluation.dual_thresholds(seen.where(VALIDATING).select(F.col("label").cast("long").alias("label"), "score"), recall, precision).first()
    between = seen.where(F.col("score").between(bounds["low"], bounds["high"]))
    sizes = between.groupBy(VALIDATING).count().collect()
    enough = {r[VALIDATING]: r["count"] >= least for r in sizes}
    learn = (between if enough.get(False) else seen).where(~F.col(VALIDATING)).select("label", "features")
    second = boosted(learn, rounds, depth, step)
    judge = (between if enough.get(True) else seen).where(VALIDATING).drop("score")
    cut = evaluation.threshold(second.transform(judge).select(F.col("label").cast("long").alias("label"), score), precision).first()[0]
    made = TwoStages(scorers.flat(first), scorers.flat(second), float(bounds["low"]), float(bounds["high"]), float(cut if cut is not None else 0.35), sum(r["count"] for r in sizes))
    seen.unpersist()
    vectors.unpersist()
    return made


def routed(rows: DataFrame, model: TwoStages, keep: Sequence[str]) -> DataFrame:
    """The columns to keep, stage (A_reject, A_accept, B), score, is_secret: one pass, in which the second scorer sees the open rows of each batch alone."""
    ship(rows.sparkSession)
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = np.column_stack([batch.column(len(keep) + i).to_numpy(zero_copy_only=False) for i in range(len(ORDER))]).astype(float)
            found = model(matrix)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found[:, 0].astype(np.int32)), pa.array(found[:, 1])], names=[*keep, "stage", "score"])

    sent = rows.select(*keep, *[F.col(c).cast("double").alias(f"feature {i}") for i, c in enumerate(ORDER)])
    out = sent.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "stage int, score double"]))
    name = F.get(F.array(F.lit("A_reject"), F.lit("A_accept"), F.lit("B")), F.col("stage"))
    return out.withColumn("is_secret", F.when(F.col("stage") == 2, F.col("score") >= model.cut).otherwise(F.col("stage") == 1)).withColumn("stage", name)


# Importance.


def importance(rows: DataFrame, model: scorers.Scorer | Sequence[scorers.Scorer], key: str, columns: Sequence[str] = ORDER, dominance: float = 0.8) -> DataFrame:
    """feature, importance (how much the log loss grows when the feature's values are exchanged), share (of all importance) and warning (a share above the dominance hints at a leak).

    Of several scorers, a row's fold (column fold, from 0) names its own. Values are exchanged over all rows: each takes
    those of the row before it in the order of a digest of the key, the first those of the last, however the rows are
    dealt to tasks. One shuffle, of the features that the scorers ask for; others change no score.
    """
    ship(rows.sparkSession)
    names, models = list(columns), [model] if callable(model) else list(model)
    used = asked(models, len(names))
    own = [f"own {i}" for i in used]
    place = F.struct(F.col("place"), F.col("key"))
    sent = rows.select(
        F.col("label").cast("double").alias("label"), (F.lit(0) if callable(model) else F.col("fold")).cast("long").alias("fold"), F.xxhash64(key).alias("place"), F.col(key).alias("key"),
        F.struct(F.lit(0.0).alias("none"), *[F.col(names[i]).cast("double").alias(c) for i, c in zip(used, own, strict=True)]).alias("own"),
    ).withColumn("range", F.shiftrightunsigned("place", 56).cast("int"))
    # The last row of each of 256 ranges of the digest goes before the first of the next range. The digest is signed: ranges from 128 on come first, which is as good an order.
    ends = sent.groupBy("range").agg(F.max_by("own", place).alias("end"))
    every = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("range", F.coalesce(F.lag("end").over(Window.orderBy("range")), F.last("end").over(every)).alias("end"))
    other = F.coalesce(F.lag("own").over(Window.partitionBy("range").orderBy("place", "key")), F.col("end"))
    pairs = sent.join(F.broadcast(ends), "range").select("label", "fold", "own", other.alias("other"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(len(names)), 0
        for batch in batches:
            label, fold = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            of = lambda first: [batch.column(first + i).to_numpy(zero_copy_only=False) for i in range(len(used))]  # noqa: B023, E731
            count += batch.num_rows
            before, after = of(2), of(2 + len(used))
            for m, scorer in enumerate(models):
                here = np.flatnonzero(fold == m) if len(models) > 1 else np.arange(batch.num_rows)
                if not len(here):
                    continue
                matrix = np.zeros((len(here), len(names)))
                for i, values in zip(used, before, strict=True):
                    matrix[:, i] = values[here]
                loss = lambda x, y, f=scorer: -np.log(np.clip(np.where(y > 0, p := f(x), 1 - p), 1e-12, 1))
                plain = loss(matrix, label[here])
                for i, values in zip(used, after, strict=True):
                    if len(moved := np.flatnonzero(matrix[:, i] != values[here])):
                        changed = matrix[moved]
                        changed[:, i] = values[here][moved]
                        total[i] += (loss(changed, label[here][moved]) - plain[moved]).sum()
        if count:
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(total), pa.array(np.full(len(names), count))], names=["feature", "grown", "n"])

    flat = pairs.select("label", "fold", *[F.col(f"{side}.`{c}`").alias(f"{side} {c}") for side in ("own", "other") for c in own])
    by = flat.mapInArrow(run, "feature string, grown double, n long").groupBy("feature").agg(F.greatest(F.sum("grown") / F.sum("n"), F.lit(0.0)).alias("importance"))
    whole = by.agg(F.sum("importance").alias("whole"))  # one row a feature
    share = F.coalesce(F.col("importance") / F.nullif(F.col("whole"), F.lit(0.0)), F.lit(0.0))
    return by.join(F.broadcast(whole)).select("feature", "importance", share.alias("share"), (share > dominance).alias("warning"))


def asked(models: Sequence[scorers.Scorer], count: int) -> list[int]:
    """The features that any of the scorers may look at: all, but for trees, whose nodes say which."""
    if not all(isinstance(m, scorers.Flat) for m in models):
        return list(range(count))
    return sorted({int(i) for m in models for i in m.feature if i >= 0})


# Focal loss.


def focal(z: np.ndarray, y: np.ndarray, gamma: float, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, slope and curvature by the margin z, for labels y: -a (1 - p)^gamma log p of the true class's chance p."""
    sign, a = np.where(y > 0, 1.0, -1.0), np.where(y > 0, alpha, 1 - alpha)
    log_p = -np.logaddexp(0, -sign * z)
    p = np.exp(log_p)
    q = -np.expm1(log_p)
    slope = a * q**gamma * (gamma * p * log_p - q)
    curve = a * p * q**gamma * (q * (gamma * log_p + gamma + 1) - gamma * (gamma * p * log_p - q))
    return -a * q**gamma * log_p, sign * slope, curve


def focal_fit(rows: DataFrame, columns: Sequence[str] = ORDER, gamma: float = 2.0, alpha: float = 0.25, decay: float = 1.0, rounds: int = 50, tolerance: float = 1e-10) -> tuple[np.ndarray, float]:
    """Weights by column and the offset of a linear scorer under the mean focal loss plus decay / n times half the squared weights.

    Each round sums loss, slope and curvature over the rows, in each task first and then by place in the matrix; the
    driver takes the Newton step over as many numbers as there are columns, damped until the loss falls.
    """
    spark, m = rows.sparkSession, len(columns) + 1
    ship(spark)
    vectors = rows.select(F.col("label").cast("double").alias("label"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x")).persist()

    def sums(weight: np.ndarray, whole: bool) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(2 + (m + m * m) * whole)
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = np.column_stack([np.stack(batch.column(1).to_numpy(zero_copy_only=False)), np.ones(batch.num_rows)])
                loss, slope, curve = focal(x @ weight, batch.column(0).to_numpy(), gamma, alpha)
                total[:2] += loss.sum(), len(loss)
                if whole:
                    total[2 : 2 + m] += slope @ x
                    total[2 + m :] += ((x * curve[:, None]).T @ x).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["place", "value"])

        found = vectors.mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).orderBy("place").collect()
        return np.array([r["value"] for r in found])

    weight, damp = np.zeros(m), 0.0
    ridge = np.append(np.full(m - 1, decay), 1e-9)
    value = lambda s, w: s[0] / s[1] + (ridge * w * w).sum() / 2 / s[1]
    for _ in range(rounds):
        here = sums(weight, True)
        if not here[1]:
            break
        slope, curve = (here[2 : 2 + m] + ridge * weight) / here[1], (here[2 + m :].reshape(m, m) + np.diag(ridge)) / here[1]
        if np.abs(slope).max() < tolerance:
            break
        now = value(here, weight)
        least = float(np.linalg.eigvalsh(curve)[0])
        damp = max(damp / 10, -2 * least if least <= 0 else 0.0)
        while damp < 1e9:
            step = np.linalg.solve(curve + damp * np.eye(m), -slope)
            if value(sums(weight + step, False), weight + step) <= now:
                break
            damp = max(1e-6, damp * 10)
        weight = weight + step
        if np.abs(step).max() < tolerance:
            break
    vectors.unpersist()
    return weight[:-1], float(weight[-1])


@dataclass(frozen=True)
class Linear:
    """A linear scorer: the chance of a weighted sum."""

    weight: np.ndarray
    offset: float

    def __call__(self, matrix: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(matrix @ self.weight + self.offset, -50, 50)))

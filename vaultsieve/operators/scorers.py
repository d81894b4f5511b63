"""Scorers as plain functions of a matrix, run over Arrow batches, whose failures are data.

A scorer is a function of a float matrix (rows by feature columns) that gives a score for each row. Fitted trees of Spark
ML become such functions by `flat`; any other model that runs in Python does by a function that loads it. A scorer that
raises, or gives the wrong number of scores, loses its batch, a score that is not finite its row: the score is null,
the reason stands beside it, and the other scorers' weights are scaled up. No failure fails the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vaultsieve.operators import features, scoring
from vaultsieve.sources.package import ship

Scorer = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Flat:
    """Trees as arrays over all their nodes: the feature that a node asks (-1: a leaf), its cut, where at most the cut and above it leads, and the leaf's value. A row walks all trees level by level."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    weights: np.ndarray
    depth: int
    logistic: bool

    def __call__(self, matrix: np.ndarray) -> np.ndarray:
        out = np.zeros(len(matrix))
        step = max(1, (1 << 20) // max(1, len(self.roots)))
        for first in range(0, len(matrix), step):
            x = matrix[first : first + step]
            at = np.tile(self.roots, (len(x), 1))
            rows = np.arange(len(x))[:, None]
            for _ in range(self.depth):
                asked = self.feature[at]
                down = np.where(x[rows, np.maximum(asked, 0)] <= self.cut[at], self.left[at], self.right[at])
                at = np.where(asked < 0, at, down)
            out[first : first + step] = self.value[at] @ self.weights
        return 1 / (1 + np.exp(-2 * out)) if self.logistic else out / self.weights.sum()

    def first(self, rounds: int) -> Flat:
        """The first trees alone."""
        return replace(self, roots=self.roots[:rounds], weights=self.weights[:rounds])


def flat(model) -> Flat:
    """Of fitted boosted trees or a fitted forest of Spark ML (or a pipeline that ends in one): its nodes, read once on the driver. Splits by numbers only."""
    model = model.stages[-1] if isinstance(model, PipelineModel) else model
    logistic = model._java_obj.getClass().getSimpleName().startswith("GBT")
    nodes: list[list] = []
    deepest = 0

    def add(node, depth: int) -> int:
        nonlocal deepest
        deepest, here = max(deepest, depth), len(nodes)
        nodes.append([-1, 0.0, here, here, 0.0])
        if node.subtreeDepth():
            split = node.split()
            nodes[here][:2] = [split.featureIndex(), split.threshold()]
            nodes[here][2], nodes[here][3] = add(node.leftChild(), depth + 1), add(node.rightChild(), depth + 1)
        elif logistic:
            nodes[here][4] = node.prediction()
        else:
            votes = list(node.impurityStats().stats())
            nodes[here][4] = votes[1] / max(sum(votes), 1e-300)
        return here

    roots = [add(tree._java_obj.rootNode(), 0) for tree in model.trees]
    feature, cut, left, right, value = (np.array(x) for x in zip(*nodes, strict=True))
    weights = np.array(model.treeWeights if logistic else [1.0] * len(roots), float)
    return Flat(feature.astype(np.int32), cut.astype(float), left.astype(np.int32), right.astype(np.int32), value.astype(float), np.array(roots, np.int32), weights, deepest, logistic)


def with_scores(rows: DataFrame, scorers: Mapping[str, Scorer], columns: Sequence[str] = features.ORDER, scores: str = "scores", failures: str = "failures") -> DataFrame:
    """rows with two maps by scorer: the score of each row (null if it has none) and, where that is null, why.

    Null features reach a scorer as NaN. Scorers travel to the tasks with the job; Spark broadcasts large ones. Nothing is shuffled.
    """
    ship(rows.sparkSession)
    names, kept = list(scorers), rows.columns
    made = T.StructType([*rows.schema, T.StructField(scores, T.MapType(T.StringType(), T.DoubleType())), T.StructField(failures, T.MapType(T.StringType(), T.StringType()))])
    held = dict(scorers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, cells = batch.num_rows, [batch.column(len(kept) + i).to_numpy(zero_copy_only=False) for i in range(len(columns))]
            matrix = np.column_stack(cells).astype(float) if cells else np.zeros((n, 0))
            values, reasons = {}, {}
            for name, scorer in held.items():
                values[name], reasons[name] = guarded(scorer, matrix)
            pairs = [[(k, values[k][i]) for k in names] for i in range(n)]
            why = [[(k, r) for k in names if (r := reasons[k] if isinstance(reasons[k], str) else reasons[k][i])] for i in range(n)]
            more = [pa.array(pairs, pa.map_(pa.string(), pa.float64())), pa.array(why, pa.map_(pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *more], names=[*kept, scores, failures])

    sent = rows.select("*", *[F.col(f"`{c}`").cast("double").alias(f"feature {i}") for i, c in enumerate(columns)])
    return sent.mapInArrow(run, made)


def guarded(scorer: Scorer, matrix: np.ndarray) -> tuple[list, str | list]:
    """A scorer's scores, None for those that are not finite, and the reason: one for all rows, or one each ('' if there is a score)."""
    try:
        found = np.asarray(scorer(matrix), float)
        if found.shape != (len(matrix),):
            raise ValueError(f"{found.shape} scores for {len(matrix)} rows")  # noqa: TRY301
    except Exception as error:  # noqa: BLE001  whatever a model raises is a failure of that model alone
        return [None] * len(matrix), f"{type(error).__name__}: {error}"
    fine = np.isfinite(found)
    return [x if ok else None for x, ok in zip(found.tolist(), fine.tolist(), strict=True)], ["" if ok else "not finite" for ok in fine.tolist()]


def combined(weights: Mapping[str, float], scores: str = "scores", how: str = "weighted", threshold: float = 0.5) -> Column:
    """One score of those that there are; null if there is none, so that the finding stays unverified. weighted: weights scaled up for the missing ones; soft: the mean; hard: 1 if more than half vote for it; surest: the one farthest from one half, the first of equals."""
    known = F.filter(F.array(*[F.struct(F.element_at(F.col(scores), F.lit(k)).alias("s"), F.lit(float(w)).alias("w"), F.lit(-i).alias("i")) for i, (k, w) in enumerate(weights.items())]), lambda x: x["s"].isNotNull())
    total = lambda f: F.aggregate(known, F.lit(0.0), lambda a, x: a + f(x))
    size = F.size(known)
    value = {
        "weighted": lambda: total(lambda x: x["s"] * x["w"]) / F.nullif(total(lambda x: x["w"]), F.lit(0.0)),
        "soft": lambda: total(lambda x: x["s"]) / size,
        "hard": lambda: F.when(total(lambda x: (x["s"] >= threshold).cast("double")) * 2 > size, 1.0).otherwise(0.0),
        "surest": lambda: F.array_max(F.transform(known, lambda x: F.struct(F.abs(x["s"] - 0.5), x["i"], x["s"].alias("s"))))["s"],
    }[how]()
    return F.when(size > 0, value)


#: Ways to judge findings by name: each makes, from scorers by name, the column of a score, null without one.
MODES: dict[str, Callable[[Mapping[str, Scorer]], Column]] = {
    "first": lambda scorers: F.element_at("scores", next(iter(scorers))),
    "ensemble": lambda scorers: combined(dict(zip(scorers, scoring.WEIGHTS if len(scorers) == 2 else [1.0] * len(scorers), strict=True))),
    "soft": lambda scorers: combined(dict.fromkeys(scorers, 1.0), how="soft"),
    "hard": lambda scorers: combined(dict.fromkeys(scorers, 1.0), how="hard"),
    "surest": lambda scorers: combined(dict.fromkeys(scorers, 1.0), how="surest"),
}


def register(name: str, mode: Callable[[Mapping[str, Scorer]], Column]) -> None:
    """A way to judge under a name of its own."""
    MODES[name] = mode


def verdicts(findings: DataFrame, scorers: Mapping[str, Scorer], mode: str = "ensemble", platt: tuple[float, float] = (0.0, 0.0), low: float = scoring.LOW, high: float = scoring.HIGH, columns: Sequence[str] = features.ORDER) -> DataFrame:
    """Findings in their contexts to verdicts: with features, scores, failures, p (calibrated), is_secret, ml_confidence, routing, combined confidence and explanation.

    A finding that no scorer could judge has a null p, is_secret null, routing 'unverified' and its own confidence.
    """
    if mode not in MODES:
        raise ValueError(f"no mode {mode}: {', '.join(MODES)}")
    made = with_scores(features.with_features(findings), scorers, columns)
    made = made.withColumn("p", scoring.platt(MODES[mode](scorers), *platt))
    said = scoring.verdict(F.col("p"), low, high)
    judged = F.col("p").isNotNull()
    return made.withColumns({
        "is_secret": F.when(judged, said["is_secret"]), "ml_confidence": F.when(judged, said["ml_confidence"]), "routing": F.when(judged, said["routing"]).otherwise("unverified"),
        "combined": F.when(judged, scoring.fused(F.col("confidence"), said["ml_confidence"], F.col("evidence"))).otherwise(F.col("confidence")),
        "explanation": F.when(judged, scoring.explanation(said["is_secret"], said["ml_confidence"])).otherwise("not verified"),
    })

"""Reading vector columns: rows of doubles, without those that are null, zero or not finite."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (array<double>): null vectors, null or non-finite components, zero and empty vectors are left out."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("v is not null and vec_id is not null")
    return rows.where(F.coalesce(fine, F.lit(False)) & F.exists("v", lambda x: x != 0))


def digest(v: Column) -> list[Column]:
    """128 bits of a vector; equal for equal components."""
    return [F.xxhash64(v).alias("d1"), F.xxhash64(F.lit("second"), v).alias("d2")]


def matrix(column: pd.Series, width: int | None = None) -> np.ndarray:
    if not len(column):
        return np.zeros((0, width or 0))
    rows = [np.asarray(x, dtype=float) for x in column]
    width = width or max(map(len, rows))
    out = np.zeros((len(rows), width))
    for i, x in enumerate(rows):
        out[i, : min(len(x), width)] = x[:width]  # vectors of other lengths are filled up with zeros
    return out


def power(largest: np.ndarray) -> np.ndarray:
    """The exponent e of the least power of two above each value, so that what is divided by 2**e is at most 1, without rounding."""
    return np.frexp(largest)[1]


def normed(points: np.ndarray) -> np.ndarray:
    """Rows at length 1. Each is scaled by a power of two first: the squares of very large or small components would leave the range of doubles."""
    points = np.ldexp(points, -power(np.abs(points).max(axis=1, initial=0.0))[:, None])
    return points / np.linalg.norm(points, axis=1, keepdims=True)


def sampled(rows: DataFrame, most: int) -> np.ndarray:
    """At most `most` vectors, by the order of a hash of their ids."""
    chosen = rows.select("v", F.xxhash64("vec_id").alias("h"), "vec_id").orderBy("h", "vec_id").limit(most).select("v").toPandas()
    return matrix(chosen["v"])


def chained(middle: np.ndarray) -> np.ndarray:
    """Vectors in an order in which each is the nearest left to the one before."""
    left, order = np.ones(len(middle), bool), [0]
    while len(order) < len(middle):
        left[order[-1]] = False
        order.append(int(np.argmax(np.where(left, middle @ middle[order[-1]], -np.inf))))
    return np.array(order)

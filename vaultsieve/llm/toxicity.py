"""Toxicity: a linear classifier over character n-grams that are scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vaultsieve.sources.package import ship

from . import hashing
from .common import staged
from .presence import Presence

#: Lengths of n-grams, in characters of the lower-cased text, and bits of their hash.
LENGTHS, BITS = (3, 4, 5, 6), 20
#: Labelled rows that the model is fitted on at most, by the order of a hash of their ids.
SAMPLE = 20_000
#: n-grams that the model keeps unless told otherwise: those with the largest chi-square among those in at least LEAST labelled texts.
FEATURES, LEAST = 2048, 3
_SLICES = 64


@cache
def _fold() -> np.ndarray:
    """Each code point's lower case, where that is one code point, and a space for all white space."""
    own = (chr(i) if not 0xD800 <= i < 0xE000 else " " for i in range(0x110000))
    return np.array([0x20 if c.isspace() else ord(low) if len(low := c.lower()) == 1 else ord(c) for c in own], np.uint32)


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of UTF-8 texts, and where each text begins among them."""
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=before[1:])
    return _fold()[np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")], before[offsets]


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: the hashes of all n-grams of the characters, and where a start may be. An n-gram lies in one text."""
    ends = np.repeat(offsets[1:], np.diff(offsets))
    run = np.zeros(len(data), np.uint32)
    for n in range(1, max(LENGTHS) + 1):
        if len(data) < n:
            return
        run = run[: len(data) - n + 1] * np.uint32(0x01000193) + data[n - 1 :] + np.uint32(1)
        if n in LENGTHS:
            x = (run ^ (run >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * n)
            yield (x ^ (x >> np.uint32(13))) >> np.uint32(32 - BITS), np.arange(n, len(data) + 1) <= ends[: len(data) - n + 1]


def found(column: pa.Array, slots: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of a string column with the distinct (row, slot) pairs in them; slots maps a hash to a feature, or -1."""
    for first, last, data, offsets in hashing.chunks(column, 1 << 18):
        data, offsets = characters(data, offsets)
        rows, kept = [], []
        for hashes, inside in grams(data, offsets):
            slot = slots[hashes]
            at = np.flatnonzero((slot >= 0) & inside)
            rows.append(np.searchsorted(offsets, at, "right") - 1)
            kept.append(slot[at].astype(np.int64))
        pairs = np.unique(np.concatenate(rows).astype(np.int64) * len(slots) + np.concatenate(kept)) if rows else np.zeros(0, np.int64)
        yield first, last, pairs // len(slots), pairs % len(slots)


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """text, label of at most `rows` labelled documents outside the held-out fifth."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).dropna()
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label")).select("text", "label")


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def ratios(sample: DataFrame, features: int = FEATURES) -> DataFrame:
    """hash, ratio of the chosen n-grams: the log of the share of toxic texts with it over the share of others, one added to each count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, n = np.zeros((2, 1 << BITS), np.int32), np.zeros(2, np.int64)
        every = np.arange(1 << BITS, dtype=np.int32)
        for batch in batches:
            label = np.clip(batch.column(1).to_numpy(zero_copy_only=False), 0, 1)
            for first, last, rows, hashes in found(batch.column(0), every):
                for kind in (0, 1):
                    by[kind] += np.bincount(hashes[label[first:last][rows] == kind], minlength=1 << BITS).astype(np.int32)
                    n[kind] += int((label[first:last] == kind).sum())
        width = (1 << BITS) // _SLICES
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(_SLICES)), *(pa.array([by[kind, i * width : (i + 1) * width].tobytes() for i in range(_SLICES)], pa.binary()) for kind in (0, 1)), *(pa.array(np.full(_SLICES, n[kind])) for kind in (0, 1))], names=["slice", "other", "toxic", "n_other", "n_toxic"])

    def add(part: pd.DataFrame) -> pd.DataFrame:
        other, toxic = (np.sum([np.frombuffer(x, np.int32) for x in part[c]], axis=0).astype(float) for c in ("other", "toxic"))
        n, p = float(part["n_other"].sum()), float(part["n_toxic"].sum())
        both, total = other + toxic, max(1.0, n + p)
        expected = both * p / total
        chi = (toxic - expected) ** 2 / np.maximum(expected, 1e-9) + (other - both + expected) ** 2 / np.maximum(both - expected, 1e-9)
        ratio = np.log((toxic + 1) / (p + 2)) - np.log((other + 1) / (n + 2))
        at = np.flatnonzero((both >= LEAST) & (expected > 0) & (expected < both))
        return pd.DataFrame({"hash": int(part["slice"].iat[0]) * len(other) + at, "chi": chi[at], "ratio": ratio[at]})

    sums = sample.mapInArrow(count, "slice long, other binary, toxic binary, n_other long, n_toxic long").groupBy("slice").applyInPandas(add, "hash long, chi double, ratio double")
    return sums.orderBy(F.desc("chi"), "hash").limit(features).select("hash", "ratio")


def fit(present: Presence, label: np.ndarray, scale: np.ndarray, rounds: int = 15, decay: float = 0.1) -> tuple[np.ndarray, float]:
    """Logistic regression on scaled presence by truncated Newton steps: a weight for each slot (times its scale) and the offset. decay weighs half the squared weights against the sum of losses."""
    n, m = len(label), len(scale)
    times = lambda v: present.times(scale * v[:-1]) + v[-1]
    turned = lambda e: np.append(scale * present.turned(e), e.sum())
    ridge = np.append(np.full(m, decay), 1e-6)
    weight = np.append(np.zeros(m), np.log((label.sum() + 1) / (n - label.sum() + 2)))
    loss = lambda v: float(np.logaddexp(0, (1 - 2 * label) * times(v)).sum() + (ridge * v * v).sum() / 2)
    for _ in range(rounds):
        chance = 1 / (1 + np.exp(-np.clip(times(weight), -30, 30)))
        slope = turned(chance - label) + ridge * weight
        curve = chance * (1 - chance)
        # Conjugate gradients for curvature * step = -slope.
        step, rest = np.zeros(m + 1), -slope
        way, left = rest.copy(), float(rest @ rest)
        first = left
        for _ in range(50):
            if left <= 1e-4 * first or left < 1e-12:
                break
            bent = turned(curve * times(way)) + ridge * way
            share = left / float(way @ bent)
            step, rest = step + share * way, rest - share * bent
            left, before = float(rest @ rest), left
            way = rest + left / before * way
        now, size = loss(weight), 1.0
        while size > 1e-3 and loss(weight + size * step) > now:
            size /= 2
        weight = weight + size * step
        if now - loss(weight) < 1e-4 * max(1.0, now):
            break
    return weight[:-1] * scale, float(weight[-1])


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, features: int = FEATURES) -> tuple[np.ndarray, np.ndarray, float]:
    """The slot of each n-gram hash (-1: none), the weight of each slot, and the offset. Without labelled rows, only an offset below 0."""
    sample = staged(labelled_sample(docs, labels, rows), "labelled")
    chosen = ratios(sample, features).toPandas()  # that many rows at most
    slots = np.full(1 << BITS, -1, np.int32)
    slots[chosen["hash"].to_numpy(dtype=np.int64)] = np.arange(len(chosen))
    scale = chosen["ratio"].to_numpy(dtype=float)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = np.clip(batch.column(1).to_numpy(zero_copy_only=False), 0, 1)
            for first, last, row, slot in found(batch.column(0), slots):
                bounds = np.searchsorted(row, np.arange(last - first + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(label[first:last].astype(np.int32)), pa.ListArray.from_arrays(pa.array(bounds), pa.array(slot.astype(np.int32)))], names=["label", "slots"])

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        # One group: the sample's size and its features are bounded by parameters.
        weight, bias = fit(Presence(part["slots"], len(scale)), part["label"].to_numpy(float), scale)
        return pd.DataFrame({"weights": [weight.tolist()], "bias": [bias]})

    model = sample.mapInArrow(present, "label int, slots array<int>").withColumn("all", F.lit(0)).groupBy("all").applyInPandas(solve, "weights array<double>, bias double").collect()
    weight, bias = (np.array(model[0]["weights"]), model[0]["bias"]) if model else (np.zeros(len(scale)), float(np.log(0.5)))
    return slots, weight, bias


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.5) for every document; the whole text is read. With `carry`, also a struct `carried` of these columns of docs.

    The model learns from labels (doc_id, toxic) whose crc32(doc_id as text) mod 5 is not 0, on at most `sample` rows, and keeps at most `features` n-grams.
    A text's features are the distinct n-grams in it, whatever its length. A null or empty text has none and gets the
    offset's score. Repeated labels of an id: the highest counts; of an id's repeated rows the least text is learned from. Null labels and labels of no document are left out,
    and a null id is not held out. No documents give no rows, no labels the score 1/3. Other columns are left out.
    """
    ship(docs.sparkSession)
    own = F.col(text_col).cast("string")
    whole = docs.select(F.col(id_col).cast("long").alias("doc_id"), own.alias("text"))
    slots, weight, bias = train(whole, labels, sample, features)
    # With documents to carry, the text travels once, within them.
    within = carry.index(text_col) if carry and text_col in carry else None
    carried = F.struct(*[own.alias(c) if c == text_col else F.col(f"`{c}`") for c in carry]) if carry else F.lit(None).cast("struct<none:int>")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *([] if within is not None else [own.alias("text")]), carried.alias("carried"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(batch.num_columns - 1)
            text = held.field(within) if within is not None else batch.column(1)
            for first, last, row, slot in found(text, slots):
                total = np.bincount(row, weight[slot], minlength=last - first) + bias
                value = 1 / (1 + np.exp(-np.clip(total, -50, 50)))
                n = last - first
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(value), pa.array((value >= 0.5).astype(np.int32)), held.slice(first, n)], names=["doc_id", "score", "predicted", "carried"])

    kinds = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), rows.schema["carried"]])
    out = rows.mapInArrow(apply, kinds)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", *(["carried"] if carry else []))

"""Quality classifier from weak labels: expectation-maximisation over heuristic labellers, then a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultsieve.sources.package import ship

from . import hashing
from .common import staged
from .presence import Presence

#: Rounds of expectation-maximisation, and the share of good documents assumed at first.
ROUNDS, PRIOR = 25, 0.8
#: Bits of the scorer's word hash, rows that it is fitted on at most (by the order of a hash), and its gradient rounds.
BITS, SAMPLE, STEPS = 16, 20_000, 60


#: Byte classes of UTF-8 text: bytes that begin a character beyond ASCII count as letters.
_CLASS = np.zeros((256, 7), np.int64)
_CLASS[[*range(0x80), *range(0xC0, 256)], 0] = 1  # characters
_CLASS[[*range(65, 91), *range(97, 123), *range(0xC0, 256)], 1] = 1  # letters
_CLASS[[i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in ".,:;!?'\"()-"], 2] = 1  # symbols
_CLASS[list(b"0123456789"), 3] = 1
_CLASS[list(b".!?"), 4] = 1
_CLASS[list(range(65, 91)), 5] = 1
_CLASS[list(b"|\t"), 6] = 1

LABELLERS = ("length", "letters", "symbols", "symbol_words", "tables", "runs", "run_share", "digits", "stops", "capitals", "repeats", "lines", "word_length")


def votes(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """Runs of rows of whole texts with what each labeller says of each: 1 good, 0 bad, 2 no vote. Labellers overlap, and none is right alone."""
    for first, last, data, offsets in hashing.chunks(column):
        n = last - first
        sums = np.zeros((len(data) + 1, _CLASS.shape[1]), np.int64)
        np.cumsum(_CLASS[data], axis=0, out=sums[1:])
        chars, letters, symbols, digits, stops, capitals, bars = (sums[offsets[1:]] - sums[offsets[:-1]]).T
        chars = np.maximum(chars, 1)
        starts, ends, bounds = hashing.words(hashing.LOWER[data], offsets)
        items = hashing.word_hashes(hashing.LOWER[data], starts, ends)
        doc = np.repeat(np.arange(n), np.diff(bounds))
        total = np.diff(bounds)
        per = lambda flags: np.bincount(doc[flags], minlength=n)
        new = np.ones(len(items), bool)
        order = np.lexsort((items, doc))
        new[1:] = (items[order][1:] != items[order][:-1]) | (doc[order][1:] != doc[order][:-1])
        distinct = np.bincount(doc[order][new], minlength=n)
        marked = per(sums[ends, 2] > sums[starts, 2])
        # Words of runs of four or more equal words.
        head = np.ones(len(items), bool)
        head[1:] = (items[1:] != items[:-1]) | (doc[1:] != doc[:-1])
        length = np.diff(np.append(np.flatnonzero(head), len(items)))
        in_runs = per(np.repeat(length >= 4, length))
        # Lines that are not empty, and distinct ones.
        cuts = np.flatnonzero(data == 10)
        edges = np.unique(np.concatenate([offsets, cuts, cuts + 1]))
        a, b = edges[:-1], edges[1:]
        full = data[a] != 10 if len(data) else np.zeros(0, bool)
        a, b = a[full], b[full]
        of = np.searchsorted(offsets, a, "right") - 1
        key = np.lexsort((line := hashing.span_hashes(data.astype(np.uint64) + np.uint64(1), a, b), of))
        fresh = np.ones(len(a), bool)
        fresh[1:] = (line[key][1:] != line[key][:-1]) | (of[key][1:] != of[key][:-1])
        lines, own = np.bincount(of, minlength=n), np.bincount(of[key][fresh], minlength=n)
        words = np.maximum(total, 1)
        vote = lambda bad, good, may=True: np.where(bad & may, 0, np.where(good & may, 1, 2))
        never = np.zeros(n, bool)
        yield first, last, np.stack(
            [
                vote(total < 5, total >= 50),
                vote(letters < 0.65 * chars, letters > 0.75 * chars),
                vote(symbols > 0.02 * chars, symbols < 0.003 * chars),
                vote(marked > 0.1 * words, never),
                vote(bars > 0.01 * chars, never),
                vote(in_runs > 0, never),
                vote(in_runs > 0.2 * words, never),
                vote(digits > 0.15 * chars, digits < 0.03 * chars),
                vote(stops < 0.001 * chars, (stops > 0.004 * chars) & (stops < 0.05 * chars)),
                vote(capitals > 0.2 * chars, capitals < 0.08 * chars),
                vote(distinct < 0.3 * total, distinct > 0.45 * total, total >= 20),
                vote(own < 0.7 * lines, own == lines, lines >= 3),
                vote((letters > 12 * words) | (letters < 2.5 * words), (letters >= 3.5 * words) & (letters <= 9 * words)),
            ],
            axis=1,
        )


def estimate(seen: np.ndarray, count: np.ndarray, rounds: int = ROUNDS, prior: float = PRIOR) -> tuple[float, np.ndarray]:
    """From vote patterns (rows of 0, 1, 2) and their counts: the share of good documents, and for each class (bad, good) and labeller the chances of the votes 0, 1 and none. Labellers count as independent given the class; having no vote is an outcome, as a labeller may only ever find faults.

    The prior belief that a good document hardly gets a vote for bad weighs as much as a fifth of the documents; without
    it, two kinds of good documents can come out as the classes."""
    belief = np.array([[0.4, 0.2, 0.4], [0.01, 0.6, 0.39]])
    chance, strength = np.tile(belief[:, None], (1, seen.shape[1], 1)), count.sum() / 5 + 1
    for _ in range(rounds):
        good = posterior(seen, prior, chance)
        weight = np.stack([count * (1 - good), count * good])
        prior = float((weight[1].sum() + 1) / (count.sum() + 2))
        chance = np.stack([np.stack([(w[:, None] * (seen == o)).sum(0) + strength * b[o] for o in (0, 1, 2)], axis=1) / (w.sum() + strength) for w, b in zip(weight, belief, strict=True)])
    return prior, chance


def posterior(seen: np.ndarray, prior: float, chance: np.ndarray) -> np.ndarray:
    """The chance of good for rows of votes (2: none)."""
    log = np.log([[1 - prior], [prior]]) + np.stack([np.log(c[np.arange(seen.shape[1]), seen]).sum(axis=1) for c in chance])
    return 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of rows with their distinct hashed words: row, slot, value (each row's values have the norm 1)."""
    for first, last, data, offsets in hashing.chunks(column):
        starts, ends, bounds = hashing.words(hashing.LOWER[data], offsets)
        slot = (hashing.word_hashes(hashing.LOWER[data], starts, ends) >> np.uint64(64 - BITS)).astype(np.int64)
        pairs = np.unique(np.repeat(np.arange(last - first), np.diff(bounds)) << BITS | slot)
        row = pairs >> BITS
        size = np.bincount(row, minlength=last - first)
        yield first, last, row, pairs & ((1 << BITS) - 1), 1 / np.sqrt(size[row])


def fit_scorer(sample: DataFrame, prior: float, chance: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Logistic regression of the posterior on hashed words, over a bounded sample, by gradient rounds in one task."""

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.concatenate([posterior(v, prior, chance) for _, _, v in votes(batch.column(0))] or [np.zeros(0)])
            for first, last, row, slot, _ in features(batch.column(0)):
                bounds = np.searchsorted(row, np.arange(last - first + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(good[first:last]), pa.ListArray.from_arrays(pa.array(bounds), pa.array(slot.astype(np.int32)))], names=["good", "slots"])

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        present, target = Presence(part["slots"], 1 << BITS), part["good"].to_numpy(float)
        size = 1 / np.sqrt(np.maximum(1, present.sizes))
        weight, bias, moving = np.zeros(1 << BITS), float(np.log((target.sum() + 1) / (len(target) - target.sum() + 1))), np.zeros((1 << BITS) + 1)
        for _ in range(steps):
            ahead = size * present.times(weight + 0.9 * moving[:-1]) + bias + 0.9 * moving[-1]
            error = 1 / (1 + np.exp(-np.clip(ahead, -30, 30))) - target
            slope = np.append(present.turned(size * error), error.sum()) / len(target)
            moving = 0.9 * moving - 2.0 * slope
            weight, bias = weight + moving[:-1], bias + moving[-1]
        return pd.DataFrame({"weights": [weight.tolist()], "bias": [bias]})

    made = sample.mapInArrow(present, "good double, slots array<int>").withColumn("all", F.lit(0)).groupBy("all").applyInPandas(solve, "weights array<double>, bias double").collect()
    return (np.array(made[0]["weights"]), made[0]["bias"]) if made else (np.zeros(1 << BITS), 0.0)


def score(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, votes (labellers that voted), agreeing (of these, for good), posterior, score, keep (score >= 0.5) for every document.

    The labellers vote on whole texts. Counts of the vote patterns of all documents (3 to the power of the number of
    labellers at most, whatever the corpus; added up in each task first) give the labellers' accuracies by
    expectation-maximisation. The posterior then labels a bounded sample (the least hashes of id and text) that a hashed
    linear word scorer is fitted on, in which repeated rows count once. The score is the mean of both in log-odds, so that a document with few votes is
    judged by its words, too.

    A null text counts as empty: it is voted bad by the length labeller. Repeated rows and ids are documents of their
    own. Without documents there are no rows. Other columns are left out.
    """
    ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[bytes, int] = {}
        for batch in batches:
            for _, _, v in votes(batch.column(0)):
                kinds, n = np.unique(v.astype(np.uint8), axis=0, return_counts=True)
                for kind, c in zip(kinds, n.tolist(), strict=True):
                    count[kind.tobytes()] = count.get(kind.tobytes(), 0) + c
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], names=["pattern", "n"])

    counted = docs.select("text").mapInArrow(patterns, "pattern binary, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    seen = np.array([list(r["pattern"]) for r in counted], np.int64).reshape(len(counted), len(LABELLERS))
    prior, chance = estimate(seen, np.array([r["n"] for r in counted], float))
    place = F.xxhash64("doc_id", "text")
    least = docs.select(place.alias("h")).orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    few = staged(docs.where(place <= F.lit(least)).groupBy(place.alias("h")).agg(F.min("text").alias("text")).select("text"), "sample") if least is not None else docs.select("text")
    weight, bias = fit_scorer(few, prior, chance)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (first, last, v), (_, _, row, slot, value) in zip(votes(batch.column(1)), features(batch.column(1)), strict=True):
                good = posterior(v, prior, chance)
                total = np.bincount(row, value * weight[slot], minlength=last - first) + bias
                odds = np.clip(np.log(np.maximum(good, 1e-12)) - np.log(np.maximum(1 - good, 1e-12)), -20, 20)
                both = 1 / (1 + np.exp(-(odds + total) / 2))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array((v < 2).sum(axis=1).astype(np.int32)), pa.array((v == 1).sum(axis=1).astype(np.int32)), pa.array(good), pa.array(both), pa.array(both >= 0.5)], names=["doc_id", "votes", "agreeing", "posterior", "score", "keep"])

    return docs.mapInArrow(apply, "doc_id long, votes int, agreeing int, posterior double, score double, keep boolean")

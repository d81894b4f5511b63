"""Near-duplicate vectors with a robust-pruned flat graph."""

from __future__ import annotations

import logging

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultsieve.sources.package import ship

from .common import staged, unstage
from .components import components
from .vectors import chained, digest, matrix, normed, sampled, usable

#: Rows that the shard centres are fitted on; centres at most; classes per centre, about; vector components per bundle of shards.
SAMPLE, CENTRES, SHARD, BUNDLE = 16384, 4096, 1000, 2**20
#: Out-degree in one shard, pruning slack, and width of the greedy search.
DEGREE, SLACK, BEAM = 16, 1.2, 24


def centres(sample: np.ndarray, count: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means on the sample."""
    points = normed(sample)
    middle = points[:count].copy()
    for _ in range(rounds):
        own = np.argmax(points @ middle.T, axis=1)
        total = np.zeros_like(middle)
        np.add.at(total, own, points)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        middle = np.where(size > 0, total / np.maximum(size, 1e-300), middle)
    return middle


def pruned(points: np.ndarray, degree: int = DEGREE, slack: float = SLACK) -> list[np.ndarray]:
    """Robust pruning: a point's nearest candidate becomes a neighbour, and candidates that are nearer to it (by the slack) than to the point are left out, and so on. Edges go both ways, or points that no other chose could not be reached."""
    near = points @ points.T
    out = []
    for i in range(len(points)):
        order = np.argsort(-near[i], kind="stable")
        order = order[order != i]
        far, chosen = 2 - 2 * near[i, order], []
        while len(order) and len(chosen) < degree:
            best = order[0]
            chosen.append(best)
            keep = slack * (2 - 2 * near[best, order]) > far
            keep[0] = False
            order, far = order[keep], far[keep]
        out.append(np.array(chosen, np.int64))
    tails, heads = np.repeat(np.arange(len(out)), [len(x) for x in out]), np.concatenate([*out, np.zeros(0, np.int64)])
    both = np.unique(np.concatenate([tails * len(out) + heads, heads * len(out) + tails])) if len(heads) else heads
    return np.split(both % max(1, len(out)), np.searchsorted(both, np.arange(1, len(out)) * len(out)))


def joined(points: np.ndarray, edges: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The graph with its parts joined by their nearest pairs, and the medoid of each part that it had: what a search enters."""
    part, entries = np.full(len(points), -1), []
    for i in range(len(points)):
        if part[i] < 0:
            front = np.array([i])
            while len(front):
                part[front] = len(entries)
                front = np.unique(np.concatenate([edges[x] for x in front]))
                front = front[part[front] < 0]
            own = np.flatnonzero(part == len(entries))
            entries.append(own[np.argmax(points[own] @ points[own].mean(axis=0))])
    while part.any():
        one, rest = np.flatnonzero(part == 0), np.flatnonzero(part)
        a, b = np.unravel_index(np.argmax(points[one] @ points[rest].T), (len(one), len(rest)))
        a, b = one[a], rest[b]
        edges[a], edges[b] = np.append(edges[a], b), np.append(edges[b], a)
        part[part == part[b]] = 0
    return edges, np.array(entries)


def reach(points: np.ndarray, edges: np.ndarray, entry: np.ndarray, query: np.ndarray, least: float, beam: int = BEAM) -> np.ndarray:
    """The points in range of one query by searched(); edges is filled up with -1."""
    return np.flatnonzero(searched((points @ query)[None], np.where(edges < 0, len(points), edges), entry, least, beam)[0])


def searched(near: np.ndarray, padded: np.ndarray, entries: np.ndarray, least: float, beam: int = BEAM) -> np.ndarray:
    """Range-expanding greedy search of many queries at once: each one's beam moves towards the query until it stands, and every point in range that it meets is expanded, until no new one is found.

    near has a row of products for each query; padded has each point's neighbours, filled up with the number of points.
    Returns the points in range that each query met.
    """
    asked, n = near.shape
    within, opened, seen = near >= least, np.zeros((asked, n), bool), np.zeros((asked, n), bool)
    seen[:, entries] = True
    tail, head = (x[padded.ravel() < n] for x in (np.repeat(np.arange(n), padded.shape[1]), padded.ravel()))
    order = np.argsort(head, kind="stable")
    ends, first = np.unique(head[order], return_index=True)
    active = np.arange(asked)
    while len(active):
        met = seen[active]
        best = np.argpartition(np.where(met, -near[active], np.inf), min(beam, n) - 1, axis=1)[:, : min(beam, n)]
        want = within[active]
        np.put_along_axis(want, best, True, axis=1)
        want &= met & ~opened[active]
        more = want.any(axis=1)
        active, want = active[more], want[more]
        opened[active] |= want
        if len(active) and len(ends):
            # Eight queries a byte: each point takes up the queries that opened one of its neighbours.
            come = np.bitwise_or.reduceat(np.packbits(want, axis=0).T[tail[order]], first, axis=0)
            seen[active[:, None], ends] |= np.unpackbits(come.T, axis=0, count=len(active)).astype(bool)
    return seen & within


def in_angle(points: np.ndarray, middle: np.ndarray, home: np.ndarray, least: float) -> np.ndarray:
    """For each point and centre, whether a vector of cosine `least` or more with the point can have that centre as its nearest.

    Vectors nearer to the centre c than to the point's own one, m, lie beyond the plane of equal products with both; the sine of the point's angle to it is its product with m - c, over the length of m - c.
    """
    if least <= 0:
        return np.ones((len(points), len(middle)), bool)
    scores = points @ middle.T
    gap = scores[np.arange(len(points)), home][:, None] - scores
    square = (middle * middle).sum(axis=1)
    apart = np.sqrt(np.maximum(0.0, square[home][:, None] + square - 2 * middle[home] @ middle.T))
    return gap <= np.sqrt(max(0.0, 1 - least * least)) * apart + 1e-7


def links_in(near: np.ndarray, padded: np.ndarray, entries: np.ndarray, least: float) -> tuple[np.ndarray, int]:
    """The points in range of each query by greedy search, and how many the first search found. The audit is whole: every search is held against the exact products, and those that missed a link search again with a wider beam."""
    hit = searched(near, padded, entries, least)
    first, beam = int(hit.sum()), BEAM
    while beam < near.shape[1]:
        missed = np.flatnonzero(((near >= least) & ~hit).any(axis=1))
        if not len(missed):
            break
        beam *= 4
        hit[missed] = searched(near[missed], padded, entries, least, beam)
    return hit, first


class Parts:
    """Connected parts of sorted ids: flat labels, each the place of the least id of its part."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.label = ids, np.arange(len(ids))

    def join(self, places: np.ndarray) -> None:
        """Make one part of these places' parts."""
        old = np.unique(self.label[places])
        if len(old) > 1:
            self.label[np.isin(self.label, old)] = old[0]


def duplicate_vectors(vectors: DataFrame, least: float = 0.9, shard: int = SHARD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row: links are all pairs whose cosine, in double precision, is `least` or more.

    Equal vectors are one class. Each class is at home in the shard of its nearest centre; a shard too large for a task
    is dealt into units by a hash. Every unit builds a robust-pruned graph whose parts are joined. A class asks every shard that a vector within
    the linking angle can have as its home, so no link is lost by the choice of shards; where directions are uniform these are
    all shards, and the work grows with the square of the classes. Units are bundled, and of two bundles only the
    first asks the second. In a bundle the product of askers and unit tells who has links there; these search the graph
    from its entries. The same products audit every search: one that misses a link is repeated with a wider beam until
    it has all, and how many the first searches found is logged. A task returns one count and one root for each class
    with links, not all pairs.

    Vectors that are null, zero, or hold null or non-finite components link with nothing and keep themselves; very large
    and very small components are scaled before they are squared. Repeated
    rows are equal vectors, linked with each other. A null id links with nothing. No rows give no rows. Other columns
    are left out. Of vectors of unequal lengths the shorter count as filled up with zeros.
    """
    ship(vectors.sparkSession)
    rows = usable(vectors, id_col, vector_col).select("vec_id", "v", *digest(F.col("v")))
    classes = staged(rows.groupBy("d1", "d2").agg(F.min("vec_id").alias("cls"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v")), "vector-classes")
    every = vectors.select(F.col(id_col).cast("long").alias("vec_id"))
    total, width = classes.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not total:
        return every.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    sample = sampled(classes.withColumnRenamed("cls", "vec_id"), SAMPLE)
    sample = np.hstack([sample, np.zeros((len(sample), width - sample.shape[1]))])
    middle = centres(sample, min(len(sample), CENTRES, -(-total // shard)))
    middle = middle[chained(middle)]

    def place(frames):
        for frame in frames:
            points = normed(matrix(frame["v"], width))
            frame["home"] = np.argmax(points @ middle.T, axis=1)
            frame["v"] = points.tolist()
            yield frame

    placed = staged(classes.select("cls", "copies", "v").mapInPandas(place, "cls long, copies long, v array<double>, home long"), "placed")
    sizes = np.zeros(len(middle), np.int64)
    for home, size in placed.groupBy("home").count().collect():  # CENTRES rows at most
        sizes[home] = size
    units = np.maximum(1, -(-sizes // (2 * shard)))
    first = np.cumsum(units) - units
    each = np.repeat(sizes / units, units)
    bundle = ((np.cumsum(each) - each) // max(shard, BUNDLE // width)).astype(np.int64)
    holds = np.zeros((len(middle), int(bundle[-1]) + 1), np.float32)
    holds[np.repeat(np.arange(len(middle)), units), bundle] = 1
    dealt = F.array(*[F.lit(int(x)) for x in units])
    unit = F.element_at(F.array(*[F.lit(int(x)) for x in first]), F.col("home").cast("int") + 1) + F.pmod(F.xxhash64("cls"), F.element_at(dealt, F.col("home").cast("int") + 1))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("cls", kind="stable").reset_index(drop=True)
        points, own = matrix(frame["v"], width), int(bundle[frame["unit"].iat[0]])
        edges, entries = joined(points, pruned(points))
        frame["edges"] = [x.tolist() for x in edges]
        frame["entry"] = np.isin(np.arange(len(points)), entries)
        frame["bundle"] = own
        asks = []
        for start in range(0, len(points), 64):
            can = in_angle(points[start : start + 64], middle, frame["home"].to_numpy()[start : start + 64], least).astype(np.float32) @ holds > 0
            asks += [np.flatnonzero(x[own:]) + own for x in can]
        frame["asks"] = [x.tolist() for x in asks]
        return frame[["cls", "copies", "v", "unit", "edges", "entry", "bundle", "asks"]]

    graph = placed.withColumn("unit", unit.cast("long")).groupBy("unit").applyInPandas(build, "cls long, copies long, v array<double>, unit long, edges array<int>, entry boolean, bundle long, asks array<long>")
    graph = staged(graph, "graphs")
    unstage(placed)
    asked = graph.select(F.col("bundle").alias("i"), F.explode("asks").alias("j"), *[F.col(c).alias(c) for c in ("cls", "copies", "v")])
    pairs = graph.select(F.col("bundle").alias("i"), F.explode("asks").alias("j")).distinct()
    data = graph.withColumnRenamed("bundle", "j").join(pairs, "j").select("i", "j", "cls", "copies", "v", "unit", "edges", "entry")

    def search(data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not (len(data) and len(asked)):
            return pd.DataFrame({c: pd.Series([], dtype="int64") for c in ("cls", "links", "root", "sure", "early")})
        same = data["i"].iat[0] == data["j"].iat[0]
        who, weight, queries = asked["cls"].to_numpy(), asked["copies"].to_numpy(), matrix(asked["v"], width)
        parts = Parts(np.unique(np.concatenate([who, data["cls"].to_numpy()])))
        links, at = np.zeros(len(parts.ids), np.int64), np.searchsorted(parts.ids, who)
        sure = early = 0
        for _, part in data.groupby("unit"):
            part = part.sort_values("cls", kind="stable")
            names, copies, points = part["cls"].to_numpy(), part["copies"].to_numpy(), matrix(part["v"], width)
            lists = [np.asarray(x, np.int64) for x in part["edges"]]
            padded = np.full((len(lists), max(1, max(map(len, lists)))), len(lists), np.int64)
            for x, line in zip(lists, padded, strict=True):
                line[: len(x)] = x
            entries, own = np.flatnonzero(part["entry"].to_numpy()), np.searchsorted(parts.ids, names)
            for start in range(0, len(who), 1024):
                near = queries[start : start + 1024] @ points.T
                if same:
                    near[who[start : start + 1024, None] == names] = -2
                rows = np.flatnonzero((near >= least).any(axis=1))
                if not len(rows):
                    continue
                hit, first = links_in(near[rows], padded, entries, least)
                sure, early = sure + int((near >= least).sum()), early + first
                links[at[start + rows]] += hit @ copies
                if not same:
                    links[own] += weight[start + rows] @ hit
                for row, query in zip(hit, at[start + rows], strict=True):
                    if row.any():
                        parts.join(np.append(own[row], query))
        some = np.flatnonzero(links)
        out = pd.DataFrame({"cls": parts.ids[some], "links": links[some], "root": parts.ids[parts.label[some]]})
        out["sure"], out["early"] = 0, 0
        if len(out):
            out.loc[0, ["sure", "early"]] = sure, early
        return out

    found = staged(data.groupBy("i", "j").cogroup(asked.groupBy("i", "j")).applyInPandas(search, "cls long, links long, root long, sure long, early long"), "found")
    sure, early = found.agg(F.coalesce(F.sum("sure"), F.lit(0)), F.coalesce(F.sum("early"), F.lit(0))).first()
    logging.getLogger(__name__).info("links in the audit: %d; found by the first search: %d; all were found after wider ones", sure, early)
    unstage(graph)
    counts = found.groupBy("cls").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")).where("a != b"))
    facts = classes.select("d1", "d2", "cls", "copies").join(counts, "cls", "left").join(roots.withColumnRenamed("id", "cls"), "cls", "left")
    facts = facts.select("d1", "d2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "cls").alias("component_id"))
    linked = rows.select("vec_id", "d1", "d2").join(facts, ["d1", "d2"]).select("vec_id", "n_links", "component_id")
    rest = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    v = F.col("v").cast("array<double>")
    fine = F.coalesce(F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    out = linked.union(rest.where(~fine).select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

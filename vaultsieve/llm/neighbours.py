"""Nearest neighbours by inner product with a permutation index."""

from __future__ import annotations

import logging

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultsieve.sources.package import ship

from .common import staged
from .vectors import chained, matrix, power, sampled, usable

#: Pivots: a sample of the rows, by the order of a hash. The footrule distance is summed over the PROBED nearest to the query.
PIVOTS, PROBED = 256, 64
#: Rows of a block of the index and queries of a part, about.
BLOCK, PART = 4096, 2048
#: Queries that are answered exactly, to tell how far to look, and the share of their neighbours that each bound must let in.
AUDIT, SURE = 128, 0.985


def footrule(files: np.ndarray) -> np.ndarray:
    """Each row's distance from a query: files has, for the query's pivots from the nearest on, the rows' places of that pivot."""
    own = np.arange(len(files), dtype=files.dtype)[:, None]
    return (np.maximum(files, own) - np.minimum(files, own)).sum(axis=0, dtype=np.uint32)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, pivots: int = PIVOTS, probed: int = PROBED, block: int = BLOCK, sure: float = SURE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the largest inner products found, ties to the smaller id; a query isn't its own neighbour.

    Each vector is represented by the order of its nearest pivots. Rows stand in blocks by their nearest pivot, and a
    block holds an inverted file for each pivot, of the places that it has with the rows. A query probes the
    files of its `probed` nearest pivots, sums the footrule distance, and scores the rows within a bound exactly, in
    double precision. Vectors are lengthened by one component so that all have the same norm: nearness by angle is then
    nearness by inner product.

    Two bounds say how far a query looks: the footrule distance, and at how many nearest pivots it visits the rows
    that stand there. Both are the least that let in the share `sure` of the true neighbours of AUDIT queries, which are
    answered exactly by one pass over all rows first; the recall that follows is logged. So the bounds follow the data, at every size:
    where vectors form groups, few blocks are visited; where directions are uniform, nearly all are. From each block
    that it visits a query scores k + 1 rows at least.

    The pivots are a bounded sample, and every row is indexed. Vectors that are null, zero, or hold null or non-finite
    components take no part. Vectors of unequal lengths are compared as if filled up with zeros. Repeated rows: rows
    with a query's id are not its neighbours; repeated candidates each count; of a query's rows the least vector asks.
    No rows give no rows. Other columns are left out. Very large and very small components are scaled for the search;
    a product that leaves the range of doubles is what doubles make of it.
    """
    ship(vectors.sparkSession)
    rows = staged(usable(vectors, id_col, vector_col), "vectors")
    none = rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).where("false")
    largest = lambda by: F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * by * (x * by)))
    total, longest, big, width = rows.agg(F.count(F.lit(1)), largest(F.lit(1.0)), F.max(F.array_max(F.transform("v", F.abs))), F.max(F.size("v"))).first()
    if not total:
        return none
    scale = 1.0
    if not 1e-200 < longest < 1e200:
        # Squares would leave the range of doubles; all vectors shrink or grow alike. Scores are of the original ones.
        scale = float(np.ldexp(1.0, min(1000, -int(power(np.float64(big))))))
        longest = rows.agg(largest(F.lit(scale))).first()[0]
    sample = sampled(rows, pivots) * scale
    sample = np.hstack([sample, np.zeros((len(sample), width - sample.shape[1]))])
    lengthen = lambda m: np.hstack([m, np.sqrt(np.maximum(0, longest - (m * m).sum(axis=1)))[:, None]])
    anchors = lengthen(sample)
    anchors = anchors[chained(anchors)]
    count, kind = len(anchors), np.uint8 if len(anchors) <= 256 else np.uint16

    def places(m: np.ndarray) -> np.ndarray:
        """For each row and pivot, how many pivots are nearer."""
        order = np.argsort(-(m @ anchors.T), axis=1, kind="stable")
        out = np.empty(order.shape, kind)
        np.put_along_axis(out, order, np.arange(count, dtype=kind)[None], axis=1)
        return out

    def posted(asking: bool):
        def run(frames):
            for frame in frames:
                m = matrix(frame["v"], width) * scale
                at = places(np.hstack([m, np.zeros((len(m), 1))]) if asking else lengthen(m))
                frame["home"], frame["places"] = at.argmin(axis=1), [x.tobytes() for x in at]
                yield frame

        return run

    schema = "vec_id long, v array<double>, home long, places binary"
    index = staged(rows.mapInPandas(posted(False), schema), "permutations")
    asked = staged(rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")).mapInPandas(posted(True), schema), "queries")
    audited = asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(AUDIT).toPandas()
    if not len(audited):
        return none

    def read(frame: pd.DataFrame) -> np.ndarray:
        return np.frombuffer(b"".join(frame["places"]), kind).reshape(len(frame), count)

    def exact(frames):
        who, q, own = audited["vec_id"].to_numpy(), matrix(audited["v"], width), read(audited)
        for frame in frames:
            ids, scores = frame["vec_id"].to_numpy(), q @ matrix(frame["v"], width).T
            files, home = np.ascontiguousarray(read(frame).T), frame["home"].to_numpy()
            for i, name in enumerate(who):
                at = np.flatnonzero(ids != name)
                at = at[np.argsort(-scores[i, at], kind="stable")[:k]]
                far = footrule(files[np.argsort(own[i])[:probed]][:, at])
                yield pd.DataFrame({"query_id": name, "vec_id": ids[at], "score": scores[i, at], "far": far.astype(np.int64), "step": own[i, home[at]].astype(np.int64)})

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = lambda found: found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    true = top(index.mapInPandas(exact, "query_id long, vec_id long, score double, far long, step long")).select("far", "step").toPandas()  # AUDIT * k rows at most
    bound = lambda x: int(np.sort(x)[max(0, int(np.ceil(sure * len(x))) - 1)]) if len(x) else 0
    most, visited = bound(true["far"].to_numpy()), bound(true["step"].to_numpy()) + 1
    recall = float(((true["far"] <= most) & (true["step"] < visited)).mean()) if len(true) else 1.0
    logging.getLogger(__name__).info("recall of the audit's neighbours: %.4f, within footrule distance %d and %d of %d pivots", recall, most, visited, count)

    # Rows stand along the chain of pivots; those at one pivot are dealt by a hash, and every `block` of them are a block.
    sizes = np.zeros(count, np.int64)
    for home, size in index.groupBy("home").count().collect():  # one row per pivot
        sizes[home] = size
    starts = np.cumsum(sizes) - sizes
    pick = lambda x: F.element_at(F.array(*[F.lit(int(n)) for n in x]), F.col("home").cast("int") + 1).cast("long")
    dealt = lambda starts, sizes, n: F.floor((pick(starts) + F.pmod(F.xxhash64("vec_id"), F.greatest(pick(sizes), F.lit(1)))) / n).cast("long")
    first, last = starts // block, (starts + np.maximum(sizes, 1) - 1) // block
    # Queries are dealt to parts along the same chain, so that those of a part visit much the same blocks.
    askers = np.zeros(count, np.int64)
    for home, size in asked.groupBy("home").count().collect():  # one row per pivot
        askers[home] = size
    part = dealt(np.cumsum(askers) - askers, askers, PART).alias("part")

    def visits(frames):
        for frame in frames:
            near = [np.flatnonzero((x < visited) & (sizes > 0)) for x in read(frame)]
            frame["block"] = [np.unique(np.concatenate([np.arange(first[p], last[p] + 1) for p in x] or [np.zeros(0, np.int64)])).tolist() for x in near]
            yield frame[["vec_id", "v", "places", "home", "block"]]

    visiting = staged(asked.mapInPandas(visits, "vec_id long, v array<double>, places binary, home long, block array<long>").select("vec_id", "v", "places", part, "block"), "visits")
    asking = visiting.select("vec_id", "v", "places", "part", F.explode("block").alias("block"))
    # An index row goes to the parts that visit its block, and to no other.
    visitors = asking.select("block", F.col("part").alias("visitor")).distinct()
    data = index.select("vec_id", "v", "places", dealt(starts, sizes, block).alias("block")).join(visitors, "block")
    data = data.select("vec_id", "v", "places", F.col("block").alias("b"), F.col("visitor").alias("p"))

    def search(data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if len(data) and len(asked):
            data = data.sort_values("vec_id", kind="stable")
            ids, m, files = data["vec_id"].to_numpy(), matrix(data["v"], width), np.ascontiguousarray(read(data).T)
            for name, vector, own in zip(asked["vec_id"], matrix(asked["v"], width), read(asked), strict=True):
                far = footrule(files[np.argsort(own)[:probed]])
                least = min(k + 1, len(far)) - 1
                at = np.flatnonzero(far <= max(most, int(np.partition(far, least)[least])))
                at = at[ids[at] != name]
                score = (m[at] * vector).sum(axis=1)
                order = np.lexsort((ids[at], -score))[:k]
                out["query_id"] += [name] * len(order)
                out["vec_id"] += ids[at][order].tolist()
                out["score"] += score[order].tolist()
        return pd.DataFrame({c: pd.Series(x, dtype="float64" if c == "score" else "int64") for c, x in out.items()})

    found = data.groupBy("b", "p").cogroup(asking.groupBy("block", "part")).applyInPandas(search, "query_id long, vec_id long, score double")
    return top(found).select("query_id", "rank", "vec_id", "score")

"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultsieve.sources.package import ship

from . import hashing
from .common import free_shuffles, hot_join, staged, unstage
from .components import components

#: A pair at the similarity 0.8 shares no band with probability (1 - 0.8 ** ROWS) ** BANDS < 4e-5.
BANDS, ROWS = 26, 5
#: Buckets of up to SMALL classes give all their pairs (at most 28). Larger ones are compared with HUBS members, and what is not in one component then, in blocks of BLOCK classes.
SMALL, HUBS, BLOCK = 8, 2, 512
#: A pair's 8-bit signatures agree in this share at least, or it isn't verified: five standard errors below 0.8.
LEAST_AGREEMENT = 0.62


def _second_permutation(x: np.ndarray) -> np.ndarray:
    """A bijection on 32-bit integers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash: the first permutation is the upper half of the mixed hash; the second is used at every circular shift of the positions that the first gives, one coordinate for each shift."""
    places = (shingles >> np.uint64(32)).astype(np.uint32)
    shifts = np.arange(coordinates, dtype=np.uint32)[:, None]
    low = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    for first in range(0, len(places), 4096):
        np.minimum(low, _second_permutation(places[None, first : first + 4096] + shifts).min(axis=1), out=low)
    return low


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingles, as 64-bit hashes, of the words with A-Z in lower case; of fewer words than a shingle, the whole sequence is one; of no words, none."""
    for first, last, data, offsets in hashing.chunks(column):
        data = hashing.LOWER[data]
        starts, ends, bounds = hashing.words(data, offsets)
        items = hashing.word_hashes(data, starts, ends)
        runs = hashing.run_hashes(items, width)
        for i in range(last - first):
            a, b = bounds[i], bounds[i + 1]
            if b - a >= width:
                yield np.unique(runs[a : b - width + 1])
            else:
                yield hashing.run_hashes(items[a:b], b - a) if b > a else items[:0]


def document_rows(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, tkey, text to: doc_id, tkey, n, s1, s2 (128 bits of the shingle set), bands (one hash for each), sketch (8 bits of each coordinate)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = hashing.mix(np.arange(bands, dtype=np.uint64) + np.uint64(1))
        for batch in batches:
            n, s1, s2, keys, sketch = [], [], [], [], []
            for got in shingle_sets(batch.column(2), width):
                n.append(len(got))
                s1.append(hashing.mix(got ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) if len(got) else np.uint64(0))
                s2.append(hashing.mix(got + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64) if len(got) else np.uint64(0))
                if not len(got):
                    keys.append([])
                    sketch.append(b"")
                    continue
                low = signature(got, bands * rows)
                key = salt.copy()
                for part in low.reshape(bands, rows).astype(np.uint64).T:
                    key = hashing.mix(key * np.uint64(31) + part)
                keys.append(key.view(np.int64))
                sketch.append(low.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(np.array(s1, np.uint64).view(np.int64)), pa.array(np.array(s2, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], names=["doc_id", "tkey", "n", "s1", "s2", "bands", "sketch"])

    return docs.mapInArrow(make, "doc_id long, tkey long, n long, s1 long, s2 long, bands array<long>, sketch binary")


def set_rows(docs: DataFrame, width: int) -> DataFrame:
    """cls, text to cls and set (its sorted 64-bit shingle hashes)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in shingle_sets(batch.column(1), width)], pa.binary())], names=["cls", "set"])

    return docs.mapInArrow(make, "cls long, set binary")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted distinct arrays."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(both) - shared)


def agreeing(pairs: DataFrame, sketches: DataFrame, percent: int, least: float) -> DataFrame:
    """Of pairs (a, b), those whose sizes allow the similarity and whose sketches agree well enough."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(lambda b: b.num_rows, batches):
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
            share = (x == y).mean(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(share)], names=["a", "b", "share"]).filter(pa.array(share >= least))

    a = sketches.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("x"))
    b = sketches.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("y"))
    sized = pairs.join(a, "a").join(b, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return sized.select("a", "b", "x", "y").mapInArrow(keep, "a long, b long, share double")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose full sets are similar."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yes = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(yes, pa.bool_()))

    both = pairs.select("a", "b").join(sets.select(F.col("cls").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("cls").alias("b"), F.col("set").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(keep, "a long, b long")


def block_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that join different components within large buckets: every pair of a bucket's members is compared unless both are in one component by then. members: bucket, m, cls, component, n, sketch.

    A bucket is dealt into blocks of about BLOCK classes and each pair of blocks is a group of its own. A group holds
    the full sets of two blocks and returns the links that join components, fewer than its members.
    """

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        values = [np.frombuffer(x, np.uint64) for x in block["set"]]
        sketch = np.frombuffer(b"".join(block["sketch"]), np.uint8).reshape(len(block), -1)
        sizes = np.array([len(x) for x in values])
        known, found = block["component"].to_numpy().copy(), []
        for i in range(len(block)):
            fits = (known[:i] != known[i]) & (100 * np.minimum(sizes[:i], sizes[i]) >= percent * np.maximum(sizes[:i], sizes[i]))
            at = np.flatnonzero(fits)
            at = at[(sketch[at] == sketch[i]).mean(axis=1) >= LEAST_AGREEMENT] if len(at) else at
            for j in at:
                if known[j] != known[i] and similar(values[i], values[j], percent):
                    found.append((block["cls"].iat[i], block["cls"].iat[j]))
                    known[known == known[j]] = known[i]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    parts = F.ceil(F.col("m") / BLOCK)
    dealt = members.withColumn("own", F.pmod(F.xxhash64("cls", "bucket"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).join(sets, "cls")
    return dealt.groupBy("bucket", "i", "j").applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text", roots: bool = False) -> DataFrame:
    """doc_id, tkey, n_shingles, component_id, kept for every document.

    Documents with equal shingle sets form a class; classes are compared, not their members. Classes that share a band
    are candidates. Small buckets give their pairs; in large ones each class meets a few members chosen anew for each
    band and keeps the one with the likest sketch; pairs that pass the sketches are verified on full sets. Large buckets that are then still of several
    components are compared in blocks, where every pair of different components is verified, so that no candidate is
    dropped however large its bucket is.

    A null or empty text has no shingles and is linked with nothing. component_id is the least doc_id reachable, itself
    included; kept is doc_id = component_id. Rows with the same id are documents of their own. A null doc_id can be
    linked but names no component unless all ids there are null. No rows give no rows. Other columns are left out; tkey
    is the text's xxhash64, which tells rows of one id apart. On request root names the component even where no id does;
    it is null for rows without shingles.
    """
    ship(docs.sparkSession)
    text = F.col(text_col).cast("string")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tkey"), text.alias("text"))
    found = staged(document_rows(docs, width, bands, rows), "signatures")
    full = found.where("n > 0")
    classes = staged(full.groupBy("s1", "s2").agg(F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.min(F.struct("doc_id", "tkey")).alias("one"), F.count(F.lit(1)).alias("copies")).withColumnRenamed("s1", "cls"), "classes")
    banded = classes.select("cls", F.explode("bands").alias("bucket"))
    picks = [F.min(F.struct(F.xxhash64("bucket", "cls", F.lit(i)), "cls"))["cls"].alias(f"hub{i}") for i in range(HUBS)]
    buckets = staged(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), *picks).where("m > 1").withColumn("n", F.col("m")), "buckets")
    members = staged(hot_join(banded, buckets, ["bucket"]).drop("n"), "members")
    small = members.where(F.col("m") <= SMALL).select("bucket", "cls")
    own = small.groupBy("bucket").agg(F.array_sort(F.collect_list("cls")).alias("all"))
    pairs = own.select(F.explode("all").alias("a"), "all").select("a", F.explode(F.filter("all", lambda x: x > F.col("a"))).alias("b"))
    hubs = members.where(F.col("m") > SMALL).select(F.col("cls").alias("a"), F.explode(F.array(*[F.col(f"hub{i}") for i in range(HUBS)])).alias("b")).where("a != b")
    sketches = classes.select("cls", "n", "sketch")
    # Of the members that a class met in large buckets, the likest is verified now; the blocks below settle what that leaves open.
    likest = agreeing(hubs.distinct(), sketches, percent, LEAST_AGREEMENT).groupBy("a").agg(F.max(F.struct("share", "b"))["b"].alias("b"))
    pairs = agreeing(pairs.distinct(), sketches, percent, LEAST_AGREEMENT).select("a", "b").union(likest.select(F.least("a", "b"), F.greatest("a", "b"))).distinct()
    pairs = staged(pairs, "pairs")
    large = members.where(F.col("m") > SMALL).select("cls")
    involved = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).union(large).distinct()
    ones = classes.join(involved, "cls").select("cls", F.col("one.doc_id").alias("doc_id"), F.col("one.tkey").alias("tkey"))
    texts = docs.where("doc_id is not null").join(ones, ["doc_id", "tkey"]).union(docs.where("doc_id is null").join(ones.where("doc_id is null").drop("doc_id"), "tkey").select("doc_id", "tkey", "text", "cls"))
    sets = staged(set_rows(texts.select("cls", "text"), width).dropDuplicates(["cls"]), "sets")
    links = staged(verified(pairs, sets, percent), "verified")
    known = components(links)
    label = F.coalesce("component", "cls")
    joined = members.where(F.col("m") > SMALL).select("bucket", "m", "cls").join(known.withColumnRenamed("id", "cls"), "cls", "left").withColumn("component", label)
    torn = joined.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("bucket")
    more = staged(block_links(joined.join(torn, "bucket").join(sketches, "cls"), sets, percent), "more")
    unstage(pairs, members, sets, buckets)
    free_shuffles(docs.sparkSession)
    if not more.isEmpty():
        known = components(links.union(more))
    sized = staged(known.join(classes.select(F.col("cls").alias("id"), "copies"), "id"), "sized")
    rest = hot_join(found.select("doc_id", "tkey", F.col("n").alias("n_shingles"), "s1"), sized.select(F.col("id").alias("s1"), F.col("component").alias("linked"), F.col("copies").alias("n")), ["s1"], "left")
    rest = staged(rest.select("doc_id", "tkey", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("linked", "s1")).alias("root")), "rooted")
    named = staged(rest.where("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n")), "named")
    out = hot_join(rest, named, ["root"], "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "tkey", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), *(["root"] if roots else []))

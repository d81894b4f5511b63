"""Importance resampling towards a target distribution: a dictionary of all distinct n-grams gives bucket counts, and its buckets go back to each document's n-grams.

N-gram strings are counted globally, and each distinct one is hashed once, in the dictionary. What travels is each
chunk's distinct n-grams: a chunk is a run of texts of bounded size, in which equal n-grams are added up first, so that
no n-gram comes more often than there are chunks, however frequent it is. They travel sorted, to parts of the dictionary that are
ranges of their order, as tries: an n-gram's prefix is an n-gram, too, and comes before it, so each is sent as its last
word. The dictionary answers with the buckets of a chunk's n-grams, in their order, which the chunk's documents then
look up. Both go by rounds of ranges, so that only one round's n-grams and answers are in shuffles at a time.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vaultsieve.sources.package import ship

from . import hashing
from .common import free_shuffles, staged, unstage

#: Buckets, longest n-gram, draws per hundred documents of at least LEAST words, and what is hashed before an id.
BUCKETS, LONGEST, DRAW, LEAST, SEED = 10_000, 3, 5, 20, "42"
#: Bytes of text in a chunk, about; a longer text is cut between words. Bytes of text for each part of the dictionary, about. Rounds of parts.
CHUNK, PART, ROUNDS = 1 << 22, 1 << 22, 2
#: Distinct n-grams that are looked at for each bound between two parts, about, and n-grams that come with a byte of text.
_LOOKS, _DENSITY = 32, 0.25

_INK = np.ones(256, bool)
_INK[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False
_BITS = 21  # of a word's rank in its chunk, which holds fewer than 2 ** 21 distinct words


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> np.uint32(1)), table >> np.uint32(1))
    return table


_CRC, _LONG = _crc_table(), 128


def crc32s(state: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """States of crc32 (its complement; that of no bytes is 0xFFFFFFFF) carried on over a string each, byte by byte for all at once but the few of more than _LONG bytes."""
    order = np.argsort(-size, kind="stable")
    start, size, now = start[order], size[order], state[order]
    few = int(np.searchsorted(-size, -_LONG, "left"))
    now[:few] = [zlib.crc32(data[a : a + n], int(~s & np.uint32(0xFFFFFFFF))) ^ 0xFFFFFFFF for a, n, s in zip(start[:few].tolist(), size[:few].tolist(), now[:few], strict=True)]
    # Longest first, so that those still with bytes are a run from `few` on.
    for i, n in enumerate(np.searchsorted(-size, -np.arange(1, int(size[few:].max(initial=0)) + 1), "right").tolist()):
        part = now[few:n]
        now[few:n] = _CRC[(part ^ data[start[few:n] + i]) & np.uint32(0xFF)] ^ (part >> np.uint32(8))
    out = np.empty(len(order), np.uint32)
    out[order] = now
    return out


def _zstd() -> pa.Codec:
    return pa.Codec("zstd", 3)


def _cut(starts: np.ndarray, ends: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Runs of one text's words of at most about `size` bytes."""
    out, first = [], 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + size, "right")))
        out.append((first, last))
        first = last
    return out


def chunk_rows(docs: DataFrame, size: int = CHUNK, share: float = _LOOKS / (PART * _DENSITY)) -> DataFrame:
    """chunk, and lists over its pieces of texts: uid, doc_id, n_words (of the whole text, at its first piece; else 0), own (n-grams start at so many of the piece's words), held (words of the piece, with those that only end its last n-grams); the distinct words, sorted, and all words as their ranks, compressed; and the chunk's looks, a `share` of its n-grams."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, count, named = TaskContext.get().partitionId() << 33, 0, 0
        for batch in batches:
            for first, last, data, offsets in hashing.chunks(batch.column(1), size):
                data = hashing.LOWER[data]
                ink = _INK[data]
                start, end = ink.copy(), ink.copy()
                start[1:] &= ~ink[:-1]
                end[:-1] &= ~ink[1:]
                edge = offsets[:-1][offsets[:-1] < len(data)]
                start[edge] = ink[edge]
                edge = offsets[1:][offsets[1:] > 0] - 1
                end[edge] = ink[edge]
                starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
                bounds = np.searchsorted(starts, offsets)
                ids = batch.column(0).slice(first, last - first)
                pieces = [(i, a, b) for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))]
                groups = [pieces] if last - first > 1 or len(data) <= size else [[(0, a, b)] for a, b in _cut(starts, ends, size)] or [pieces]
                uid = base + named + np.arange(last - first)
                named += last - first
                for group in groups:
                    lo, total = group[0][1], int(bounds[-1])
                    hi = group[-1][2] if len(groups) == 1 else min(total, group[-1][2] + LONGEST - 1)
                    a, z = (int(starts[lo]), int(ends[hi - 1])) if hi > lo else (0, 0)
                    letters = pa.py_buffer(data[a:z][ink[a:z]].tobytes())
                    spans = np.append(0, np.cumsum(ends[lo:hi] - starts[lo:hi]))
                    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(spans), letters]).dictionary_encode()
                    order = pc.sort_indices(words.dictionary).to_numpy()
                    rank = np.empty(len(order), np.uint32)
                    rank[order] = np.arange(len(order), dtype=np.uint32)
                    if len(order) >= 1 << _BITS:
                        raise ValueError(f"a chunk of {size} bytes holds {len(order)} distinct words")
                    whole = [int(bounds[i + 1] - bounds[i]) if p == bounds[i] else 0 for i, p, _ in group]
                    own = [b - p for _, p, b in group]
                    held = own if len(groups) == 1 else [hi - lo]
                    of = [uid[[i for i, *_ in group]], ids.take(pa.array([i for i, *_ in group])), whole, own, held]
                    lists = [pa.array([x], pa.list_(t)) for x, t in zip([of[0].tolist(), of[1].to_pylist(), *of[2:]], (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)]
                    ranks, names = rank[words.indices.to_numpy()], words.dictionary.take(pa.array(order)).to_pylist()
                    coded = ranks.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()  # all lowest bytes first
                    text = b" ".join(names)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([base + count]), *lists, *(pa.array([_zstd().compress(x, asbytes=True)], pa.binary()) for x in (text, coded)), pa.array([len(text)]), pa.array([looks(names, ranks, share)], pa.list_(pa.binary()))],
                        names=["chunk", "uid", "doc_id", "n_words", "own", "held", "names", "ranks", "size", "looks"],
                    )
                    count += 1

    return docs.mapInArrow(rows, "chunk long, uid array<long>, doc_id array<long>, n_words array<long>, own array<int>, held array<int>, names binary, ranks binary, size long, looks array<binary>")


class Chunk:
    """A chunk's words and pieces, and keys for its n-grams: in a key's three places are the ranks of the words, from 1 on, or 0."""

    def __init__(self, row: dict):
        self.own, self.held = np.array(row["own"], np.int64), np.array(row["held"], np.int64)
        n = int(self.held.sum())
        self.names = _zstd().decompress(row["names"], row["size"], asbytes=True).split(b" ") if n else []
        self.ranks = np.frombuffer(_zstd().decompress(row["ranks"], 4 * n, asbytes=True) if n else b"", np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.uint64) + np.uint64(1)

    def grams(self, low: int = 0, high: int = 1 << 63) -> tuple[np.ndarray, np.ndarray]:
        """The keys from low to below high of all places of n-grams, and the piece that each is of."""
        n, last = len(self.ranks), np.cumsum(self.held)
        end, may = np.repeat(last, self.held), np.repeat(last - self.held + self.own, self.held)
        piece, at = np.repeat(np.arange(len(self.own)), self.held), np.arange(n)
        keys, pieces, key = [], [], np.zeros(n, np.uint64)
        for k in range(min(LONGEST, n)):
            key = key[: n - k] + (self.ranks[k:] << np.uint64(_BITS * (LONGEST - 1 - k)))
            inside = (at[: n - k] + k < end[: n - k]) & (at[: n - k] < may[: n - k]) & (key >= np.uint64(low)) & (key < np.uint64(high))
            keys.append(key[inside])
            pieces.append(piece[: n - k][inside])
        return (np.concatenate(keys), np.concatenate(pieces)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def bound(self, gram: bytes) -> int:
        """The least key of n-grams that don't come before this one."""
        key = 0
        for k, word in enumerate(gram.split(b" ")):
            rank = bisect_left(self.names, word)
            shift = _BITS * (LONGEST - 1 - k)
            key += (rank + 1) << shift
            if rank == len(self.names) or self.names[rank] != word:
                break
        return key


def ranks_of(keys: np.ndarray) -> list[np.ndarray]:
    mask = np.uint64((1 << _BITS) - 1)
    return [((keys >> np.uint64(_BITS * (LONGEST - 1 - k))) & mask).astype(np.int64) for k in range(LONGEST)]


def looks(names: list[bytes], ranks: np.ndarray, share: float) -> list[bytes]:
    """Distinct n-grams chosen by a hash of their words, so that every chunk chooses the same ones."""
    if not names:
        return []
    size = np.array([len(x) for x in names], np.int64)
    ends = np.cumsum(size)
    word = hashing.word_hashes(np.frombuffer(b"".join(names), np.uint8), ends - size, ends)[ranks]
    total, out = np.zeros(len(ranks), np.uint64), set()
    for k in range(min(LONGEST, len(ranks))):
        total = hashing.mix(total[: len(ranks) - k] * np.uint64(0x9E3779B97F4A7C15) + word[k:])
        out |= {b" ".join(names[r] for r in ranks[i : i + k + 1]) for i in np.flatnonzero(total < np.uint64(min(1.0, share) * (2**64 - 1025))).tolist()}
    return sorted(out)


def bounds_of(chunks: DataFrame, parts: int) -> list[bytes]:
    """N-grams at which the parts of the dictionary begin, but the first: every so many of the chosen ones, of which there are about _LOOKS a part."""
    seen = [r["look"] for r in chunks.select(F.explode("looks").alias("look")).distinct().orderBy("look").collect()]
    return [bytes(seen[i * len(seen) // parts]) for i in range(1, min(parts, len(seen)))]


def tries(chunks: DataFrame, bounds: list[bytes], first: int, last: int) -> DataFrame:
    """part, chunk, nodes, skip, size, trie of the parts first to last - 1: a chunk's distinct n-grams of that part, sorted, each as its depth, its count and its last word. `skip` nodes before them hold the prefixes of the first one."""
    held = chunks.sparkSession.sparkContext.broadcast(bounds)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = held.value
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row)
                cuts = [chunk.bound(x) for x in edges[max(0, first - 1) : last]]
                low, high = cuts.pop(0) if first else 0, cuts.pop() if last <= len(edges) else 1 << 63
                keys, count = np.unique(chunk.grams(low, high)[0], return_counts=True)
                ranks = ranks_of(keys)
                depth = np.sum([x > 0 for x in ranks], axis=0).astype(np.uint8)
                final = np.where(depth == 1, ranks[0], np.where(depth == 2, ranks[1], ranks[2])) - 1
                spaced = pa.array([x + b" " for x in chunk.names], pa.large_binary()).take(pa.array(final))
                at, text = np.frombuffer(spaced.buffers()[1], np.int64), memoryview(spaced.buffers()[2] or b"")
                count, edge = count.astype("<i4"), np.searchsorted(keys, np.array([low, *cuts, high], np.uint64))
                out: list[list] = [[] for _ in range(6)]
                for p in range(last - first):
                    a, b = int(edge[p]), int(edge[p + 1])
                    if a < b:
                        path = [int(ranks[k][a]) - 1 for k in range(int(depth[a]) - 1)]
                        n = len(path) + b - a
                        raw = b"".join([bytes(range(1, len(path) + 1)), depth[a:b].tobytes(), bytes(4 * len(path)), count[a:b].tobytes(), *(chunk.names[i] + b" " for i in path), text[at[a] : at[b]]])
                        for x, value in zip(out, (first + p, row["chunk"], n, len(path), len(raw), _zstd().compress(raw, asbytes=True)), strict=True):
                            x.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["part", "chunk", "nodes", "skip", "size", "trie"])

    return chunks.mapInArrow(rows, "part long, chunk long, nodes int, skip int, size long, trie binary")


class Merged:
    """The tries of a part, as one: `of` has each node's n-gram, `count` how often each distinct n-gram comes, `crc` its checksum."""

    def __init__(self, raws: list[bytes], nodes: list[int]):
        depth = np.concatenate([np.frombuffer(x, np.uint8, n) for x, n in zip(raws, nodes, strict=True)])
        number = np.concatenate([np.frombuffer(x, "<i4", n, offset=n) for x, n in zip(raws, nodes, strict=True)])
        text = np.concatenate([np.frombuffer(x, np.uint8, offset=5 * n) for x, n in zip(raws, nodes, strict=True)])
        ink, cut = text != 0x20, np.flatnonzero(text == 0x20)
        at = cut - np.arange(len(cut))  # where words end without the spaces
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cut), [None, pa.py_buffer(np.append(0, at).astype(np.int64)), pa.py_buffer(text[ink].tobytes())]).dictionary_encode()
        code, here = words.indices.to_numpy().astype(np.int64) + 1, np.arange(len(depth))
        up = [np.maximum.accumulate(np.where(depth == k, here, 0)) for k in range(1, LONGEST)]
        path = [np.where(depth > k + 1, code[up[k]], np.where(depth == k + 1, code, 0)) for k in range(LONGEST - 1)]
        final = np.where(depth == LONGEST, code, 0)
        order = np.lexsort((final, path[1], path[0])) if len(words.dictionary) >= 1 << _BITS else np.argsort((path[0] << 2 * _BITS) + (path[1] << _BITS) + final)
        new = np.ones(len(order), bool)
        new[1:] = np.any([x[order][1:] != x[order][:-1] for x in (*path, final)], axis=0)
        group = np.cumsum(new) - 1
        self.of = np.empty(len(order), np.int64)
        self.of[order] = group
        one = order[new]
        self.count = np.bincount(group, number[order], minlength=len(one)).astype(np.int64)
        # A prefix's state is carried on over a space and the last word; prefixes come first.
        spots = np.frombuffer(words.dictionary.buffers()[1], np.int64)[words.dictionary.offset :]
        data = np.frombuffer(words.dictionary.buffers()[2] or b"", np.uint8)
        state, level, last = np.full(len(one), 0xFFFFFFFF, np.uint32), depth[one], code[one] - 1
        above = np.arange(len(one))
        for k in range(1, LONGEST + 1):
            nodes = np.flatnonzero(level == k)
            if k > 1:
                prior = np.maximum.accumulate(np.where(level == k - 1, above, 0))[nodes]
                state[nodes] = _CRC[(state[prior] ^ np.uint32(0x20)) & np.uint32(0xFF)] ^ (state[prior] >> np.uint32(8))
            state[nodes] = crc32s(state[nodes], data, spots[last[nodes]], spots[last[nodes] + 1] - spots[last[nodes]])
        self.crc = ~state


def dictionary(packed: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Of each part of the dictionary: rows (chunk, part, places), the buckets of that chunk's n-grams in their order, and one row without a chunk whose totals are all counts by bucket. Each distinct n-gram is counted over all chunks and hashed once."""

    def part(table: pa.Table) -> pa.Table:
        nodes, skip = table.column("nodes").to_pylist(), table.column("skip").to_pylist()
        whole = Merged([_zstd().decompress(x.as_py(), n, asbytes=True) for x, n in zip(table.column("trie"), table.column("size").to_pylist(), strict=True)], nodes)
        bucket = whole.crc % np.uint32(buckets)
        total = np.bincount(bucket, whole.count, minlength=buckets).astype(np.int64)
        used, at = np.flatnonzero(total), np.cumsum([0, *nodes])
        places = [bucket[whole.of[a + s : b]].astype("<u4" if buckets > 1 << 16 else "<u2").tobytes() for a, s, b in zip(at[:-1], skip, at[1:], strict=True)]
        n, p = len(places), table.column("part")[0].as_py()
        return pa.table({"chunk": pa.array([*table.column("chunk").to_pylist(), None], pa.int64()), "part": pa.array([p] * (n + 1), pa.int64()), "places": pa.array([*places, None], pa.binary()), "totals": pa.array([None] * n + [[(int(b), int(total[b])) for b in used]], pa.list_(pa.struct([("bucket", pa.int32()), ("n", pa.int64())])))})

    return packed.groupBy("part").applyInArrow(part, "chunk long, part long, places binary, totals array<struct<bucket:int,n:long>>")


def bucket_counts(answers: DataFrame) -> DataFrame:
    """bucket, n over all parts."""
    return answers.where("chunk is null").select(F.inline("totals")).groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket, in thousandths: as many numbers as buckets."""
    counts = source.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    rows = counts.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect()
    by = {r["bucket"]: (r["s"], r["t"]) for r in rows}
    whole_s, whole_t = sum(s for s, _ in by.values()), sum(t for _, t in by.values())
    s, t = (np.array([by.get(b, (0, 0))[i] for b in range(buckets)], float) for i in (0, 1))
    return np.floor(1000 * np.log((t + 1) * (whole_s + buckets) / ((s + 1) * (whole_t + buckets)))).astype(np.int64)


def weighed(chunks: DataFrame, answers: DataFrame, gain: np.ndarray, bounds: list[bytes], first: int, last: int, wide: bool = False) -> DataFrame:
    """uid, doc_id, n_words, n_features, weight of each piece of a text, as far as its n-grams are of the parts first to last - 1: their buckets come from the dictionary's answers to its chunk. n_words is counted with part 0."""
    held = chunks.sparkSession.sparkContext.broadcast((gain, bounds))

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        gain, edges = held.value
        out = []
        for row in left.to_pylist():
            chunk = Chunk(row)
            low, high = chunk.bound(edges[first - 1]) if first else 0, chunk.bound(edges[last - 1]) if last <= len(edges) else 1 << 63
            keys, piece = chunk.grams(low, high)
            order = np.argsort(keys)
            keys = keys[order]
            new = np.ones(len(keys), bool)
            new[1:] = keys[1:] != keys[:-1]
            got = dict(zip(right.column("part").to_pylist(), right.column("places").to_pylist(), strict=True))
            bucket = np.concatenate([np.frombuffer(got[p], "<u4" if wide else "<u2") for p in sorted(got)] or [np.zeros(0, np.int64)])
            value = gain[bucket][np.cumsum(new) - 1] if len(keys) else np.zeros(0)
            n = len(row["uid"])
            weight = np.bincount(piece[order], value, minlength=n).astype(np.int64)  # whole numbers below 2 ** 53
            words = row["n_words"] if not first else [0] * n
            out.append(pa.table({"uid": row["uid"], "doc_id": pa.array(row["doc_id"], pa.int64()), "n_words": pa.array(words, pa.int64()), "n_features": np.bincount(piece, minlength=n), "weight": weight}))
        return pa.concat_tables(out) if out else pa.table({k: pa.array([], pa.int64()) for k in ("uid", "doc_id", "n_words", "n_features", "weight")})

    ours = answers.where(F.col("chunk").isNotNull() & (F.col("part") >= first) & (F.col("part") < last))
    return chunks.groupBy("chunk").cogroup(ours.groupBy("chunk")).applyInArrow(join, "uid long, doc_id long, n_words long, n_features long, weight long")


def spans(parts: int, rounds: int) -> list[tuple[int, int]]:
    """Rounds of parts: first part, last part + 1."""
    cuts = sorted({parts * i // rounds for i in range(rounds + 1)})
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _release(spark) -> None:
    """Have the shuffle files of all jobs so far deleted. Spark holds on to those of the last job, so an empty one goes before."""
    spark.range(1).collect()
    free_shuffles(spark)


def parts_for(docs: DataFrame, size: int = PART) -> int:
    """Parts of the dictionary, so that each holds the n-grams of about `size` bytes of text."""
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(1, -(-total // size))


def ranked(scores: DataFrame, draw: int = DRAW, least: int = LEAST) -> DataFrame:
    """With `rank`: of the documents of at least `least` words, floor(draw * N / 100) of the highest scores, ties to the smaller id (null last, then by uid). Places are counted within ranges of the order, to which the rows of the ranges before are added."""
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last(), F.col("uid").asc()]
    able = scores.where(F.col("n_words") >= least)
    dealt = staged(able.select("uid", "doc_id", "score").repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    counts = {r["range"]: r["n"] for r in dealt.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per task
    most, before, offset = draw * sum(counts.values()) // 100, 0, []
    for k in sorted(counts):
        if before < most:
            offset.append((k, before))
        before += counts[k]
    if not offset:
        return scores.withColumn("rank", F.lit(None).cast("long"))
    above = F.broadcast(scores.sparkSession.createDataFrame(offset, "range int, before long"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order)) + F.col("before")
    drawn = dealt.join(above, "range").select("uid", place.cast("long").alias("rank")).where(F.col("rank") <= most)
    return scores.join(drawn, "uid", "left")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS, draw: int = DRAW, least: int = LEAST, seed: str = SEED, chunk: int = CHUNK, part: int = PART, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document: n-grams of 1 to 3 words, weighed by how much more frequent their buckets are in target than in docs, with Gumbel noise from the id, so that the highest scores are a draw without replacement.

    Words are in lower case (A-Z only); whole texts are read. A null text has no words, a text without words the weight
    0; both are scored, and drawn only if they have `least` words. Repeated rows and ids are documents of their own with equal noise; a null
    id gets that of an empty one. An empty target, or no documents, count as no n-grams. Other columns are left out.
    """
    spark = docs.sparkSession
    ship(spark)
    if buckets < 1 or chunk > 1 << 23:
        raise ValueError("there must be a bucket, and a chunk of 8 MiB at most")
    text = lambda df, c: F.coalesce(df[c].cast("string"), F.lit(""))
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), text(docs, text_col).alias("text"))
    aim = target.select(F.lit(None).cast("long").alias("doc_id"), text(target, target_col).alias("text"))
    chunks, bounds, answers, counts = [], [], [], []
    for rows, name in ((own, "documents"), (aim, "target")):
        parts = parts_for(rows, part)
        chunks.append(staged(chunk_rows(rows, chunk, _LOOKS / (part * _DENSITY)), f"chunks-{name}"))
        bounds.append(bounds_of(chunks[-1], parts))
        answers.append([])
        for first, last in spans(len(bounds[-1]) + 1, rounds if name == "documents" else 1):
            answers[-1].append(staged(dictionary(tries(chunks[-1], bounds[-1], first, last), buckets), f"dictionary-{name}"))
            _release(spark)
        counts.append(bucket_counts(reduce(DataFrame.unionByName, answers[-1])))
    gain = gains(*counts, buckets)
    pieces = []
    for answer, (first, last) in zip(answers[0], spans(len(bounds[0]) + 1, rounds), strict=True):
        part_sums = weighed(chunks[0], answer, gain, bounds[0], first, last, buckets > 1 << 16)
        pieces.append(staged(part_sums.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")]), "weights"))
        unstage(answer)
        _release(spark)
    unstage(*chunks, *answers[1])
    pieces = reduce(DataFrame.unionByName, pieces).groupBy("uid").agg(F.first("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")])
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.left(digest, F.lit(8)), 16, 10).cast("double")
    noise = F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scores = staged(pieces.withColumn("score", (F.col("weight") + noise).cast("long")), "scores")
    return ranked(scores, draw, least).select("doc_id", "n_features", "weight", "score", "rank")


#: The same with every n-gram of every document as a row; crc32 is added up byte by byte.
ORACLE = r"""
WITH RECURSIVE crc(i, k, v) AS (SELECT i, 0, i::UBIGINT FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END FROM crc WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS t FROM crc WHERE k = 8),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
fd AS (SELECT doc_id, f, count(*) AS n FROM (SELECT doc_id, array_to_string(w[i:i + k - 1], ' ') AS f FROM d, range(1, 4) g(k), unnest(range(1, len(w) - k + 2)) u(i)) GROUP BY ALL),
fb AS (SELECT f, count(*) AS n FROM (SELECT array_to_string(w[i:i + k - 1], ' ') AS f FROM b, range(1, 4) g(k), unnest(range(1, len(w) - k + 2)) u(i)) GROUP BY f),
names AS (SELECT f FROM fd UNION SELECT f FROM fb),
dict AS (SELECT f, xor(list_reduce(list_prepend(4294967295::UBIGINT, [('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::UBIGINT FOR i IN range(octet_length(encode(f)))]), lambda s, x: xor(t[CAST((xor(s, x) & 255) + 1 AS BIGINT)], s >> 8)), 4294967295::UBIGINT) % 10000 AS bucket FROM names, tab),
s AS (SELECT bucket, sum(n) AS s FROM fd JOIN dict USING (f) GROUP BY bucket), t AS (SELECT bucket, sum(n) AS t FROM fb JOIN dict USING (f) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE))) AS g FROM s LEFT JOIN t USING (bucket)),
per AS (SELECT doc_id, sum(n * g) AS weight, sum(n) AS n_features FROM fd JOIN dict USING (f) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (SELECT d.doc_id, len(w) AS words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN per ON d.doc_id = per.doc_id),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE words >= 20)
SELECT scored.doc_id, n_features, weight, score, rank::BIGINT AS rank FROM scored LEFT JOIN (SELECT * FROM placed WHERE rank <= (SELECT 5 * count(*) // 100 FROM scored WHERE words >= 20)) p ON scored.doc_id = p.doc_id
"""

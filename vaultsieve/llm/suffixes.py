"""Substring dedup over bytes: a distributed merge sort of suffixes that exchanges front-coded sorted runs and merges them with loser trees that know common prefixes.

Sorting all suffixes of a corpus moves each byte a hundred times. Equal strings of `length` bytes hold equal least K-grams
at equal places, so only suffixes that start at such K-grams are sorted, each with the bytes before it, and of those only
the ones whose K-gram occurs twice in different texts or places.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultsieve.sources.package import ship

from . import hashing
from .common import free_shuffles, hot_join, staged, unstage

#: Bytes in a K-gram; a window of `length` bytes holds length - K + 1 of them.
K = 40
#: Suffixes that a task sorts into one run, and suffixes per group of runs that one task merges, about.
RUN, GROUP = 60_000, 20_000
_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)


def document_rows(docs: DataFrame, length: int, k: int) -> DataFrame:
    """One row per document: doc_id, tkey, n_bytes, c1, c2 (the first 128 bits of sha), sha, and its least K-grams in lists: gram, at, lo, hi. Windows that start at lo to hi have their least K-gram at `at`."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in hashing.chunks(batch.column(1)):
                n, raw = last - first, data.tobytes()
                digests = [hashlib.sha256(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                sha, both = [x.hexdigest() for x in digests], hashing.halves(digests)
                items = data.astype(np.uint64) + np.uint64(1)
                start = end = at = np.zeros(0, np.int64)
                grams = np.zeros(0, np.uint64)
                if len(data) >= length:
                    grams = hashing.run_hashes(items, k)
                    low = hashing.slide((grams & _HIGH) | np.arange(len(grams), dtype=np.uint64), length - k + 1, True)
                    start = np.flatnonzero(hashing.whole(offsets, len(data), length))
                    at = (low[start] & _LOW).astype(np.int64)
                    new = np.ones(len(start), bool)
                    new[1:] = at[1:] != at[:-1]  # K-grams lie in one document, so a new document is a new place
                    last = np.ones(len(start), bool)
                    last[:-1] = new[1:]
                    end = start[last]
                    start, at = start[new], at[new]
                    grams = grams[at]
                doc = np.searchsorted(offsets, start, "right") - 1
                lists = pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32))
                of = [grams.view(np.int64), (at - offsets[doc]).astype(np.int32), (start - offsets[doc]).astype(np.int32), (end - offsets[doc]).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), batch.column(2).slice(first, n), pa.array(np.diff(offsets)), *both, pa.array(sha, pa.string()), *(pa.ListArray.from_arrays(lists, pa.array(x)) for x in of)], names=["doc_id", "tkey", "n_bytes", "c1", "c2", "sha", "gram", "at", "lo", "hi"])

    return docs.mapInArrow(rows, "doc_id long, tkey long, n_bytes long, c1 long, c2 long, sha string, gram array<long>, at array<int>, lo array<int>, hi array<int>")


def front_coded(strings: list[bytes]) -> tuple[np.ndarray, bytes, np.ndarray]:
    """Of a sorted run: how many bytes each string shares with the one before it, and the other bytes with their counts."""
    sizes = np.array([len(x) for x in strings])
    padded = np.zeros((len(strings), int(sizes.max(initial=0)) + 1), np.uint8)
    padded[np.arange(padded.shape[1]) < sizes[:, None]] = np.frombuffer(b"".join(strings), np.uint8)
    differ = padded[1:] != padded[:-1]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), padded.shape[1])
    shared = np.append(np.zeros(min(1, len(strings)), np.int64), np.minimum(shared, np.minimum(sizes[1:], sizes[:-1])))
    return shared, b"".join(s[c:] for s, c in zip(strings, shared.tolist(), strict=True)), sizes - shared


def restored(shared: np.ndarray, rest: bytes, counts: np.ndarray) -> list[bytes]:
    out, last, at = [], b"", 0
    for c, n in zip(shared.tolist(), counts.tolist(), strict=True):
        last = last[:c] + rest[at : at + n]
        out.append(last)
        at += n
    return out


def merged(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """Merge sorted runs (strings, bytes shared with the one before) with a loser tree: run, place in it, and bytes shared with the string given before.

    Each loser keeps how many bytes it shares with the winner that beat it. On the way up from the last winner's run,
    every loser met was beaten by that winner, so two such numbers decide unless they are equal; then bytes are compared
    from there on. No byte known to be shared is looked at again.
    """
    leaves = 1
    while leaves < len(runs):
        leaves *= 2
    strings = [r[0] for r in runs] + [[]] * (leaves - len(runs))
    known = [r[1] for r in runs] + [[]] * (leaves - len(runs))
    place, share = [0] * leaves, [0] * leaves
    heads: list[bytes | None] = [s[0] if s else None for s in strings]
    tree = [-1] * leaves

    def wins(a: int, b: int) -> bool:
        """Whether a's head comes first; the loser's share becomes that with the winner's head."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return y is None
        if share[a] != share[b]:
            return share[a] > share[b]
        i, n = share[a], min(len(x), len(y))
        while i + 16 <= n and x[i : i + 16] == y[i : i + 16]:
            i += 16
        while i < n and x[i] == y[i]:
            i += 1
        first = i == len(x) if i == n else x[i] < y[i]
        share[b if first else a] = i
        return first

    def rise(leaf: int) -> int:
        node, best = (leaves + leaf) // 2, leaf
        while node:
            other = tree[node]
            if other < 0:  # the first round: wait for the other half
                tree[node] = best
                return -1
            if not wins(best, other):
                tree[node], best = best, other
            node //= 2
        return best

    best = 0
    for leaf in range(leaves):
        best = rise(leaf)
    while heads[best] is not None:
        yield best, place[best], share[best]
        place[best] += 1
        done = place[best] >= len(strings[best])
        heads[best] = None if done else strings[best][place[best]]
        share[best] = 0 if done else known[best][place[best]]
        best = rise(best)


_NUMBERS = ("shared", "counts", "left_counts", "docs", "tkeys", "ats")
_RUN = "part long, rest binary, left binary, " + "".join(f"{x} binary, " for x in _NUMBERS) + "doc_id long, tkey long, first int, last int, at int, w1 array<long>, w2 array<long>"


def packed(length: int) -> tuple[str, ...]:
    """How the numbers of a run are stored: counts of up to `length` bytes, ids and places."""
    return (*["<u2" if length < 1 << 16 else "<u4"] * 3, "<i8", "<i8", "<u4")


def sorted_runs(suspects: DataFrame, length: int, k: int, parts: int) -> DataFrame:
    """doc_id, text, tkey, hits (gram, at, lo, hi, hot) to rows of three kinds.

    With `part`: a front-coded sorted run of suffixes. With `first`: a string with all bytes around it that a task has
    met before goes no further, and its windows are repeats at once. With `w1`: a suffix of a hot K-gram, whose windows
    are told apart by 128-bit hashes instead, one after another from `first` on, as no task could hold all its suffixes.
    """
    width = [x.split()[0] for x in _RUN.split(", ")]
    kinds = [pa.int64(), *[pa.binary()] * 8, pa.int64(), pa.int64(), *[pa.int32()] * 3, *[pa.list_(pa.int64())] * 2]

    def table(columns: dict[str, list], n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(width, kinds, strict=True)], names=width)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            held.sort(key=lambda e: e[:3])
            met: set[tuple[bytes, bytes]] = set()
            again, hot, by = [], [], {}
            for e in held:
                if (e[7], e[8]) in met:
                    again.append((e[0], e[2], e[4], e[5]))
                    continue
                met.add((e[7], e[8]))
                hot.append(e) if e[6] else by.setdefault(e[3] % parts, []).append(e)
            held.clear()
            yield table(dict(zip(("doc_id", "tkey", "first", "last"), zip(*again, strict=True), strict=True)) if again else {}, len(again))
            coded: dict[str, list] = {c: [] for c in ("part", "rest", "left", *_NUMBERS)}
            for part, entries in by.items():
                entries.sort(key=lambda e: e[8])
                shared, rest, counts = front_coded([e[8] for e in entries])
                numbers = [shared, counts, [len(e[7]) for e in entries], [e[0] for e in entries], [e[2] for e in entries], [e[1] for e in entries]]
                for c, x in zip(coded, (part, rest, b"".join(e[7] for e in entries), *(np.array(x, np.int64).astype(kind).tobytes() for x, kind in zip(numbers, packed(length), strict=True))), strict=True):
                    coded[c].append(x)
            yield table(coded, len(by))
            for first in range(0, len(hot), 2000):
                some = hot[first : first + 2000]
                raw = [np.frombuffer(e[7] + e[8], np.uint8).astype(np.uint64) + np.uint64(1) for e in some]
                both = [[hashing.run_hashes(x, length, base).view(np.int64) for x in raw] for base in (0, 1)]
                yield table({"doc_id": [e[0] for e in some], "tkey": [e[2] for e in some], "first": [e[4] for e in some], "at": [e[1] for e in some], "w1": both[0], "w2": both[1]}, len(some))

        for batch in batches:
            for doc, text, tkey, hits in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                raw = text.encode()
                for hit in hits:
                    at, lo, hi = hit["at"], hit["lo"], hit["hi"]
                    held.append((doc, at, tkey, hit["gram"], lo, hi, hit["hot"], raw[lo:at], raw[at : hi + length]))
                if len(held) >= RUN:
                    yield from flush()
        yield from flush()

    return suspects.mapInArrow(rows, _RUN)


def classes(shared: np.ndarray, depth: int) -> np.ndarray:
    """Of sorted strings, by how many bytes each shares with the one before: one number for those that agree in `depth` bytes."""
    return np.cumsum(shared < depth)


def settled(lefts: list[bytes], rights: list[bytes], shared: np.ndarray, length: int, k: int, order: np.ndarray) -> np.ndarray:
    """For each suffix, and each count of bytes before it at which a window may begin, whether that window stands before in `order` (the suffixes' numbers by place), too.

    rights are sorted, and shared tells how many bytes neighbours have in common; the bytes before them are sorted from
    the right end. Two windows are the same if their suffixes agree in the bytes after and in those before: both are
    classes of neighbours with common prefixes of that depth.
    """
    n, most = len(rights), length - k
    before, after = np.array([len(x) for x in lefts]), np.array([len(x) for x in rights])
    turned = [x[::-1] for x in lefts]
    by = np.array(sorted(range(n), key=turned.__getitem__), np.int64)
    common = front_coded([turned[i] for i in by.tolist()])[0]
    gone = np.zeros((n, most + 1), bool)
    left = np.zeros(n, np.int64)
    for o in range(most + 1):
        left[by] = classes(common, o)
        may = order[(before[order] >= o) & (after[order] >= length - o)]
        key = left[may] * (n + 1) + classes(shared, length - o)[may]
        _, first = np.unique(key, return_index=True)
        again = np.ones(len(may), bool)
        again[first] = False
        gone[may[again], o] = True
    return gone


def repeats(runs: DataFrame, length: int, k: int) -> DataFrame:
    """doc_id, tkey, first, last: starts of windows that also start earlier, from the merged runs of each part."""

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        number = {c: [np.frombuffer(x, kind).astype(np.int64) for x in frame[c]] for c, kind in zip(_NUMBERS, packed(length), strict=True)}
        sorted_ = [(restored(shared, rest, counts), shared.tolist()) for shared, rest, counts in zip(number["shared"], frame["rest"], number["counts"], strict=True)]
        starts = np.cumsum([0] + [len(x[0]) for x in sorted_])
        merging = np.array(list(merged(sorted_)), np.int64).reshape(-1, 3)
        take, shared = starts[merging[:, 0]] + merging[:, 1], merging[:, 2]
        # Only suffixes that share their K-gram with a neighbour can hold repeats.
        with_next = np.append(shared[1:] >= k, False)
        keep = with_next | (shared >= k)
        keep[:1] = with_next[:1]
        take, shared = take[keep], shared[keep]
        shared[:1] = 0
        docs, tkeys, ats = (np.concatenate([*number[c], np.zeros(0, np.int64)])[take] for c in ("docs", "tkeys", "ats"))
        lefts = []
        for left, sizes in zip(frame["left"], number["left_counts"], strict=True):
            ends = np.cumsum(sizes).tolist()
            lefts += [left[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        rights = [x for run, _ in sorted_ for x in run]
        gone = settled([lefts[i] for i in take.tolist()], [rights[i] for i in take.tolist()], shared, length, k, np.lexsort((tkeys, ats, docs)))
        edge = np.diff(np.pad(gone, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        (row, low), (_, high) = np.nonzero(edge == 1), np.nonzero(edge == -1)
        return pd.DataFrame({"doc_id": docs[row], "tkey": tkeys[row], "first": (ats[row] - high + 1).astype(np.int32), "last": (ats[row] - low).astype(np.int32)})

    schema = "doc_id long, tkey long, first int, last int"
    met = runs.where("part is null and w1 is null").select("doc_id", "tkey", "first", "last")
    return runs.where("part is not null").select("part", "rest", "left", *_NUMBERS).groupBy("part").applyInPandas(merge, schema).union(met).union(hot_repeats(runs))


def hot_repeats(runs: DataFrame) -> DataFrame:
    """The same for suffixes of hot K-grams: each of their windows' hashes is a key of its own."""
    windows = runs.where("w1 is not null").select("doc_id", "tkey", "first", "at", F.posexplode(F.arrays_zip("w1", "w2")).alias("i", "w"))
    windows = windows.select("doc_id", "tkey", "at", (F.col("first") + F.col("i")).alias("start"), "w.w1", "w.w2")
    place = F.struct("doc_id", "at", "tkey")
    least = staged(windows.groupBy("w1", "w2").agg(F.min(place).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1"), "least")
    later = hot_join(windows, least, ["w1", "w2"]).where(place != F.col("least"))
    return later.select("doc_id", "tkey", F.col("start").alias("first"), F.col("start").alias("last"))


def cut(suspects: DataFrame, length: int, texts: bool) -> DataFrame:
    """suspects (doc_id, text, tkey, ranges of window starts) to doc_id, tkey, n_removed, n_spans, kept_sha256, kept (bytes, if asked for)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, ranges in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                raw = np.frombuffer(text.encode(), np.uint8)
                edge = np.zeros(len(raw) + 1, np.int32)
                np.add.at(edge, [r["first"] for r in ranges], 1)
                np.add.at(edge, [r["last"] + length for r in ranges], -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = raw[~gone].tobytes()
                out.append((int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept if texts else None))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array([x[i] for x in out], t) for i, t in enumerate(kinds))], names=["doc_id", "tkey", "n_removed", "n_spans", "kept_sha256", "kept"])

    return suspects.mapInArrow(rows, "doc_id long, tkey long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def dedup_bytes(docs: DataFrame, length: int = 100, k: int = K, id_col: str = "doc_id", text_col: str = "text", texts: bool = False, hot: int = GROUP) -> DataFrame:
    """Remove each byte that a string of `length` bytes covers which also starts earlier: in a smaller id, or earlier in the same document.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (the remaining bytes; null where
    nothing was removed) and tkey. Texts that repeat a whole text of a smaller id go in advance; their first copy stands
    for them. All windows of the others are assigned to their least K-gram; only suffixes at K-grams that occur again
    are sorted, and common prefixes of neighbours decide. Where a K-gram has `hot` places or more, its windows are
    compared by 128-bit hashes, so that no task gets more than that of one K-gram.

    A null text is empty, and texts shorter than `length` lose nothing. Ids are integers; rows with the same id count as
    one document's when places are compared, and equal rows of one id keep what they keep. A null id takes no part: its
    bytes stay. No rows give no rows. Other columns are left out. Very long texts are one row of work and never cut. A `length` below k is refused.
    """
    if not k <= length:
        raise ValueError(f"a string has {k} bytes at least")
    ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tkey"))
    key = ["doc_id", "tkey"]
    rows = staged(document_rows(docs, length, k).withColumn("uid", F.monotonically_increasing_id()), "documents")
    facts = staged(rows.select(*key, "n_bytes", "c1", "c2", "sha"), "facts")
    firsts = staged(facts.where((F.col("n_bytes") >= length) & F.col("doc_id").isNotNull()).groupBy("c1", "c2").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n")).where("source != high").drop("high"), "firsts")
    copies = staged(hot_join(facts.select(*key, "c1", "c2"), firsts, ["c1", "c2"]).where("doc_id > source").select(*key).distinct(), "copies")
    grams = rows.where("doc_id is not null").select("uid", "c1", F.posexplode(F.arrays_zip("gram", "at", "lo", "hi")).alias("i", "x")).select("uid", "c1", "i", "x.*")
    spot = F.xxhash64("c1", "i").alias("spot")
    repeated = staged(grams.select("gram", spot).groupBy("gram").agg(F.min("spot").alias("a"), F.max("spot").alias("b"), F.count(F.lit(1)).alias("n")).where("a != b").select("gram", "n"), "grams")
    hit = F.struct("gram", "at", "lo", "hi", (F.col("n") >= hot).alias("hot"))
    places = hot_join(grams.select("gram", "uid", "at", "lo", "hi"), repeated, ["gram"]).groupBy("uid").agg(F.collect_list(hit).alias("hits"), F.count_if(F.col("n") < hot).alias("n"))
    places = staged(rows.select("uid", *key).join(places, "uid").join(copies, key, "left_anti").dropDuplicates(key).select(*key, "hits", "n"), "places")
    unstage(repeated, firsts, rows)
    total = places.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    free_shuffles(docs.sparkSession)
    suspects = staged(docs.join(places.drop("n"), key).dropDuplicates(key).select("doc_id", "text", "tkey", "hits"), "suspects")
    unstage(places)
    runs = staged(sorted_runs(suspects, length, k, max(1, -(-total // GROUP))), "runs")
    gone = repeats(runs, length, k).groupBy(key).agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    hit = cut(suspects.drop("hits").join(gone, key).select("doc_id", "text", "tkey", "ranges"), length, texts)
    if texts:
        hit = staged(hit, "cut")
    out = facts.join(hit, key, "left").join(copies.withColumn("copy", F.lit(True)), key, "left")
    pick = lambda whole, part, none: F.when(F.col("copy"), whole).otherwise(F.coalesce(part, none))
    out = out.select(
        "doc_id",
        "n_bytes",
        pick(F.col("n_bytes"), "n_removed", F.lit(0)).cast("long").alias("n_removed"),
        pick(F.lit(1), "n_spans", F.lit(0)).cast("long").alias("n_spans"),
        pick(F.lit(hashlib.sha256(b"").hexdigest()), "kept_sha256", F.col("sha")).alias("kept_sha256"),
        F.when(F.col("copy"), F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
        "tkey",
    )
    return out if texts else out.drop("kept", "tkey")

"""Substring dedup over words: a de Bruijn graph of content-chosen word k-mers, compacted through joins, whose long repeated spans are verified window by window."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultsieve.sources.package import ship

from . import hashing
from .common import free_shuffles, hot_join, staged, unstage

#: Words in a k-mer. Of the k-mers that start in any window - K + 1 words in a row, the one with the least hash is an edge of the graph, so each window has one.
K = 20
#: Doublings when paths are compacted: paths of up to 2 ** DOUBLINGS edges become one; longer ones become several, with the same result.
DOUBLINGS = 8
_EMPTY = hashlib.sha256(b"").hexdigest()


def _columns(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The second column by runs of documents: their rows in the batch, bytes, offsets, word starts, word ends, words before each document, word hashes."""
    for first, last, data, offsets in hashing.chunks(batch.column(1)):
        starts, ends, bounds = hashing.words(data, offsets)
        yield first, last, data, offsets, starts, ends, bounds, hashing.word_hashes(data, starts, ends)


def document_rows(docs: DataFrame, window: int, k: int) -> DataFrame:
    """One row per document: doc_id, tkey, n_words, c1, c2 (the first 128 bits of sha), sha (of the words joined by one space), and its chosen k-mers as lists: kmer, at (word position), gap (from the chosen k-mer before), prev and next (that and the following link, hashed with the distance; 0 where there is none)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets, _, _, bounds, items in _columns(batch):
                raw, n = data.tobytes(), last - first
                digests = [hashlib.sha256(b" ".join(raw[a:b].split())) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                sha, both = [x.hexdigest() for x in digests], hashing.halves(digests)
                at, grams = hashing.anchors(items, bounds, k, window - k + 1)
                doc = np.searchsorted(bounds, at, "right") - 1
                gap = np.diff(at, prepend=at[:1])
                link = hashing.mix(np.append(np.uint64(0), grams)[: len(grams)] * np.uint64(3) + hashing.mix(grams + gap.astype(np.uint64)))
                link[np.diff(doc, prepend=-1) != 0] = 0
                lists = pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32))
                of = [grams.view(np.int64), (at - bounds[doc]).astype(np.int32), gap.astype(np.int32), link.view(np.int64), np.append(link[1:], np.uint64(0))[: len(link)].view(np.int64)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), batch.column(2).slice(first, n), pa.array(np.diff(bounds)), *both, pa.array(sha, pa.string()), *(pa.ListArray.from_arrays(lists, pa.array(x)) for x in of)], names=["doc_id", "tkey", "n_words", "c1", "c2", "sha", "kmer", "at", "gap", "prev", "next"])

    return docs.mapInArrow(rows, "doc_id long, tkey long, n_words long, c1 long, c2 long, sha string, kmer array<long>, at array<int>, gap array<int>, prev array<long>, next array<long>")


def compacted(repeated: DataFrame, doublings: int = DOUBLINGS) -> DataFrame:
    """kmer, path, place: k-mers with one way in and one way out join their neighbours' path, named by its first k-mer; place is the distance from there in words.

    `repeated` has kmer, next, prev, gap; next and prev are null where ways part. A link holds if it is the only way
    out of one k-mer and the only way into the other. Pointer doubling: each round, every k-mer jumps to its jump's jump.
    """
    tails = repeated.where("next is not null").select(F.col("next").alias("link"), F.col("kmer").alias("head"))
    heads = repeated.where("prev is not null").select(F.col("prev").alias("link"), "kmer", "gap")
    linked = heads.join(tails, "link").select("kmer", "head", "gap")
    up = repeated.select("kmer").join(linked, "kmer", "left").select("kmer", F.coalesce("head", "kmer").alias("path"), F.coalesce("gap", F.lit(0)).alias("place"))
    up = staged(up, "paths")
    for _ in range(doublings):
        jump = up.select(F.col("kmer").alias("path"), F.col("path").alias("further"), F.col("place").alias("more"))
        before, up = up, staged(up.join(jump, "path").select("kmer", F.col("further").alias("path"), (F.col("place") + F.col("more")).alias("place"), (F.col("further") != F.col("path")).alias("moves")), "paths")
        unstage(before)
        if up.where("moves").isEmpty():
            break
    return up.select("kmer", "path", "place")


def repeated_spans(rows: DataFrame, window: int, k: int) -> DataFrame:
    """uid (of a row), spans (array of first and last word position + 1): one span for each occurrence of a compacted path, wide enough for every window that holds one of its k-mers. A window that starts in two different texts is within a span of both."""
    edges = rows.select("uid", F.col("c1").alias("content"), F.inline(F.arrays_zip("kmer", "at", "gap", "prev", "next")))
    only = lambda c: F.when((F.min(c) == F.max(c)) & (F.min(c) != 0), F.min(c)).alias(c)
    repeated = edges.groupBy("kmer").agg(only("next"), only("prev"), F.min("gap").alias("gap"), F.min("content").alias("low"), F.max("content").alias("high"), F.count(F.lit(1)).alias("n"))
    repeated = staged(repeated.where("low != high").drop("low", "high"), "repeated")
    paths = staged(compacted(repeated).join(repeated.select("kmer", "n"), "kmer"), "compacted")
    seen = hot_join(edges.select("kmer", "uid", "at"), paths, ["kmer"]).drop("n")
    paths = seen.groupBy("uid", "path", (F.col("at") - F.col("place")).alias("along")).agg(F.min("at").alias("first"), F.max("at").alias("last"))
    span = F.struct(F.greatest(F.col("first") - (window - k), F.lit(0)).alias("first"), (F.col("last") + window).alias("last"))
    return paths.groupBy("uid").agg(F.collect_list(span).alias("spans"))


def window_rows(suspects: DataFrame, window: int) -> DataFrame:
    """doc_id, tkey, h1, h2 (128 bits of a window's words, each half of hashes of its own), ats (where it starts in the document): one row for each document and distinct window in its spans, so that a word said a thousand times is no thousand rows."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            keys, spans = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_pylist()
            for first, last, data, _, starts, ends, bounds, items in _columns(batch):
                if len(items) < window:
                    continue
                keep = np.zeros(len(items) - window + 1, bool)
                for doc in range(last - first):
                    for span in spans[first + doc]:
                        keep[bounds[doc] + span["first"] : max(0, min(bounds[doc] + span["last"], bounds[doc + 1]) - window + 1)] = True
                at = np.flatnonzero(keep)
                doc = np.searchsorted(bounds, at, "right") - 1
                h1, h2 = (hashing.run_hashes(x, window, base)[at] for base, x in enumerate((items, hashing.word_hashes(data, starts, ends, 1))))
                order = np.lexsort((h2, h1, doc))
                at, doc, h1, h2 = (x[order] for x in (at, doc, h1, h2))
                new = np.ones(len(at), bool)
                new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (doc[1:] != doc[:-1])
                starts = np.flatnonzero(new)
                ats = pa.ListArray.from_arrays(pa.array(np.append(starts, len(at)).astype(np.int32)), pa.array((at - bounds[doc]).astype(np.int32)))
                own = first + doc[starts]
                yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(keys[own]), pa.array(h1[starts].view(np.int64)), pa.array(h2[starts].view(np.int64)), ats], names=["doc_id", "tkey", "h1", "h2", "ats"])

    return suspects.mapInArrow(rows, "doc_id long, tkey long, h1 long, h2 long, ats array<int>")


def cut(suspects: DataFrame, window: int, texts: bool) -> DataFrame:
    """suspects (doc_id, text, tkey, starts of removed windows) to doc_id, tkey, n_removed, kept_sha256 and, if asked for, kept_text (words joined by one space)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, starts in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                parts = (text or "").encode().split()
                edge = np.zeros(len(parts) + 1, np.int32)
                starts = np.unique(np.array(starts, np.int64))
                edge[starts] += 1
                edge[starts + window] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                kept = b" ".join([w for w, g in zip(parts, gone.tolist(), strict=True) if not g])
                out.append((int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if texts else None))
            removed, sha, kept = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())], names=["doc_id", "tkey", "n_removed", "kept_sha256", "kept_text"])

    return suspects.mapInArrow(rows, "doc_id long, tkey long, n_removed long, kept_sha256 string, kept_text string")


def dedup_substrings(docs: DataFrame, window: int = 50, k: int = K, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """Remove each word that a window of `window` words covers which also starts in a document with a smaller id.

    1. Chosen k-mers of all documents are edges of a de Bruijn graph; a k-mer that only one text (or exact copies of
       it) holds is no repeat. Nonbranching repeated paths are compacted by pointer-doubling joins.
    2. A document's path occurrences, widened by window - k words, are its suspect spans.
    3. Every window in a span is verified by its source coordinates: 128-bit hashes of its words, whose least id is
       found by an aggregate, tell whether it starts in a smaller document.

    Documents that repeat a whole word sequence of a smaller id go as a whole in advance; their first copy stands for
    them. Returns doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text (null where nothing was
    removed) and tkey (the text's xxhash64, which tells rows of one id apart).

    Ids are integers. Rows with the same id are documents of their own, but never remove each other's words. A null id takes no part: its words stay. Null
    and empty texts have no words; texts shorter than a window lose none. No rows give no rows. Other columns are left
    out. Very long texts are one row of work and never cut.
    """
    ship(docs.sparkSession)
    text = F.col(text_col).cast("string")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tkey"))
    key = ["doc_id", "tkey"]
    rows = staged(document_rows(docs, window, k).withColumn("uid", F.monotonically_increasing_id()), "documents")
    facts, rows = rows.select(*key, "n_words", "c1", "c2", "sha"), rows.where("doc_id is not null")
    firsts = staged(facts.where((F.col("n_words") >= window) & F.col("doc_id").isNotNull()).groupBy("c1", "c2").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n")).where("source != high").drop("high"), "firsts")
    copies = staged(hot_join(facts.select(*key, "c1", "c2"), firsts, ["c1", "c2"]).where("doc_id > source").select(*key).distinct(), "copies")
    spans = rows.select("uid", *key).join(repeated_spans(rows, window, k), "uid").drop("uid").join(copies, key, "left_anti").dropDuplicates(key)
    suspects = staged(docs.join(spans, key).select("doc_id", "text", "tkey", "spans"), "suspects")
    free_shuffles(docs.sparkSession)
    windows = staged(window_rows(suspects, window), "windows")
    least = staged(windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n")).where("source != high").drop("high"), "least")
    gone = hot_join(windows, least, ["h1", "h2"]).where("doc_id > source").groupBy(key).agg(F.flatten(F.collect_list("ats")).alias("starts"))
    hit = cut(suspects.drop("spans").join(gone, key).select("doc_id", "text", "tkey", "starts"), window, texts).dropDuplicates(key)
    if texts:
        hit = staged(hit, "cut")
    out = facts.join(hit, key, "left").join(copies.withColumn("copy", F.lit(True)), key, "left")
    out = out.select(
        "doc_id",
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.lit(_EMPTY)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(F.col("copy"), F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
        "tkey",
    )
    return out if texts else out.drop("kept_text", "tkey")

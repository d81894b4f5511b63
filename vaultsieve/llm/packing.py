"""Packing token ids into sequences of one length: concatenate and cut."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vaultsieve.sources.package import ship

from .common import staged

#: Words whose ids a task remembers; beyond that it forgets all and goes on.
REMEMBERED = 400_000
_PUNCTUATION = frozenset(b"!\"#$%&()*+,-./:;=?@[]^_`{}~")


class WordIds(dict):
    """The ids, as little-endian unsigned 32-bit bytes, of a word without white space. The tokenizer splits at white space first, so a text's ids are its words' ids in order."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        # The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from 256 on.
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in own]
        self.alphabet = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}
        # Letters of the Latin blocks go straight to the model if that gives what the whole tokenizer gives for a sample.
        sample = "Straßenbahnéñü"
        self.direct = self._letters(sample.lower()) == self.whole.encode(sample, add_special_tokens=False).ids

    def _letters(self, word: str) -> list[int]:
        shown = word if word.isascii() else "".join(map(self.alphabet.__getitem__, word.encode()))
        return [x.id for x in self.model.tokenize(shown)]

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        text = word.decode()
        if self.direct and text.isalpha() and max(text) < "\u0250" and "\u0130" not in text:
            low = text.lower()
            ids = self[low.encode()] if low != text else np.array(self._letters(text), dtype="<u4").tobytes()
        elif len(text) > 1 and word[-1] in _PUNCTUATION and (text[-2].isalpha() and text[-2] != "\u0130" or word[-2:-1].isdigit()):
            ids = self[word[:-1]] + self[word[-1:]]  # a mark behind a letter or digit is a token of its own
        else:
            ids = np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        self[word] = ids
        return ids


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, part (the task that made it), before (ids of that task before this document's), n, ids (little-endian unsigned 32-bit)."""
    last = np.array([end_id], dtype="<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part, before = WordIds(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                piece = batch.slice(first, 500)
                ids = [b"".join(map(ids_of.__getitem__, (text or "").encode().split())) + last for text in piece.column(1).to_pylist()]
                counts = np.array([len(x) // 4 for x in ids], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(np.full(len(ids), part)), pa.array(before + np.cumsum(counts) - counts), pa.array(counts), pa.array(ids, pa.binary())], names=["doc_id", "part", "before", "n", "ids"])
                before += int(counts.sum())

    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(encode, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, part long, before long, n long, ids binary")


def pack(docs: DataFrame, tokenizer: str, length: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Cut the concatenated ids of all documents, each followed by end_id, at every multiple of `length`.

    The first pass tokenizes and writes ids with running totals within each task. Sums of the tasks' totals give
    global offsets (one row per task: that table is broadcast). The second pass cuts documents at the boundaries:
    one row per piece with doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded (the sequence's
    size: `length`; the last one's the least power of two that holds it) and, if asked for, ids.

    A null or empty text is the end id alone. A long document is cut into many pieces. Repeated rows and null ids are
    documents of their own; no rows give no pieces. Other columns are left out. The order of documents is the order
    in which Spark reads them, fixed once the first pass is written.
    """
    ship(docs.sparkSession)
    tokens = staged(tokenized(docs, tokenizer, end_id, id_col, text_col), "pack-ids")
    totals = tokens.groupBy("part").agg(F.sum("n").alias("n"))
    run = Window.orderBy("part")
    totals = totals.select("part", (F.sum("n").over(run) - F.col("n")).alias("base"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("total"))
    at = tokens.join(F.broadcast(totals), "part").withColumn("first", F.col("base") + F.col("before"))
    at = at.withColumn("sequence_id", F.explode(F.sequence(F.floor(F.col("first") / length), F.floor((F.col("first") + F.col("n") - 1) / length))))
    at = at.withColumn("start", F.greatest(F.lit(0), F.col("sequence_id") * length - F.col("first")))
    at = at.withColumn("length", F.least(F.col("n"), (F.col("sequence_id") + 1) * length - F.col("first")) - F.col("start"))
    ids = F.col("ids").substr((F.col("start") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int"))
    rest = F.col("total") - F.col("sequence_id") * length
    padded = F.when(rest >= length, F.lit(length)).otherwise(F.pow(F.lit(2.0), F.length(F.bin(rest - 1)) - (rest == 1).cast("int")))
    return at.select(
        "doc_id",
        "start",
        "length",
        F.crc32(ids).alias("ids_crc32"),
        F.col("n").alias("doc_tokens"),
        "sequence_id",
        (F.col("first") + F.col("start") - F.col("sequence_id") * length).alias("offset"),
        padded.cast("long").alias("padded"),
        *([ids.alias("ids")] if with_ids else []),
    )

"""A corpus pipeline: each stage calls one operator, its rows are written as Parquet and read again as the next stage's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultsieve.llm import minhash, mixing, packing, substrings, toxicity
from vaultsieve.llm.common import staged, table
from vaultsieve.llm.queries import tokenizer_path

#: A stage learns or compares, so SQL can't express the whole; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels table."""
    scores = toxicity.score(docs, table(spark, sf_dir, "labels"), carry=docs.columns)
    return scores.where("predicted = 0").select("carried.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) one row stays: of the smallest doc_id (null is the largest), then of the smallest text hash, then the smallest of rows equal in both."""
    found = minhash.near_duplicates(docs, roots=True).where("root is not null")
    keys = staged(found.groupBy("doc_id", "tkey").agg(F.first("root").alias("root"), F.count(F.lit(1)).alias("n")), "near-keys")
    one = keys.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "tkey")).alias("one"))
    stays = F.col("doc_id").eqNullSafe(F.col("one.doc_id")) & (F.col("tkey") == F.col("one.tkey"))
    judged = keys.join(one, "root").select(F.col("doc_id").alias("found_id"), F.col("tkey").alias("found_key"), "n", stays.alias("stays"))
    same = F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.xxhash64(F.col("text")) == F.col("found_key"))
    left = docs.join(judged.where("not stays"), same, "left_anti")
    repeated = judged.where("stays and n > 1")
    if repeated.isEmpty():
        return left
    rows = left.join(repeated, same, "left_semi").groupBy("doc_id", F.xxhash64("text")).agg(F.min(F.struct(*docs.columns)).alias("row"))
    return left.join(repeated, same, "left_anti").union(rows.select("row.*"))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages of 50 words or more that a smaller doc_id holds, too, go. A text that loses words is then its other words joined by one space, and n_chars follows; a document that loses all words goes."""
    cut = substrings.dedup_substrings(docs, texts=True).where("n_removed > 0").select(F.col("doc_id").alias("cut_id"), F.col("tkey").alias("cut_key"), "kept_text").dropDuplicates(["cut_id", "cut_key"])
    same = (F.col("doc_id") == F.col("cut_id")) & (F.xxhash64(F.col("text")) == F.col("cut_key"))
    joined = docs.join(cut, same, "left").where("kept_text is null or kept_text != ''")
    return joined.withColumn("text", F.coalesce("kept_text", "text")).withColumn("n_chars", F.when(F.col("kept_text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document stays as often as the mix takes it."""
    taken = mixing.mix_sources(docs, carry=docs.columns).where("copies > 0")
    return taken.select("carried", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("carried.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 4096 ids: one row per piece."""
    return packing.pack(docs, tokenizer_path()).drop("padded")


STAGES = [("toxicity", drop_toxic), ("minhash_near_dedup", drop_near_duplicates), ("substring_dedup", drop_repeated_passages), ("mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

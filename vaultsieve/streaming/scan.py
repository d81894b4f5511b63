"""Scanning what lands: the same column functions on a stream, which need no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultsieve.operators import detect, lines


def text_stream(spark: SparkSession, folder: str) -> DataFrame:
    """file, text of whole files as they land."""
    return spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").load(folder).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def findings(texts: DataFrame) -> DataFrame:
    return detect.scan_lines(lines.number_lines(texts.select("file", "text"), "text"))


def counts_by_time(found: DataFrame, at: str, every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Findings by severity in windows of event time; later events than the watermark are left out."""
    return found.withWatermark(at, late).groupBy(F.window(at, every), "severity").agg(F.count(F.lit(1)).alias("n"))

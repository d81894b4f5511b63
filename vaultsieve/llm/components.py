"""Connected components by joins: each round hooks labels to the least neighbouring label and jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, unstage


def components(links: DataFrame) -> DataFrame:
    """links (a, b: long) to (id, component) for every id in a link: the least id that links reach.

    Each round takes the least label among an id's neighbours and its own, by one aggregate that combines before the
    shuffle, then replaces labels by their labels. Rounds end when no label changes; each is written to the shared
    folder, which cuts the lineage. Loops are harmless; repeated links count once; no links give no rows.
    """
    both = staged(links.select("a", "b").union(links.select("b", "a")).where("a != b").distinct(), "links")
    labels = staged(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").select(F.col("a").alias("id"), "component", F.lit(False).alias("own"))
        every = near.union(labels.select("id", "component", F.lit(True)))
        hooked = every.groupBy("id").agg(F.min("component").alias("low"), F.max(F.when(F.col("own"), F.col("component"))).alias("component"))
        to = labels.select(F.col("id").alias("low"), F.col("component").alias("further"))
        fresh = staged(hooked.join(to, "low").select("id", "further", (F.col("further") != F.col("component")).alias("moved")), "labels")
        unstage(labels)
        labels = fresh.select("id", F.col("further").alias("component"))
        if fresh.where("moved").isEmpty():
            unstage(both)
            return labels

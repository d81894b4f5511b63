"""Shared by the operators: word rules, scratch tables and column picking."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultsieve.sources.package import ship

#: A word: a longest run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it. Only a session in local mode, where one process does all, gets a temporary folder if that is unset."""
    sc = spark.sparkContext
    if named := sc.getConf().get("spark.checkpoint.dir"):
        return named
    if (java := sc._jsc.sc().getCheckpointDir()).isDefined():
        return java.get()
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="vaultsieve-"))
    return sc._jsc.sc().getCheckpointDir().get()


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: what follows neither recomputes it nor depends on the executors that made it."""
    ship(df.sparkSession)
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstage(*tables: DataFrame) -> None:
    """Delete what staged() wrote, once nothing that is still to run reads it."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        for file in df.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that are done, which it else does at the driver's next collection of garbage, however late that is. The last job's files stay."""
    spark.sparkContext._jvm.System.gc()


#: Rows of a key that make it hot, and hot keys that are broadcast at most: those of the most rows.
HOT, MOST = 1000, 10_000


def hot_join(rows: DataFrame, keyed: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """rows.join(keyed, on, how), inner or left, where keyed (a written table) has a key once, and as `n` how many of the rows hold it.

    The at most MOST hottest keys are broadcast, so their rows stay where they are; no other key can hold more than
    one row in MOST.
    """
    hot = staged(keyed.where(F.col("n") >= HOT).orderBy(F.desc("n"), *on).limit(MOST), "hot-keys")
    none = hot.isEmpty()
    free_shuffles(rows.sparkSession)
    if none:
        return rows.join(keyed, on, how)
    names = F.broadcast(hot.select(*on))
    cold = rows.join(names, on, "left_anti").join(keyed.join(names, on, "left_anti"), on, how)
    return cold.unionByName(rows.join(F.broadcast(hot), on))


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")

"""Training records as JSON lines, and sinks for records and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vaultsieve.operators import dataset

SCHEMA = T.StructType([
    T.StructField("token", T.StringType()), T.StructField("line_content", T.StringType()), T.StructField("context_before", T.ArrayType(T.StringType())), T.StructField("context_after", T.ArrayType(T.StringType())),
    T.StructField("label", T.IntegerType()), T.StructField("file_path", T.StringType()), T.StructField("secret_type", T.StringType()), T.StructField("negative_type", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("_corrupt_record", T.StringType()),
])


def read(spark: SparkSession, path: str, skip_invalid: bool = True) -> DataFrame:
    """Records of JSON lines. Lines that can't be read or lack a field are skipped, or stop the job if they are not to be."""
    rows = spark.read.schema(SCHEMA).option("mode", "PERMISSIVE" if skip_invalid else "FAILFAST").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    valid = F.col("_corrupt_record").isNull() & (F.size(dataset.errors(F.lit(0))) == 0)
    return rows.where(valid if skip_invalid else F.when(valid, True).otherwise(F.raise_error(F.lit("a record is not valid")).cast("boolean"))).drop("_corrupt_record")


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).json(path)


def write(rows: DataFrame, path: str, with_tokens: bool = True) -> None:
    (rows if with_tokens else rows.drop("token")).write.mode("overwrite").json(path)


def manifest(files: DataFrame) -> DataFrame:
    """file name and SHA-256 of files with content."""
    return files.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.sha2("content", 256).alias("sha256"))


def altered(files: DataFrame, known: DataFrame) -> DataFrame:
    """Names whose content is not what the manifest `known` (name, sha256) says, or that are missing on either side."""
    seen = manifest(files).withColumnRenamed("sha256", "seen")
    return seen.join(known, "name", "full_outer").where(~F.col("seen").eqNullSafe(F.col("sha256"))).select("name", "sha256", "seen")

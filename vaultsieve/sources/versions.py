"""Sinks that may be tried again: stream batches that are written once, and models with their configuration as one version.

What a reader sees is named by a small file that is written last. Spark's own file systems do the writing, so any store that
Spark reaches will do.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, folder: str) -> bool:
    path, files = _files(spark, folder)
    return files.exists(path)


def _put(spark: SparkSession, folder: str, name: str, text: str) -> None:
    """A small file, which comes into being whole or not at all."""
    path, files = _files(spark, folder)
    files.mkdirs(path)
    jvm = spark._jvm
    part, whole = jvm.org.apache.hadoop.fs.Path(path, f".{name}.part"), jvm.org.apache.hadoop.fs.Path(path, name)
    out = files.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not files.rename(part, whole):
        files.delete(part, False)
        if not files.exists(whole):
            raise OSError(f"{whole} could not be written")


# Stream batches.


def batch_writer(folder: str, columns: tuple[str, ...] | None = None) -> Callable[[DataFrame, int], None]:
    """For writeStream.foreachBatch: each batch goes to a folder of its own by its number, and counts once a file with its number is there. A batch that comes again writes nothing; one that broke off is written over."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if _exists(spark, f"{folder}/commits/{number}"):
            return
        rows = batch.select(*columns) if columns else batch
        rows.write.mode("overwrite").json(f"{folder}/batches/{number}")
        _put(spark, f"{folder}/commits", str(number), json.dumps({"batch": number}))

    return write


def committed(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches that count."""
    path, files = _files(spark, f"{folder}/commits")
    if not files.exists(path):
        return []
    return sorted(int(name) for x in files.listStatus(path) if (name := x.getPath().getName()).isdigit())


def read_batches(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Rows of all batches that count, with the number of each; a batch that broke off isn't read."""
    numbers = committed(spark, folder)
    if not numbers:
        return spark.createDataFrame([], f"{schema}, batch long")
    rows = spark.read.schema(schema).json([f"{folder}/batches/{n}" for n in numbers])
    return rows.withColumn("batch", F.regexp_extract(F.input_file_name(), r"/batches/(\d+)/", 1).cast("long"))


# Models.


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """name (below the folder), sha256 of all its files, hashed by tasks."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_extract("path", f"/{re.escape(folder.rstrip('/').rpartition('/')[2])}/((?:models|config)/.*)$", 1)
    return files.select(name.alias("name"), F.sha2("content", 256).alias("sha256")).where("name != ''")


def save_version(spark: SparkSession, root: str, version: str, models: Mapping[str, PipelineModel], config: Mapping) -> str:
    """Models by name and a one-row configuration under root/version, and at last the manifest of their files' digests. A version that is there already stays as it is; one that broke off before its manifest is written anew."""
    folder = f"{root}/{version}"
    if _exists(spark, f"{folder}/manifest.json"):
        raise FileExistsError(f"version {version} is there already")
    for name, model in models.items():
        model.write().overwrite().save(f"{folder}/models/{name}")
    line = json.dumps({"version": version, "models": sorted(models), **config}, sort_keys=True)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/config")
    found = {r["name"]: r["sha256"] for r in digests(spark, folder).collect()}  # a model's few files
    _put(spark, folder, "manifest.json", json.dumps(found, sort_keys=True))
    return folder


def versions(spark: SparkSession, root: str) -> list[str]:
    """Versions that are whole, by name."""
    path, files = _files(spark, root)
    if not files.exists(path):
        return []
    names = [x.getPath().getName() for x in files.listStatus(path) if x.isDirectory()]
    return sorted(n for n in names if _exists(spark, f"{root}/{n}/manifest.json"))


def load_version(spark: SparkSession, root: str, version: str | None = None) -> tuple[dict[str, PipelineModel], dict]:
    """Models and configuration of a version, or of the last whole one. A file that is missing, new or not as its digest says stops it."""
    named = version or next(iter(reversed(versions(spark, root))), None)
    folder = f"{root}/{named}"
    if named is None or not _exists(spark, f"{folder}/manifest.json"):
        raise FileNotFoundError(f"no whole version {version or ''} under {root}")
    known = json.loads("".join(r["value"] for r in spark.read.text(f"{folder}/manifest.json").collect()))
    found = {r["name"]: r["sha256"] for r in digests(spark, folder).collect()}
    if known != found:
        raise ValueError(f"version {named} is not as written: {sorted(k for k in known.keys() | found.keys() if known.get(k) != found.get(k))}")
    config = json.loads(spark.read.text(f"{folder}/config").first()["value"])
    return {name: PipelineModel.load(f"{folder}/models/{name}") for name in config["models"]}, config

"""Trees of files as tables: folders are listed by tasks, a round for each level, and tasks open the files.

The driver holds the roots and, of each round, one number. Entries of a folder are read one after another by one task,
in batches; folders are dealt over the tasks. A round is kept in the folder of `spark.checkpoint.dir`, so that a lost executor's
folders are not listed anew in every later round.
"""

from __future__ import annotations

import os
import posixpath
import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultsieve.sources.package import ship

#: Entries of a batch of a listing, bytes of a batch of contents, and what opening a file costs in bytes.
ENTRIES, BYTES, OPEN = 10_000, 4 * 2**20, 4 * 2**20
_ENTRY = "path string, length long, kind string"


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share; only a session in local mode gets a temporary one if none is set."""
    sc = spark.sparkContext
    if named := sc.getConf().get("spark.checkpoint.dir"):
        return named
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="vaultsieve-"))
    return sc._jsc.sc().getCheckpointDir().get()


def _kept(df: DataFrame) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/listing-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path as scans name it, and the path there: local ones are plain, others are URIs."""
    return (pyarrow.fs.LocalFileSystem(), path[5:]) if path.startswith("file:") else pyarrow.fs.FileSystem.from_uri(path)


def entries(folder: str) -> Iterator[tuple[str, int | None, str]]:
    """path, length, kind (file, folder, unreadable) of what a folder holds. Links are left out, and so is what is neither file nor folder."""
    try:
        if folder.startswith("file:"):
            with os.scandir(folder[5:]) as found:
                for x in found:
                    if x.is_symlink():
                        continue
                    if x.is_dir(follow_symlinks=False):
                        yield "file:" + x.path, None, "folder"
                    elif x.is_file(follow_symlinks=False):
                        try:
                            yield "file:" + x.path, x.stat(follow_symlinks=False).st_size, "file"
                        except FileNotFoundError:  # gone since
                            continue
        else:
            system, at = pyarrow.fs.FileSystem.from_uri(folder)
            head = folder[: len(folder) - len(at.lstrip("/"))] if folder.endswith(at.lstrip("/")) else folder.split("://", 1)[0] + "://"
            for x in system.get_file_info(pyarrow.fs.FileSelector(at, recursive=False)):
                if x.type in (pyarrow.fs.FileType.File, pyarrow.fs.FileType.Directory):
                    is_file = x.type == pyarrow.fs.FileType.File
                    yield head + x.path.lstrip("/"), x.size if is_file else None, "file" if is_file else "folder"
    except FileNotFoundError:
        return
    except OSError:
        yield folder, None, "unreadable"


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], names=["path", "length", "kind"])

    rows: list = []
    for batch in batches:
        for folder in batch.column(0).to_pylist():
            for entry in entries(folder):
                rows.append(entry)
                if len(rows) == ENTRIES:
                    yield made(rows)
                    rows = []
    yield made(rows)


def _root(spark: SparkSession, root: str) -> tuple[str, int | None, str] | None:
    """A root as scans name it, with its length if it is a file; nothing if it doesn't exist."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(root)
    system = at.getFileSystem(conf)
    if not system.exists(at):
        return None
    status, uri = system.getFileStatus(at), at.makeQualified(system.getUri(), system.getWorkingDirectory()).toUri()
    name = f"file:{uri.getPath()}" if uri.getScheme() == "file" else uri.toString()
    return (name, None, "folder") if status.isDirectory() else (name, status.getLen(), "file")


def tree(spark: SparkSession, roots: str | Sequence[str], recursive: bool = True, wanted: Column | None = None) -> DataFrame:
    """path, length, kind of the files below the roots, and of folders that could not be read (kind `unreadable`).

    Roots that don't exist are left out, as are links; names that begin with a dot or an underscore are not. With
    `wanted`, a condition on path, folders and files for which it is not true are left out, and such folders never listed.
    """
    ship(spark)
    found = [x for x in (_root(spark, r) for r in ([roots] if isinstance(roots, str) else roots)) if x]
    rounds = [spark.createDataFrame([x for x in found if x[2] == "file"], _ENTRY)]
    level, count = spark.createDataFrame([x for x in found if x[2] == "folder"], _ENTRY), sum(x[2] == "folder" for x in found)
    most = 4 * spark.sparkContext.defaultParallelism
    while count:
        listed = level.select("path").repartition(min(count, most), "path").mapInArrow(_list, _ENTRY)
        if wanted is not None:
            listed = listed.where(wanted | (F.col("kind") == "unreadable"))
        listed = _kept(listed)
        rounds.append(listed.where("kind != 'folder'"))
        level = listed.where("kind = 'folder'")
        count = level.count() if recursive else 0
    out = rounds[0]
    for x in rounds[1:]:
        out = out.unionByName(x)
    return out


def contents(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """path, length, content of listed files (path, length): tasks of about `spark.sql.files.maxPartitionBytes` open them. The content is null of files beyond max_bytes and of those that may not be read; files that are gone since are left out."""
    spark = files.sparkSession
    ship(spark)
    total, count = files.agg(F.coalesce(F.sum(F.col("length") + OPEN), F.lit(0)), F.count(F.lit(1))).first()
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    parts = max(1, min(count, max(-(-total // size), spark.sparkContext.defaultParallelism)))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.binary()))], names=["path", "length", "content"])

        rows, held = [], 0
        for batch in batches:
            for path, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                content = None
                if max_bytes is None or length <= max_bytes:
                    system, at = opened(path)
                    try:
                        with system.open_input_stream(at) as stream:
                            content = stream.read()
                    except FileNotFoundError:
                        continue
                    except PermissionError:
                        pass
                rows.append((path, length, content))
                held += len(content or b"")
                if held >= BYTES:
                    yield made(rows)
                    rows, held = [], 0
        yield made(rows)

    return files.select("path", "length").repartition(parts, "path").mapInArrow(fetch, "path string, length long, content binary")


def write_tree(files: DataFrame, folder: str) -> int:
    """Write each row (file, content) as a file of that relative path below the folder, which all executors must reach; returns how many. A file comes into being whole, so that tasks that are tried again do no harm. Paths that lead out of the folder are refused."""
    spark = files.sparkSession
    ship(spark)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    uri = at.makeQualified(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri(), jvm.org.apache.hadoop.fs.Path("/")).toUri()
    root = f"file:{uri.getPath()}" if uri.getScheme() == "file" else uri.toString()

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(root)
        part = f"{base}-parts/{uuid.uuid4().hex}/part"  # beside the folder, where what a lost task leaves is no file of the tree; each task has a folder of its own, as a folder takes one entry at a time
        for above in (base, part.rsplit("/", 1)[0]):
            system.create_dir(above, recursive=True)
        made = {base}

        def enter(above: str) -> None:
            """Make a folder, from the top down, so that none is tried whose parent isn't there."""
            if above not in made:
                enter(above.rsplit("/", 1)[0])
                system.create_dir(above, recursive=False)
                made.add(above)

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name.startswith("/") or ".." in name.split("/"):
                    raise ValueError(f"{name} leads out of the folder")
                whole = posixpath.normpath(f"{base}/{name}")
                enter(whole.rsplit("/", 1)[0])
                with system.open_output_stream(part) as out:
                    out.write(content or b"")
                system.move(part, whole)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return files.select("file", F.col("content").cast("binary")).mapInArrow(put, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

"""Files as rows: whole trees, lists of paths, and what is left out on the way."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultsieve.operators import detect, lines, paths
from vaultsieve.operators.context import contexts
from vaultsieve.sources import listing
from vaultsieve.sources.package import ship

SCHEMA = "path string, length long, content binary"
#: One well-formed UTF-8 sequence, of bytes as Latin-1 characters, or any one character.
_SEQUENCE = (
    r"(?s)([\x00-\x7F]|[\xC2-\xDF][\x80-\xBF]|\xE0[\xA0-\xBF][\x80-\xBF]|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}|\xED[\x80-\x9F][\x80-\xBF]"
    r"|\xF0[\x90-\xBF][\x80-\xBF]{2}|[\xF1-\xF3][\x80-\xBF]{3}|\xF4[\x80-\x8F][\x80-\xBF]{2})|."
)


def _roots(roots: str | Sequence[str]) -> list[str]:
    return [roots] if isinstance(roots, str) else list(roots)


def _hadoop(spark: SparkSession, path: str):
    """A path as Hadoop names it, and its file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return at.makeQualified(system.getUri(), system.getWorkingDirectory()), system


def _exists(spark: SparkSession, path: str) -> bool:
    at, system = _hadoop(spark, path)
    return system.exists(at)


def links(spark: SparkSession, roots: Sequence[str], recursive: bool = True) -> list[str]:
    """Symbolic links below local roots, as the scan names paths. Stores that are not local have none."""
    found = []
    for root in roots:
        at, _ = _hadoop(spark, root)
        if at.toUri().getScheme() == "file":
            for folder, folders, names in os.walk(at.toUri().getPath()):
                found += [f"file:{os.path.join(folder, n)}" for n in [*folders, *names] if os.path.islink(os.path.join(folder, n))]
                if not recursive:
                    break
    return found


def is_linked(path: Column, known: Sequence[str]) -> Column:
    """Whether a path is one of these links or lies behind one."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.arrays_overlap(above, F.array(*[F.lit(x) for x in known])) if known else F.lit(False)


def _is_hidden(path: str) -> bool:
    return any(x.startswith((".", "_")) for x in path.split("/"))


def _named(spark: SparkSession, path: str) -> tuple[pyarrow.fs.FileSystem, str, str]:
    """A path's file system for Arrow, the path there, and what comes before it in the names that Spark gives."""
    uri = _hadoop(spark, path)[0].toUri()
    system, at = pyarrow.fs.FileSystem.from_uri(uri.toString())
    return system, at, "file:" if uri.getScheme() == "file" else f"{uri.getScheme()}://"


def hidden_files(spark: SparkSession, listed: list[tuple[str, int]], max_bytes: int, extra_ignored: str | None) -> DataFrame:
    """path, length, content (null beyond max_bytes) of listed files, which tasks open by Arrow's file systems."""
    ship(spark)
    rows = spark.createDataFrame(listed, "path string, length long")
    if extra_ignored is not None:
        rows = rows.where(paths.is_scanned(F.col("path"), extra_ignored))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                content = None
                if length <= max_bytes:
                    local = path.startswith("file:")
                    system, at = (pyarrow.fs.LocalFileSystem(), path[5:]) if local else pyarrow.fs.FileSystem.from_uri(path)
                    with system.open_input_stream(at) as stream:
                        content = stream.read()
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([length], pa.int64()), pa.array([content], pa.binary())], names=["path", "length", "content"])

    return rows.mapInArrow(fetch, SCHEMA)


def read_tree(spark: SparkSession, roots: str | Sequence[str], recursive: bool = True, extra_ignored: str | None = None, max_bytes: int = 10 * 1024 * 1024) -> DataFrame:
    """path, length, content of all files below the roots that exist; links are left out.

    With extra_ignored (a list of patterns, perhaps empty), files that the path rules leave out are dropped from the
    listing, so that they are never opened. Spark's readers skip names that begin with a dot or an underscore, where
    credentials often are: those are listed by the driver and opened by tasks, without content if larger than max_bytes.
    """
    there = [x for x in _roots(roots) if _exists(spark, x)]
    if not there:
        return spark.createDataFrame([], SCHEMA)
    hidden = []
    for system, at, head in (_named(spark, x) for x in there):
        for info in system.get_file_info(pyarrow.fs.FileSelector(at, recursive=recursive)) if system.get_file_info(at).type == pyarrow.fs.FileType.Directory else []:
            if info.type == pyarrow.fs.FileType.File and _is_hidden(info.path[len(at) :]):
                hidden.append((head + info.path, info.size))
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("ignoreMissingFiles", "true")
    files = reader.load(there)
    if extra_ignored is not None:
        # The path as the listing has it is an encoded URI, and a condition on it alone prunes the listing.
        listed = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
        files = files.where(paths.is_scanned(listed, extra_ignored))
    files = files.select("path", "length", "content")
    if hidden:
        files = files.unionByName(hidden_files(spark, hidden, max_bytes, extra_ignored))
    if known := links(spark, there, recursive):
        files = files.where(~is_linked(F.regexp_replace("path", "^file:/+", "file:/"), known))
    return files


def scannable(files: DataFrame, extra_ignored: str = "", max_bytes: int = 10 * 1024 * 1024) -> DataFrame:
    """Files that a scan reads: by path and size first, so that contents of larger files are never fetched, then without binary ones."""
    kept = files.where(paths.is_scanned(F.col("path"), extra_ignored) & paths.within_size(F.col("length"), max_bytes))
    return kept.where(~lines.looks_binary(F.col("content")))


def errors(files: DataFrame, extra_ignored: str = "", max_bytes: int = 10 * 1024 * 1024) -> DataFrame:
    """path, error of files that would be scanned but are too large."""
    return files.where(paths.is_scanned(F.col("path"), extra_ignored) & ~paths.within_size(F.col("length"), max_bytes)).select("path", F.concat(F.lit("Skipped large file: "), "path").alias("error"))


def missing(spark: SparkSession, named: str | Sequence[str], what: str) -> DataFrame:
    """path, error of the paths that don't exist."""
    return spark.createDataFrame([(x, f"{what}: {x}") for x in _roots(named) if not _exists(spark, x)], "path string, error string")


def scan_errors(spark: SparkSession, roots: str | Sequence[str], recursive: bool = True, extra_ignored: str = "", max_bytes: int = 10 * 1024 * 1024) -> DataFrame:
    """path, error of what a scan of the roots leaves out without being told to: roots that don't exist, files that are too large and folders that can't be read. No file is opened."""
    listed = listing.tree(spark, roots, recursive, paths.is_entered(F.col("path"), extra_ignored))
    unread = listed.where("kind = 'unreadable'").select("path", F.concat(F.lit("Unreadable folder: "), "path").alias("error"))
    return missing(spark, roots, "Not a directory").unionByName(errors(listed.where("kind = 'file'"), extra_ignored, max_bytes)).unionByName(unread)


def decoded(content: Column) -> Column:
    """Text of bytes; those that are no UTF-8 are left out, one by one."""
    text = content.cast("string")
    valid = F.encode(F.regexp_replace(F.decode(content, "ISO-8859-1"), _SEQUENCE, "$1"), "ISO-8859-1").cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(valid)


def as_lines(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """file, lines of decoded contents; with max_bytes, the leading lines that stay within it."""
    text = decoded(F.col("content"))
    return files.select(F.col("path").alias("file"), (lines.split_lines(text, lines.FILE_END) if max_bytes is None else lines.lines_within(text, max_bytes)).alias("lines"))


def scan(spark: SparkSession, roots: str | Sequence[str], recursive: bool = True, extra_ignored: str = "", max_bytes: int = 10 * 1024 * 1024) -> DataFrame:
    """Findings of all files below the roots, each with its neighbouring lines. Tasks list the folders, a round for each level, without those that the path rules leave out; then one narrow stage leads from file to finding. What can't be scanned is in scan_errors()."""
    listed = listing.tree(spark, roots, recursive, paths.is_entered(F.col("path"), extra_ignored))
    named = listed.where(F.col("kind") == "file").where(paths.is_scanned(F.col("path"), extra_ignored) & paths.within_size(F.col("length"), max_bytes))
    files = listing.contents(named).where(~lines.looks_binary(F.col("content")))
    return detect.scan_lines(contexts(as_lines(files)))


def scan_files(spark: SparkSession, named: str | Sequence[str], max_bytes: int = 10 * 1024 * 1024) -> DataFrame:
    """Findings of the named files. No path is left out, a link is followed, and a large file is read up to max_bytes; names without a file are in missing(spark, named, "File not found")."""
    there = [x for x in _roots(named) if _exists(spark, x)]
    hidden, plain = ([x for x in there if _is_hidden(x.rsplit("/", 1)[-1]) == h] for h in (True, False))
    files = spark.read.format("binaryFile").load(plain).select("path", "length", "content") if plain else spark.createDataFrame([], SCHEMA)
    if hidden:
        sized = [(head + at, system.get_file_info(at).size) for system, at, head in (_named(spark, x) for x in hidden)]
        files = files.unionByName(hidden_files(spark, sized, max(n for _, n in sized), None))
    return detect.scan_lines(contexts(as_lines(files.where(~lines.looks_binary(F.col("content"))), max_bytes)))


def ignore_patterns(spark: SparkSession, path: str, extra: Sequence[str] = ()) -> list[str]:
    """The patterns of an ignore file, in order, and then extra ones, so that these have the last word; a small text that the driver reads. Without the file, the extra ones alone."""
    text = ""
    if _exists(spark, path):
        system, at, _ = _named(spark, path)
        with system.open_input_stream(at) as stream:
            text = stream.read().decode(errors="ignore")
    return [x.strip() for x in text.splitlines() if x.strip() and not x.strip().startswith("#")] + list(extra)

"""File sources: CSV, file listings (metadata directories), text logs."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def decoded(name: Column) -> Column:
    """A URI-encoded path or name as it is shown by listings."""
    # URI path encoding leaves ``+`` as is while URL decoding would turn it into a space, so ``+`` is escaped before decoding.
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def file_name() -> Column:
    """The scanned file's name, decoded (``_metadata.file_name`` is URL-encoded)."""
    return decoded(F.col("_metadata.file_name"))


def stem_of(path: Column) -> Column:
    """The decoded file name of a ``source_file``, without its extension."""
    return F.regexp_replace(decoded(F.regexp_extract(path, r"[^/]*$", 0)), r"\.[^.]*$", "")


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType | str | None = None,
    **options,
) -> DataFrame:
    """CSV with a header row and inferred types (or an explicit ``schema``).

    Inference costs one extra pass over the files; pass ``schema`` to skip
    it for very large inputs.
    """
    reader = spark.read.option("header", "true")
    if schema is not None:
        reader = reader.schema(schema)
    else:
        reader = reader.option("inferSchema", "true")
    for k, v in options.items():
        reader = reader.option(k, v)
    paths = [path] if isinstance(path, str) else list(path)
    return reader.csv(paths)


def list_files(spark: SparkSession, pattern: str, glob_filter: str | None = None) -> DataFrame:
    """Paths, sizes and modification times of files matching ``pattern``.

    Uses the ``binaryFile`` source with the ``content`` column pruned, so
    files are listed (in parallel on the cluster for large trees), not read.
    A pattern matching nothing gives an empty frame.
    """
    reader = spark.read.format("binaryFile")
    if glob_filter:
        reader = reader.option("pathGlobFilter", glob_filter)
    try:
        df = reader.load(pattern)
    except Exception as exc:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(exc) or "Path does not exist" in str(exc):
            return spark.createDataFrame(
                [], "path string, length bigint, modificationTime timestamp"
            )
        raise
    return df.select("path", "length", "modificationTime")


def file_states(spark: SparkSession, path: str | Sequence[str], glob_filter: str | None = None) -> DataFrame:
    """``(source_file, length, file_mtime)`` of each file with content, named as scans name them; listed, not opened.

    No such path gives an empty frame.
    """
    reader = spark.read.format("binaryFile")
    if glob_filter:
        reader = reader.option("pathGlobFilter", glob_filter)
    try:
        df = reader.load(path if isinstance(path, str) else list(path))
    except AnalysisException as exc:
        if not (exc.getCondition() or "").startswith("PATH_NOT_FOUND"):
            raise
        return spark.createDataFrame([], "source_file string, length long, file_mtime timestamp")
    return df.select(
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_size").alias("length"),
        F.col("_metadata.file_modification_time").alias("file_mtime"),
    )


def listed_files(scan: DataFrame) -> DataFrame:
    """``(source_file)`` of each file that a scan has listed, also of those without a byte, which Spark never opens.

    The names come from the listing that the scan's plan holds on the driver.
    """
    names = [(re.sub("^file:///", "file:/", n),) for n in scan.inputFiles()]
    return scan.sparkSession.createDataFrame(names, "source_file string")


def list_tree(spark: SparkSession, root: str, glob_filter: str | None = None) -> DataFrame:
    """Paths, sizes and modification times of all files with content at any depth under ``root``, listed, not opened.

    Spark lists a folder's subfolders in tasks where they are more than
    ``spark.sql.sources.parallelPartitionDiscovery.threshold``. No such root gives an empty frame.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob_filter:
        reader = reader.option("pathGlobFilter", glob_filter)
    try:
        files = reader.load(root)
    except AnalysisException as exc:
        if not (exc.getCondition() or "").startswith("PATH_NOT_FOUND"):
            raise
        return spark.createDataFrame([], "path string, length bigint, modificationTime timestamp")
    return files.select("path", "length", "modificationTime")


def existing_paths(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """The subset of ``paths`` that exist (one file-system metadata call each)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        if hp.getFileSystem(conf).exists(hp):
            out.append(p)
    return out


def list_folders(spark: SparkSession, folders: Sequence[str], glob_filter: str | None = None) -> DataFrame:
    """Files directly inside the existing ``folders``, listed in one scan."""
    present = existing_paths(spark, folders)
    if not present:
        return spark.createDataFrame([], "path string, length bigint, modificationTime timestamp")
    reader = spark.read.format("binaryFile")
    if glob_filter:
        reader = reader.option("pathGlobFilter", glob_filter)
    return reader.load(present).select("path", "length", "modificationTime")


def read_text_files(spark: SparkSession, path: str, glob_filter: str | None = None) -> DataFrame:
    """One row per file: ``(file_name, value)`` with the whole file text."""
    reader = spark.read
    if glob_filter:
        reader = reader.option("pathGlobFilter", glob_filter)
    return reader.text(path, wholetext=True).select(file_name().alias("file_name"), F.col("value"))


def write_named_files(files: DataFrame, root: str) -> int:
    """Write a file per row of ``(folder, name, text)`` at ``root/folder/name``; returns the number of rows.

    Spark's writers choose the names of their files, so the tasks write these through
    Arrow's file systems, for which ``root`` must lie in a store that executors share. Rows are dealt out by path over ``spark.sql.shuffle.partitions`` tasks;
    a task that runs again writes the same files again.
    """
    spark = files.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    uri = re.sub("^file:/+", "file:///", fs.makeQualified(path).toUri().toString())

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSystem

        store, top = FileSystem.from_uri(uri)
        made: set[str] = set()
        for rows in batches:
            for folder, name, text in zip(rows["folder"], rows["name"], rows["text"], strict=True):
                if folder not in made:
                    store.create_dir(f"{top}/{folder}", recursive=True)
                    made.add(folder)
                with store.open_output_stream(f"{top}/{folder}/{name}") as out:
                    out.write(text.encode())
            yield pd.DataFrame({"n": [len(rows)]})

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = files.select("folder", "name", "text").repartition(n, "folder", "name")
    return sum(r.n for r in dealt.mapInPandas(put, "n long").toLocalIterator())

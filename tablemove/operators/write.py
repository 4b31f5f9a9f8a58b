"""Table writes: ensure namespace, create-or-replace, strict create.

A copy is a map-only plan (scan -> write): no shuffle, one output file per
input split, so it scales with the cluster and ``maxPartitionBytes``.

Catalogs that implement staged table operations (lakehouse formats, JDBC)
get the plain V2 ``writeTo(...).createOrReplace()``, which is atomic there.
The session catalog cannot replace a table stored as a built-in file format
(``UNSUPPORTED_FEATURE.TABLE_OPERATION``), so for it the rows are written to
a staging table first; only after that write succeeded is the old table
dropped and the staging table renamed into place. A failing write leaves
the old table untouched, and copying a table onto itself works because the
read completes before the drop. Between drop and rename the name is briefly
absent; the rename is a metadata move on HDFS-like stores.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from ..functions.identifiers import (
    SESSION_CATALOG,
    catalog_of,
    join_name,
    quote_name,
    split_name,
)
from ..session import ensure_checkpoint_dir, scratch_path

# Providers the session catalog stores itself (no staged replace support).
FILE_FORMATS = frozenset({"parquet", "orc", "csv", "json", "avro", "text"})


def ensure_namespace(spark: SparkSession, namespace: str, location: str | None = None) -> None:
    """``CREATE NAMESPACE IF NOT EXISTS``, optionally at a given location."""
    sql = f"CREATE NAMESPACE IF NOT EXISTS {quote_name(namespace)}"
    if location:
        sql += " LOCATION '" + location.replace("'", "\\'") + "'"
    spark.sql(sql)


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(quote_name(name))


def _provider(spark: SparkSession, fmt: str | None) -> str:
    return (fmt or spark.conf.get("spark.sql.sources.default", "parquet")).lower()


def uses_staged_swap(spark: SparkSession, target: str, fmt: str | None) -> bool:
    """True when ``target`` is a session-catalog table in a built-in file format."""
    current = spark.catalog.currentCatalog()
    return (
        catalog_of(target, current) == SESSION_CATALOG
        and _provider(spark, fmt) in FILE_FORMATS
    )


def _partition_cols(partition_by: Sequence[str] | None) -> list[Column]:
    return [F.col(quote_name([c])) for c in (partition_by or [])]


def replace_table(
    df: DataFrame,
    target: str,
    fmt: str | None = None,
    partition_by: Sequence[str] | None = None,
) -> str:
    """Create ``target`` from ``df`` or replace it wholesale.

    Returns the strategy used: ``"v2_replace"``, ``"create"`` (session
    catalog, no previous table) or ``"staged_swap"``.
    """
    spark = df.sparkSession
    if not uses_staged_swap(spark, target, fmt):
        writer = df.writeTo(quote_name(target))
        if fmt:
            writer = writer.using(fmt)
        if partition_by:
            cols = _partition_cols(partition_by)
            writer = writer.partitionedBy(cols[0], *cols[1:])
        writer.createOrReplace()
        return "v2_replace"

    if not table_exists(spark, target):
        # Nothing to replace: write the table directly (fails, rather than
        # overwrites, if a concurrent writer created it meanwhile).
        writer = df.write.format(_provider(spark, fmt))
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.saveAsTable(quote_name(target))
        return "create"

    parts = split_name(target)
    stage = parts[:-1] + [f"{parts[-1]}{STAGE_MARKER}{uuid.uuid4().hex[:8]}"]
    stage_name = join_name(*stage)
    writer = df.write.format(_provider(spark, fmt))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    try:
        writer.saveAsTable(stage_name)
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {stage_name}")
        raise
    spark.sql(f"DROP TABLE IF EXISTS {quote_name(target)}")
    # The session catalog renames within the namespace; name the leaf only.
    spark.sql(f"ALTER TABLE {stage_name} RENAME TO {quote_name(parts[-1:] if len(parts) < 2 else parts[-2:])}")
    if partition_by:
        # Partition entries still name the staging folder; re-sync them
        # with the folders now under the renamed table.
        spark.sql(f"MSCK REPAIR TABLE {quote_name(target)} SYNC PARTITIONS")
    return "staged_swap"


STAGE_MARKER = "__tm_stage_"


def cleanup_staging(spark: SparkSession, namespace: str, restore: bool = True) -> list[tuple[str, str]]:
    """Resolve staging tables left by an interrupted replace: ``[(table, action)]``.

    A staging table enters the catalog only after its rows are written (the
    catalog entry of a CTAS is created after the data), so it is complete.
    If the driver died between dropping the old table and renaming, the
    target name is missing: with ``restore`` the staging table is renamed
    into place (``"restored"``). Otherwise it is dropped (``"dropped"``).
    Only call this when no replace into ``namespace`` is running.
    """
    from .catalog import list_tables

    ns = split_name(namespace)
    done = []
    rows = list_tables(spark, namespace).filter(F.col("tableName").contains(STAGE_MARKER)).collect()
    for r in rows:
        stage = quote_name(ns + [r.tableName])
        target = r.tableName.split(STAGE_MARKER)[0]
        if restore and not spark.catalog.tableExists(quote_name(ns + [target])):
            spark.sql(f"ALTER TABLE {stage} RENAME TO {quote_name(ns[-1:] + [target])}")
            done.append((target, "restored"))
        else:
            spark.sql(f"DROP TABLE IF EXISTS {stage}")
            done.append((r.tableName, "dropped"))
    return done


def create_table(
    df: DataFrame,
    target: str,
    fmt: str | None = None,
    partition_by: Sequence[str] | None = None,
) -> str:
    """Strict create: fails with ``TABLE_OR_VIEW_ALREADY_EXISTS`` if present."""
    writer = df.writeTo(quote_name(target))
    if fmt:
        writer = writer.using(fmt)
    if partition_by:
        cols = _partition_cols(partition_by)
        writer = writer.partitionedBy(cols[0], *cols[1:])
    writer.create()
    return "v2_create"


def counted(df: DataFrame, name: str = "tm_write") -> tuple[DataFrame, Observation]:
    """Attach a row-count observation, collected by the write itself.

    The count comes from the write's own tasks (no second pass), and Spark
    applies each task's metric once even when tasks are retried.
    """
    obs = Observation(f"{name}_{uuid.uuid4().hex[:8]}")
    return df.observe(obs, F.count(F.lit(1)).alias("rows")), obs


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back: computed once, looked at several times."""
    ensure_checkpoint_dir(df.sparkSession)
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def error_class(exc: BaseException) -> str:
    """Map a failure to ``not_found`` / ``already_exists`` / ``other``."""
    if isinstance(exc, AnalysisException):
        cond = exc.getCondition() or ""
        if cond.startswith(("TABLE_OR_VIEW_NOT_FOUND", "SCHEMA_NOT_FOUND", "NO_SUCH")):
            return "not_found"
        if cond.startswith(("TABLE_OR_VIEW_ALREADY_EXISTS", "TABLE_ALREADY_EXISTS")):
            return "already_exists"
    return "other"


def error_text(exc: BaseException) -> str:
    if isinstance(exc, AnalysisException):
        cond = exc.getCondition()
        msg = str(exc).splitlines()[0] if str(exc) else ""
        return f"{cond}: {msg}" if cond and cond not in msg else msg
    return f"{type(exc).__name__}: {str(exc).splitlines()[0] if str(exc) else ''}"

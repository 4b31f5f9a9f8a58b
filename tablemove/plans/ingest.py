"""Ingest: CSV files or session-catalog tables into a managed target namespace.

The same map-only copy path as :mod:`tablemove.plans.copy`; ingest adds the
namespace naming rule (``<db>`` -> ``<db>_iceberg`` in the target catalog by
default) and the CSV source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..functions.identifiers import quote_name, split_name
from ..operators.catalog import list_tables
from ..operators.select import selected_names
from ..operators.write import ensure_namespace
from ..sources.files import read_csv
from .copy import CopyResult, copy_dataframe, copy_tables

DEFAULT_SUFFIX = "_iceberg"


def target_namespace_for(database: str, target_catalog: str | None = None, suffix: str = DEFAULT_SUFFIX) -> str:
    """``db`` -> ``[catalog.]db_iceberg`` (the ingest naming rule)."""
    leaf = split_name(database)[-1] + suffix
    return quote_name(([target_catalog] if target_catalog else []) + [leaf])


def _ensure_parent(spark: SparkSession, target: str) -> None:
    parent = split_name(target)[:-1]
    if parent:
        ensure_namespace(spark, quote_name(parent))


def ingest_tables(
    spark: SparkSession,
    database: str,
    tables: str | Sequence[str],
    target_catalog: str | None = None,
    target_namespace: str | None = None,
    suffix: str = DEFAULT_SUFFIX,
    fmt: str | None = None,
    keep_partitioning: bool = False,
    verify: bool = False,
    parallelism: int = 1,
    target_location: str | None = None,
    scheduler_pool: str | None = None,
) -> DataFrame:
    """Copy session tables of ``database`` into the target namespace.

    ``tables`` is a list of names or ``"*"``; names are resolved against the
    listing of ``database`` (temp views excluded). Names that are not in the
    listing are still attempted and reported as ``not_found``, so a typo is
    visible in the outcome rather than silently dropped; use
    :func:`ingest_selection` for the select-then-copy flow that drops them.
    """
    if tables == "*" or (not isinstance(tables, str) and "*" in tables):
        names = selected_names(list_tables(spark, database), "*")
    else:
        names = [tables] if isinstance(tables, str) else list(tables)
    target = target_namespace or target_namespace_for(database, target_catalog, suffix)
    return copy_tables(
        spark,
        database,
        target,
        names,
        mode="replace",
        fmt=fmt,
        keep_partitioning=keep_partitioning,
        verify=verify,
        parallelism=parallelism,
        target_location=target_location,
        scheduler_pool=scheduler_pool,
    )


def ingest_selection(
    spark: SparkSession,
    database: str,
    spec: str | Sequence[str],
    **kwargs,
) -> DataFrame:
    """Select tables from the listing (unknown dropped, first-seen order), then ingest."""
    names = selected_names(list_tables(spark, database), spec)
    return ingest_tables(spark, database, names, **kwargs)


def ingest_table(
    spark: SparkSession,
    source: str,
    target: str,
    fmt: str | None = None,
    verify: bool = False,
) -> CopyResult:
    """One session table into ``target`` (create or replace)."""
    _ensure_parent(spark, target)
    df = spark.read.table(quote_name(source))
    return copy_dataframe(df, target, mode="replace", fmt=fmt, verify=verify)


def ingest_files(
    spark: SparkSession,
    path: str | Sequence[str],
    target: str,
    fmt: str | None = None,
    verify: bool = False,
    **csv_options,
) -> CopyResult:
    """CSV files (header row, inferred types) into ``target``.

    A directory path discovers ``key=value`` sub-folders as partition
    columns; a single file path under such a folder does not.
    """
    _ensure_parent(spark, target)
    df = read_csv(spark, path, **csv_options)
    return copy_dataframe(df, target, mode="replace", fmt=fmt, verify=verify)

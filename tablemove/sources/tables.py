"""Table sources: catalog tables, and parquet files registered as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..functions.identifiers import quote_name, split_name
from ..operators.write import ensure_namespace


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """``spark.read.table`` on a (possibly catalog-qualified) name."""
    return spark.read.table(quote_name(name))


def register_parquet_tables(
    spark: SparkSession,
    directory: str,
    namespace: str,
    tables: Sequence[str],
    location: str | None = None,
) -> list[str]:
    """Expose ``<directory>/<t>.parquet`` as external tables ``namespace.t``.

    No data is copied: each table is catalog metadata pointing at the files,
    so a later copy reads the files directly (with pruning and pushdown).
    Dropping these tables never deletes the files.
    """
    ensure_namespace(spark, namespace, location)
    names = []
    for t in tables:
        name = quote_name(split_name(namespace) + [t])
        path = f"{directory.rstrip('/')}/{t}.parquet".replace("'", "\\'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} USING parquet LOCATION '{path}'")
        names.append(name)
    return names

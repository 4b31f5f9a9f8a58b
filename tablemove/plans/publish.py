"""Publish manifest: newest metadata file per table -> registration DDL.

For each table to publish, find its newest ``vN.metadata.json`` (highest
integer ``N``, so ``v10`` beats ``v2``) under ``<table location>/metadata``,
express its path relative to the warehouse root, and render the external
warehouse's ``CREATE OR REPLACE ICEBERG TABLE`` statement. Tables without a
location, without metadata files or outside the warehouse get a failed row
with the reason; the others are unaffected.

Work is a file listing (parallel, content never read) + regex extraction +
``groupBy(table_root).max_by(path, version)`` (partially aggregated on the
map side) + a join of two frames that both have one row per table.
Running the DDL against the warehouse is left to the caller.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identifiers import quote_name, split_name
from ..operators.catalog import table_location, table_locations
from ..sources.files import list_folders, list_tree

# Fixed value: default file pattern.
VERSION_PATTERN = r"^v(\d+)\.metadata\.json$"

_SCHEME_ONLY = r"^[A-Za-z][A-Za-z0-9+.-]*:"
_SCHEME = _SCHEME_ONLY + r"(//[^/]*)?"
_PLAIN_IDENT = r"^[A-Za-z_][A-Za-z0-9_$]*$"


def _strip_scheme(c: Column) -> Column:
    return F.regexp_replace(c, _SCHEME, "")


def metadata_versions(files: DataFrame, pattern: str = VERSION_PATTERN) -> DataFrame:
    """``(table_root, path, file_name, version)`` for files matching ``pattern``."""
    name = F.regexp_extract(F.col("path"), r"[^/]+$", 0)
    root = F.regexp_extract(F.col("path"), r"^(.*)/metadata/[^/]+$", 1)
    version = F.regexp_extract(name, pattern, 1)
    return (
        files.select("path", name.alias("file_name"), root.alias("table_root"), version.alias("_v"))
        .filter((F.col("_v") != "") & (F.col("table_root") != ""))
        .select("table_root", "path", "file_name", F.col("_v").cast("long").alias("version"))
    )


def latest_metadata(versions: DataFrame) -> DataFrame:
    """One row per table root: the path of the highest version."""
    return versions.groupBy("table_root").agg(
        F.max_by("path", "version").alias("metadata_file"),
        F.max("version").alias("version"),
    )


def relative_to(path: Column, warehouse: str) -> Column:
    """``path`` without the warehouse prefix (``/`` appended); null if outside."""
    wh = warehouse if warehouse.endswith("/") else warehouse + "/"
    # A warehouse given without a scheme is compared to scheme-less paths.
    p = path if re.match(_SCHEME_ONLY, wh) else _strip_scheme(path)
    return F.when(p.startswith(wh), F.substring(p, len(wh) + 1, 1 << 30))


def warehouse_ident(c: Column) -> Column:
    """Plain identifiers as is; anything else double-quoted (quotes doubled)."""
    return F.when(c.rlike(_PLAIN_IDENT), c).otherwise(
        F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    )


def sql_string(c: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))


def registration_ddl(
    sf_db: Column,
    sf_schema: Column,
    table: Column,
    metadata_path: Column,
    catalog_integration: str,
    external_volume: str,
) -> Column:
    return F.concat(
        F.lit("CREATE OR REPLACE ICEBERG TABLE "),
        F.concat_ws(".", warehouse_ident(sf_db), warehouse_ident(sf_schema), warehouse_ident(table)),
        F.lit(" CATALOG = "), sql_string(F.lit(catalog_integration)),
        F.lit(" EXTERNAL_VOLUME = "), sql_string(F.lit(external_volume)),
        F.lit(" METADATA_FILE_PATH = "), sql_string(metadata_path),
        F.lit(";"),
    )


def build_manifest(
    files: DataFrame,
    tables: DataFrame,
    warehouse: str,
    pattern: str = VERSION_PATTERN,
    *,
    catalog_integration: str,
    external_volume: str,
) -> DataFrame:
    """Manifest rows for ``tables`` given a listing ``files`` (``path`` column).

    ``tables`` columns: ``namespace, table, location, sf_db, sf_schema``
    (``location`` may be null when the catalog reported none), and optionally
    ``lookup_error``, the reason why there is none.
    """
    latest = latest_metadata(metadata_versions(files, pattern))
    loc = F.regexp_replace(F.col("location"), "/+$", "")
    joined = tables.withColumn("table_root", loc).join(latest, "table_root", "left")
    rel = relative_to(F.col("metadata_file"), warehouse)
    status_ok = F.col("location").isNotNull() & F.col("metadata_file").isNotNull() & rel.isNotNull()
    no_location = F.lit("no Location for table")
    if "lookup_error" in tables.columns:
        no_location = F.coalesce("lookup_error", no_location)
    error = (
        F.when(F.col("location").isNull(), no_location)
        .when(F.col("metadata_file").isNull(), F.lit("no metadata file matching the version pattern"))
        .when(rel.isNull(), F.lit("metadata file is outside the warehouse location"))
    )
    return joined.select(
        "namespace",
        "table",
        "sf_db",
        "sf_schema",
        "version",
        F.when(status_ok, rel).alias("metadata_path"),
        F.when(
            status_ok,
            registration_ddl(F.col("sf_db"), F.col("sf_schema"), F.col("table"), rel,
                             catalog_integration, external_volume),
        ).alias("ddl"),
        F.when(status_ok, "ok").otherwise("failed").alias("status"),
        error.alias("error"),
    )


def publish_manifest(
    spark: SparkSession,
    namespace: str,
    tables: Sequence[str],
    warehouse: str,
    sf_db: str,
    sf_schema: str,
    pattern: str = VERSION_PATTERN,
    lookup_parallelism: int = 8,
    *,
    catalog_integration: str,
    external_volume: str,
) -> DataFrame:
    """Manifest for catalog tables: locations from ``DESCRIBE``, one listing for all.

    Location lookup is one catalog call per table (metadata only, made
    ``lookup_parallelism`` at a time); the metadata folders of all tables
    are listed in a single file scan.
    """
    def lookup(t: str) -> tuple:
        reason = None
        try:
            location = table_location(spark, quote_name(split_name(namespace) + [t]))
        except Exception as exc:  # noqa: BLE001 - an unreadable table becomes a failed row
            location, reason = None, str(exc).split("\n", 1)[0]
        if location:
            # DESCRIBE shows a URI (spaces as %20); listings show plain paths
            location = unquote(location)
        return (namespace, t, location, sf_db, sf_schema, reason)

    names = list(dict.fromkeys(tables))
    if lookup_parallelism > 1 and len(names) > 1:
        with ThreadPoolExecutor(max_workers=lookup_parallelism) as pool:
            rows = list(pool.map(lookup, names))
    else:
        rows = [lookup(t) for t in names]
    table_df = spark.createDataFrame(
        rows, "namespace string, table string, location string, sf_db string, sf_schema string, lookup_error string"
    )
    folders = [r[2].rstrip("/") + "/metadata" for r in rows if r[2]]
    files = list_folders(spark, folders)
    return build_manifest(
        files.select("path"), table_df, warehouse, pattern, catalog_integration=catalog_integration, external_volume=external_volume
    )


def publish_namespace(
    spark: SparkSession,
    namespace: str,
    warehouse: str,
    sf_db: str,
    sf_schema: str,
    pattern: str = VERSION_PATTERN,
    *,
    catalog_integration: str,
    external_volume: str,
) -> DataFrame:
    """Manifest for all tables of a namespace: one catalog listing joined to one file listing.

    Neither the catalog nor the file system is asked table by table. All
    files under ``warehouse`` are listed (not opened), by Spark tasks where
    a folder has many subfolders; the driver holds the listing's names. For a few tables out of a
    large warehouse :func:`publish_manifest` lists their folders only. A
    table outside the warehouse counts as one without a metadata file.
    """
    tables = table_locations(spark, namespace).withColumn("sf_db", F.lit(sf_db)).withColumn("sf_schema", F.lit(sf_schema))
    files = list_tree(spark, warehouse, "*.metadata.json" if pattern == VERSION_PATTERN else None)
    return build_manifest(
        files.select("path"), tables, warehouse, pattern, catalog_integration=catalog_integration, external_volume=external_volume
    )

"""Catalog metadata reads as DataFrames (listing, describe, properties, schema).

These are metadata operations: their size is the number of namespaces,
tables or columns, never the number of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from ..functions.identifiers import quote_name, split_name
from ..sources.files import decoded

TABLE_LISTING = T.StructType(
    [
        T.StructField("namespace", T.StringType()),
        T.StructField("tableName", T.StringType()),
        T.StructField("isTemporary", T.BooleanType()),
    ]
)


def list_namespaces(spark: SparkSession, catalog: str | None = None) -> DataFrame:
    """``SHOW NAMESPACES [IN catalog]`` -> one ``namespace`` column."""
    sql = "SHOW NAMESPACES" + (f" IN {quote_name(catalog)}" if catalog else "")
    df = spark.sql(sql)
    return df.select(F.col(df.columns[0]).alias("namespace"))


def list_tables(spark: SparkSession, namespace: str, include_temporary: bool = False) -> DataFrame:
    """Tables of a namespace; temp views dropped, a missing namespace is empty."""
    try:
        df = spark.sql(f"SHOW TABLES IN {quote_name(namespace)}")
        df.schema  # noqa: B018 - forces analysis so a missing namespace raises here
    except AnalysisException as exc:
        if (exc.getCondition() or "").startswith(("SCHEMA_NOT_FOUND", "NO_SUCH_NAMESPACE")):
            return spark.createDataFrame([], TABLE_LISTING)
        raise
    df = df.select("namespace", "tableName", "isTemporary")
    if not include_temporary:
        df = df.filter(~F.col("isTemporary"))
    return df


def describe_extended(spark: SparkSession, table: str) -> DataFrame:
    return spark.sql(f"DESCRIBE TABLE EXTENDED {quote_name(table)}")


def table_location(spark: SparkSession, table: str) -> str | None:
    """The ``Location`` row of ``DESCRIBE EXTENDED``; ``None`` when absent."""
    row = (
        describe_extended(spark, table)
        .filter(F.col("col_name") == "Location")
        .select("data_type")
        .first()
    )
    return row[0] if row else None


def table_locations(spark: SparkSession, namespace: str) -> DataFrame:
    """``(namespace, table, location)`` of all tables of a namespace, from one catalog listing.

    Locations are plain paths, as file listings show them (a catalog shows
    a URI, spaces as %20), and null for tables and views without one. A missing namespace is empty.
    """
    try:
        listed = spark.sql(f"SHOW TABLE EXTENDED IN {quote_name(namespace)} LIKE '*'")
        listed.schema  # noqa: B018 - forces analysis so a missing namespace raises here
    except AnalysisException as exc:
        if (exc.getCondition() or "").startswith(("SCHEMA_NOT_FOUND", "NO_SUCH_NAMESPACE")):
            return spark.createDataFrame([], "namespace string, table string, location string")
        raise
    uri = F.regexp_extract("information", r"(?m)^Location: ?(.*)$", 1)
    return listed.filter(~F.col("isTemporary")).select(
        F.lit(split_name(namespace)[-1]).alias("namespace"), F.col("tableName").alias("table"), F.nullif(decoded(uri), F.lit("")).alias("location")
    )


def table_provider(spark: SparkSession, table: str) -> str | None:
    """The ``Provider`` row of ``DESCRIBE EXTENDED``; ``None`` when absent."""
    row = describe_extended(spark, table).filter(F.col("col_name") == "Provider").select("data_type").first()
    return row[0] if row else None


def table_properties(spark: SparkSession, table: str) -> DataFrame:
    """``SHOW TBLPROPERTIES`` -> ``(key, value)``."""
    return spark.sql(f"SHOW TBLPROPERTIES {quote_name(table)}")


def schema_frame(df: DataFrame) -> DataFrame:
    """A DataFrame's schema as rows ``(position, column, type, nullable)``."""
    rows = [
        (i, f.name, f.dataType.simpleString(), f.nullable)
        for i, f in enumerate(df.schema.fields)
    ]
    return df.sparkSession.createDataFrame(
        rows, "position int, column string, type string, nullable boolean"
    )


def preview(spark: SparkSession, table: str, n: int = 5) -> DataFrame:
    """First ``n`` rows of a table (no order: a look at the data, not a report)."""
    return spark.read.table(quote_name(table)).limit(n)


def partition_columns(spark: SparkSession, table: str) -> list[str]:
    """Partition columns of a catalog table, in declared order."""
    return [c.name for c in spark.catalog.listColumns(quote_name(table)) if c.isPartition]

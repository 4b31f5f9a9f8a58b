"""Chained registrations: a finished copy with the flag set queues a register job.

Each completed ``migrate_catalogs`` job whose ``register_on_snowflake`` flag
is true yields one pending ``register_snowflake`` record with
``azure_db <- dest_db``, the same ``sf_db``/``sf_schema``/``tables`` and
``chained_from <- job_id``. The child id is derived from the parent id
(a SHA-256 formatted like a UUID), so re-running the chain step yields the
same ids and :func:`chain_registrations` can skip children already queued.

When per-table outcome rows are given, only the tables that copied
successfully are registered (a partly failed copy should not publish the
tables it did not write); jobs without outcome rows keep their list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.audit import TYPE_MIGRATE, TYPE_REGISTER


def parent_predicate() -> Column:
    return (
        (F.col("status") == "completed")
        & (F.col("job_type") == TYPE_MIGRATE)
        & F.coalesce(F.col("register_on_snowflake"), F.lit(False))
    )


def child_job_id(parent_id: Column) -> Column:
    """Deterministic UUID-shaped id for the registration child of ``parent_id``."""
    h = F.substring(F.sha2(F.concat(F.lit(TYPE_REGISTER + ":"), parent_id), 256), 1, 32)
    return F.regexp_replace(h, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def chain_registrations(
    jobs: DataFrame,
    outcomes: DataFrame | None = None,
    existing: DataFrame | None = None,
) -> DataFrame:
    """Pending registration records for qualifying parent jobs.

    ``outcomes``: optional ``(job_id, position, table, status)`` rows of the
    parents' per-table copies. ``existing``: optional frame with a
    ``job_id`` column of already-queued jobs to skip.
    """
    parents = jobs.filter(parent_predicate())
    tables = F.col("tables")
    if outcomes is not None:
        ok = (
            outcomes.filter(F.col("status") == "succeeded")
            .groupBy("job_id")
            .agg(F.array_sort(F.collect_list(F.struct("position", "table"))).alias("_ok"))
            .select("job_id", F.transform("_ok", lambda x: x["table"]).alias("_ok_tables"))
        )
        had = outcomes.select("job_id").distinct().withColumn("_had", F.lit(True))
        parents = parents.join(ok, "job_id", "left").join(had, "job_id", "left")
        tables = F.when(F.col("_had"), F.coalesce(F.col("_ok_tables"), F.array().cast("array<string>"))).otherwise(F.col("tables"))
    children = parents.select(
        child_job_id(F.col("job_id")).alias("job_id"),
        F.lit(TYPE_REGISTER).alias("job_type"),
        F.col("dest_db").alias("azure_db"),
        F.col("sf_db"),
        F.col("sf_schema"),
        tables.alias("tables"),
        F.lit("pending").alias("status"),
        F.col("job_id").alias("chained_from"),
    )
    if existing is not None:
        children = children.join(existing.select("job_id"), "job_id", "left_anti")
    return children

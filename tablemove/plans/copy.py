"""Table copies between namespaces and catalogs, with one outcome row per table.

Each table copy is one Spark job ``read.table -> write`` (map-only, no
shuffle). The per-table loop runs on the driver because its unit is a
*table name*, not a row: the driver never touches table data. Failures are
isolated per table; the namespace creation failure is fatal, as in a
migration that cannot proceed at all. ``parallelism > 1`` submits several
table copies at once from a thread pool (useful for many small tables; the
scheduler shares executors between the concurrent jobs); outcome order is
the selection order either way.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.identifiers import quote_name, split_name
from ..operators import reconcile as rc
from ..operators.catalog import partition_columns
from ..operators.write import (
    counted,
    create_table,
    ensure_namespace,
    error_class,
    error_text,
    replace_table,
)

OUTCOME = T.StructType(
    [
        T.StructField("position", T.IntegerType(), False),
        T.StructField("table", T.StringType(), False),
        T.StructField("source", T.StringType(), False),
        T.StructField("target", T.StringType(), False),
        T.StructField("status", T.StringType(), False),
        T.StructField("rows", T.LongType()),
        T.StructField("strategy", T.StringType()),
        T.StructField("verified", T.BooleanType()),
        T.StructField("error_class", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


@dataclass
class CopyResult:
    status: str
    rows: int | None = None
    strategy: str | None = None
    verified: bool | None = None
    error_class: str | None = None
    error: str | None = None


def copy_dataframe(
    df: DataFrame,
    target: str,
    mode: str = "replace",
    fmt: str | None = None,
    partition_by: Sequence[str] | None = None,
    verify: bool = False,
) -> CopyResult:
    """Write ``df`` to ``target`` and report rows written (and verification).

    The row count (and, with ``verify``, the content hash) is observed by
    the write's own tasks; verification then fingerprints the target once.
    """
    if verify:
        observed, obs = rc.observed_fingerprint(df, f"tm_copy_{uuid.uuid4().hex[:8]}")
    else:
        observed, obs = counted(df, "tm_copy")
    if mode == "replace":
        strategy = replace_table(observed, target, fmt=fmt, partition_by=partition_by)
    elif mode == "create":
        strategy = create_table(observed, target, fmt=fmt, partition_by=partition_by)
    else:
        raise ValueError(f"unknown mode {mode!r} (expected 'replace' or 'create')")
    metrics = obs.get
    rows = int(metrics.get("rows", 0))
    verified = None
    if verify:
        spark = df.sparkSession
        t = rc.fingerprint(spark.read.table(quote_name(target))).first()
        verified = t["rows"] == rows and t["hash_sum"] == metrics.get("hash_sum")
    return CopyResult("succeeded", rows=rows, strategy=strategy, verified=verified)


def _copy_one(
    spark: SparkSession,
    source: str,
    target: str,
    mode: str,
    fmt: str | None,
    keep_partitioning: bool,
    verify: bool,
) -> CopyResult:
    try:
        df = spark.read.table(quote_name(source))
        parts = partition_columns(spark, source) if keep_partitioning else None
        return copy_dataframe(df, target, mode=mode, fmt=fmt, partition_by=parts, verify=verify)
    except Exception as exc:  # noqa: BLE001 - isolate every per-table failure
        return CopyResult("failed", error_class=error_class(exc), error=error_text(exc))


def copy_tables(
    spark: SparkSession,
    source_namespace: str,
    target_namespace: str | None,
    tables: Sequence[str],
    mode: str = "replace",
    fmt: str | None = None,
    keep_partitioning: bool = False,
    verify: bool = False,
    parallelism: int = 1,
    target_location: str | None = None,
    scheduler_pool: str | None = None,
) -> DataFrame:
    """Copy ``tables`` from one namespace to another; one outcome row each.

    ``scheduler_pool`` names a scheduler pool for the copy jobs (with
    ``spark.scheduler.mode=FAIR`` concurrent copies then share executors
    fairly instead of first-come first-served).

    ``target_namespace`` defaults to the source namespace name (useful when
    only the catalog differs: ``cat_a.db`` -> ``cat_b.db``). Names may carry a
    catalog: ``copy_tables(spark, "src_cat.sales", "dst_cat.sales", [...])``.
    """
    target_namespace = target_namespace or source_namespace
    ensure_namespace(spark, target_namespace, target_location)  # fatal if it fails
    names = list(dict.fromkeys(t for t in tables if t))

    def run(pos_table: tuple[int, str]) -> tuple:
        pos, table = pos_table
        if scheduler_pool:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", scheduler_pool)
        src = split_name(source_namespace) + [table]
        dst = split_name(target_namespace) + [table]
        r = _copy_one(spark, quote_name(src), quote_name(dst), mode, fmt, keep_partitioning, verify)
        return (pos, table, ".".join(src), ".".join(dst), r.status, r.rows, r.strategy, r.verified, r.error_class, r.error)

    items = list(enumerate(names, start=1))
    if parallelism > 1 and len(items) > 1:
        with ThreadPoolExecutor(max_workers=parallelism) as pool:
            rows = list(pool.map(run, items))
    else:
        rows = [run(i) for i in items]
    return spark.createDataFrame(rows, OUTCOME)


def copy_table(spark: SparkSession, source: str, target: str, mode: str = "create", fmt: str | None = None, verify: bool = False) -> CopyResult:
    """Single copy; strict ``create`` by default (fails if ``target`` exists).

    Unlike :func:`copy_tables`, errors propagate to the caller.
    """
    df = spark.read.table(quote_name(source))
    return copy_dataframe(df, target, mode=mode, fmt=fmt, verify=verify)


def copy_summary(outcomes: DataFrame) -> DataFrame:
    """Per status: number of tables and their names joined in selection order."""
    return (
        outcomes.groupBy("status")
        .agg(
            F.count(F.lit(1)).alias("tables"),
            F.expr("listagg(`table`, ', ') WITHIN GROUP (ORDER BY position)").alias("names"),
        )
    )


def job_status(outcomes: DataFrame) -> str:
    """Worst outcome of a multi-table job: ``failed`` if any table failed."""
    failed = outcomes.filter(F.col("status") != "succeeded").limit(1).count()
    return "failed" if failed else "completed"

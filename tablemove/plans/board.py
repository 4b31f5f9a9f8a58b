"""Job board: queued and archived jobs with their logs, newest file first.

Queue and archive records are unioned with a ``state`` label; each job is
left-joined to its log text (missing log -> a fixed notice). Logs are read
whole per file (``wholetext``); the job id is the file stem
(``<job_id>.log``) or, for logs written by Spark with
``partitionBy("job_id")``, the partition value.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.audit import job_type_display, status_colour
from ..sources.files import file_name
from ..sources.jobs import read_job_records

# Fixed values shown by the board.
LOG_MISSING = "Log file not yet available."
STATUS_MISSING = "unknown"
TYPE_MISSING = "N/A"


def read_logs(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``(job_id, log)``: one row per log file, whole text."""
    reader = spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.text(path, wholetext=True)
    stem = F.regexp_replace(file_name(), r"\.log$", "")
    key = F.coalesce(F.col("job_id"), stem) if "job_id" in df.columns else stem
    return df.select(key.alias("job_id"), F.col("value").alias("log"))


def _records(spark: SparkSession, path: str, state: str, multi_line: bool, glob: str | None) -> DataFrame | None:
    try:
        records, _ = read_job_records(spark, path, multi_line=multi_line, glob=glob)
        records.schema  # noqa: B018
    except AnalysisException as exc:
        if (exc.getCondition() or "").startswith("PATH_NOT_FOUND"):
            return None
        raise
    return records.withColumn("state", F.lit(state))


def job_board(
    spark: SparkSession,
    queue: str,
    archive: str,
    logs: str | DataFrame | None = None,
    multi_line: bool = True,
    glob: str | None = "*.json",
    top: int | None = None,
) -> DataFrame | None:
    """Queued + archived jobs, newest file first, with log text; ``None`` if no folder exists.

    ``top`` keeps only the newest ``top`` jobs (a top-k, not a full sort).

    ``logs`` is a folder of log files (see :func:`read_logs`) or a frame
    ``(job_id, log)``, e.g. a log table; one file per job is simple but
    costs a file open per job, a table does not.
    """
    parts = [p for p in (_records(spark, queue, "queued", multi_line, glob),
                         _records(spark, archive, "archived", multi_line, glob)) if p is not None]
    if not parts:
        return None
    jobs = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    status = F.coalesce(F.col("status"), F.lit(STATUS_MISSING))
    board = jobs.select(
        "job_id",
        F.col("job_type"),
        job_type_display(F.coalesce(F.col("job_type"), F.lit(TYPE_MISSING))).alias("job_type_display"),
        F.upper(status).alias("status_display"),
        status_colour(status).alias("status_colour"),
        "state",
        "file_mtime",
        "source_file",
    )
    order = [F.col("file_mtime").desc(), F.col("job_id")]
    if top:
        # Pick the newest jobs before touching any log text (a top-k, no
        # global sort), so only their logs are read into the join.
        board = board.orderBy(*order).limit(top)
    log_df = None
    if isinstance(logs, DataFrame):
        log_df = logs.select("job_id", "log")
    elif logs:
        try:
            log_df = read_logs(spark, logs)
            log_df.schema  # noqa: B018
        except AnalysisException as exc:
            if not (exc.getCondition() or "").startswith("PATH_NOT_FOUND"):
                raise
            log_df = None
    if log_df is not None:
        if top:
            # exactly ``top`` ids at most: a broadcast with a known bound
            log_df = log_df.join(F.broadcast(board.select("job_id")), "job_id", "left_semi")
        board = board.join(log_df, "job_id", "left")
    else:
        board = board.withColumn("log", F.lit(None).cast("string"))
    board = board.withColumn("has_log", F.col("log").isNotNull()).withColumn(
        "log", F.coalesce(F.col("log"), F.lit(LOG_MISSING))
    )
    return board.orderBy(*order)

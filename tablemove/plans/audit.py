"""Incremental job-audit report over an archive of job records.

The report lives in a typed *ledger* table (the seven report columns plus
``LEDGER_EXTRA``); it is never round-tripped through CSV, so
values do not drift between runs. Beside it, ``<ledger>_files`` keeps path, length and
modification time of the files that the ledger covers. A run:

1. lists the archive and scans the files whose state is new (incremental), or all of them (full rescan),
2. computes the report columns with built-in expressions (no UDFs),
3. keeps the newest record of each job: rows that are new, or newer than the
   ledger's, are appended, or replace those they supersede; a full rescan replaces the ledger,
4. returns the ledger ordered by End Time (newest first, nulls last, then
   Job ID) plus a status message.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.audit import REPORT_COLUMNS, audit_frame, iso_timestamp
from ..functions.identifiers import quote_name, split_name
from ..operators.catalog import table_provider
from ..operators.write import counted, ensure_namespace, replace_table, table_exists, written
from ..session import ensure_checkpoint_dir, scratch_path
from ..sources.files import file_states
from ..sources.jobs import read_job_records

# Status messages of a report run.
MSG_NO_ARCHIVE = "Archive directory does not exist."
MSG_EMPTY = "No completed jobs found to report."
MSG_UP_TO_DATE = "Audit report is already up-to-date."
MSG_UPDATED = "Report updated with {n} new job(s)."
MSG_UNREADABLE = "Could not read existing audit report. Performing a full rescan. Error: %s"

#: Key, file and file time of a row's record; ``entry`` tells records without an id apart, which share their file's key (null: has an id).
LEDGER_EXTRA = ["job_key", "entry", "source_file", "file_mtime"]
#: A run reads so many files by name; with more of them new it scans the archive and drops the others' records.
MAX_NAMED_FILES = 5_000

log = logging.getLogger(__name__)


@dataclass
class AuditResult:
    report: DataFrame | None
    message: str
    new_jobs: int
    rejects: DataFrame | None = None


def one_per_job(records: DataFrame) -> DataFrame:
    """Ledger rows of ``records``, one per job: that of the newest file.

    Records of one job in the same file, or in files of the same time, go by
    file, then by the largest row. Records without an id share their file's key but are
    not taken for one job; only equal ones count once.
    """
    rows = audit_frame(records, keep=["job_key", "source_file", "file_mtime", "job_id"])
    values = [quote_name([c]) for c in REPORT_COLUMNS]
    anonymous = F.when(F.col("job_id").isNull(), F.sha2(F.to_json(F.struct(*values)), 256))
    newest = F.max(F.struct("file_mtime", "source_file", *values)).alias("r")
    picked = rows.groupBy("job_key", anonymous.alias("entry")).agg(newest)
    return picked.select(*[F.col(f"r.{v}") for v in values], "job_key", "entry", F.col("r.source_file"), F.col("r.file_mtime"))


def report_view(ledger: DataFrame) -> DataFrame:
    """The seven report columns of a ledger."""
    return ledger.select(*[F.col(quote_name([c])) for c in REPORT_COLUMNS])


def sorted_report(report: DataFrame) -> DataFrame:
    """End Time descending, nulls last; Job ID breaks ties deterministically."""
    return report.orderBy(F.col("`End Time (UTC)`").desc_nulls_last(), F.col("`Job ID`").asc())


def top_recent(report: DataFrame, n: int) -> DataFrame:
    """The ``n`` most recently ended jobs (a top-k, not a full sort)."""
    return sorted_report(report).limit(n)


# Up to this many distinct new keys, the increment's keys are broadcast to
# the ledger scan instead of shuffling the ledger's keys (checked count).
MAX_BROADCAST_NEW_KEYS = 1_000_000


def ledger_rows_of(spark: SparkSession, rows: DataFrame, ledger: str) -> DataFrame:
    """The ledger's rows whose ``job_key`` is among those of ``rows``.

    An increment is usually far smaller than the ledger, so its
    distinct keys are counted first (a job over the new rows only); within
    the bound they are broadcast into a semi-join over the ledger, which then isn't
    shuffled. Beyond the bound it is a plain semi-join.
    """
    keys = rows.select("job_key").distinct()
    few = keys.count() <= MAX_BROADCAST_NEW_KEYS
    return spark.read.table(quote_name(ledger)).join(F.broadcast(keys) if few else keys, "job_key", "left_semi")


def merge_rows(spark: SparkSession, rows: DataFrame, ledger: str, fmt: str | None = None) -> int:
    """Put ``rows`` (of ``one_per_job``) into the ledger; returns how many were new or newer.

    A row goes in if the ledger has none of its job, or an older one with other
    values; doing it again therefore changes nothing. New jobs only are appended.
    Where a row supersedes one, the ledger is written anew without the old row, by the staged swap,
    so it always holds one row per job. Without a ledger the rows become it.
    """
    ensure_checkpoint_dir(spark)
    name = quote_name(ledger)
    if not table_exists(spark, ledger):
        fresh, obs = counted(rows, "tm_audit")
        replace_table(fresh, ledger, fmt=fmt)
        return int(obs.get.get("rows", 0))
    rows = written(rows, "audit-rows")
    old = ledger_rows_of(spark, rows, ledger).alias("old")
    same_job = (F.col("new.job_key") == F.col("old.job_key")) & F.col("new.entry").eqNullSafe(F.col("old.entry"))
    both = rows.alias("new").join(old, same_job, "left")
    equal = F.lit(True)
    for c in REPORT_COLUMNS:
        equal = equal & F.col(f"new.{quote_name([c])}").eqNullSafe(F.col(f"old.{quote_name([c])}"))
    newer = F.struct("new.file_mtime", "new.source_file") > F.struct("old.file_mtime", "old.source_file")
    missing = F.col("old.job_key").isNull()
    fresh = both.filter(missing | (~equal & (newer | F.col("old.file_mtime").isNull()))).select("new.*", missing.alias("_new"))
    columns = spark.read.table(name).columns
    kinds = {r._new: r.n for r in fresh.groupBy("_new").agg(F.count(F.lit(1)).alias("n")).collect()}
    if False in kinds:
        gone = fresh.filter("NOT _new").select("job_key", "entry").alias("gone")
        superseded = (F.col("kept.job_key") == F.col("gone.job_key")) & F.col("kept.entry").eqNullSafe(F.col("gone.entry"))
        kept = spark.read.table(name).alias("kept").join(gone, superseded, "left_anti")
        replace_table(kept.select(*columns).unionByName(fresh.select(*columns)), ledger, fmt=table_provider(spark, ledger))
        spark.catalog.refreshTable(name)
    elif True in kinds:
        fresh.select(*columns).write.insertInto(name)  # by position, in the ledger's own format
    return sum(kinds.values())


def append_rejects(spark: SparkSession, rejects: DataFrame, ledger: str) -> str:
    """Append rejects that ``<ledger>_rejects`` does not hold yet; returns that table's name."""
    table = f"{ledger}_rejects"
    rejects = rejects.select("source_file", "_corrupt_record").distinct()
    if table_exists(spark, table):
        rejects = rejects.join(spark.read.table(quote_name(table)), ["source_file", "_corrupt_record"], "left_anti")
    rejects.write.mode("append").saveAsTable(quote_name(table))
    return table


def _is_missing_path(exc: AnalysisException) -> bool:
    return (exc.getCondition() or "").startswith("PATH_NOT_FOUND")


def _readable(spark: SparkSession, ledger: str) -> bool:
    """Whether the ledger has its columns and gives a row; if not, a warning says that everything is scanned anew."""
    try:
        spark.read.table(quote_name(ledger)).select(*[quote_name([c]) for c in [*REPORT_COLUMNS, *LEDGER_EXTRA]]).first()
        return True
    except Exception as exc:  # noqa: BLE001 - whatever keeps it from being read
        log.warning(MSG_UNREADABLE, str(exc).split("\n", 1)[0])
        return False


def new_files(spark: SparkSession, states: DataFrame, ledger: str) -> DataFrame:
    """Those of the listed ``states`` that ``<ledger>_files`` does not hold with the same length and time."""
    table = f"{ledger}_files"
    if not table_exists(spark, table):
        return states
    return states.join(spark.read.table(quote_name(table)), states.columns, "left_anti")


def generate_report(
    spark: SparkSession,
    archive: str,
    ledger: str,
    full_rescan: bool = False,
    multi_line: bool = True,
    glob: str | None = "*.json",
    fmt: str | None = None,
) -> AuditResult:
    """Update the ledger table ``ledger`` from ``archive``; return the report.

    An incremental run opens only files that are new, or of another length or
    modification time than when the ledger took them in; it ends with
    the ledger of a full rescan, except that a job whose file has gone stays. The newest record of a job wins. ``new_jobs``
    counts rows that are new or replaced; ``rejects`` are those of the files that the run has read.
    The file states are written after the ledger: a run cut short between the two reads the same
    files again and finds nothing to change. A ledger that can't be read is made anew.
    """
    try:
        spark.read.text(archive).schema  # noqa: B018 - resolve the path now
    except AnalysisException as exc:
        if _is_missing_path(exc):
            return AuditResult(None, MSG_NO_ARCHIVE, 0)
        raise
    parent = split_name(ledger)[:-1]
    if parent:
        ensure_namespace(spark, quote_name(parent))
    states, files_table = file_states(spark, archive, glob), f"{ledger}_files"
    incremental = not full_rescan and table_exists(spark, ledger) and _readable(spark, ledger)
    seen = new_files(spark, states, ledger) if incremental else states
    named = [r for r in seen.limit(MAX_NAMED_FILES + 1).collect()] if incremental else None
    keep = partial(written, tag="audit-pieces") if named != [] else None
    if named is not None and len(named) <= MAX_NAMED_FILES:
        seen = spark.createDataFrame(named, states.schema)
        records, rejects = read_job_records(spark, archive, multi_line, glob, files=[r.source_file for r in named], keep=keep)
    else:
        path = scratch_path(spark, "audit-files")
        seen.write.parquet(path)  # as listed before the scan: a file that grows meanwhile is read again next time
        seen = spark.read.schema(states.schema).parquet(path)
        records, rejects = read_job_records(spark, archive, multi_line, glob, keep=keep)
        if incremental:
            records = records.join(seen.select("source_file"), "source_file", "left_semi")
    if incremental:
        new_jobs = merge_rows(spark, one_per_job(records), ledger) if named else 0
    else:
        fresh, obs = counted(one_per_job(records), "tm_audit")
        replace_table(fresh, ledger, fmt=fmt)
        new_jobs = int(obs.get.get("rows", 0))
    if not incremental:
        replace_table(seen, files_table)
    elif named:
        seen.write.mode("append").saveAsTable(quote_name(files_table))
    ledger_df = spark.read.table(quote_name(ledger))
    if new_jobs == 0 and ledger_df.isEmpty():
        return AuditResult(None, MSG_EMPTY, 0, rejects)
    message = MSG_UP_TO_DATE if new_jobs == 0 else MSG_UPDATED.format(n=new_jobs)
    return AuditResult(sorted_report(report_view(ledger_df)), message, new_jobs, rejects)


def compact_ledger(spark: SparkSession, ledger: str, rows_per_file: int = 2_000_000) -> int:
    """Rewrite the ledger into about ``rows / rows_per_file`` files; returns the file count.

    Incremental runs append a few small files each; compaction reads the
    ledger once and writes it back through the staged swap (the old table
    stays until the new one is written) in the ledger's own format. The rows
    are dealt evenly over as many tasks as files.
    """
    df = spark.read.table(quote_name(ledger))
    n = max(1, -(-df.count() // rows_per_file))
    replace_table(df.repartition(n), ledger, fmt=table_provider(spark, ledger))
    spark.catalog.refreshTable(quote_name(ledger))
    return len(spark.read.table(quote_name(ledger)).inputFiles())


def filter_report(
    report: DataFrame,
    job_types: Sequence[str] | None = None,
    statuses: Sequence[str] | None = None,
) -> DataFrame:
    """``Job Type IN (..) AND Status IN (..)``; an empty selection means no filter."""
    out = report
    if job_types:
        out = out.filter(F.col("`Job Type`").isin(list(job_types)))
    if statuses:
        out = out.filter(F.col("`Status`").isin(list(statuses)))
    return out


def filter_values(report: DataFrame) -> DataFrame:
    """Distinct choices for the two filters: ``(filter, value)`` rows.

    One scan: the pairs are made distinct first (which also frees the plan of
    the report's order), so that only few rows are taken apart.
    """
    pairs = report.select("Job Type", "Status").distinct()
    choices = [
        F.struct(F.lit(name).alias("filter"), F.col(quote_name([name])).alias("value")) for name in ("Job Type", "Status")
    ]
    return pairs.select(F.inline(F.array(*choices))).distinct()


def write_report_csv(report: DataFrame, path: str) -> None:
    """CSV export with header (directory of part files, full overwrite).

    Timestamps are written with microseconds and an explicit offset (the
    default CSV format keeps milliseconds only), so an import reads back
    the same instants.
    """
    (
        report.write.mode("overwrite")
        .option("header", True)
        .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
        .csv(path)
    )


AUDIT_CSV_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in REPORT_COLUMNS]
)


def import_report_csv(spark: SparkSession, csv_path: str, ledger: str) -> int:
    """Seed a ledger from an earlier CSV report; returns rows imported.

    Every column is read as text (no re-inference), End Time parsed per value;
    empty strings stay empty strings (no NaN/null drift).
    """
    # Spark writes '' as a quoted "" and null as a bare empty field; with no
    # null marker that can occur in the data, the two read back apart.
    df = (
        spark.read.option("header", True)
        .option("nullValue", "\u0000")
        .schema(AUDIT_CSV_SCHEMA)
        .csv(csv_path)
    )
    rows = df.select(
        *[F.col(quote_name([c])) for c in REPORT_COLUMNS if c != "End Time (UTC)"],
        iso_timestamp(F.regexp_replace(F.col("`End Time (UTC)`"), r"\+00:00$", "Z")).alias("End Time (UTC)"),
        F.col("`Job ID`").alias("job_key"),
        F.lit(None).cast("string").alias("entry"),
        F.lit(csv_path).alias("source_file"),
        F.lit(None).cast("timestamp").alias("file_mtime"),
    ).select(*[quote_name([c]) for c in REPORT_COLUMNS], *LEDGER_EXTRA)
    counted_rows, obs = counted(rows, "tm_import")
    replace_table(counted_rows, ledger)
    spark.sql(f"DROP TABLE IF EXISTS {quote_name(f'{ledger}_files')}")  # no file is known to be covered
    return int(obs.get.get("rows", 0))


def export_writer(
    report: DataFrame,
    url: str,
    database: str | None = None,
    schema: str | None = None,
    table: str = "AUDIT_TABLE",
    properties: dict | None = None,
    mode: str = "overwrite",
):
    """A configured JDBC writer for the report (target names upper-cased).

    The write runs on the executors (one connection per partition); nothing
    is collected to the driver.
    """
    name = ".".join(p.upper() for p in (database, schema) if p) + ("." if database or schema else "") + table.upper()
    writer = report.write.format("jdbc").mode(mode).option("url", url).option("dbtable", name)
    for k, v in (properties or {}).items():
        writer = writer.option(k, v)
    return writer


def export_report(report: DataFrame, url: str, **kwargs) -> None:
    """Overwrite the warehouse table with ``report`` over JDBC."""
    export_writer(report, url, **kwargs).save()

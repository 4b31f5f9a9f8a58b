"""

Every query reads the driver's parquet tables (or data Spark derives from
them) in full. Scratch tables and files go below ``spark.checkpoint.dir``
(a local folder is created only when the session has none, as in tests);
each call uses fresh names so a query can run twice in one session.

Comparison-friendly projections: timestamps that the report keeps as
``TIMESTAMP`` are returned as epoch microseconds (``BIGINT``) so both
engines hash the same value.
"""

from __future__ import annotations

import time
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemove.functions.identifiers import quote_name
from tablemove.operators.catalog import list_tables, partition_columns
from tablemove.operators.reconcile import reconcile_tables
from tablemove.operators.select import select_tables
from tablemove.operators.state import append_events, latest_state
from tablemove.operators.write import ensure_namespace
from tablemove.plans import audit as audit_plan
from tablemove.plans.board import job_board
from tablemove.plans.chain import chain_registrations
from tablemove.plans.copy import copy_summary, copy_table, copy_tables
from tablemove.plans.ingest import ingest_files, ingest_selection, ingest_tables
from tablemove.plans.publish import build_manifest, publish_namespace
from tablemove.session import ensure_checkpoint_dir, scratch_path, unique_name
from tablemove.sources.files import write_named_files
from tablemove.sources.job_fixture import jobs_from_events
from tablemove.sources.jobs import JOB_COLUMNS, read_job_records, write_job_records
from tablemove.sources.tables import register_parquet_tables
from tablemove.streaming.audit_stream import run_audit_stream
from tablemove.streaming.copy_requests import refresh_results, start_copy_request_stream

SMOKE_DIR = "/root/testdata/sf0.001"
ALL_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


# --------------------------------------------------------------------------- helpers
def _source_namespace(spark: SparkSession, sf_dir: str, tables: list[str]) -> str:
    """A fresh namespace whose tables are the given parquet files (no copy)."""
    ensure_checkpoint_dir(spark)
    ns = unique_name("tm_src")
    register_parquet_tables(spark, sf_dir, ns, tables, location=scratch_path(spark, ns))
    return ns


def _target_namespace(spark: SparkSession, prefix: str = "tm_dst") -> tuple[str, str]:
    ensure_checkpoint_dir(spark)
    ns = unique_name(prefix)
    return ns, scratch_path(spark, ns)


def _ingested(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    src = _source_namespace(spark, sf_dir, [table])
    dst, loc = _target_namespace(spark)
    out = ingest_tables(spark, src, [table], target_namespace=dst, target_location=loc)
    row = out.first()
    if row.status != "succeeded":
        raise RuntimeError(f"ingest of {table} failed: {row.error}")
    return spark.read.table(quote_name([dst, table]))


def _micros(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.unix_micros(F.col(quote_name([column]))))


def _job_archive(spark: SparkSession, sf_dir: str, predicate: str | None = None, path: str | None = None) -> str:
    """Job records derived from ``events`` written as JSON lines; returns the folder."""
    ensure_checkpoint_dir(spark)
    path = path or scratch_path(spark, "archive")
    jobs = jobs_from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))
    if predicate:
        jobs = jobs.filter(predicate)
    write_job_records(jobs, path)
    return path


def _ledger_name(spark: SparkSession) -> str:
    ns, loc = _target_namespace(spark, "tm_audit")
    ensure_namespace(spark, ns, loc)
    return f"{ns}.ledger"


def _audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = _job_archive(spark, sf_dir)
    res = audit_plan.generate_report(
        spark, archive, _ledger_name(spark), full_rescan=True, multi_line=False
    )
    return res.report


def _for_compare(report: DataFrame) -> DataFrame:
    return _micros(report, "End Time (UTC)")


# --------------------------------------------------------------------------- queries
def q_ingest_orders(spark, sf_dir):
    return _ingested(spark, sf_dir, "orders")


def q_ingest_lineitem(spark, sf_dir):
    return _ingested(spark, sf_dir, "lineitem")


def q_ingest_embeddings(spark, sf_dir):
    return _ingested(spark, sf_dir, "embeddings")


def q_ingest_documents(spark, sf_dir):
    return _ingested(spark, sf_dir, "documents")


def q_copy_customer(spark, sf_dir):
    src = _source_namespace(spark, sf_dir, ["customer"])
    dst, loc = _target_namespace(spark)
    copy_tables(spark, src, dst, ["customer"], target_location=loc)
    return spark.read.table(quote_name([dst, "customer"]))


def q_copy_part(spark, sf_dir):
    src = _source_namespace(spark, sf_dir, ["part"])
    dst, loc = _target_namespace(spark)
    # Copy twice: the second run replaces the first (idempotent re-run).
    copy_tables(spark, src, dst, ["part"], target_location=loc)
    copy_tables(spark, src, dst, ["part"], target_location=loc)
    return spark.read.table(quote_name([dst, "part"]))


def q_copy_create_strict(spark, sf_dir):
    src = _source_namespace(spark, sf_dir, ["supplier"])
    dst, loc = _target_namespace(spark)
    ensure_namespace(spark, dst, loc)
    copy_table(spark, f"{src}.supplier", f"{dst}.supplier", mode="create")
    return spark.read.table(quote_name([dst, "supplier"]))


def q_ingest_csv_nation(spark, sf_dir):
    ensure_checkpoint_dir(spark)
    csv_dir = scratch_path(spark, "csv", "load_date=2025-06-04")
    spark.read.parquet(f"{sf_dir}/nation.parquet").write.option("header", True).csv(csv_dir)
    dst, loc = _target_namespace(spark)
    ensure_namespace(spark, dst, loc)
    ingest_files(spark, f"{csv_dir}/*.csv", f"{dst}.nation")
    return spark.read.table(quote_name([dst, "nation"]))


def q_ingest_partitioned_orders(spark, sf_dir):
    """Source partitioned by status; the copy carries columns, partition col last."""
    ensure_checkpoint_dir(spark)
    src, src_loc = _target_namespace(spark, "tm_psrc")
    ensure_namespace(spark, src, src_loc)
    (
        spark.read.parquet(f"{sf_dir}/orders.parquet")
        .write.partitionBy("o_orderstatus")
        .saveAsTable(quote_name([src, "orders"]))
    )
    dst, loc = _target_namespace(spark)
    ingest_tables(spark, src, ["orders"], target_namespace=dst, target_location=loc)
    return spark.read.table(quote_name([dst, "orders"]))


def q_copy_outcomes(spark, sf_dir):
    src = _source_namespace(spark, sf_dir, ["customer", "part", "lineitem"])
    dst, loc = _target_namespace(spark)
    out = copy_tables(
        spark, src, dst, ["customer", "missing_table", "part", "lineitem"],
        target_location=loc, verify=True,
    )
    return out.select("position", "table", "status", "rows", "verified", "error_class")


def q_copy_summary(spark, sf_dir):
    src = _source_namespace(spark, sf_dir, ["customer", "part"])
    dst, loc = _target_namespace(spark)
    out = copy_tables(spark, src, dst, ["customer", "missing_table", "part"], target_location=loc)
    rows = out.groupBy("status").agg(F.sum("rows").alias("rows"))
    return copy_summary(out).join(rows, "status")


def q_reconcile_copy(spark, sf_dir):
    src = _source_namespace(spark, sf_dir, ["lineitem", "orders"])
    dst, loc = _target_namespace(spark)
    out = copy_tables(spark, src, dst, ["lineitem", "orders"], target_location=loc, verify=True)
    return out.select("table", F.col("rows").alias("target_rows"), F.col("verified").alias("matched"))


def q_select_tables(spark, sf_dir):
    """Select from a listing (unknown dropped, duplicates once), then ingest."""
    src = _source_namespace(spark, sf_dir, ALL_TABLES)
    spark.read.parquet(f"{sf_dir}/region.parquet").createOrReplaceTempView("tm_temp_view")
    dst, loc = _target_namespace(spark)
    spec = ["orders", "no_such_table", "region", "orders", "tm_temp_view", "nation"]
    chosen = select_tables(list_tables(spark, src), spec)
    out = ingest_selection(spark, src, spec, target_namespace=dst, target_location=loc)
    return chosen.join(out.select(F.col("table").alias("tableName"), "status", "rows"), "tableName")


def q_list_tables(spark, sf_dir):
    """Listing of an ingested namespace, with each table's row count."""
    src = _source_namespace(spark, sf_dir, ALL_TABLES)
    dst, loc = _target_namespace(spark)
    ingest_tables(spark, src, "*", target_namespace=dst, target_location=loc, parallelism=4)
    listing = list_tables(spark, dst).select("tableName")
    counts = None
    for t in ALL_TABLES:
        c = spark.read.table(quote_name([dst, t])).agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(t).alias("tableName"), "rows"
        )
        counts = c if counts is None else counts.unionByName(c)
    return listing.join(counts, "tableName")


def q_audit_full(spark, sf_dir):
    return _for_compare(_audit_report(spark, sf_dir))


def q_audit_incremental(spark, sf_dir):
    """Two runs: the earlier half of the jobs, then the rest appended."""
    ensure_checkpoint_dir(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    mid = events.agg(
        F.timestamp_micros(
            ((F.unix_micros(F.min(F.col("ts").cast("timestamp"))) + F.unix_micros(F.max(F.col("ts").cast("timestamp")))) / 2).cast("long")
        ).alias("mid")
    ).first()["mid"]
    archive = scratch_path(spark, "archive")
    ledger = _ledger_name(spark)
    early = jobs_from_events(events.filter(F.col("ts").cast("timestamp") < F.lit(mid)))
    late = jobs_from_events(events.filter(~(F.col("ts").cast("timestamp") < F.lit(mid))))
    write_job_records(early, archive)
    first = audit_plan.generate_report(spark, archive, ledger, multi_line=False)
    write_job_records(late, archive)
    second = audit_plan.generate_report(spark, archive, ledger, multi_line=False)
    if first.new_jobs == 0 or second.new_jobs == 0:
        raise RuntimeError(f"incremental run added nothing: {first.message} / {second.message}")
    return _for_compare(second.report)


def q_audit_filtered(spark, sf_dir):
    report = _audit_report(spark, sf_dir)
    return _for_compare(
        audit_plan.filter_report(
            report, job_types=["Migrate Catalogs", "Register Snowflake"], statuses=["COMPLETED", "FAILED"]
        )
    )


def q_audit_top_recent(spark, sf_dir):
    return _for_compare(audit_plan.top_recent(_audit_report(spark, sf_dir), 50))


def q_audit_filter_values(spark, sf_dir):
    return audit_plan.filter_values(_audit_report(spark, sf_dir))


def q_audit_duration_stats(spark, sf_dir):
    """Count of jobs per Status and Duration kind (numeric / N/A / Error)."""
    report = _audit_report(spark, sf_dir)
    kind = (
        F.when(F.col("`Duration (s)`").isin("N/A", "Error"), F.col("`Duration (s)`"))
        .otherwise(F.lit("numeric"))
    )
    return report.groupBy(F.col("Status").alias("status"), kind.alias("duration_kind")).agg(
        F.count(F.lit(1)).alias("jobs")
    )


def _archived_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, _ = read_job_records(spark, _job_archive(spark, sf_dir), multi_line=False)
    return records


def q_chain_registrations(spark, sf_dir):
    children = chain_registrations(_archived_records(spark, sf_dir))
    return children.withColumn("tables", F.array_join("tables", ", "))


def q_job_board(spark, sf_dir):
    """Running jobs sit in the queue, the rest in the archive; failed ones have a log."""
    ensure_checkpoint_dir(spark)
    jobs = jobs_from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))
    queue, archive, logs = (scratch_path(spark, n) for n in ("queue", "archive", "logs"))
    write_job_records(jobs.filter(F.col("status") == "running"), queue)
    write_job_records(jobs.filter(F.col("status") != "running"), archive)
    (
        jobs.filter(F.col("status") == "failed")
        .select("job_id", F.concat(F.lit("job "), "job_id", F.lit(" ended with status failed")).alias("log"))
        .write.json(logs)
    )
    log_table = spark.read.schema("job_id string, log string").json(logs)
    board = job_board(spark, queue, archive, log_table, multi_line=False)
    return board.drop("file_mtime", "source_file")


def _status_events(jobs: DataFrame) -> DataFrame:
    """pending, running (with start), then the final status (with end) if finished."""
    n = F.substring("job_id", 5, 100).cast("long")
    none = F.lit(None).cast("string")

    def ev(status, k, start, end):
        return F.struct(status.alias("status"), (n * 4 + k).alias("event_seq"),
                        start.alias("start_time"), end.alias("end_time"))

    finished = F.col("status") != "running"
    events = F.array(
        ev(F.lit("pending"), 1, none, none),
        ev(F.lit("running"), 2, F.col("start_time"), none),
        F.when(finished, ev(F.col("status"), 3, none, F.col("end_time"))),
    )
    return (
        jobs.select("job_id", F.explode(events).alias("e"))
        .filter(F.col("e").isNotNull())
        .select("job_id", "e.event_seq", "e.status", "e.start_time", "e.end_time")
    )


def q_job_latest_state(spark, sf_dir):
    ns, loc = _target_namespace(spark, "tm_state")
    ensure_namespace(spark, ns, loc)
    table = f"{ns}.job_events"
    append_events(_status_events(_archived_records(spark, sf_dir)), table)
    return latest_state(spark.read.table(table))


PUBLISH_WAREHOUSE = "hdfs://namenode/warehouse"
DDL_NAMES = {"catalog_integration": "my_hive_catalog_integration", "external_volume": "iceberg_azure_vol"}


def manifest_from_records(jobs: DataFrame) -> DataFrame:
    """Migrations write metadata versions; registration jobs name the tables to publish."""
    n = (F.substring("job_id", 5, 100).cast("long") + 1).cast("string")
    name = (
        F.when(F.col("status") == "completed", F.concat(F.lit("v"), n, F.lit(".metadata.json")))
        .when(F.col("status") == "failed", F.concat(F.lit("v"), n, F.lit(".metadata.json.tmp")))
        .otherwise(F.concat(F.lit("snap-"), n, F.lit(".avro")))
    )
    files = (
        jobs.filter(F.col("job_type") == "migrate_catalogs")
        .select("dest_db", "status", "job_id", F.explode("tables").alias("t"))
        .select(F.concat_ws("/", F.lit(PUBLISH_WAREHOUSE), "dest_db", "t", F.lit("metadata"), name).alias("path"))
    )
    tables = (
        jobs.filter(F.col("job_type") == "register_snowflake")
        .select(F.col("azure_db").alias("namespace"), F.explode("tables").alias("table"), "sf_db", "sf_schema")
        .distinct()
        .withColumn("location", F.concat_ws("/", F.lit(PUBLISH_WAREHOUSE), "namespace", "table"))
    )
    return build_manifest(files, tables, PUBLISH_WAREHOUSE, **DDL_NAMES)


def q_publish_manifest(spark, sf_dir):
    return manifest_from_records(_archived_records(spark, sf_dir))


def q_publish_listed(spark, sf_dir):
    """Tables of a namespace and the metadata files that lie in their folders: a table per region, a version per supplier."""
    ns, loc = _target_namespace(spark, "tm_listed")
    ensure_namespace(spark, ns, loc)
    nations, regions = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    for r in regions.collect():
        nations.filter(F.col("n_regionkey") == r.r_regionkey).write.saveAsTable(f"{ns}.region_{r.r_regionkey}")
    unread = F.when(F.col("s_suppkey") % 4 == 0, ".tmp").otherwise("")
    files = suppliers.filter("n_regionkey > 0 AND s_suppkey IS NOT NULL").select(
        F.concat(F.lit("region_"), "n_regionkey", F.lit("/metadata")).alias("folder"),
        F.concat(F.lit("v"), "s_suppkey", F.lit(".metadata.json"), unread).alias("name"),
    )
    write_named_files(files.withColumn("text", F.lit("{}")), loc)
    return publish_namespace(spark, ns, loc, "SFDB", "PUBLIC", **DDL_NAMES).drop("namespace")


def q_audit_stream(spark, sf_dir):
    archive = _job_archive(spark, sf_dir)
    ledger = _ledger_name(spark)
    out = run_audit_stream(spark, archive, ledger, scratch_path(spark, "ckpt-audit"), multi_line=False)
    return _for_compare(audit_plan.report_view(out))


STREAM_TABLES = ["region", "nation", "supplier", "customer", "part", "orders", "lineitem", "events"]


def q_copy_request_stream(spark, sf_dir):
    """Copy requests (one per table, plus one of an unknown type) served by a stream."""
    src = _source_namespace(spark, sf_dir, STREAM_TABLES)
    ns, loc = _target_namespace(spark, "tm_req")
    ensure_namespace(spark, ns, loc)
    queue, archive = scratch_path(spark, "queue"), scratch_path(spark, "archive")
    requests = [(f"req-{t}", "ingest_from_hive", src, [t]) for t in STREAM_TABLES]
    requests.append(("req-unknown", "compact_table", src, ["orders"]))
    (
        spark.createDataFrame(requests, "job_id string, job_type string, source_db string, tables array<string>")
        .repartition(3)
        .write.json(queue)
    )
    q = start_copy_request_stream(
        spark, queue, archive, scratch_path(spark, "ckpt-req"),
        outcomes_table=f"{ns}.outcomes", events_table=f"{ns}.job_events",
        target_location_root=scratch_path(spark, "req-targets"), multi_line=False,
    )
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    refresh_results(spark, f"{ns}.outcomes", f"{ns}.job_events")
    states = latest_state(spark.read.table(f"{ns}.job_events")).select(
        "job_id", F.col("status").alias("job_status")
    )
    outcomes = spark.read.table(f"{ns}.outcomes").select("job_id", "table", "status", "rows")
    return states.join(outcomes, "job_id", "left")


def q_request_stream_chain(spark, sf_dir):
    """A flagged migration with one missing table queues a registration of the tables that it copied."""
    src = _source_namespace(spark, sf_dir, STREAM_TABLES)
    ns, loc = _target_namespace(spark, "tm_req")
    ensure_namespace(spark, ns, loc)
    queue = scratch_path(spark, "queue")
    request = [("req-chain", "migrate_catalogs", src, f"{ns}_to", [*STREAM_TABLES, "missing"], True, "SFDB", "PUBLIC")]
    spark.createDataFrame(
        request,
        "job_id string, job_type string, source_db string, dest_db string, tables array<string>, "
        "register_on_snowflake boolean, sf_db string, sf_schema string",
    ).write.json(queue)
    q = start_copy_request_stream(
        spark, queue, scratch_path(spark, "archive"), scratch_path(spark, "ckpt-req"),
        outcomes_table=f"{ns}.outcomes", events_table=f"{ns}.job_events",
        target_location_root=scratch_path(spark, "req-targets"),
    )
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    refresh_results(spark, f"{ns}.outcomes", f"{ns}.job_events")
    queued, _ = read_job_records(spark, queue)
    children = queued.filter(F.col("chained_from").isNotNull()).select(
        "chained_from", "job_type", "status", "sf_db", "sf_schema", F.explode("tables").alias("table")
    )
    copied = spark.read.table(f"{ns}.outcomes").select("table", "rows")
    return children.join(copied, "table", "left")


def _cut_short(rejects: DataFrame) -> DataFrame:
    """Rejects that hold some text. Spark's writer leaves a file without a byte where its first task has no rows; the report names that, too."""
    return rejects.filter(F.col("_corrupt_record") != "")


def q_audit_rejects(spark, sf_dir):
    """An archive where some lines are cut short: they are rejected, the rest reported."""
    ensure_checkpoint_dir(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    jobs = jobs_from_events(events).withColumn("_n", F.substring("job_id", 5, 100).cast("long"))
    line = F.to_json(F.struct(*JOB_COLUMNS))
    archive = scratch_path(spark, "archive")
    jobs.select(
        F.when(F.col("_n") % 17 == 0, F.substring(line, 1, 25)).otherwise(line).alias("value")
    ).write.text(archive)
    res = audit_plan.generate_report(
        spark, archive, _ledger_name(spark), full_rescan=True, multi_line=False, glob=None
    )
    n_rejects = _cut_short(res.rejects).count()
    expected = jobs.filter(F.col("_n") % 17 == 0).count()
    if n_rejects != expected:
        raise RuntimeError(f"expected {expected} rejected lines, got {n_rejects}")
    return _for_compare(res.report)


def q_copy_keep_partitioning(spark, sf_dir):
    """Copy a status-partitioned table keeping its partition layout."""
    src, src_loc = _target_namespace(spark, "tm_psrc")
    ensure_namespace(spark, src, src_loc)
    (
        spark.read.parquet(f"{sf_dir}/orders.parquet")
        .write.partitionBy("o_orderstatus")
        .saveAsTable(quote_name([src, "orders"]))
    )
    dst, loc = _target_namespace(spark)
    copy_tables(spark, src, dst, ["orders"], keep_partitioning=True, target_location=loc)
    if partition_columns(spark, f"{dst}.orders") != ["o_orderstatus"]:
        raise RuntimeError("partition layout not kept")
    return spark.read.table(quote_name([dst, "orders"]))


def q_ingest_all_verified(spark, sf_dir):
    """Every driver table ingested (four at a time) and verified by count + hash."""
    src = _source_namespace(spark, sf_dir, ALL_TABLES)
    dst, loc = _target_namespace(spark)
    out = ingest_tables(spark, src, ALL_TABLES, target_namespace=dst, target_location=loc,
                        verify=True, parallelism=4)
    return out.select("position", "table", "status", "rows", "verified")


def q_audit_csv_roundtrip(spark, sf_dir):
    """Report exported as CSV, then imported as a new ledger: values unchanged."""
    report = _audit_report(spark, sf_dir)
    csv_dir = scratch_path(spark, "report-csv")
    audit_plan.write_report_csv(report, csv_dir)
    ledger = _ledger_name(spark)
    audit_plan.import_report_csv(spark, csv_dir, ledger)
    return _for_compare(audit_plan.report_view(spark.read.table(ledger)))


def q_audit_compacted(spark, sf_dir):
    """Ledger built by two incremental runs, then compacted; the report is unchanged."""
    ensure_checkpoint_dir(spark)
    jobs = jobs_from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))
    kind = F.col("job_type").isin("ingest_from_hive", "migrate_catalogs")
    archive, ledger = scratch_path(spark, "archive"), _ledger_name(spark)
    write_job_records(jobs.filter(kind), archive)
    audit_plan.generate_report(spark, archive, ledger, multi_line=False)
    write_job_records(jobs.filter(~kind), archive)
    audit_plan.generate_report(spark, archive, ledger, multi_line=False)
    audit_plan.compact_ledger(spark, ledger)
    return _for_compare(audit_plan.report_view(spark.read.table(ledger)))


def q_reconcile_tables(spark, sf_dir):
    """Check earlier copies after the fact; one table was never copied."""
    names = ["customer", "part", "orders", "lineitem"]
    src = _source_namespace(spark, sf_dir, names + ["supplier"])
    dst, loc = _target_namespace(spark)
    copy_tables(spark, src, dst, names, target_location=loc, parallelism=2)
    return reconcile_tables(spark, src, dst, names + ["supplier"])


def q_reconcile_nested(spark, sf_dir):
    """Copies of nested columns, one with wider numbers inside, one with a changed value deep in a map."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn(
        "said", F.struct(F.create_map("role", F.create_map(F.lit("turn"), F.col("turn").cast("int"))).alias("by"), "text")
    )
    vecs = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        "vec_id", F.array(F.struct(F.col("vec_id").cast("int").alias("n"), F.create_map(F.lit("id"), F.col("vec_id").cast("int")).alias("m"))).alias("parts")
    )
    wide = "array<struct<n:bigint,m:map<string,bigint>>>"
    src, src_loc = _target_namespace(spark, "tm_src")
    dst, dst_loc = _target_namespace(spark)
    ensure_namespace(spark, src, src_loc)
    ensure_namespace(spark, dst, dst_loc)
    turns.write.saveAsTable(f"{src}.turns")
    vecs.write.saveAsTable(f"{src}.vecs")
    copy_tables(spark, src, f"{dst}_same", ["turns"], target_location=f"{dst_loc}_same", verify=True)
    spark.read.table(f"{dst}_same.turns").write.saveAsTable(f"{dst}.turns")
    vecs.withColumn("parts", F.col("parts").cast(wide)).write.saveAsTable(f"{dst}.vecs")
    other = F.create_map("role", F.create_map(F.lit("turn"), F.when(F.col("turn") == 0, 1).otherwise(F.col("turn").cast("int"))))
    for ns, frame in ((src, turns), (dst, turns.withColumn("said", F.struct(other.alias("by"), "text")))):
        frame.write.saveAsTable(f"{ns}.changed")
    return reconcile_tables(spark, src, dst, ["turns", "vecs", "changed"])


#: Changes that keep counts and all non-null values: table -> (how the source reads, how the target reads), in both engines' SQL.
_NULL_CHANGES = {
    "same": ("c_nationkey AS a, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey END AS b", None),
    "moved": ("CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_nationkey END AS a, CASE WHEN c_custkey % 2 = 1 THEN NULL ELSE c_nationkey END AS b",
              "CASE WHEN c_custkey % 2 = 1 THEN NULL ELSE c_nationkey END AS a, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_nationkey END AS b"),
    "elements": ("{arr}(c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 1 END, 2) AS v",
                 "CASE WHEN c_custkey % 5 = 0 THEN {arr}(c_custkey, 2) ELSE {arr}(c_custkey, 1, 2) END AS v"),
    "borders": ("{arr}(c_custkey) AS v, {arr}(c_nationkey) AS w", "{arr}(c_custkey, c_nationkey) AS v, {none} AS w"),
    "fields": ("{row1} AS s", "{row2} AS s"),
    "missing": ("CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE {arr}(c_custkey) END AS v", "CASE WHEN c_custkey % 7 = 0 THEN {none} ELSE {arr}(c_custkey) END AS v"),
}
_SPARK_WORDS = {
    "arr": "array", "none": "array_remove(array(c_custkey), c_custkey)",
    "row1": "named_struct('p', CAST(NULL AS BIGINT), 'q', c_custkey)", "row2": "named_struct('p', c_custkey, 'q', CAST(NULL AS BIGINT))",
}
_DUCK_WORDS = {
    "arr": "list_value", "none": "list_filter(list_value(c_custkey), lambda x: x <> c_custkey)",
    "row1": "{'p': NULL::BIGINT, 'q': c_custkey}", "row2": "{'p': c_custkey, 'q': NULL::BIGINT}",
}


def q_reconcile_nulls(spark, sf_dir):
    """Copies in which only the place of nulls or of array borders differs from the source; one is a true copy."""
    spark.read.parquet(f"{sf_dir}/customer.parquet").createOrReplaceTempView("tm_null_source")
    src, src_loc = _target_namespace(spark, "tm_src")
    dst, dst_loc = _target_namespace(spark)
    ensure_namespace(spark, src, src_loc)
    ensure_namespace(spark, dst, dst_loc)
    for name, (source, target) in _NULL_CHANGES.items():
        for ns, reads in ((src, source), (dst, target or source)):
            spark.sql(f"SELECT c_custkey % 1000 AS k, {reads.format(**_SPARK_WORDS)} FROM tm_null_source").write.saveAsTable(f"{ns}.{name}")
    return reconcile_tables(spark, src, dst, list(_NULL_CHANGES))


def _indented(jobs):
    """Each record as JSON over several lines, its list's items at line starts."""
    line = F.to_json(F.struct(*JOB_COLUMNS))
    spread = F.regexp_replace(F.regexp_replace(line, r'","', '",\n  "'), r"\[", "[\n")
    return jobs.select(F.concat(F.lit("{\n  "), F.substring(spread, 2, 1 << 30)).alias("value"))


def q_audit_indented(spark, sf_dir):
    """Indented records, very many to a file, read by split files: the report is that of JSON lines."""
    ensure_checkpoint_dir(spark)
    jobs = jobs_from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))
    archive, ledger = scratch_path(spark, "archive"), _ledger_name(spark)
    _indented(jobs).write.text(archive)
    res = audit_plan.generate_report(spark, archive, ledger, glob=None)
    if not _cut_short(res.rejects).isEmpty():
        raise RuntimeError("an indented record was rejected")
    return _for_compare(res.report)


def q_audit_mixed_layout(spark, sf_dir):
    """Indented records, JSON lines and cut lines in the same files: what can be read is reported, each cut line is a reject."""
    ensure_checkpoint_dir(spark)
    jobs = jobs_from_events(spark.read.parquet(f"{sf_dir}/events.parquet")).withColumn("_n", F.substring("job_id", 5, 100).cast("long"))
    line = F.to_json(F.struct(*JOB_COLUMNS))
    lines = jobs.filter("_n % 17 <> 0 AND _n % 2 = 1").select(line.alias("value"))
    cut = jobs.filter("_n % 17 = 0").select(F.substring(line, 1, 25).alias("value"))
    archive = scratch_path(spark, "archive")
    mixed = _indented(jobs.filter("_n % 17 <> 0 AND _n % 2 = 0")).unionByName(lines).unionByName(cut)
    mixed.repartition("value").write.text(archive)
    res = audit_plan.generate_report(spark, archive, _ledger_name(spark), glob=None)
    n_rejects, expected = _cut_short(res.rejects).count(), cut.count()
    if n_rejects != expected:
        raise RuntimeError(f"expected {expected} rejects, got {n_rejects}")
    return _for_compare(res.report)


def q_audit_empty_files(spark, sf_dir):
    """Files a crash has left without content, beside good ones: (kind, rows) of what the batch and the stream report of them."""
    ensure_checkpoint_dir(spark)
    jobs = jobs_from_events(spark.read.parquet(f"{sf_dir}/events.parquet")).withColumn("_n", F.substring("job_id", 5, 100).cast("long") % 4)
    archive, ledger = scratch_path(spark, "archive"), _ledger_name(spark)
    lines = jobs.select("_n", F.when(F.col("_n") < 2, F.to_json(F.struct(*JOB_COLUMNS))).otherwise(" ").alias("value"))
    lines.write.partitionBy("_n").text(archive)  # two of the four folders hold blank lines only
    res = audit_plan.generate_report(spark, archive, ledger, glob=None)
    streamed = run_audit_stream(spark, archive, f"{ledger}_s", scratch_path(spark, "ckpt-empty"), glob=None)
    spark.catalog.refreshTable(f"{ledger}_s_rejects")
    folder = F.regexp_extract("source_file", r"/_n=(\d)/", 1)
    counts = [("batch", "empty", res.rejects), ("stream", "empty", spark.read.table(f"{ledger}_s_rejects")),
              ("batch", "reported", res.report), ("stream", "reported", streamed)]
    out = None
    for run, kind, df in counts:
        n = F.count_distinct(folder) if kind == "empty" else F.count(F.lit(1))
        row = df.agg(n.cast("long").alias("n")).select(F.lit(run).alias("run"), F.lit(kind).alias("kind"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def q_audit_incremental_dup(spark, sf_dir):
    """Every job archived twice, the second time with another status: the newest wins, in two runs as in one."""
    ensure_checkpoint_dir(spark)
    jobs = jobs_from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))
    archive, ledger = scratch_path(spark, "archive"), _ledger_name(spark)
    write_job_records(jobs, archive)
    audit_plan.generate_report(spark, archive, ledger, multi_line=False)
    time.sleep(1.1)  # file times of some stores have whole seconds
    write_job_records(jobs.withColumn("status", F.lit("repeated")), archive)
    second = audit_plan.generate_report(spark, archive, ledger, multi_line=False)
    full = audit_plan.generate_report(spark, archive, _ledger_name(spark), full_rescan=True, multi_line=False)
    both = _for_compare(second.report).withColumn("run", F.lit("incremental"))
    return both.unionByName(_for_compare(full.report).withColumn("run", F.lit("full")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "ingest_orders": q_ingest_orders,
    "ingest_lineitem": q_ingest_lineitem,
    "ingest_embeddings": q_ingest_embeddings,
    "ingest_documents": q_ingest_documents,
    "copy_customer": q_copy_customer,
    "copy_part": q_copy_part,
    "copy_create_strict": q_copy_create_strict,
    "ingest_csv_nation": q_ingest_csv_nation,
    "ingest_partitioned_orders": q_ingest_partitioned_orders,
    "copy_outcomes": q_copy_outcomes,
    "copy_summary": q_copy_summary,
    "reconcile_copy": q_reconcile_copy,
    "select_tables": q_select_tables,
    "list_tables": q_list_tables,
    "audit_full": q_audit_full,
    "audit_incremental": q_audit_incremental,
    "audit_filtered": q_audit_filtered,
    "audit_top_recent": q_audit_top_recent,
    "audit_filter_values": q_audit_filter_values,
    "audit_duration_stats": q_audit_duration_stats,
    "chain_registrations": q_chain_registrations,
    "job_board": q_job_board,
    "job_latest_state": q_job_latest_state,
    "publish_manifest": q_publish_manifest,
    "publish_listed": q_publish_listed,
    "audit_stream": q_audit_stream,
    "copy_request_stream": q_copy_request_stream,
    "audit_rejects": q_audit_rejects,
    "copy_keep_partitioning": q_copy_keep_partitioning,
    "ingest_all_verified": q_ingest_all_verified,
    "reconcile_tables": q_reconcile_tables,
    "request_stream_chain": q_request_stream_chain,
    "reconcile_nested": q_reconcile_nested,
    "reconcile_nulls": q_reconcile_nulls,
    "audit_incremental_dup": q_audit_incremental_dup,
    "audit_indented": q_audit_indented,
    "audit_mixed_layout": q_audit_mixed_layout,
    "audit_empty_files": q_audit_empty_files,
    "audit_csv_roundtrip": q_audit_csv_roundtrip,
    "audit_compacted": q_audit_compacted,
}


# --------------------------------------------------------------------------- oracle SQL
_JOBS_CTE = """
jobs AS (
  SELECT
    'job-' || lpad(CAST(event_id AS VARCHAR), 8, '0') AS job_id,
    CASE event_type WHEN 'signup' THEN 'ingest_from_hive' WHEN 'purchase' THEN 'migrate_catalogs'
      WHEN 'error' THEN 'register_snowflake' WHEN 'view' THEN 'export_audit_to_snowflake'
      ELSE 'compact_table' END AS job_type,
    'db' || CAST(user_id % 7 AS VARCHAR) AS source_db,
    CASE WHEN event_type = 'purchase' THEN 'cloud' || CAST(user_id % 3 AS VARCHAR) END AS dest_db,
    CASE WHEN event_type = 'error' THEN 'cloud' || CAST(user_id % 3 AS VARCHAR) END AS azure_db,
    CASE WHEN event_type <> 'view' THEN list_value('t' || CAST(event_id % 5 AS VARCHAR),
                                                   't' || CAST(event_id % 5 + 1 AS VARCHAR)) END AS tables,
    CASE WHEN event_id % 10 = 0 THEN 'failed' WHEN event_id % 10 = 1 THEN 'running'
         ELSE 'completed' END AS status,
    (event_type = 'purchase' AND event_id % 2 = 0) AS register_on_snowflake,
    'SFDB' AS sf_db, 'PUBLIC' AS sf_schema,
    CASE WHEN event_type = 'error' AND event_id % 3 = 0
         THEN 'job-' || lpad(CAST(event_id % 100 AS VARCHAR), 8, '0') END AS chained_from,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS start_time,
    CASE WHEN event_id % 10 = 1 THEN NULL WHEN event_id % 13 = 0 THEN 'bogus'
         ELSE strftime(ts + to_microseconds(CAST(round(value * 1000000) AS BIGINT)), '%Y-%m-%dT%H:%M:%S.%fZ')
    END AS end_time
  FROM events
)"""

_REPORT_CTE = _JOBS_CTE + """,
report AS (
  SELECT
    job_id AS "Job ID",
    array_to_string(list_transform(string_split(replace(job_type, '_', ' '), ' '),
                                   lambda w: upper(w[1]) || lower(w[2:])), ' ') AS "Job Type",
    upper(status) AS "Status",
    start_time AS "Start Time (UTC)",
    epoch_us(try_cast(end_time AS TIMESTAMPTZ)) AS "End Time (UTC)",
    CASE WHEN start_time IS NULL OR start_time = '' OR end_time IS NULL OR end_time = '' THEN 'N/A'
         WHEN try_cast(end_time AS TIMESTAMPTZ) IS NULL OR try_cast(start_time AS TIMESTAMPTZ) IS NULL THEN 'Error'
         ELSE printf('%.2f', (epoch_us(try_cast(end_time AS TIMESTAMPTZ))
                              - epoch_us(try_cast(start_time AS TIMESTAMPTZ))) / 1e6)
    END AS "Duration (s)",
    CASE job_type
      WHEN 'ingest_from_hive' THEN 'Source DB: ' || coalesce(source_db, 'None') || ', Tables: '
           || coalesce(array_to_string(tables, ', '), '')
      WHEN 'migrate_catalogs' THEN 'From: ' || coalesce(source_db, 'None') || ' To: ' || coalesce(dest_db, 'None')
           || ', Tables: ' || coalesce(array_to_string(tables, ', '), '')
           || CASE WHEN register_on_snowflake THEN ' (Chained SF Reg.)' ELSE '' END
      WHEN 'register_snowflake' THEN 'Azure DB: ' || coalesce(azure_db, 'None') || ' -> SF: '
           || coalesce(sf_db, 'None') || '.' || coalesce(sf_schema, 'None') || ', Tables: '
           || coalesce(array_to_string(tables, ', '), '')
           || CASE WHEN chained_from IS NOT NULL AND chained_from <> ''
                   THEN ' (Chained from ' || substr(chained_from, 1, 8) || '...)' ELSE '' END
      ELSE '' END AS "Details"
  FROM jobs
)"""

_ORACLE: dict[str, str] = {
    "ingest_orders": "SELECT * FROM orders",
    "ingest_lineitem": "SELECT * FROM lineitem",
    "ingest_embeddings": "SELECT * FROM embeddings",
    "ingest_documents": "SELECT * FROM documents",
    "copy_customer": "SELECT * FROM customer",
    "copy_part": "SELECT * FROM part",
    "copy_create_strict": "SELECT * FROM supplier",
    "ingest_csv_nation": "SELECT * FROM nation",
    "ingest_partitioned_orders": (
        "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority, o_orderstatus FROM orders"
    ),
    "copy_outcomes": """
        SELECT 1 AS position, 'customer' AS "table", 'succeeded' AS status, (SELECT count(*) FROM customer) AS rows,
               true AS verified, CAST(NULL AS VARCHAR) AS error_class
        UNION ALL SELECT 2, 'missing_table', 'failed', NULL, NULL, 'not_found'
        UNION ALL SELECT 3, 'part', 'succeeded', (SELECT count(*) FROM part), true, NULL
        UNION ALL SELECT 4, 'lineitem', 'succeeded', (SELECT count(*) FROM lineitem), true, NULL""",
    "copy_summary": """
        SELECT 'succeeded' AS status, CAST(2 AS BIGINT) AS tables, 'customer, part' AS names,
               (SELECT count(*) FROM customer) + (SELECT count(*) FROM part) AS rows
        UNION ALL SELECT 'failed', 1, 'missing_table', NULL""",
    "reconcile_copy": """
        SELECT 'lineitem' AS "table", count(*) AS target_rows, true AS matched FROM lineitem
        UNION ALL SELECT 'orders', count(*), true FROM orders""",
    "select_tables": """
        SELECT 1 AS position, 'orders' AS tableName, 'succeeded' AS status, (SELECT count(*) FROM orders) AS rows
        UNION ALL SELECT 2, 'region', 'succeeded', (SELECT count(*) FROM region)
        UNION ALL SELECT 3, 'nation', 'succeeded', (SELECT count(*) FROM nation)""",
    "list_tables": " UNION ALL ".join(
        f"SELECT '{t}' AS tableName, count(*) AS rows FROM {t}" for t in ALL_TABLES
    ),
    "audit_full": "WITH " + _REPORT_CTE + " SELECT * FROM report",
    "audit_incremental": "WITH " + _REPORT_CTE + " SELECT * FROM report",
    "audit_filtered": "WITH " + _REPORT_CTE + """ SELECT * FROM report
        WHERE "Job Type" IN ('Migrate Catalogs', 'Register Snowflake') AND "Status" IN ('COMPLETED', 'FAILED')""",
    "audit_top_recent": "WITH " + _REPORT_CTE + """ SELECT * FROM report
        ORDER BY "End Time (UTC)" DESC NULLS LAST, "Job ID" LIMIT 50""",
    "audit_filter_values": "WITH " + _REPORT_CTE + """
        SELECT DISTINCT 'Job Type' AS filter, "Job Type" AS value FROM report
        UNION SELECT DISTINCT 'Status', "Status" FROM report""",
    "audit_duration_stats": "WITH " + _REPORT_CTE + """
        SELECT "Status" AS status,
               CASE WHEN "Duration (s)" IN ('N/A', 'Error') THEN "Duration (s)" ELSE 'numeric' END AS duration_kind,
               count(*) AS jobs
        FROM report GROUP BY 1, 2""",
}


_TITLE = (
    "array_to_string(list_transform(string_split(replace({c}, '_', ' '), ' '),"
    " lambda w: upper(w[1]) || lower(w[2:])), ' ')"
)
_WH = PUBLISH_WAREHOUSE + "/"

_ORACLE["chain_registrations"] = "WITH " + _JOBS_CTE + r"""
    SELECT regexp_replace(substr(sha256('register_snowflake:' || job_id), 1, 32),
                          '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5') AS job_id,
           'register_snowflake' AS job_type, dest_db AS azure_db, sf_db, sf_schema,
           array_to_string(tables, ', ') AS tables, 'pending' AS status, job_id AS chained_from
    FROM jobs
    WHERE status = 'completed' AND job_type = 'migrate_catalogs' AND coalesce(register_on_snowflake, false)"""

_ORACLE["job_board"] = "WITH " + _JOBS_CTE + """
    SELECT job_id, job_type, """ + _TITLE.format(c="job_type") + """ AS job_type_display,
           upper(status) AS status_display,
           CASE status WHEN 'completed' THEN 'green' WHEN 'failed' THEN 'red'
                       WHEN 'running' THEN 'orange' ELSE 'blue' END AS status_colour,
           CASE WHEN status = 'running' THEN 'queued' ELSE 'archived' END AS state,
           CASE WHEN status = 'failed' THEN 'job ' || job_id || ' ended with status failed'
                ELSE 'Log file not yet available.' END AS log,
           status = 'failed' AS has_log
    FROM jobs"""

_ORACLE["job_latest_state"] = "WITH " + _JOBS_CTE + """,
    ev AS (
      SELECT job_id, CAST(substr(job_id, 5) AS BIGINT) * 4 + 1 AS seq, 'pending' AS status,
             CAST(NULL AS VARCHAR) AS start_time, CAST(NULL AS VARCHAR) AS end_time FROM jobs
      UNION ALL SELECT job_id, CAST(substr(job_id, 5) AS BIGINT) * 4 + 2, 'running', start_time, NULL FROM jobs
      UNION ALL SELECT job_id, CAST(substr(job_id, 5) AS BIGINT) * 4 + 3, status, NULL, end_time
                FROM jobs WHERE status <> 'running')
    SELECT job_id, arg_max(status, seq) AS status,
           arg_max(start_time, CASE WHEN start_time IS NOT NULL THEN seq END) AS start_time,
           arg_max(end_time, CASE WHEN end_time IS NOT NULL THEN seq END) AS end_time,
           count(*) AS events
    FROM ev GROUP BY job_id"""

_ORACLE["publish_manifest"] = "WITH " + _JOBS_CTE + f""",
    files AS (
      SELECT dest_db AS ns, t AS tbl, CAST(substr(job_id, 5) AS BIGINT) + 1 AS n, status,
             '{_WH}' || dest_db || '/' || t || '/metadata/v'
               || CAST(CAST(substr(job_id, 5) AS BIGINT) + 1 AS VARCHAR) || '.metadata.json' AS path
      FROM (SELECT *, unnest(tables) AS t FROM jobs WHERE job_type = 'migrate_catalogs')),
    latest AS (SELECT ns, tbl, max(n) AS version, arg_max(path, n) AS path
               FROM files WHERE status = 'completed' GROUP BY ns, tbl),
    req AS (SELECT DISTINCT azure_db AS namespace, unnest(tables) AS "table", sf_db, sf_schema
            FROM jobs WHERE job_type = 'register_snowflake')
    SELECT r.namespace, r."table", r.sf_db, r.sf_schema, l.version,
           substr(l.path, {len(_WH) + 1}) AS metadata_path,
           CASE WHEN l.path IS NOT NULL THEN
             'CREATE OR REPLACE ICEBERG TABLE ' || r.sf_db || '.' || r.sf_schema || '.' || r."table"
             || ' CATALOG = ''my_hive_catalog_integration'' EXTERNAL_VOLUME = ''iceberg_azure_vol'''
             || ' METADATA_FILE_PATH = ''' || substr(l.path, {len(_WH) + 1}) || ''';'
           END AS ddl,
           CASE WHEN l.path IS NOT NULL THEN 'ok' ELSE 'failed' END AS status,
           CASE WHEN l.path IS NULL THEN 'no metadata file matching the version pattern' END AS error
    FROM req r LEFT JOIN latest l ON l.ns = r.namespace AND l.tbl = r."table" """

_ORACLE["publish_listed"] = """
    WITH newest AS (
      SELECT n_regionkey, max(s_suppkey) AS version FROM supplier JOIN nation ON s_nationkey = n_nationkey
      WHERE n_regionkey > 0 AND s_suppkey % 4 <> 0 GROUP BY n_regionkey),
    t AS (SELECT 'region_' || r_regionkey AS "table", version FROM region LEFT JOIN newest ON n_regionkey = r_regionkey),
    p AS (SELECT *, "table" || '/metadata/v' || version || '.metadata.json' AS metadata_path FROM t)
    SELECT "table", 'SFDB' AS sf_db, 'PUBLIC' AS sf_schema, version, metadata_path,
           'CREATE OR REPLACE ICEBERG TABLE SFDB.PUBLIC.' || "table" || ' CATALOG = ''my_hive_catalog_integration'' EXTERNAL_VOLUME = ''iceberg_azure_vol'''
             || ' METADATA_FILE_PATH = ''' || metadata_path || ''';' AS ddl,
           CASE WHEN version IS NOT NULL THEN 'ok' ELSE 'failed' END AS status,
           CASE WHEN version IS NULL THEN 'no metadata file matching the version pattern' END AS error
    FROM p"""

_ORACLE["audit_stream"] = "WITH " + _REPORT_CTE + " SELECT * FROM report"

_ORACLE["audit_rejects"] = "WITH " + _REPORT_CTE + """ SELECT * FROM report
    WHERE CAST(substr("Job ID", 5) AS BIGINT) % 17 <> 0"""

_ORACLE["copy_keep_partitioning"] = (
    "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority, o_orderstatus FROM orders"
)

_ORACLE["ingest_all_verified"] = " UNION ALL ".join(
    f"SELECT {i} AS position, '{t}' AS \"table\", 'succeeded' AS status, count(*) AS rows, true AS verified FROM {t}"
    for i, t in enumerate(ALL_TABLES, start=1)
)

_ORACLE["copy_request_stream"] = " UNION ALL ".join(
    f"""SELECT 'req-{t}' AS job_id, 'completed' AS job_status, '{t}' AS "table",
               'succeeded' AS status, count(*) AS rows FROM {t}"""
    for t in STREAM_TABLES
) + " UNION ALL SELECT 'req-unknown', 'failed', NULL, NULL, NULL"


_ORACLE["request_stream_chain"] = " UNION ALL ".join(
    f"""SELECT 'req-chain' AS chained_from, 'register_snowflake' AS job_type, 'pending' AS status,
               'SFDB' AS sf_db, 'PUBLIC' AS sf_schema, '{t}' AS "table", count(*) AS rows FROM {t}"""
    for t in STREAM_TABLES
)

_ORACLE["audit_csv_roundtrip"] = "WITH " + _REPORT_CTE + " SELECT * FROM report"
_ORACLE["audit_compacted"] = "WITH " + _REPORT_CTE + " SELECT * FROM report"

_ORACLE["reconcile_tables"] = " UNION ALL ".join(
    f"""SELECT '{t}' AS "table", count(*) AS source_rows, count(*) AS target_rows, true AS matched FROM {t}"""
    for t in ["customer", "part", "orders", "lineitem"]
) + """ UNION ALL SELECT 'supplier', count(*), NULL, false FROM supplier"""


_ORACLE["reconcile_nested"] = """
    SELECT 'turns' AS "table", count(*) AS source_rows, count(*) AS target_rows, true AS matched FROM conversations
    UNION ALL SELECT 'changed', count(*), count(*), count(*) FILTER (WHERE turn = 0) = 0 FROM conversations
    UNION ALL SELECT 'vecs', count(*), count(*), true FROM embeddings"""



def _null_change_sql(name: str) -> str:
    source, target = (f"SELECT c_custkey % 1000 AS k, {r.format(**_DUCK_WORDS)} FROM customer" for r in (_NULL_CHANGES[name][0], _NULL_CHANGES[name][1] or _NULL_CHANGES[name][0]))
    return f"""SELECT '{name}' AS "table", (SELECT count(*) FROM customer) AS source_rows, (SELECT count(*) FROM customer) AS target_rows,
        NOT EXISTS (({source}) EXCEPT ALL ({target})) AND NOT EXISTS (({target}) EXCEPT ALL ({source})) AS matched"""


_ORACLE["reconcile_nulls"] = " UNION ALL ".join(map(_null_change_sql, _NULL_CHANGES))

_ORACLE["audit_incremental_dup"] = "WITH " + _REPORT_CTE + """
    SELECT report.* REPLACE ('REPEATED' AS "Status"), run FROM report CROSS JOIN (VALUES ('incremental'), ('full')) AS r(run)"""

_ORACLE["audit_indented"] = _ORACLE["audit_full"]
_ORACLE["audit_mixed_layout"] = _ORACLE["audit_rejects"]
_ORACLE["audit_empty_files"] = """
    SELECT run, 'empty' AS kind, count(DISTINCT event_id % 4) FILTER (WHERE event_id % 4 >= 2) AS n FROM events, (VALUES ('batch'), ('stream')) AS r(run) GROUP BY run
    UNION ALL SELECT run, 'reported', count(*) FILTER (WHERE event_id % 4 < 2) FROM events, (VALUES ('batch'), ('stream')) AS r(run) GROUP BY run"""


# --------------------------------------------------------------------------- contract
# The training-data operators are optional: the rest of the library works without them.
try:
    import corpus_pipeline
    from tablemove.llm import queries as _llm
except ImportError as e:
    if getattr(e, "name", None) not in ("corpus_pipeline", "tablemove.llm"):
        warnings.warn(f"the training-data operators are left out: {e}", stacklevel=2)
else:
    QUERIES.update(_llm.QUERIES)
    QUERIES["pipeline"] = corpus_pipeline.run
    _ORACLE.update(_llm.ORACLE_SQL)
    if corpus_pipeline.ORACLE_SQL:
        _ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: ingest ``orders`` from a session namespace and read it back."""
    return q_ingest_orders(spark, SMOKE_DIR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in _ORACLE.items() if k in QUERIES}

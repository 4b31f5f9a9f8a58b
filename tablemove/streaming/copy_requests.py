"""Serve copy requests dropped into a queue folder, as a Structured Stream.

Each request is a job record (``ingest_from_hive``: ``source_db`` +
``tables``; ``migrate_catalogs``: ``source_db``, ``dest_db`` + ``tables``).
For every micro-batch the requests are read (a handful of small records -
their *tables* are copied by Spark jobs, never passed through the driver),
each request runs as one multi-table copy, and two things are appended:
per-table outcome rows and job status events (running, then
completed/failed). ``register_snowflake`` requests (e.g. queued by
:func:`tablemove.plans.chain.chain_registrations`) build publish-manifest
rows when a ``warehouse`` root is given; other job types fail without
running anything. A request without an id goes by its file stem. Records
that cannot be parsed fail, and the reason of every failed request that has
no outcome rows is kept in ``<events table>_errors``.

Processed request files are moved to the archive folder by the file source
(``cleanSource=archive``); the move of a file happens in a later batch than
its processing. A replayed batch re-runs its copies, which are idempotent
(create-or-replace); outcome rows are keyed by ``(job_id, batch_id, table)``
and events by ``(job_id, event_seq)`` (sequence numbers are derived from the
batch id and the request order), and rows already present are not appended
again.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.audit import TYPE_INGEST, TYPE_MIGRATE, TYPE_REGISTER
from ..functions.identifiers import quote_name, split_name
from ..operators.state import EVENT_SCHEMA
from ..operators.write import ensure_namespace
from ..plans.chain import chain_registrations
from ..plans.copy import OUTCOME, copy_tables
from ..plans.ingest import target_namespace_for
from ..plans.publish import publish_manifest
from ..sources.jobs import batch_records, job_record_stream, read_job_records, write_job_records

REQUEST_OUTCOME = T.StructType(
    [T.StructField("job_id", T.StringType()), T.StructField("batch_id", T.LongType())] + OUTCOME.fields
)

#: Requests that could not be parsed (with their text) or that raised.
REQUEST_ERROR = "job_id string, batch_id long, source_file string, record string, error string"

#: What a registration is chained from.
PARENT = (
    "job_id string, job_type string, status string, register_on_snowflake boolean, "
    "dest_db string, sf_db string, sf_schema string, tables array<string>"
)


def _now_iso() -> str:
    return dt.datetime.now(dt.timezone.utc).isoformat().replace("+00:00", "Z")


def _append_new(spark: SparkSession, rows: DataFrame, table: str, key: list[str]) -> None:
    """Append ``rows`` whose ``key`` is not in ``table`` yet (a replayed batch adds nothing)."""
    name = quote_name(table)
    if spark.catalog.tableExists(name):
        rows = rows.join(spark.read.table(name).select(*key).distinct(), key, "left_anti")
    rows.write.mode("append").saveAsTable(name)


def _handler(
    outcomes_table: str,
    events_table: str,
    source_catalog: str | None,
    target_catalog: str | None,
    target_location_root: str | None,
    warehouse: str | None = None,
    manifest_table: str | None = None,
    queue: str | None = None,
    ddl_names: dict[str, str] | None = None,
):
    errors_table = f"{events_table}_errors"

    def qualified(ns: str | None) -> str | None:
        if not ns:
            return None
        return quote_name(([target_catalog] if target_catalog else []) + [ns])

    def serve(spark: SparkSession, req, batch_id: int) -> tuple[str, bool, DataFrame | None]:
        """Run one request: ``(status, ran, outcome rows or None)``."""
        tables = list(req.tables or [])
        tag = [F.lit(req.job_key).alias("job_id"), F.lit(batch_id).cast("long").alias("batch_id")]
        if req.job_type in (TYPE_INGEST, TYPE_MIGRATE):
            src = quote_name([p for p in (source_catalog, req.source_db) if p])
            if req.job_type == TYPE_INGEST:
                dst = target_namespace_for(req.source_db, target_catalog)
            else:
                dst = qualified(req.dest_db or req.source_db)
            loc = None
            if target_location_root:
                loc = f"{target_location_root.rstrip('/')}/{split_name(dst)[-1]}.db"
            out = copy_tables(spark, src, dst, tables, target_location=loc)
            out = out.select(*tag, *OUTCOME.fieldNames())
            statuses = [r.status for r in out.select("status").collect()]  # one per table
            ok = bool(tables) and all(x == "succeeded" for x in statuses)
            return ("completed" if ok else "failed"), True, out
        if req.job_type == TYPE_REGISTER and warehouse and manifest_table and ddl_names:
            manifest = publish_manifest(spark, qualified(req.azure_db), tables, warehouse, req.sf_db, req.sf_schema, **ddl_names)
            rows = manifest.collect()  # one row per requested table
            tagged = spark.createDataFrame(rows, manifest.schema).select(*tag, "*")
            _append_new(spark, tagged, manifest_table, ["job_id", "batch_id", "table"])
            ok = bool(tables) and all(r.status == "ok" for r in rows)
            return ("completed" if ok else "failed"), True, None
        return "failed", False, None  # unknown type: fails, no end time

    def chain(spark: SparkSession, parents: list[tuple], outcomes: DataFrame) -> None:
        """Queue the registrations that are not in the queue yet (a replayed batch adds none)."""
        queued, _ = read_job_records(spark, queue)
        children = chain_registrations(spark.createDataFrame(parents, PARENT), outcomes, queued)
        children = children.filter(F.size("tables") > 0)
        rows = children.collect()  # one per flagged request
        if rows:
            write_job_records(spark.createDataFrame(rows, children.schema).coalesce(1), queue)

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        requests = (
            batch.select("job_key", "job_type", "source_db", "dest_db", "azure_db", "sf_db", "sf_schema",
                         "tables", "register_on_snowflake", "file_mtime", "source_file", "_corrupt_record")
            .orderBy("file_mtime", "source_file", "job_key")
            .collect()
        )
        outcome_frames = []
        events = []
        errors = []
        parents = []
        seq = batch_id << 32  # no batch of collected requests comes near 2^31
        for req in requests:
            seq += 2
            if req._corrupt_record is not None:
                events.append((req.job_key, seq, "failed", None, None))
                errors.append((req.job_key, batch_id, req.source_file, req._corrupt_record, "not a job record"))
                continue
            events.append((req.job_key, seq - 1, "running", _now_iso(), None))
            try:
                status, ran, out = serve(spark, req, batch_id)
                if not ran:
                    errors.append((req.job_key, batch_id, req.source_file, None, f"no handler for job type {req.job_type}"))
            except Exception as exc:  # noqa: BLE001 - a request failure must not stop the batch
                status, ran, out = "failed", True, None
                errors.append((req.job_key, batch_id, req.source_file, None, str(exc)))
            if out is not None:
                outcome_frames.append(out)
                if queue and req.job_type == TYPE_MIGRATE and req.register_on_snowflake:
                    # which tables are registered depends on their outcome rows, not on the whole request's
                    parents.append((req.job_key, req.job_type, "completed", True, req.dest_db or req.source_db,
                                    req.sf_db, req.sf_schema, req.tables))
            events.append((req.job_key, seq, status, None, _now_iso() if ran else None))
        if outcome_frames:
            merged = outcome_frames[0]
            for f in outcome_frames[1:]:
                merged = merged.unionByName(f)
            _append_new(spark, merged, outcomes_table, ["job_id", "batch_id", "table"])
            if parents:
                chain(spark, parents, merged)
        if events:
            _append_new(spark, spark.createDataFrame(events, EVENT_SCHEMA), events_table, ["job_id", "event_seq"])
        if errors:
            _append_new(spark, spark.createDataFrame(errors, REQUEST_ERROR), errors_table, ["job_id", "batch_id", "source_file"])

    return handle


def start_copy_request_stream(
    spark: SparkSession,
    queue: str,
    archive: str,
    checkpoint: str,
    outcomes_table: str,
    events_table: str,
    source_catalog: str | None = None,
    target_catalog: str | None = None,
    target_location_root: str | None = None,
    multi_line: bool = True,
    glob: str | None = "*.json",
    max_files_per_trigger: int = 100,
    available_now: bool = True,
    warehouse: str | None = None,
    manifest_table: str | None = None,
    ddl_names: dict[str, str] | None = None,
):
    """Start the request stream; returns the ``StreamingQuery``.

    ``warehouse``, ``manifest_table`` and ``ddl_names`` (``catalog_integration`` and ``external_volume``) enable
    ``register_snowflake`` requests: their manifest rows are appended to ``manifest_table``.
    """
    for t in (outcomes_table, events_table, manifest_table):
        if not t:
            continue
        parent = split_name(t)[:-1]
        if parent:
            ensure_namespace(spark, quote_name(parent))
    stream = job_record_stream(
        spark, queue, multi_line=multi_line, glob=glob,
        maxFilesPerTrigger=str(max_files_per_trigger),
        cleanSource="archive", sourceArchiveDir=archive,
    )
    serve = _handler(outcomes_table, events_table, source_catalog, target_catalog, target_location_root,
                     warehouse, manifest_table, queue, ddl_names)

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = batch_records(batch, queue, multi_line, glob)
        errors = quote_name(f"{events_table}_errors")
        if batch.sparkSession.catalog.tableExists(errors):  # a file without content stays listed until it is archived
            known = batch.sparkSession.read.table(errors).filter("record = ''").select("source_file").distinct()
            empty = F.coalesce(F.col("_corrupt_record") == "", F.lit(False))
            rows = rows.filter(~empty).unionByName(rows.filter(empty).join(known, "source_file", "left_anti").select(*rows.columns))
        serve(rows, batch_id)

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def refresh_results(spark: SparkSession, outcomes_table: str, events_table: str) -> None:
    """Drop this session's cached listings of the tables the stream appended to."""
    for t in (outcomes_table, events_table):
        if spark.catalog.tableExists(quote_name(t)):
            spark.catalog.refreshTable(quote_name(t))

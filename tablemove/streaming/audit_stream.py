"""Keep the audit ledger current with a file-source stream.

The file source's checkpoint is the set of archive files already seen, so
each run parses only new files (the streaming form of "skip known jobs").
Each micro-batch is turned into report rows and merged into the ledger,
where the newest record of a job wins; a batch replayed after a failure
therefore changes nothing. Records that cannot be parsed go to
``<ledger>_rejects``. Run it with ``availableNow`` from a scheduler
(process everything new, then stop) or with a processing-time trigger.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identifiers import quote_name, split_name
from ..operators.write import ensure_namespace, written
from ..plans.audit import append_rejects, merge_rows, one_per_job
from ..sources.jobs import batch_records, job_record_stream


def _append_batch(ledger: str, archive: str, multi_line: bool, glob: str | None):
    def handle(pieces: DataFrame, batch_id: int) -> None:
        spark = pieces.sparkSession
        batch = batch_records(pieces, archive, multi_line, glob, keep=partial(written, tag="audit-pieces"))
        merge_rows(spark, one_per_job(batch.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")), ledger)
        append_rejects(spark, batch.filter(F.col("_corrupt_record").isNotNull()), ledger)  # a replayed batch adds nothing

    return handle


def start_audit_stream(
    spark: SparkSession,
    archive: str,
    ledger: str,
    checkpoint: str,
    multi_line: bool = True,
    glob: str | None = "*.json",
    available_now: bool = True,
    processing_time: str | None = None,
    max_files_per_trigger: int | None = None,
):
    """Start the stream; returns the ``StreamingQuery``."""
    parent = split_name(ledger)[:-1]
    if parent:
        ensure_namespace(spark, quote_name(parent))
    options = {}
    if max_files_per_trigger:
        options["maxFilesPerTrigger"] = str(max_files_per_trigger)
    stream = job_record_stream(spark, archive, multi_line=multi_line, glob=glob, **options)
    writer = stream.writeStream.foreachBatch(_append_batch(ledger, archive, multi_line, glob)).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()


def run_audit_stream(spark: SparkSession, archive: str, ledger: str, checkpoint: str, **kwargs) -> DataFrame:
    """Process all new archive files now, then return the ledger."""
    q = start_audit_stream(spark, archive, ledger, checkpoint, available_now=True, **kwargs)
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    # Micro-batches write through the stream's own session; drop this
    # session's cached listing of the ledger before reading it.
    spark.catalog.refreshTable(quote_name(ledger))
    return spark.read.table(quote_name(ledger))

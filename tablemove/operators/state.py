"""Job state as an append-only event log, folded to the latest state.

Instead of rewriting a job file in place on every status change, each
change is one appended row ``(job_id, event_seq, status, start_time,
end_time)``. The current state of a job is the fold of its rows: status of
the latest event, and the latest non-null start and end time. The fold is a
plain ``groupBy(job_id)`` with ``max_by`` aggregates, which Spark combines
partially on the map side, so a job with very many events does not
concentrate its rows in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("job_id", T.StringType(), False),
        T.StructField("event_seq", T.LongType(), False),
        T.StructField("status", T.StringType()),
        T.StructField("start_time", T.StringType()),
        T.StructField("end_time", T.StringType()),
    ]
)


def latest_state(events: DataFrame) -> DataFrame:
    """``(job_id, status, start_time, end_time, events)`` per job."""
    seq = F.col("event_seq")
    return events.groupBy("job_id").agg(
        F.max_by("status", seq).alias("status"),
        F.max_by("start_time", F.when(F.col("start_time").isNotNull(), seq)).alias("start_time"),
        F.max_by("end_time", F.when(F.col("end_time").isNotNull(), seq)).alias("end_time"),
        F.count(F.lit(1)).alias("events"),
    )


def append_events(events: DataFrame, table: str) -> None:
    """Append status events to the event table (created on first use)."""
    events.select(*[f.name for f in EVENT_SCHEMA.fields]).write.mode("append").saveAsTable(table)

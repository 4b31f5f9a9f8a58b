"""Derive job records from the ``events`` table (test and benchmark input).

One job record per event, so the archive grows with the event table. The
mapping is fixed so that an independent SQL engine can rebuild the same
records from the same parquet file and check our results against it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

# Fixed mapping (Spark SQL); its DuckDB twin lives in the oracle SQL.
JOBS_FROM_EVENTS = [
    "concat('job-', lpad(cast(event_id AS STRING), 8, '0')) AS job_id",
    """CASE event_type WHEN 'signup' THEN 'ingest_from_hive' WHEN 'purchase' THEN 'migrate_catalogs'
         WHEN 'error' THEN 'register_snowflake' WHEN 'view' THEN 'export_audit_to_snowflake'
         ELSE 'compact_table' END AS job_type""",
    "concat('db', cast(user_id % 7 AS STRING)) AS source_db",
    "CASE WHEN event_type = 'purchase' THEN concat('cloud', cast(user_id % 3 AS STRING)) END AS dest_db",
    "CASE WHEN event_type = 'error' THEN concat('cloud', cast(user_id % 3 AS STRING)) END AS azure_db",
    """CASE WHEN event_type <> 'view' THEN array(concat('t', cast(event_id % 5 AS STRING)),
         concat('t', cast(event_id % 5 + 1 AS STRING))) END AS tables""",
    """CASE WHEN event_id % 10 = 0 THEN 'failed' WHEN event_id % 10 = 1 THEN 'running'
         ELSE 'completed' END AS status""",
    "(event_type = 'purchase' AND event_id % 2 = 0) AS register_on_snowflake",
    "'SFDB' AS sf_db",
    "'PUBLIC' AS sf_schema",
    """CASE WHEN event_type = 'error' AND event_id % 3 = 0
         THEN concat('job-', lpad(cast(event_id % 100 AS STRING), 8, '0')) END AS chained_from""",
    "CAST(NULL AS STRING) AS csv_path",
    """concat(date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), 'Z') AS start_time""",
    """CASE WHEN event_id % 10 = 1 THEN NULL WHEN event_id % 13 = 0 THEN 'bogus'
         ELSE concat(date_format(timestampadd(MICROSECOND, cast(round(value * 1000000) AS BIGINT), ts),
                     "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), 'Z') END AS end_time""",
]


def jobs_from_events(events: DataFrame) -> DataFrame:
    """Job records (the job schema) derived row by row from ``events``."""
    return events.selectExpr(*JOBS_FROM_EVENTS)

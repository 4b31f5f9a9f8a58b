"""Plan shapes that the scale design relies on (checked on executed plans)."""

import json
import os

from tablemove.operators.reconcile import fingerprint
from tablemove.operators.write import counted
from tablemove.plans import audit as P
from tablemove.sources.jobs import read_job_records
from tablemove.sources.tables import register_parquet_tables


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_copy_is_map_only_and_fingerprint_partial(spark, ns):
    register_parquet_tables(spark, "/root/testdata/sf0.001", ns, ["lineitem"])
    src = spark.table(f"{ns}.lineitem")
    copy_plan = _plan(counted(src)[0])
    assert "Exchange" not in copy_plan and "CollectMetrics" in copy_plan
    fp = _plan(fingerprint(src))
    assert "HashAggregate" in fp and "Sort" not in fp


def test_audit_projection_is_codegen_and_topk_is_not_a_full_sort(spark, tmp, ns):
    arch = f"{tmp}/archive"
    os.makedirs(arch)
    with open(f"{arch}/a.json", "w") as f:
        json.dump({"job_id": "a", "job_type": "ingest_from_hive", "status": "completed",
                   "start_time": "2024-01-01T00:00:00Z", "end_time": "2024-01-01T00:00:01Z"}, f)
    records, _ = read_job_records(spark, arch, multi_line=False)
    rows = P.audit_frame(records, keep=["job_key", "source_file"])
    projects = [ln for ln in _plan(rows).splitlines() if "Project [" in ln]
    assert projects and all(ln.lstrip(" :+-").startswith("*(") for ln in projects)
    P.generate_report(spark, arch, f"{ns}.ledger")
    top = P.top_recent(P.report_view(spark.table(f"{ns}.ledger")), 5)
    assert "TakeOrderedAndProject" in _plan(top)


def test_increment_broadcasts_new_keys_and_leaves_the_ledger_where_it_is(spark, ns):
    spark.range(1000).selectExpr("concat('k', id) AS job_key", "'f' AS source_file").write.saveAsTable(f"{ns}.led")
    rows = spark.createDataFrame([("k1", 1), ("new", 2)], "job_key string, v int")
    plan = _plan(P.ledger_rows_of(spark, rows, f"{ns}.led"))
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan
    before = plan[plan.index("BroadcastHashJoin"):plan.index("BroadcastExchange")]
    assert "FileScan parquet" in before and "Exchange hashpartitioning" not in before

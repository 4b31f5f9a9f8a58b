"""Streaming wrappers: audit ledger kept current; copy requests served and archived."""

import json
import os

from pyspark.sql import functions as F

from tablemove.plans import audit as P
from tablemove.session import scratch_path
from tablemove.sources.tables import register_parquet_tables
from tablemove.streaming.audit_stream import run_audit_stream
from tablemove.streaming.copy_requests import refresh_results, start_copy_request_stream


def _write(folder, name, obj):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        json.dump(obj, f, indent=4)


def _job(i):
    return {"job_id": f"s-{i}", "job_type": "ingest_from_hive", "status": "completed", "source_db": "d",
            "tables": ["x"], "start_time": "2024-01-01T00:00:00Z", "end_time": f"2024-01-01T00:00:0{i}Z"}


def test_audit_stream_incremental_matches_full(spark, tmp, ns):
    arch, ckpt, ledger = f"{tmp}/archive", f"{tmp}/ckpt", f"{ns}.ledger"
    for i in range(3):
        _write(arch, f"s-{i}.json", _job(i))
    assert run_audit_stream(spark, arch, ledger, ckpt).count() == 3
    for i in range(3, 6):
        _write(arch, f"s-{i}.json", _job(i))
    out = run_audit_stream(spark, arch, ledger, ckpt)
    assert out.count() == 6
    full = P.generate_report(spark, arch, f"{ns}.full", full_rescan=True).report
    cols = P.report_view(out)
    assert cols.exceptAll(full).count() == 0 and full.exceptAll(cols).count() == 0
    # a rerun with nothing new adds nothing
    assert run_audit_stream(spark, arch, ledger, ckpt).count() == 6


def test_copy_request_stream(spark, tmp, ns):
    register_parquet_tables(spark, "/root/testdata/sf0.001", ns, ["region", "nation"])
    queue, archive = f"{tmp}/queue", f"{tmp}/archive"
    _write(queue, "r1.json", {"job_id": "r1", "job_type": "ingest_from_hive", "source_db": ns, "tables": ["region", "nation"]})
    _write(queue, "r2.json", {"job_id": "r2", "job_type": "migrate_catalogs", "source_db": ns, "dest_db": ns + "_m",
                              "tables": ["region", "missing"]})
    _write(queue, "r3.json", {"job_id": "r3", "job_type": "compact_table", "source_db": ns, "tables": ["region"]})
    spark.range(2).write.saveAsTable(f"{ns}.pub")
    loc = spark.sql(f"DESCRIBE EXTENDED {ns}.pub").filter("col_name = 'Location'").first()[1].replace("file:", "")
    os.makedirs(f"{loc}/metadata")
    for v in (1, 10, 2):
        with open(f"{loc}/metadata/v{v}.metadata.json", "w") as f:
            f.write("{}")
    _write(queue, "r5.json", {"job_id": "r5", "job_type": "register_snowflake", "azure_db": ns, "sf_db": "SFDB",
                              "sf_schema": "PUBLIC", "tables": ["pub"]})
    ckpt = f"{tmp}/ckpt"
    for run in range(2):
        if run == 1:  # the file source moves processed files one batch later
            _write(queue, "r4.json", {"job_id": "r4", "job_type": "ingest_from_hive", "source_db": ns,
                                      "tables": ["region"]})
        q = start_copy_request_stream(spark, queue, archive, ckpt, f"{ns}.outcomes", f"{ns}.events",
                                      target_location_root=f"{tmp}/targets", max_files_per_trigger=10,
                                      warehouse=os.path.dirname(os.path.dirname(loc)),
                                      manifest_table=f"{ns}.manifest",
                                      ddl_names={"catalog_integration": "ci", "external_volume": "ev"})
        q.awaitTermination()
        assert q.exception() is None
    refresh_results(spark, f"{ns}.outcomes", f"{ns}.events")
    out = {(r.job_id, r.table): (r.status, r.rows) for r in spark.table(f"{ns}.outcomes").collect()}
    assert out == {("r1", "region"): ("succeeded", 5), ("r1", "nation"): ("succeeded", 25),
                   ("r4", "region"): ("succeeded", 5),
                   ("r2", "region"): ("succeeded", 5), ("r2", "missing"): ("failed", None)}
    from tablemove.operators.state import latest_state
    st = {r.job_id: (r.status, r.end_time is None) for r in latest_state(spark.table(f"{ns}.events")).collect()}
    assert st == {"r1": ("completed", False), "r2": ("failed", False), "r3": ("failed", True),
                  "r4": ("completed", False), "r5": ("completed", False)}
    spark.catalog.refreshTable(f"{ns}.manifest")
    m = spark.table(f"{ns}.manifest").first()
    assert (m.job_id, m.table, m.status) == ("r5", "pub", "ok") and m.metadata_path.endswith("pub/metadata/v10.metadata.json")
    assert spark.table(f"{ns}_iceberg.nation").count() == 25
    moved = [f for _, _, fs in os.walk(archive) for f in fs if f.endswith(".json")]
    assert {"r1.json", "r2.json", "r3.json", "r5.json"} <= set(moved)


def test_request_batch_replay_appends_nothing_twice(spark, tmp, ns):
    """Running one micro-batch handler twice (a replay) leaves one set of rows."""
    from tablemove.sources.jobs import _scan, parse_pieces
    from tablemove.streaming.copy_requests import _handler

    register_parquet_tables(spark, "/root/testdata/sf0.001", ns, ["region"])
    _write(f"{tmp}/q", "r1.json", {"job_id": "r1", "job_type": "ingest_from_hive", "source_db": ns,
                                   "tables": ["region"]})
    _write(f"{tmp}/q", "no-id.json", {"job_type": "export_audit_to_snowflake", "csv_path": "x"})
    with open(f"{tmp}/q/broken.json", "w") as f:
        f.write('{"job_id": ')
    raw = parse_pieces(_scan(spark.read, f"{tmp}/q", True, "*.json"))
    handle = _handler(f"{ns}.outcomes", f"{ns}.events", None, None, f"{tmp}/targets")
    handle(raw, 7)
    handle(raw, 7)
    spark.catalog.refreshTable(f"{ns}.outcomes")
    spark.catalog.refreshTable(f"{ns}.events")
    assert spark.table(f"{ns}.outcomes").count() == 1
    events = [(r.job_id, r.status) for r in spark.table(f"{ns}.events").orderBy("job_id", "event_seq").collect()]
    assert events == [("broken", "failed"), ("no-id", "running"), ("no-id", "failed"), ("r1", "running"), ("r1", "completed")]
    errors = {r.job_id: r for r in spark.table(f"{ns}.events_errors").collect()}
    assert set(errors) == {"broken", "no-id"} and spark.table(f"{ns}.events_errors").count() == 2
    assert errors["broken"].record == '{"job_id": ' and "export_audit" in errors["no-id"].error


def test_flagged_migration_queues_what_it_copied_once(spark, tmp, ns):
    """The child names the copied tables only, a replay adds none, and a run serves it."""
    from tablemove.sources.jobs import _scan, parse_pieces, read_job_records
    from tablemove.streaming.copy_requests import _handler

    register_parquet_tables(spark, "/root/testdata/sf0.001", ns, ["region"])
    base = {"job_type": "migrate_catalogs", "source_db": ns, "dest_db": f"{ns}_to", "sf_db": "S", "sf_schema": "P"}
    _write(f"{tmp}/q", "m1.json", {**base, "job_id": "m1", "tables": ["region", "gone"], "register_on_snowflake": True})
    _write(f"{tmp}/q", "m2.json", {**base, "job_id": "m2", "tables": ["region"]})
    _write(f"{tmp}/q", "m3.json", {**base, "job_id": "m3", "tables": ["gone"], "register_on_snowflake": True})
    handle = _handler(f"{ns}.outcomes", f"{ns}.events", None, None, f"{tmp}/targets", queue=f"{tmp}/q")
    raw = parse_pieces(_scan(spark.read, [f"{tmp}/q/{m}.json" for m in ("m1", "m2", "m3")], True, "*.json"))
    handle(raw, 1)
    handle(raw, 1)
    queued = read_job_records(spark, f"{tmp}/q")[0].filter("chained_from is not null").collect()
    assert [(r.chained_from, r.job_type, r.azure_db, r.tables) for r in queued] == [
        ("m1", "register_snowflake", f"{ns}_to", ["region"])]

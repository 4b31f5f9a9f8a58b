"""Command line over the library (in-process, with the test session)."""

import json
import os

from tablemove.cli import run
from tablemove.sources.tables import register_parquet_tables


def test_ingest_and_migrate_commands(spark, ns, capsys):
    register_parquet_tables(spark, "/root/testdata/sf0.001", ns, ["region", "nation"])
    assert run(["ingest", "--database", ns, "--tables", "region", "nation"], spark) == 0
    assert spark.table(f"{ns}_iceberg.nation").count() == 25
    assert "n_nationkey" in capsys.readouterr().out  # the preview
    assert run(["migrate", "--source-db", ns, "--dest-db", ns + "_m", "--tables", "region", "zzz"], spark) == 1
    assert run(["migrate", "--source-db", ns, "--dest-db", ns + "_m", "--tables", "region", "zzz",
                "--allow-failures"], spark) == 0
    assert run(["migrate", "--source-db", ns, "--dest-db", ns + "_m", "--tables", "region", "--strict"], spark) == 1
    out = capsys.readouterr().out
    assert "not_found" in out and "already_exists" in out


def test_audit_and_chain_commands(spark, ns, tmp, capsys):
    arch = f"{tmp}/archive"
    os.makedirs(arch)
    job = {"job_id": "m1", "job_type": "migrate_catalogs", "status": "completed", "register_on_snowflake": True,
           "source_db": "a", "dest_db": "b", "sf_db": "SF", "sf_schema": "P", "tables": ["t"],
           "start_time": "2024-01-01T00:00:00Z", "end_time": "2024-01-01T00:00:01Z"}
    with open(f"{arch}/m1.json", "w") as f:
        json.dump(job, f, indent=4)
    with open(f"{arch}/broken.json", "w") as f:
        f.write('{"job_id": ')
    assert run(["audit", "--archive", arch, "--ledger", f"{ns}.ledger", "--csv", f"{tmp}/csv"], spark) == 0
    out = capsys.readouterr().out
    assert "Report updated with 1 new job(s)." in out and "could not parse a record in" in out
    assert run(["audit", "--archive", arch, "--ledger", f"{ns}.ledger", "--compact"], spark) == 0
    out = capsys.readouterr().out
    assert "Audit report is already up-to-date." in out and "ledger files after compaction: 1" in out
    assert run(["chain", "--archive", arch, "--queue", f"{tmp}/queue"], spark) == 0
    assert run(["chain", "--archive", arch, "--queue", f"{tmp}/queue"], spark) == 0  # no duplicate
    queued = spark.read.json(f"{tmp}/queue").collect()
    assert [(r.job_type, r.chained_from, r.azure_db) for r in queued] == [("register_snowflake", "m1", "b")]


def test_utc_now_iso(spark):
    from tablemove.functions.audit import utc_now_iso

    v = spark.range(1).select(utc_now_iso().alias("t")).first().t
    assert v.endswith("Z") and len(v) == len("2024-01-01T00:00:00.000000Z")


def test_ingest_files_command(spark, ns, tmp, capsys):
    spark.read.parquet("/root/testdata/sf0.001/nation.parquet").write.option("header", True).csv(f"{tmp}/csv")
    assert run(["ingest-files", "--path", f"{tmp}/csv", "--target", f"{ns}.nation", "--preview", "2"], spark) == 0
    assert spark.table(f"{ns}.nation").count() == 25
    assert "nation" in capsys.readouterr().out

"""Copies and ingest: strategies, isolation, strict create, selection, verification."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tablemove.operators.catalog import list_tables, partition_columns, schema_frame
from tablemove.operators.reconcile import compare
from tablemove.operators.select import EmptySelection, selected_names, select_tables
from tablemove.operators.write import replace_table
from tablemove.plans.copy import copy_summary, copy_table, copy_tables
from tablemove.plans.ingest import ingest_files, ingest_tables, target_namespace_for
from tablemove.sources.tables import register_parquet_tables

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def src(spark, ns):
    register_parquet_tables(spark, SF, ns, ["orders", "region", "nation", "embeddings"])
    return ns


def test_ingest_twice_is_idempotent(spark, src, tmp):
    dst = src + "_x"
    for strategy in ("create", "staged_swap"):
        out = ingest_tables(spark, src, ["orders"], target_namespace=dst, target_location=f"{tmp}/x", verify=True)
        r = out.first()
        assert (r.status, r.rows, r.verified, r.strategy) == ("succeeded", 1500, True, strategy)
    assert spark.table(f"{dst}.orders").exceptAll(spark.table(f"{src}.orders")).count() == 0
    assert [t.tableName for t in list_tables(spark, dst).collect()] == ["orders"]  # no staging leftovers


def test_default_target_namespace_rule():
    assert target_namespace_for("sales") == "`sales_iceberg`"
    assert target_namespace_for("sales", "cat") == "`cat`.`sales_iceberg`"


def test_failure_isolated_and_summary(spark, src, tmp):
    out = copy_tables(spark, src, src + "_y", ["region", "nope", "nation"], target_location=f"{tmp}/y")
    got = [(r.position, r.table, r.status, r.error_class) for r in out.orderBy("position").collect()]
    assert got == [(1, "region", "succeeded", None), (2, "nope", "failed", "not_found"), (3, "nation", "succeeded", None)]
    summary = {r.status: (r.tables, r.names) for r in copy_summary(out).collect()}
    assert summary == {"succeeded": (2, "region, nation"), "failed": (1, "nope")}


def test_strict_create_fails_second_time(spark, src, ns):
    copy_table(spark, f"{src}.region", f"{ns}.region_copy", mode="create")
    with pytest.raises(AnalysisException) as e:
        copy_table(spark, f"{src}.region", f"{ns}.region_copy", mode="create")
    assert "ALREADY_EXISTS" in e.value.getCondition()
    first = copy_tables(spark, src, ns + "_s", ["region"], mode="create").first()
    again = copy_tables(spark, src, ns + "_s", ["region"], mode="create").first()
    assert (first.status, again.status, again.error_class) == ("succeeded", "failed", "already_exists")


def test_self_copy_and_failed_write_keep_table(spark, ns):
    spark.range(10).write.saveAsTable(f"{ns}.t")
    # self copy: read completes before the swap
    replace_table(spark.table(f"{ns}.t").withColumn("id", F.col("id") + 1), f"{ns}.t")
    assert sorted(r.id for r in spark.table(f"{ns}.t").collect()) == list(range(1, 11))
    # a write that fails at run time leaves the old rows in place
    bad = spark.table(f"{ns}.t").withColumn("id", F.expr("assert_true(id < 0)"))
    with pytest.raises(Exception):
        replace_table(bad, f"{ns}.t")
    assert spark.table(f"{ns}.t").count() == 10
    assert [t.tableName for t in list_tables(spark, ns).collect()] == ["t"]


def test_nested_types_copy(spark, src, ns):
    out = copy_tables(spark, src, ns + "_n", ["embeddings"], verify=True)
    assert out.first().verified is True


def test_partitioned_source(spark, ns):
    spark.read.parquet(f"{SF}/orders.parquet").write.partitionBy("o_orderstatus").saveAsTable(f"{ns}.po")
    copy_tables(spark, ns, ns + "_p", ["po"])
    assert spark.table(f"{ns}_p.po").columns[-1] == "o_orderstatus"
    assert partition_columns(spark, f"{ns}_p.po") == []
    copy_tables(spark, ns, ns + "_k", ["po"], keep_partitioning=True)
    assert partition_columns(spark, f"{ns}_k.po") == ["o_orderstatus"]
    assert spark.table(f"{ns}_k.po").count() == 1500
    copy_tables(spark, ns, ns + "_k", ["po"], keep_partitioning=True)  # replace keeps rows too
    assert spark.table(f"{ns}_k.po").count() == 1500


def test_selection_rules(spark, src):
    spark.range(1).createOrReplaceTempView("tm_some_view")
    listing = list_tables(spark, src)
    assert "tm_some_view" not in [r.tableName for r in listing.collect()]
    assert selected_names(listing, ["nation", "zzz", "region", "nation"]) == ["nation", "region"]
    assert selected_names(listing, "*") == ["embeddings", "nation", "orders", "region"]
    with pytest.raises(EmptySelection):
        selected_names(listing, ["zzz", "tm_some_view"])
    assert [r.position for r in select_tables(listing, ["orders", "region"]).collect()] == [1, 2]


def test_missing_namespace_lists_empty(spark):
    assert list_tables(spark, "tm_no_such_namespace_xyz").count() == 0


def test_reconcile_detects_difference(spark, ns):
    a = spark.range(100).withColumn("m", F.create_map(F.lit("k"), F.col("id")))
    b = spark.range(100).withColumn("id", F.when(F.col("id") == 5, 500).otherwise(F.col("id"))).withColumn(
        "m", F.create_map(F.lit("k"), F.col("id")))
    assert compare(a, a.orderBy(F.desc("id")))["matched"]
    assert not compare(a, b)["matched"]


def test_reconcile_nested_types(spark):
    base = spark.range(50)
    inner = F.create_map(F.lit("a"), F.col("id").cast("int"), F.lit("b"), F.lit(None).cast("int"))
    swapped = F.create_map(F.lit("b"), F.lit(None).cast("int"), F.lit("a"), F.col("id").cast("int"))

    def table(m, x):
        return base.select("id", F.array(F.struct(m.alias("m"), x.alias("x"))).alias("s"), F.when(F.col("id") > 9, F.struct(m.alias("m"))).alias("o"))

    a, b = table(inner, F.col("id").cast("float")), table(swapped, F.col("id").cast("double"))
    wide = b.withColumn("s", F.col("s").cast("array<struct<m:map<string,bigint>,x:double>>"))
    assert compare(a, b)["matched"] and compare(a, wide)["matched"]
    changed = table(F.create_map(F.lit("a"), F.lit(3), F.lit("b"), F.lit(None).cast("int")), F.col("id").cast("float"))
    assert not compare(a, changed)["matched"]


def test_csv_single_file_vs_directory(spark, tmp, ns):
    d = f"{tmp}/sales/load_date=2025-06-04"
    spark.read.parquet(f"{SF}/nation.parquet").coalesce(1).write.option("header", True).csv(d)
    ingest_files(spark, f"{d}/*.csv", f"{ns}.one")
    ingest_files(spark, f"{tmp}/sales", f"{ns}.many")
    assert spark.table(f"{ns}.one").columns == ["n_nationkey", "n_name", "n_regionkey"]
    assert spark.table(f"{ns}.many").columns[-1] == "load_date"
    types = {r.column: r.type for r in schema_frame(spark.table(f"{ns}.one")).collect()}
    assert types == {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"}


def test_parallel_copies_keep_order(spark, src, tmp):
    out = copy_tables(spark, src, src + "_par", ["region", "nation", "orders"], parallelism=3,
                      target_location=f"{tmp}/par", scheduler_pool="copies")
    assert [(r.position, r.table, r.status) for r in out.collect()] == [
        (1, "region", "succeeded"), (2, "nation", "succeeded"), (3, "orders", "succeeded")]


def test_cleanup_staging(spark, ns):
    from tablemove.operators.write import cleanup_staging

    spark.range(3).write.saveAsTable(f"{ns}.keep__tm_stage_deadbeef")  # target exists: leftover
    spark.range(3).write.saveAsTable(f"{ns}.keep")
    spark.range(4).write.saveAsTable(f"{ns}.lost__tm_stage_0badf00d")  # died between drop and rename
    assert sorted(cleanup_staging(spark, ns)) == [("keep__tm_stage_deadbeef", "dropped"), ("lost", "restored")]
    assert sorted(r.tableName for r in list_tables(spark, ns).collect()) == ["keep", "lost"]
    assert spark.table(f"{ns}.lost").count() == 4


def test_job_status_is_worst_of_tables(spark, src, tmp):
    from tablemove.plans.copy import job_status

    ok = copy_tables(spark, src, src + "_j1", ["region"], target_location=f"{tmp}/j1")
    bad = copy_tables(spark, src, src + "_j2", ["region", "nope"], target_location=f"{tmp}/j2")
    assert (job_status(ok), job_status(bad)) == ("completed", "failed")


def test_catalog_reads(spark, src, ns):
    from tablemove.operators.catalog import list_namespaces, preview, table_location, table_properties
    from tablemove.plans.ingest import ingest_table

    assert src in [r.namespace for r in list_namespaces(spark).collect()]
    r = ingest_table(spark, f"{src}.region", f"{ns}.region_one", verify=True)
    assert (r.status, r.rows, r.verified) == ("succeeded", 5, True)
    assert preview(spark, f"{ns}.region_one", 3).count() == 3
    assert table_location(spark, f"{ns}.region_one").endswith("region_one")
    assert "key" in table_properties(spark, f"{ns}.region_one").columns


def test_copy_table_verify_and_outcome_names(spark, src, ns):
    r = copy_table(spark, f"{src}.nation", f"{ns}.nation_v", mode="replace", verify=True)
    assert (r.rows, r.verified, r.strategy) == (25, True, "create")
    out = copy_tables(spark, src, ns + "_o", ["nation"]).first()
    assert (out.source, out.target) == (f"{src}.nation", f"{ns}_o.nation")


def test_reconcile_tables_detects_changed_copy(spark, src, ns):
    from tablemove.operators.reconcile import reconcile_tables

    dst = ns + "_r"
    copy_tables(spark, src, dst, ["region", "nation"])
    spark.sql(f"INSERT INTO {dst}.nation SELECT * FROM {dst}.nation LIMIT 1")  # an extra row
    got = {r.table: (r.source_rows, r.target_rows, r.matched)
           for r in reconcile_tables(spark, src, dst, ["region", "nation", "orders"]).collect()}
    assert got == {"region": (5, 5, True), "nation": (25, 26, False), "orders": (1500, None, False)}


def test_fingerprint_survives_type_widening(spark):
    a = spark.createDataFrame([(1, 2.5, "2024-01-01 00:00:00")], "i short, f float, t string").select(
        "i", "f", F.col("t").cast("timestamp_ntz").alias("t"))
    b = a.select(F.col("i").cast("int").alias("i"), F.col("f").cast("double").alias("f"),
                 F.col("t").cast("timestamp").alias("t"))
    assert compare(a, b)["matched"]
    assert not compare(a, b.withColumn("i", F.col("i") + 1))["matched"]

"""Report-column expressions against a plain-Python rendering of the rules."""

import datetime as dt
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablemove.functions import audit as A


def py_duration(start, end):
    if not start or not end:
        return "N/A"
    try:
        s = dt.datetime.fromisoformat(start.replace("Z", "+00:00"))
        e = dt.datetime.fromisoformat(end.replace("Z", "+00:00"))
    except ValueError:
        return "Error"
    if s.tzinfo is None:
        s = s.replace(tzinfo=dt.timezone.utc)
    if e.tzinfo is None:
        e = e.replace(tzinfo=dt.timezone.utc)
    return f"{(e - s).total_seconds():.2f}"


def _seconds(spark, micros):
    df = spark.createDataFrame([(m,) for m in micros], "m long")
    return [r[0] for r in df.select(A.seconds_text(F.col("m"))).collect()]


def test_seconds_ties_follow_python(spark):
    cases = [125_000, 2_675_000, 375_000, 5_000, 15_000, 1_005_000, -125_000, -2_675_000, 0, 1, -1, 994_999_995_000]
    want = [f"{m / 1e6:.2f}" for m in cases]
    assert _seconds(spark, cases) == want
    assert want[0] == "0.12" and want[1] == "2.67"


def test_seconds_random_and_constructed_ties(spark):
    rnd = random.Random(7)
    micros = [rnd.randrange(-10**12, 10**12) for _ in range(3000)]
    micros += [rnd.randrange(0, 10**8) * 10000 + 5000 for _ in range(3000)]  # decimal ties
    assert _seconds(spark, micros) == [f"{m / 1e6:.2f}" for m in micros]


def test_duration_rules(spark):
    rows = [
        ("2024-01-01T00:00:00Z", "2024-01-01T00:00:10.5Z"),
        ("2024-01-01T00:00:00Z", None),
        (None, "2024-01-01T00:00:00Z"),
        ("", "2024-01-01T00:00:00Z"),
        ("2024-01-01T00:00:00Z", "bogus"),
        ("2024-01-01 00:00:00", "2024-01-01T01:00:00+01:00"),
        ("2024-01-01T00:00:00", "2024-01-01T00:00:01.000001Z"),
        ("2024-01-02", "2024-01-01T00:00:00Z"),
        ("2024-01-01T00:00:00.125Z", "2024-01-01T00:00:00.25Z"),
    ]
    df = spark.createDataFrame(rows, "s string, e string")
    got = [r[0] for r in df.select(A.duration_text(F.col("s"), F.col("e"))).collect()]
    assert got == [py_duration(s, e) for s, e in rows]


def test_iso_parse_is_independent_of_session_zone(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:00",), ("2024-01-01T00:00:00Z",)], "s string")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = [r[0] for r in df.select(A.iso_micros(F.col("s"))).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == [1704067200000000, 1704067200000000]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="ab_Z9' é-xY", max_size=12), min_size=1, max_size=20))
def test_title_case_matches_python(spark, words):
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r[0] for r in df.select(A.title_case(F.col("w"))).collect()]
    assert got == [w.title() for w in words]


def test_job_type_and_status_defaults(spark):
    df = spark.createDataFrame([("migrate_catalogs", "completed"), (None, None), ("weird2type it's", "x")], "t string, s string")
    got = df.select(A.job_type_display(F.col("t")), A.status_display(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [
        ("Migrate Catalogs", "COMPLETED"),
        ("Unknown", "UNKNOWN"),
        ("weird2type it's".title(), "X"),
    ]


def test_details_templates(spark):
    rows = [
        ("ingest_from_hive", "db1", None, None, None, None, ["a", "b"], None, None),
        ("ingest_from_hive", None, None, None, None, None, None, None, None),
        ("migrate_catalogs", "db1", "cl1", None, None, None, ["t"], True, None),
        ("migrate_catalogs", "db1", None, None, None, None, [], False, None),
        ("register_snowflake", None, None, "cl1", "SF", "PUB", ["t1"], None, "0123456789abcdef"),
        ("register_snowflake", None, None, "cl1", "SF", None, ["t1"], None, ""),
        ("export_audit_to_snowflake", "x", None, None, "SF", "PUB", None, None, None),
        ("other", "x", None, None, None, None, ["t"], None, None),
    ]
    df = spark.createDataFrame(
        rows,
        "job_type string, source_db string, dest_db string, azure_db string, sf_db string, "
        "sf_schema string, tables array<string>, register_on_snowflake boolean, chained_from string",
    )
    c = F.col
    got = [r[0] for r in df.select(A.details(c("job_type"), c("source_db"), c("dest_db"), c("azure_db"),
                                             c("sf_db"), c("sf_schema"), c("tables"),
                                             c("register_on_snowflake"), c("chained_from"))).collect()]
    assert got == [
        "Source DB: db1, Tables: a, b",
        "Source DB: None, Tables: ",
        "From: db1 To: cl1, Tables: t (Chained SF Reg.)",
        "From: db1 To: None, Tables: ",
        "Azure DB: cl1 -> SF: SF.PUB, Tables: t1 (Chained from 01234567...)",
        "Azure DB: cl1 -> SF: SF.None, Tables: t1",
        "",
        "",
    ]


def test_status_colour(spark):
    df = spark.createDataFrame([("completed",), ("failed",), ("running",), ("pending",)], "s string")
    assert [r[0] for r in df.select(A.status_colour(F.col("s"))).collect()] == ["green", "red", "orange", "blue"]

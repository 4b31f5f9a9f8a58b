"""Audit pipeline: archive scan, messages, incremental == full rescan, filters."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tablemove.plans import audit as P
from tablemove.sources.jobs import read_job_records


def _write_jobs(folder, jobs):
    os.makedirs(folder, exist_ok=True)
    for j in jobs:
        with open(os.path.join(folder, f"{j.get('job_id', 'nokey')}.json"), "w") as f:
            json.dump(j, f, indent=4)


def _job(i, status="completed", end="2024-01-01T00:10:00Z", **kw):
    d = {
        "job_id": f"id-{i:04d}",
        "job_type": "ingest_from_hive",
        "source_db": "db",
        "tables": ["a", "b"],
        "status": status,
        "start_time": "2024-01-01T00:00:00Z",
    }
    if end is not None:
        d["end_time"] = end
    d.update(kw)
    return d


def _rows(df):
    return sorted(tuple(str(v) for v in r) for r in df.collect())


def test_missing_archive_message(spark, tmp):
    res = P.generate_report(spark, f"{tmp}/nope", "tm_audit_missing.ledger")
    assert res.report is None and res.message == "Archive directory does not exist."


def test_multiline_files_rejects_and_stem_key(spark, tmp):
    arch = f"{tmp}/archive"
    _write_jobs(arch, [_job(1), _job(2, status="failed", end=None)])
    with open(f"{arch}/broken.json", "w") as f:
        f.write('{"job_id": "x", ')
    with open(f"{arch}/no-id-file.json", "w") as f:
        json.dump({"job_type": "migrate_catalogs", "status": "running"}, f, indent=2)
    records, rejects = read_job_records(spark, arch)
    keys = sorted(r.job_key for r in records.collect())
    assert keys == ["id-0001", "id-0002", "no-id-file"]
    assert [r.source_file.endswith("broken.json") for r in rejects.collect()] == [True]


def test_full_then_incremental_messages(spark, tmp, ns):
    arch, ledger = f"{tmp}/archive", f"{ns}.ledger"
    _write_jobs(arch, [_job(i) for i in range(3)])
    r1 = P.generate_report(spark, arch, ledger)
    assert r1.message == "Report updated with 3 new job(s)." and r1.report.count() == 3
    r2 = P.generate_report(spark, arch, ledger)
    assert r2.message == "Audit report is already up-to-date." and r2.new_jobs == 0
    _write_jobs(arch, [_job(7, end="bogus"), _job(8, status="running", end=None)])
    r3 = P.generate_report(spark, arch, ledger)
    assert r3.message == "Report updated with 2 new job(s)."
    full = P.generate_report(spark, arch, f"{ns}.ledger_full", full_rescan=True)
    assert _rows(r3.report) == _rows(full.report)


def test_empty_archive(spark, tmp, ns):
    os.makedirs(f"{tmp}/empty")
    with open(f"{tmp}/empty/readme.txt", "w") as f:
        f.write("not a job")
    res = P.generate_report(spark, f"{tmp}/empty", f"{ns}.ledger")
    assert res.report is None and res.message == "No completed jobs found to report."


def test_incremental_equals_full_for_random_splits(spark, tmp, ns):
    rnd = random.Random(3)
    jobs = []
    for i in range(40):
        end = rnd.choice([None, "bogus", f"2024-01-0{rnd.randint(1, 9)}T0{rnd.randint(0, 9)}:00:00.{rnd.randint(0, 999999):06d}Z"])
        jobs.append(_job(i, status=rnd.choice(["completed", "failed", "running"]), end=end,
                         job_type=rnd.choice(["ingest_from_hive", "migrate_catalogs", "register_snowflake", "zzz"])))
    for split in (0, 13, 40):
        arch = f"{tmp}/arch{split}"
        ledger = f"{ns}.inc{split}"
        _write_jobs(arch, jobs[:split])
        if split:
            P.generate_report(spark, arch, ledger)
        _write_jobs(arch, jobs[split:])
        inc = P.generate_report(spark, arch, ledger)
        full = P.generate_report(spark, arch, f"{ns}.full{split}", full_rescan=True)
        assert _rows(inc.report) == _rows(full.report)
        assert inc.report.count() == 40


def test_sort_nulls_last_and_ties_by_id(spark, tmp, ns):
    arch = f"{tmp}/archive"
    _write_jobs(arch, [
        _job(1, end="2024-01-01T00:05:00Z"), _job(2, end=None, status="running"),
        _job(3, end="2024-01-01T00:09:00Z"), _job(4, end="2024-01-01T00:09:00Z"), _job(5, end="bogus"),
    ])
    res = P.generate_report(spark, arch, f"{ns}.ledger")
    ids = [r["Job ID"] for r in res.report.collect()]
    assert ids == ["id-0003", "id-0004", "id-0001", "id-0002", "id-0005"]
    assert [r["Job ID"] for r in P.top_recent(res.report, 2).collect()] == ["id-0003", "id-0004"]


def test_filters(spark, tmp, ns):
    arch = f"{tmp}/archive"
    _write_jobs(arch, [_job(1), _job(2, status="failed"), _job(3, job_type="migrate_catalogs")])
    rep = P.generate_report(spark, arch, f"{ns}.ledger").report
    assert P.filter_report(rep).count() == 3
    assert P.filter_report(rep, [], []).count() == 3
    assert P.filter_report(rep, ["Ingest From Hive"]).count() == 2
    assert P.filter_report(rep, ["Ingest From Hive"], ["FAILED"]).count() == 1
    vals = {(r.filter, r.value) for r in P.filter_values(rep).collect()}
    assert vals == {("Job Type", "Ingest From Hive"), ("Job Type", "Migrate Catalogs"),
                    ("Status", "COMPLETED"), ("Status", "FAILED")}


def test_csv_export_import_keeps_values(spark, tmp, ns):
    arch = f"{tmp}/archive"
    _write_jobs(arch, [_job(1, end="2024-01-01T00:00:12.300000Z"), _job(2, end=None, status="running")])
    rep = P.generate_report(spark, arch, f"{ns}.ledger").report
    P.write_report_csv(rep, f"{tmp}/csv")
    n = P.import_report_csv(spark, f"{tmp}/csv", f"{ns}.imported")
    assert n == 2
    back = P.report_view(spark.table(f"{ns}.imported"))
    assert _rows(back) == _rows(rep)
    durations = sorted(r["Duration (s)"] for r in back.collect())
    assert durations == ["12.30", "N/A"]  # no 12.3 / NaN drift


def test_export_writer_names(spark, tmp, ns):
    arch = f"{tmp}/archive"
    _write_jobs(arch, [_job(1)])
    rep = P.generate_report(spark, arch, f"{ns}.ledger").report
    w = P.export_writer(rep, "jdbc:none://x", database="sfdb", schema="public")
    assert w is not None  # configured, not executed: no database is started in tests


def test_mixed_end_time_formats_parse_per_value(spark, tmp, ns):
    """Each End Time is parsed on its own: mixed formats do not null each other out."""
    arch = f"{tmp}/archive"
    _write_jobs(arch, [
        _job(1, end="2024-01-01T00:00:05Z"),
        _job(2, end="2024-01-01 00:00:06"),
        _job(3, end="2024-01-01T00:00:07.5+00:00"),
        _job(4, end="2024-01-01T02:00:08+02:00"),
    ])
    P.generate_report(spark, arch, f"{ns}.ledger")
    _write_jobs(arch, [_job(5, end="2024-01-01T00:00:09.123456Z")])
    rep = P.generate_report(spark, arch, f"{ns}.ledger").report
    got = {r["Job ID"]: (r["End Time (UTC)"] is not None, r["Duration (s)"]) for r in rep.collect()}
    assert got == {"id-0001": (True, "5.00"), "id-0002": (True, "6.00"), "id-0003": (True, "7.50"),
                   "id-0004": (True, "8.00"), "id-0005": (True, "9.12")}


def test_file_that_grew_adds_its_new_job(spark, tmp, ns):
    arch, ledger = f"{tmp}/archive", f"{ns}.ledger"
    _write_jobs(arch, [_job(1), _job(2)])
    P.generate_report(spark, arch, ledger)
    with open(f"{arch}/id-0001.json", "a") as f:
        f.write("\n" + json.dumps(_job(99)))
    _write_jobs(arch, [_job(3)])
    res = P.generate_report(spark, arch, ledger)
    assert res.new_jobs == 2 and res.message == "Report updated with 2 new job(s)."
    assert sorted(r["Job ID"] for r in res.report.collect()) == ["id-0001", "id-0002", "id-0003", "id-0099"]


def test_mixed_layouts_lose_no_record(spark, tmp):
    os.makedirs(f"{tmp}/mixed")
    lines = [json.dumps(_job(i)) for i in range(1, 6)]
    texts = {
        "lines": "\n".join(lines) + "\n",
        "indented": json.dumps(_job(6), indent=2),
        "both": json.dumps(_job(7), indent=4) + "\r\n\r\n" + json.dumps(_job(8)) + "\nstray text\n",
        "cut": json.dumps(_job(9))[:-5],
        "array": json.dumps([_job(10), _job(11)], indent=2),
        "trailing": json.dumps(_job(12)) + " tail",
        "empty": "",
    }
    for name, text in texts.items():
        with open(f"{tmp}/mixed/{name}.json", "w", newline="") as f:
            f.write(text)
    records, rejects = read_job_records(spark, f"{tmp}/mixed")
    assert sorted(r.job_id for r in records.collect()) == [f"id-{i:04d}" for i in (1, 2, 3, 4, 5, 6, 7, 8, 10, 11)]
    assert sorted(r.source_file.rsplit("/", 1)[-1] for r in rejects.collect()) == ["both.json", "cut.json", "empty.json", "trailing.json"]


LEGAL = [
    '{"job_id": "1", "tables":[\nnull,\n"a"]}', '{\n"job_id":\n"2",\n"tables": [\n"x",\nnull\n]\n}', '{\n"job_id": "3",\n"extra":\n{\n"n":\n7\n}\n}',
    '{"job_id": "4", "list": [\n{\n"x": 1\n},\n{\n"y": [\n{"z": "}{"}\n]\n}\n]\n}', '[\n{"job_id": "5"},\n{"job_id": "6"}\n]',
    '{"job_id": "7", "note": "brace \\" {\\n{ [ in text"}', '{"deep": [[[[[[[{"a": [{}]}]]]]]]], "job_id": "8"}', '{"job_id": "9"}\n{"job_id": "10"}',
]
BROKEN = ['{"job_id": "x", ', '{"job_id": "y', '{"job_id": "z"}, ', '"text"', "}", '{"job_id": "a"}{"job_id": "b"}', '{"tables": ["a"', "word"]


def _ids(df):
    return sorted(r.job_id for r in df.collect())


@pytest.mark.parametrize("split", [None, "64b"])
def test_every_legal_record_whatever_lies_around_it(spark, tmp, split):
    os.makedirs(f"{tmp}/a")
    n = 0
    for i, bad in enumerate([None, *BROKEN]):
        for j, good in enumerate(LEGAL):
            for text in ([good] if bad is None else [f"{bad}\n{good}", f"{good}\n{bad}", f"{LEGAL[-1]}\r\n{bad}\n{good}"]):
                n += 1
                if bad and n % 3 != (i + j) % 3:  # one of three places each
                    continue
                with open(f"{tmp}/a/{i}-{j}-{n}.json", "w", newline="") as f:
                    f.write(text)
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        records, rejects = read_job_records(spark, f"{tmp}/a")
        got, bad = records.collect(), rejects.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    by_file, bad_files = {}, {r.source_file.rsplit("/", 1)[-1] for r in bad}
    for r in got:
        by_file.setdefault(r.source_file.rsplit("/", 1)[-1], []).append(r.job_id)
    for i, j, n in ((i, j, n) for i, j, n in (name[:-5].split("-") for name in os.listdir(f"{tmp}/a")) if BROKEN[int(i) - 1] == "}" and i != "0"):
        if open(f"{tmp}/a/{i}-{j}-{n}.json").read().startswith("}"):  # reads as if its opening brace were there
            os.remove(f"{tmp}/a/{i}-{j}-{n}.json")
    want = [["1"], ["2"], ["3"], ["4"], ["5", "6"], ["7"], ["8"], ["10", "9"]]
    for name in os.listdir(f"{tmp}/a"):
        i, j, _ = name[:-5].split("-")
        assert set(want[int(j)]) <= set(by_file.get(name, [])), (name, open(f"{tmp}/a/{name}").read(), by_file.get(name))
        assert (name in bad_files) == (i != "0"), (name, open(f"{tmp}/a/{name}").read(), by_file.get(name))


def test_long_file_is_read_by_many_tasks(spark, tmp):
    os.makedirs(f"{tmp}/a")
    with open(f"{tmp}/a/all.json", "w") as f:
        f.write("\n".join(json.dumps(_job(i), indent=2) for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        records, rejects = read_job_records(spark, f"{tmp}/a")
        assert records.rdd.getNumPartitions() > 5
        assert _ids(records) == [f"id-{i:04d}" for i in range(3000)] and rejects.count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_files_without_content_are_rejects(spark, tmp, ns):
    from tablemove.streaming.audit_stream import run_audit_stream

    arch = f"{tmp}/a"
    _write_jobs(arch, [_job(1)])
    for name, text in (("none", ""), ("blank", " \n\t\n"), ("brace", "{")):
        with open(f"{arch}/{name}.json", "w") as f:
            f.write(text)
    for multi_line in (True, False):
        records, rejects = read_job_records(spark, arch, multi_line=multi_line)
        found = {r.source_file.rsplit("/", 1)[-1]: r._corrupt_record for r in rejects.filter("source_file NOT LIKE '%id-0001%'").collect()}
        assert found == {"none.json": "", "blank.json": "", "brace.json": "{"}
    assert _ids(read_job_records(spark, arch)[0]) == ["id-0001"]
    run_audit_stream(spark, arch, f"{ns}.led", f"{tmp}/ckpt")
    _write_jobs(arch, [_job(2)])
    run_audit_stream(spark, arch, f"{ns}.led", f"{tmp}/ckpt")
    spark.catalog.refreshTable(f"{ns}.led_rejects")
    assert sorted(r.source_file.rsplit("/", 1)[-1] for r in spark.table(f"{ns}.led_rejects").collect()) == ["blank.json", "brace.json", "none.json"]


def test_ledger_keeps_its_format(spark, tmp, ns):
    arch, ledger = f"{tmp}/archive", f"{ns}.ledger"
    _write_jobs(arch, [_job(1)])
    P.generate_report(spark, arch, ledger, fmt="orc")
    _write_jobs(arch, [_job(2)])
    assert P.generate_report(spark, arch, ledger).new_jobs == 1
    assert spark.table(ledger).count() == 2


def test_compact_ledger(spark, tmp, ns):
    arch, ledger = f"{tmp}/archive", f"{ns}.ledger"
    for i in range(4):
        _write_jobs(arch, [_job(i)])
        P.generate_report(spark, arch, ledger)
    before = _rows(P.report_view(spark.table(ledger)))
    assert len(spark.table(ledger).inputFiles()) >= 4
    assert P.compact_ledger(spark, ledger) == 1
    assert _rows(P.report_view(spark.table(ledger))) == before
    _write_jobs(arch, [_job(9)])
    assert P.generate_report(spark, arch, ledger).new_jobs == 1  # still incremental after compaction


def test_csv_round_trip_keeps_empty_and_null_apart(spark, tmp, ns):
    arch = f"{tmp}/archive"
    no_start = _job(2, job_type="export_audit_to_snowflake")
    del no_start["start_time"]
    _write_jobs(arch, [_job(1, end="2024-01-01T00:00:00.123456Z"), no_start])
    rep = P.generate_report(spark, arch, f"{ns}.ledger").report
    P.write_report_csv(rep, f"{tmp}/csv")
    P.import_report_csv(spark, f"{tmp}/csv", f"{ns}.imported")
    back = {r["Job ID"]: r for r in P.report_view(spark.table(f"{ns}.imported")).collect()}
    assert back["id-0002"]["Details"] == "" and back["id-0002"]["Start Time (UTC)"] is None
    assert back["id-0002"]["Duration (s)"] == "N/A"
    assert back["id-0001"]["End Time (UTC)"].microsecond == 123456


def test_ledger_rows_of_both_paths(spark, tmp, ns, monkeypatch):
    """Broadcast path and plain semi-join agree."""
    _write_jobs(f"{tmp}/archive", [_job(i) for i in range(20)])
    P.generate_report(spark, f"{tmp}/archive", f"{ns}.keys")
    rows = spark.createDataFrame([("id-0003", 1), ("id-0003", 2), ("new", 3)], "job_key string, v int")
    fast = _rows(P.ledger_rows_of(spark, rows, f"{ns}.keys"))
    monkeypatch.setattr(P, "MAX_BROADCAST_NEW_KEYS", 0)
    assert _rows(P.ledger_rows_of(spark, rows, f"{ns}.keys")) == fast and len(fast) == 1


def test_newest_record_wins_and_unchanged_files_stay_shut(spark, tmp, ns, monkeypatch):
    arch, ledger = f"{tmp}/archive", f"{ns}.ledger"
    _write_jobs(arch, [_job(i, status="running", end=None) for i in range(30)])
    P.generate_report(spark, arch, ledger)
    opened = []
    real = P.read_job_records

    def spy(*args, files=None, **kw):
        records, rejects = real(*args, files=files, **kw)
        opened.append(sorted(r.stem for r in records.select("stem").distinct().collect()))
        return records, rejects

    monkeypatch.setattr(P, "read_job_records", spy)
    _write_jobs(arch, [_job(3), _job(40)])  # job 3 has ended since, job 40 is new
    res = P.generate_report(spark, arch, ledger)
    assert res.new_jobs == 2 and opened == [["id-0003", "id-0040"]]
    status = {r["Job ID"]: r["Status"] for r in res.report.collect()}
    assert status["id-0003"] == "COMPLETED" and status["id-0004"] == "RUNNING" and len(status) == 31
    assert P.generate_report(spark, arch, ledger).message == P.MSG_UP_TO_DATE and opened[1:] == [[]]
    monkeypatch.setattr(P, "MAX_NAMED_FILES", 1)
    _write_jobs(arch, [_job(5), _job(6, status="failed"), _job(41)])
    many = P.generate_report(spark, arch, ledger)
    full = P.generate_report(spark, arch, f"{ns}.full", full_rescan=True)
    assert many.new_jobs == 3 and _rows(many.report) == _rows(full.report)


def test_named_files_prune_the_scan(spark, tmp):
    arch = f"{tmp}/archive"
    os.makedirs(arch)
    for i in range(12):
        with open(f"{arch}/{i}.json", "w") as f:
            f.write(json.dumps(_job(i)) + "\n")
    for multi_line in (True, False):
        path = read_job_records(spark, arch, multi_line)[0].select("source_file").first().source_file
        some, _ = read_job_records(spark, arch, multi_line, files=[path])
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            plan = some._jdf.queryExecution().executedPlan()
            some._jdf.queryExecution().toRdd().count()
            leaves = plan.collectLeaves()
            read = {leaves.apply(k).metrics().apply("numFiles").value() for k in range(leaves.size()) if leaves.apply(k).metrics().contains("numFiles")}
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
        assert read == {1}


def test_an_unreadable_ledger_is_made_anew(spark, tmp, ns, caplog):
    arch, ledger = f"{tmp}/archive", f"{ns}.ledger"
    _write_jobs(arch, [_job(1), _job(2)])
    spark.createDataFrame([("id-0001",)], "job_key string").write.saveAsTable(ledger)
    res = P.generate_report(spark, arch, ledger)
    assert res.new_jobs == 2 and "Performing a full rescan" in caplog.text
    assert P.generate_report(spark, arch, ledger).message == P.MSG_UP_TO_DATE


def test_incremental_with_any_file_name(spark, tmp, ns):
    arch, ledger = f"{tmp}/my archive", f"{ns}.ledger"
    os.makedirs(arch)
    for i, name in enumerate(("job one", "j[2]", "k{3}"), 1):
        with open(f"{arch}/{name}.json", "w") as f:
            json.dump(_job(i), f)
        assert P.generate_report(spark, arch, ledger).new_jobs == 1
    assert P.generate_report(spark, arch, ledger).message == P.MSG_UP_TO_DATE


def test_stem_key_is_the_decoded_file_name(spark, tmp):
    arch = f"{tmp}/arch ive"
    os.makedirs(arch)
    for name in ("a b+c", "100%done"):
        with open(f"{arch}/{name}.json", "w") as f:
            json.dump({"job_type": "ingest_from_hive", "status": "completed"}, f)
    records, _ = read_job_records(spark, arch)
    assert sorted(r.job_key for r in records.collect()) == ["100%done", "a b+c"]


def test_one_row_per_job_in_every_path(spark, tmp, ns):
    from tablemove.streaming.audit_stream import run_audit_stream

    arch = f"{tmp}/archive"
    _write_jobs(f"{arch}", [_job(1)])
    os.utime(f"{arch}/id-0001.json", (1_000_000, 1_000_000))
    with open(f"{arch}/again.json", "w") as f:  # the same job later, and twice in one file
        f.write("".join(json.dumps(_job(1, status=s)) + "\n" for s in ("failed", "running")))
    with open(f"{arch}/anon.json", "w") as f:  # three records without an id, two of them equal
        f.write("".join(json.dumps({"job_type": t, "status": "completed"}) + "\n" for t in ("a", "b", "b")))
    full = P.generate_report(spark, arch, f"{ns}.full", full_rescan=True)
    got = _rows(full.report.select("Job ID", "Job Type", "Status"))
    assert got == [("N/A", "A", "COMPLETED"), ("N/A", "B", "COMPLETED"), ("id-0001", "Ingest From Hive", "RUNNING")]
    assert P.generate_report(spark, arch, f"{ns}.full").new_jobs == 0
    streamed = run_audit_stream(spark, arch, f"{ns}.streamed", f"{tmp}/ckpt")
    assert _rows(P.report_view(streamed)) == _rows(full.report)


def test_compaction_keeps_the_format(spark, tmp, ns):
    from tablemove.operators.catalog import table_provider

    _write_jobs(f"{tmp}/archive", [_job(1), _job(2)])
    P.generate_report(spark, f"{tmp}/archive", f"{ns}.ledger", fmt="orc")
    P.compact_ledger(spark, f"{ns}.ledger")
    assert table_provider(spark, f"{ns}.ledger").lower() == "orc" and spark.table(f"{ns}.ledger").count() == 2


def test_filter_values_scans_once_without_a_sort(spark, tmp, ns):
    _write_jobs(f"{tmp}/archive", [_job(1), _job(2, status="failed")])
    report = P.generate_report(spark, f"{tmp}/archive", f"{ns}.ledger").report
    plan = P.filter_values(report)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "rangepartitioning" not in plan


def test_pieces_are_read_once_for_report_and_rejects(spark, tmp, ns):
    from tablemove.streaming.audit_stream import run_audit_stream

    arch = f"{tmp}/a"
    _write_jobs(arch, [_job(1), _job(2)])
    for name, text in (("cut", json.dumps(_job(3))[:-5]), ("list", "[null,\n" + json.dumps(_job(4)) + "]"), ("blank", " \n")):
        with open(f"{arch}/{name}.json", "w") as f:
            f.write(text)
    records, rejects = read_job_records(spark, arch)
    want, bad = _ids(records), _rows(rejects)
    assert want == ["id-0001", "id-0002", "id-0004"] and len(bad) == 3
    streamed = run_audit_stream(spark, arch, f"{ns}.s", f"{tmp}/ckpt")
    res = P.generate_report(spark, arch, f"{ns}.led", full_rescan=True)
    for name in os.listdir(arch):
        os.remove(f"{arch}/{name}")
    assert sorted(r["Job ID"] for r in res.report.collect()) == sorted(r["Job ID"] for r in streamed.collect()) == want
    assert _rows(res.rejects) == bad  # from what the report's one pass has found

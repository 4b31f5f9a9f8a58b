"""Command line: ``python -m tablemove <command> ...`` (or via ``spark-submit``).

Commands mirror the jobs a user runs: ``ingest`` (session tables into
``<db>_iceberg``), ``migrate`` (namespace to namespace across catalogs),
``register`` (publish manifest), ``audit`` (incremental report) and
``chain`` (queue registrations for finished copies). The session comes from
``SparkSession.builder.getOrCreate()``, so catalogs, warehouse and
``spark.checkpoint.dir`` are whatever the submit command configured.

Each command prints its outcome rows; the exit code is 1 when any table
failed (unless ``--allow-failures``), so a scheduler sees partial failures.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tablemove", description=__doc__.splitlines()[0])
    sub = p.add_subparsers(dest="command", required=True)

    ing = sub.add_parser("ingest", help="copy session tables into <db>_iceberg of a target catalog")
    ing.add_argument("--database", required=True)
    ing.add_argument("--tables", required=True, nargs="+", help="names, or * for all")
    ing.add_argument("--target-catalog")
    ing.add_argument("--format", dest="fmt")
    ing.add_argument("--verify", action="store_true")
    ing.add_argument("--parallelism", type=int, default=1)
    ing.add_argument("--preview", type=int, default=5, help="rows of each new table to print")

    inf = sub.add_parser("ingest-files", help="copy CSV files (header, inferred types) into a table")
    inf.add_argument("--path", required=True, nargs="+", help="files or a folder")
    inf.add_argument("--target", required=True, help="[catalog.]namespace.table")
    inf.add_argument("--format", dest="fmt")
    inf.add_argument("--verify", action="store_true")
    inf.add_argument("--preview", type=int, default=5, help="rows of the new table to print")

    mig = sub.add_parser("migrate", help="copy tables between catalogs (create or replace)")
    mig.add_argument("--source-db", required=True)
    mig.add_argument("--dest-db")
    mig.add_argument("--tables", required=True, nargs="+")
    mig.add_argument("--source-catalog")
    mig.add_argument("--target-catalog")
    mig.add_argument("--format", dest="fmt")
    mig.add_argument("--strict", action="store_true", help="fail tables that already exist")
    mig.add_argument("--verify", action="store_true")
    mig.add_argument("--parallelism", type=int, default=1)

    reg = sub.add_parser("register", help="manifest of newest metadata files and registration DDL")
    reg.add_argument("--azure-db", required=True, help="namespace holding the copied tables")
    reg.add_argument("--tables", required=True, nargs="+", help="table names, or * for all (one listing of the warehouse)")
    reg.add_argument("--sf-db", required=True)
    reg.add_argument("--sf-schema", required=True)
    reg.add_argument("--warehouse", required=True)
    reg.add_argument("--catalog-integration", required=True)
    reg.add_argument("--external-volume", required=True)
    reg.add_argument("--catalog")
    reg.add_argument("--output-table", help="append manifest rows to this table")

    aud = sub.add_parser("audit", help="update the audit ledger from a job archive")
    aud.add_argument("--archive", required=True)
    aud.add_argument("--ledger", required=True, help="ledger table name")
    aud.add_argument("--full-rescan", action="store_true")
    aud.add_argument("--json-lines", action="store_true", help="archive holds JSON lines, not one object per file")
    aud.add_argument("--csv", help="also export the report as CSV to this folder")
    aud.add_argument("--compact", action="store_true", help="rewrite the ledger into few large files afterwards")

    ch = sub.add_parser("chain", help="queue registration records for finished flagged copies")
    ch.add_argument("--archive", required=True)
    ch.add_argument("--queue", required=True)
    ch.add_argument("--json-lines", action="store_true")

    for sp in (ing, inf, mig, reg, aud, ch):
        sp.add_argument("--allow-failures", action="store_true")
        sp.add_argument("--show", type=int, default=100, help="rows to print")
    return p


def _qualified(catalog: str | None, ns: str) -> str:
    return f"{catalog}.{ns}" if catalog else ns


def run(argv: list[str], spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"tablemove-{args.command}").getOrCreate()
    failed = False

    if args.command == "ingest":
        from .functions.identifiers import quote_name, split_name
        from .operators.catalog import list_tables, preview
        from .plans.copy import copy_summary
        from .plans.ingest import ingest_tables, target_namespace_for

        tables = "*" if args.tables == ["*"] else args.tables
        out = ingest_tables(spark, args.database, tables, target_catalog=args.target_catalog,
                            fmt=args.fmt, verify=args.verify, parallelism=args.parallelism)
        out.show(args.show, truncate=False)
        copy_summary(out).show(truncate=False)
        target = target_namespace_for(args.database, args.target_catalog)
        list_tables(spark, target).show(args.show, truncate=False)
        if args.preview:
            for r in out.filter("status = 'succeeded'").limit(args.show).collect():  # console display only
                print(f"{target}.{r.table}")
                preview(spark, quote_name([*split_name(target), r.table]), args.preview).show()
        failed = out.filter("status <> 'succeeded'").limit(1).count() > 0
    elif args.command == "ingest-files":
        from .functions.identifiers import quote_name, split_name
        from .operators.catalog import list_tables, preview
        from .plans.ingest import ingest_files

        path = args.path[0] if len(args.path) == 1 else args.path
        done = ingest_files(spark, path, args.target, fmt=args.fmt, verify=args.verify)
        print(done)
        parent = split_name(args.target)[:-1]
        if parent:
            list_tables(spark, quote_name(parent)).show(args.show, truncate=False)
        preview(spark, args.target, args.preview).show(truncate=False)
    elif args.command == "migrate":
        from .operators.catalog import list_tables
        from .plans.copy import copy_summary, copy_tables

        src = _qualified(args.source_catalog, args.source_db)
        dst = _qualified(args.target_catalog, args.dest_db or args.source_db)
        tables = args.tables
        if tables == ["*"]:
            tables = [r.tableName for r in list_tables(spark, src).collect()]  # names only
        out = copy_tables(spark, src, dst, tables, mode="create" if args.strict else "replace",
                          fmt=args.fmt, verify=args.verify, parallelism=args.parallelism)
        out.show(args.show, truncate=False)
        copy_summary(out).show(truncate=False)
        failed = out.filter("status <> 'succeeded'").limit(1).count() > 0
    elif args.command == "register":
        from .plans.publish import publish_manifest, publish_namespace

        ns = _qualified(args.catalog, args.azure_db)
        target = (args.warehouse, args.sf_db, args.sf_schema)
        names = {"catalog_integration": args.catalog_integration, "external_volume": args.external_volume}
        if args.tables == ["*"]:
            manifest = publish_namespace(spark, ns, *target, **names)
        else:
            manifest = publish_manifest(spark, ns, args.tables, *target, **names)
        rows = manifest.collect()  # one row per requested table
        for r in rows:
            print(r.ddl if r.status == "ok" else f"-- {r.table}: {r.error}")
        if args.output_table:
            spark.createDataFrame(rows, manifest.schema).write.mode("append").saveAsTable(args.output_table)
        failed = any(r.status != "ok" for r in rows)
    elif args.command == "audit":
        from .plans.audit import append_rejects, compact_ledger, generate_report, write_report_csv

        res = generate_report(spark, args.archive, args.ledger, full_rescan=args.full_rescan,
                              multi_line=not args.json_lines)
        print(res.message)
        if res.rejects is not None:
            bad_files = spark.read.table(append_rejects(spark, res.rejects, args.ledger)).select("source_file").distinct()
            n_bad = bad_files.count()
            if n_bad:
                print(f"Warning: {n_bad} file(s) with records that could not be parsed, e.g.:")
                for r in bad_files.limit(20).collect():  # console display only
                    print(f"  could not parse a record in {r.source_file}")
        if res.report is not None:
            res.report.show(args.show, truncate=False)
            if args.csv:
                write_report_csv(res.report, args.csv)
            if args.compact:
                print("ledger files after compaction:", compact_ledger(spark, args.ledger))
        failed = res.report is None and res.message != "No completed jobs found to report."
    elif args.command == "chain":
        from .plans.chain import chain_registrations
        from .sources.jobs import read_job_records, write_job_records

        records, _ = read_job_records(spark, args.archive, multi_line=not args.json_lines)
        existing = records.select("job_id")  # children that were served
        try:
            queued, _ = read_job_records(spark, args.queue)  # either layout
            existing = existing.unionByName(queued.select("job_id"))
        except AnalysisException as exc:
            if not (exc.getCondition() or "").startswith("PATH_NOT_FOUND"):
                raise
        children = chain_registrations(records, existing=existing)
        write_job_records(children, args.queue)
        print("queued registration records written to", args.queue)

    return 1 if failed and not args.allow_failures else 0


def main() -> None:
    sys.exit(run(sys.argv[1:]))


if __name__ == "__main__":
    main()

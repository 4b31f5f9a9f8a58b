"""tablemove: move tables between Spark catalogs and account for the moves."""

from .operators.reconcile import reconcile_tables
from .operators.state import latest_state
from .plans.audit import compact_ledger, filter_report, generate_report, top_recent
from .plans.board import job_board
from .plans.chain import chain_registrations
from .plans.copy import copy_summary, copy_table, copy_tables
from .plans.ingest import ingest_files, ingest_selection, ingest_table, ingest_tables
from .plans.publish import build_manifest, publish_manifest, publish_namespace

__version__ = "0.1.0"

__all__ = [
    "build_manifest", "chain_registrations", "compact_ledger", "copy_summary", "copy_table",
    "copy_tables", "filter_report", "generate_report", "ingest_files", "ingest_selection",
    "ingest_table", "ingest_tables", "job_board", "latest_state", "publish_manifest", "publish_namespace",
    "reconcile_tables", "top_recent",
]

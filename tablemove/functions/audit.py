"""Column expressions of the job-audit report (all built-in, JVM-side).

Rules per report column (input: one job record):

* Job ID   - the ``job_id`` field, ``N/A`` when missing.
* Job Type - ``job_type`` (``Unknown`` when missing), ``_`` -> space, then
  title case as Python's ``str.title`` does it: a letter is upper-cased when
  the character before it is not a cased letter, otherwise lower-cased
  (so ``2type`` -> ``2Type``, unlike SQL ``initcap``).
* Status   - ``status`` (``Unknown`` when missing), upper-cased.
* Start Time (UTC) - the raw ``start_time`` text.
* End Time (UTC)   - ``end_time`` parsed to a timestamp; unparseable -> null.
* Duration (s) - ``N/A`` when either time is missing or empty; ``Error``
  when either does not parse; otherwise the seconds between them as text
  with two decimals, rounded exactly as Python's ``'%.2f' % seconds``.
* Details  - a per-type text template (below); other types give ``''``.

ISO-8601 parsing: ``yyyy-MM-dd`` with optional ``T``/space time part,
fractions up to microseconds, an optional ``Z`` or ``+hh:mm`` zone; text
without a zone counts as UTC regardless of the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# These texts must equal the reference report's exactly.
REPORT_COLUMNS = [
    "Job ID",
    "Job Type",
    "Status",
    "Start Time (UTC)",
    "End Time (UTC)",
    "Duration (s)",
    "Details",
]
MISSING_ID = "N/A"
MISSING_TEXT = "Unknown"
DURATION_MISSING = "N/A"
DURATION_ERROR = "Error"
NONE_TEXT = "None"
TYPE_INGEST = "ingest_from_hive"
TYPE_MIGRATE = "migrate_catalogs"
TYPE_REGISTER = "register_snowflake"
TYPE_EXPORT = "export_audit_to_snowflake"
KNOWN_JOB_TYPES = [TYPE_INGEST, TYPE_MIGRATE, TYPE_REGISTER, TYPE_EXPORT]
# Detail templates, as "{field}" placeholders:
#   ingest:   "Source DB: {source_db}, Tables: {tables}"
#   migrate:  "From: {source_db} To: {dest_db}, Tables: {tables}"
#             + " (Chained SF Reg.)" when register_on_snowflake is true
#   register: "Azure DB: {azure_db} -> SF: {sf_db}.{sf_schema}, Tables: {tables}"
#             + " (Chained from {first 8 chars of chained_from}...)" when set
# Tables are joined with ", ". Status colours: completed green, failed red,
# running orange, anything else blue.
STATUS_COLOURS = {"completed": "green", "failed": "red", "running": "orange"}
DEFAULT_COLOUR = "blue"
# ---------------------------------------------------------------------------

_ZONE = r"(Z|z|[+-]\d{2}(:?\d{2})?(:?\d{2}(\.\d+)?)?)$"
_ISO_SHAPE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d{1,9})?)?)?" + r"(Z|z|[+-]\d{2}(:?\d{2})?(:?\d{2}(\.\d+)?)?)?)?$"


_CASED = r"\p{Lu}\p{Ll}\p{Lt}"
_MARK = "\u0001 "


def title_case(c: Column) -> Column:
    """Python ``str.title`` semantics on a string column, fully code-generated.

    ``str.title`` upper-cases a letter when the character before it is not a
    cased letter and lower-cases it otherwise. SQL ``initcap`` does the same
    but only treats spaces as word breaks, so a marker ending in a space is
    inserted after every other uncased character that precedes a letter,
    ``initcap`` runs, and the markers are removed again.
    """
    marked = F.regexp_replace(F.lower(c), f"([^{_CASED} ])(?=[{_CASED}])", "$1" + _MARK)
    return F.replace(F.initcap(marked), F.lit(_MARK), F.lit(""))


def iso_micros(c: Column) -> Column:
    """Epoch microseconds of ISO-8601 text; no zone means UTC; bad -> null."""
    s = c
    zoned = s.rlike(r"[T ]\d{2}.*" + _ZONE)
    shaped = s.rlike(_ISO_SHAPE)
    with_zone = F.unix_micros(_try_cast(s, "TIMESTAMP"))
    naive = F.timestamp_diff(
        "MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), _try_cast(s, "TIMESTAMP_NTZ")
    )
    return F.when(~shaped, None).when(zoned, with_zone).otherwise(naive)


def _try_cast(c: Column, to: str) -> Column:
    return c.try_cast(to)


def iso_timestamp(c: Column) -> Column:
    """ISO-8601 text -> TIMESTAMP (absolute instant); bad -> null."""
    return F.timestamp_micros(iso_micros(c))


def utc_now_iso() -> Column:
    """Current time as ISO-8601 text in UTC with a ``Z`` suffix (any session zone)."""
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.localtimestamp())
    return F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))


def _blank(c: Column) -> Column:
    return c.isNull() | (c == "")


# Steps of the exact ``'%.2f'`` rendering of ``micros / 1e6`` (see
# :func:`seconds_text`); each step names its inputs as columns so the steps
# can run as successive projections, computing every intermediate once.
_SEC_STEPS = [
    ("_a", lambda c: F.abs(c("_d"))),
    ("_cf", lambda c: F.floor(c("_a") / F.lit(10000)).cast("long")),
    ("_rem", lambda c: F.pmod(c("_a"), F.lit(10000))),
    ("_n", lambda c: F.floor(c("_a") / F.lit(5000)).cast("long")),  # odd when _rem == 5000
    ("_sh", lambda c: F.lit(61) - F.length(F.bin(c("_n")))),
    # Powers of two are exact doubles, and n * 2**k and fmod on them are
    # exact too, so these comparisons and remainders carry no rounding.
    ("_s", lambda c: F.when((c("_n").cast("double") * F.pow(F.lit(2.0), c("_sh"))) < F.lit(float(200 * 2**53)),
                            c("_sh")).otherwise(c("_sh") - 1)),
    # (n * 2**s) mod 200 == ((n mod 200) * (2**s mod 200)) mod 200
    ("_frac", lambda c: F.pmod(F.pmod(c("_n"), F.lit(200))
                               * F.pmod(F.pow(F.lit(2.0), c("_s")), F.lit(200.0)).cast("long"), F.lit(200))),
    ("_up", lambda c: (c("_rem") > 5000) | ((c("_rem") == 5000) & (
        (c("_frac") > 100) | ((c("_frac") == 0) & (F.pmod(c("_cf"), F.lit(2)) == 1))))),
    ("_cents", lambda c: c("_cf") + F.when(c("_up"), 1).otherwise(0)),
]
_SEC_TEXT = lambda c: F.concat(
    F.when(c("_d") < 0, "-").otherwise(""),
    F.floor(c("_cents") / F.lit(100)).cast("long").cast("string"),
    F.lit("."),
    F.lpad(F.pmod(c("_cents"), F.lit(100)).cast("string"), 2, "0"),
)


def seconds_text(micros: Column) -> Column:
    """``'%.2f'`` of ``micros / 1e6`` exactly as Python formats the double.

    Non-tie values round to nearest; for decimal ties (``...5`` at the third
    decimal) the double nearest to the tie decides: above -> up, below ->
    down, exactly representable -> half-even. Which side the double lies on
    is computed with integer arithmetic: for ``T = n / 200`` (``n`` odd) the
    double is ``round(n * 2**s / 200) / 2**s`` with ``s`` such that the
    quotient has 53 bits, so it lies above ``T`` iff ``(n * 2**s) mod 200 > 100``.

    This single-expression form inlines every step; :func:`with_seconds_text`
    computes the same steps as successive projections (smaller code).
    """
    env: dict[str, Column] = {"_d": micros}
    for name, step in _SEC_STEPS:
        env[name] = step(env.__getitem__)
    return _SEC_TEXT(env.__getitem__)


def with_seconds_text(df: DataFrame, micros: str, out: str) -> DataFrame:
    """Add column ``out`` = :func:`seconds_text` of column ``micros``, step by step."""
    keep = [F.col(quote_col) for quote_col in (f"`{c}`" for c in df.columns)]
    cur = df.select(*keep, F.col(micros).alias("_d"))
    for name, step in _SEC_STEPS:
        cur = cur.withColumn(name, step(F.col))
    return cur.select(*keep, _SEC_TEXT(F.col).alias(out))


def duration_from_micros(start: Column, end: Column, s_us: Column, e_us: Column) -> Column:
    """Duration text given the raw texts and their parsed micros (column refs)."""
    return (
        F.when(_blank(start) | _blank(end), F.lit(DURATION_MISSING))
        .when(s_us.isNull() | e_us.isNull(), F.lit(DURATION_ERROR))
        .otherwise(seconds_text(e_us - s_us))
    )


def duration_text(start: Column, end: Column) -> Column:
    """Stand-alone form; prefer :func:`audit_frame`, which parses each time once."""
    return duration_from_micros(start, end, iso_micros(start), iso_micros(end))


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(NONE_TEXT))


def tables_text(tables: Column) -> Column:
    return F.coalesce(F.array_join(tables, ", "), F.lit(""))


def details(
    job_type: Column,
    source_db: Column,
    dest_db: Column,
    azure_db: Column,
    sf_db: Column,
    sf_schema: Column,
    tables: Column,
    register_flag: Column,
    chained_from: Column,
    tables_joined: bool = False,
) -> Column:
    """Per-type detail text; ``tables`` is the array, or its joined text if ``tables_joined``."""
    t = tables if tables_joined else tables_text(tables)
    ingest = F.concat(F.lit("Source DB: "), _text(source_db), F.lit(", Tables: "), t)
    migrate = F.concat(
        F.lit("From: "), _text(source_db), F.lit(" To: "), _text(dest_db), F.lit(", Tables: "), t,
        F.when(F.coalesce(register_flag, F.lit(False)), F.lit(" (Chained SF Reg.)")).otherwise(F.lit("")),
    )
    register = F.concat(
        F.lit("Azure DB: "), _text(azure_db), F.lit(" -> SF: "), _text(sf_db), F.lit("."), _text(sf_schema),
        F.lit(", Tables: "), t,
        F.when(~_blank(chained_from), F.concat(F.lit(" (Chained from "), F.substring(chained_from, 1, 8), F.lit("...)"))).otherwise(F.lit("")),
    )
    return (
        F.when(job_type == TYPE_INGEST, ingest)
        .when(job_type == TYPE_MIGRATE, migrate)
        .when(job_type == TYPE_REGISTER, register)
        .otherwise(F.lit(""))
    )


def job_type_display(job_type: Column) -> Column:
    return title_case(F.translate(F.coalesce(job_type, F.lit(MISSING_TEXT)), "_", " "))


def status_display(status: Column) -> Column:
    return F.upper(F.coalesce(status, F.lit(MISSING_TEXT)))


def status_colour(status: Column) -> Column:
    out = None
    for k, v in STATUS_COLOURS.items():
        out = (F.when(status == k, v) if out is None else out.when(status == k, v))
    return out.otherwise(DEFAULT_COLOUR)


def audit_frame(records: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The seven report columns (plus ``keep`` columns) over job-record rows.

    Built in two projections: the start/end instants are parsed once into
    columns, and the report columns refer to those. (Spelling the parse
    inside every expression that needs it would copy the parse tree many
    times over and push the generated code past the size where Spark falls
    back to interpretation.)
    """
    c = F.col
    parsed = records.select(
        *[c(n) for n in _JOB_INPUTS + list(keep or [])],
        iso_micros(c("start_time")).alias("_s_us"),
        iso_micros(c("end_time")).alias("_e_us"),
        tables_text(c("tables")).alias("_tables_txt"),
    )
    parsed = with_seconds_text(parsed.withColumn("_d_us", c("_e_us") - c("_s_us")), "_d_us", "_secs")
    return parsed.select(
        F.coalesce(c("job_id"), F.lit(MISSING_ID)).alias("Job ID"),
        job_type_display(c("job_type")).alias("Job Type"),
        status_display(c("status")).alias("Status"),
        c("start_time").alias("Start Time (UTC)"),
        F.timestamp_micros(c("_e_us")).alias("End Time (UTC)"),
        (
            F.when(_blank(c("start_time")) | _blank(c("end_time")), F.lit(DURATION_MISSING))
            .when(c("_s_us").isNull() | c("_e_us").isNull(), F.lit(DURATION_ERROR))
            .otherwise(c("_secs"))
        ).alias("Duration (s)"),
        details(
            c("job_type"), c("source_db"), c("dest_db"), c("azure_db"), c("sf_db"),
            c("sf_schema"), c("_tables_txt"), c("register_on_snowflake"), c("chained_from"),
            tables_joined=True,
        ).alias("Details"),
        *[c(n) for n in (keep or [])],
    )


_JOB_INPUTS = [
    "job_id", "job_type", "status", "start_time", "end_time", "source_db", "dest_db", "azure_db",
    "sf_db", "sf_schema", "tables", "register_on_snowflake", "chained_from",
]

"""Job records: schema, scan with bad-record tolerance, JSON sink.

A job record is one JSON object. Two on-disk layouts are read:

* ``multi_line=True``  - objects over one or more lines, each from the start
  of a line: indented, as in a job queue/archive folder, or JSON lines, or
  both in one file; also arrays of objects. Files are split at line starts with an
  opening brace, so a file may be of any size and is read by many tasks; only one
  record is held at a time. The file stem is the job's fallback key.
* ``multi_line=False`` - JSON lines only: the same without looking at braces.

Unparseable records are not dropped silently: they come back as a second
DataFrame ``(source_file, job_id, _corrupt_record)``, with a row (an empty record) for each
file that holds nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import file_name, file_states, listed_files, stem_of

JOB_FIELDS = [
    T.StructField("job_id", T.StringType()),
    T.StructField("job_type", T.StringType()),
    T.StructField("source_db", T.StringType()),
    T.StructField("dest_db", T.StringType()),
    T.StructField("azure_db", T.StringType()),
    T.StructField("tables", T.ArrayType(T.StringType())),
    T.StructField("status", T.StringType()),
    T.StructField("register_on_snowflake", T.BooleanType()),
    T.StructField("sf_db", T.StringType()),
    T.StructField("sf_schema", T.StringType()),
    T.StructField("chained_from", T.StringType()),
    T.StructField("csv_path", T.StringType()),
    T.StructField("start_time", T.StringType()),
    T.StructField("end_time", T.StringType()),
]
JOB_SCHEMA = T.StructType(JOB_FIELDS)
JOB_READ_SCHEMA = T.StructType(JOB_FIELDS + [T.StructField("_corrupt_record", T.StringType())])
JOB_COLUMNS = [f.name for f in JOB_FIELDS]


def with_file_columns(df: DataFrame) -> DataFrame:
    """Add ``source_file``, ``file_mtime``, ``stem`` and, where there is a ``job_id``, ``job_key``."""
    out = (
        df.withColumn("source_file", F.col("_metadata.file_path"))
        .withColumn("file_mtime", F.col("_metadata.file_modification_time"))
        .withColumn("stem", F.regexp_replace(file_name(), r"\.[^.]*$", ""))
    )
    return out.withColumn("job_key", F.coalesce("job_id", "stem")) if "job_id" in df.columns else out


def _scan(reader, path, multi_line: bool, glob: str | None, files: list[str] | None = None) -> DataFrame:
    """What a batch or streaming ``reader`` finds: records and rejects of JSON lines, else pieces for ``parse_pieces``.

    ``files`` keeps the scan to these file paths; others are not opened.
    """
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if multi_line:
        raw = reader.option("lineSep", "\n{").text(path).withColumn("_block", F.col("_metadata.file_block_start"))
    else:
        lines = reader.schema(JOB_READ_SCHEMA).option("mode", "PERMISSIVE")
        raw = lines.option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    if files is not None:
        raw = raw.filter(F.col("_metadata.file_path").isin(files))
    return with_file_columns(raw)


def _reduced(skeleton: Column, times: int) -> Column:
    """Brackets without the pairs that hold nothing, taken out ``times`` times from within."""
    for _ in range(times):
        skeleton = F.regexp_replace(skeleton, r"\{\}|\[\]", "")
    return skeleton


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once a row; a plain one would be copied into each expression and filter that names it."""
    return df.withColumn(name, F.explode(F.array(value)))


def _with_shape(df: DataFrame, text: str, depth: int) -> DataFrame:
    """Add ``_skeleton`` (brackets outside strings) and ``_whole``: the text is one object or array, nested up to ``depth`` more levels."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)\\.", ""), '"[^"]*"', "s")
    df = _once(_once(df, "_bare", bare), "_skeleton", F.regexp_replace("_bare", r"[^\[\]{}]+", ""))
    inner = _reduced(F.expr("substring(_skeleton, 2, length(_skeleton) - 2)"), depth)
    # a value with nothing but brackets and blanks around the outer pair, and no string left open
    whole = F.col("_bare").rlike(r"(?s)^\s*(\{[^\"]*\}|\[[^\"]*\])\s*$") & (inner == "") & (F.length("_skeleton") >= 2)
    return _once(df, "_whole", whole).drop("_bare")


#: Levels below the outermost that a record may have: in the quick check, and at all.
QUICK_DEPTH, DEPTH = 4, 32


def parse_pieces(pieces: DataFrame, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Records and rejects of pieces of files (``value``, ``_block`` and the file columns; not a stream).

    A piece reaches from one line start with an opening brace, which the split has
    taken away, to the next. Most are whole objects and are parsed where
    they are. Only what is left, such as text beside a record, a record cut short, or
    one with inner lines that start with a brace, is cut into lines and looked at in file order: a line
    goes on the one before if JSON allows the one after the other (after a colon, an opening bracket or a comma, before a closing one),
    until the brackets are balanced. What then is no whole object or array is a reject.
    A record cut short after a bracket or colon may take lines after it along, but never a whole piece.
    A file that starts with a key or a closing brace reads as if an opening one were before it.
    ``keep`` may write a frame and give it back as read again: the pieces are then read and parsed
    once, whatever is asked of the rows.
    """
    keep = keep or (lambda df: df)
    lead = F.regexp_extract("value", r"^[\s\uFEFF]*(\S)", 1)
    text = F.when(lead.isin('"', "}"), F.concat(F.lit("{"), "value")).otherwise(F.regexp_replace("value", "^\uFEFF", ""))
    parts = pieces.select("source_file", "file_mtime", "stem", "_block", F.monotonically_increasing_id().alias("_at"), text.alias("_text"))
    parts = _with_shape(parts.filter(F.col("_text").rlike(r"\S")), "_text", QUICK_DEPTH)
    of_file = ["source_file", "file_mtime", "stem"]
    parts = keep(_parsed(parts, [*of_file, "_block", "_at"]))
    rest = _with_shape(_joined(parts.filter("NOT _whole"), of_file), "_text", DEPTH)
    return _job_rows(parts.filter("_whole"), of_file).unionByName(_job_rows(keep(_parsed(rest, of_file)), of_file))


def _joined(parts: DataFrame, keep: list[str]) -> DataFrame:
    """(``_text``, file columns) of pieces that are not whole, cut into lines and joined again where a value goes on."""
    cut = parts.withColumn("_cut", F.split("_text", r"\s*\n\s*(?=\S)"))
    cut = cut.select(*keep, "_block", "_at", F.size("_cut").alias("_n"), F.posexplode("_cut").alias("_sub", "_text"))
    cut = _with_shape(cut, "_text", 0)
    brackets = F.length(F.regexp_replace("_skeleton", r"[\]}]", "")) - F.length(F.regexp_replace("_skeleton", r"[\[{]", ""))
    cut = cut.select(
        "*", brackets.alias("_rise"), F.regexp_extract("_text", r"(\S)\s*$", 1).alias("_tail"),
        F.regexp_extract(_reduced(F.col("_skeleton"), DEPTH), r"[\[{]$", 0).alias("_open"),
    )
    in_file = Window.partitionBy("source_file").orderBy("_block", "_at", "_sub")

    def before(c: str) -> Column:
        return F.lag(c).over(in_file)

    next_piece = (before("_sub") == before("_n") - 1) & (F.col("_sub") == 0) & (
        (before("_block") != F.col("_block")) | (before("_at") == F.col("_at") - 1)
    )
    follows = ((before("_at") == F.col("_at")) & (before("_sub") == F.col("_sub") - 1)) | next_piece
    lead = F.regexp_extract("_text", r"^\s*(\S)", 1)
    unfinished = (
        before("_tail").isin("[", ":") | ((before("_tail") == ",") & ((lead == '"') | (before("_open") != "{")))
        | ((before("_tail") == "{") & (lead == '"')) | lead.isin("}", "]", ",", ":")
    )
    cut = cut.withColumn("_goes_on", F.coalesce(follows & unfinished, F.lit(False)))
    cut = cut.withColumn("_run", F.sum(F.when(F.col("_goes_on"), 0).otherwise(1)).over(in_file))
    in_run = Window.partitionBy("source_file", "_run").orderBy("_block", "_at", "_sub")
    cut = cut.withColumn("_level", F.sum("_rise").over(in_run))
    cut = cut.withColumn("_value", F.sum(F.when(F.lag("_level").over(in_run) <= 0, 1).otherwise(0)).over(in_run))
    parts = F.array_sort(F.collect_list(F.struct("_block", "_at", "_sub", "_text")))
    values = cut.groupBy("source_file", "_run", "_value").agg(F.first("file_mtime").alias("file_mtime"), F.first("stem").alias("stem"), parts.alias("_parts"))
    values = values.withColumn("_text", F.array_join(F.col("_parts._text"), "\n"))
    return values.filter(F.col("_text").rlike(r"\S")).select("_text", *keep)


def _parsed(texts: DataFrame, columns: list[str]) -> DataFrame:
    """Texts with ``_jobs``, what they hold; one that is no ``_whole`` stays unparsed, as text after the end of a value would be passed over.

    ``_text`` stays only where a reject may need it.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    whole = F.when(F.col("_whole"), F.col("_text"))
    parsed = _once(texts, "_jobs", F.from_json(whole, T.ArrayType(JOB_READ_SCHEMA), options))
    all_read = (F.size("_jobs") > 0) & ~F.exists("_jobs", lambda job: job.isNull())
    return parsed.select(*columns, "_whole", "_jobs", F.when(F.coalesce(all_read, F.lit(False)), None).otherwise(F.col("_text")).alias("_text"))


def _job_rows(parsed: DataFrame, columns: list[str]) -> DataFrame:
    """Records and rejects of ``_parsed`` texts."""
    rows = parsed.withColumn("_job", F.explode_outer("_jobs"))
    corrupt = F.when(F.col("_job").isNull(), F.col("_text")).otherwise(F.col("_job._corrupt_record"))
    jobs = [F.col(f"_job.{c}").alias(c) for c in JOB_COLUMNS]
    return rows.select(*jobs, corrupt.alias("_corrupt_record"), *columns).withColumn("job_key", F.coalesce("job_id", "stem"))


def without_rows(files: DataFrame, rows: DataFrame) -> DataFrame:
    """A row like those of ``rows``, with an empty ``_corrupt_record``, for each of ``files`` (``source_file``) that has none."""
    none = files.join(rows.select("source_file").distinct(), "source_file", "left_anti").withColumn("stem", stem_of(F.col("source_file")))
    made = {"source_file": F.col("source_file"), "stem": F.col("stem"), "job_key": F.col("stem"), "_corrupt_record": F.lit("")}
    return none.select(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema.fields])


def read_job_records(
    spark: SparkSession,
    path: str | list[str],
    multi_line: bool = True,
    glob: str | None = "*.json",
    files: list[str] | None = None,
    keep: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Scan job records under ``path``; return ``(records, rejects)``.

    ``records`` has the job fields plus ``source_file``, ``file_mtime``,
    ``stem`` and ``job_key`` (= ``job_id``, else the file stem). ``files`` (values of
    ``source_file``) keeps the scan to these; the others are listed, not opened.
    ``keep`` is that of ``parse_pieces``; without it each use of the frames scans anew.
    """
    scan = raw = _scan(spark.read, path if isinstance(path, str) else list(path), multi_line, glob, files)
    if multi_line:
        raw = parse_pieces(raw, keep)
    # The always-true ``keep_scan`` term keeps a data column in the scan:
    # Spark refuses raw JSON scans whose only column is the corrupt-record
    # column, which is what a bare ``count()`` over either frame would
    # otherwise prune to (e.g. after AQE drops an empty join side).
    keep_scan = F.length(F.coalesce(F.col("job_id"), F.lit(""))) >= 0
    raw = raw.filter(keep_scan)
    records = raw.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    listed = listed_files(scan)
    if files is not None:
        listed = listed.filter(F.col("source_file").isin(files))
    rejects = raw.filter(F.col("_corrupt_record").isNotNull()).unionByName(without_rows(listed, raw))
    return records, rejects.select("source_file", "job_id", "_corrupt_record")


def job_record_stream(spark: SparkSession, path: str, multi_line: bool = True, glob: str | None = "*.json", **options):
    """Streaming scan of a job folder; its micro-batches go through ``batch_records``."""
    return _scan(spark.readStream.options(**options), path, multi_line, glob)


def batch_records(
    batch: DataFrame,
    path: str,
    multi_line: bool = True,
    glob: str | None = "*.json",
    keep: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Records and rejects of a micro-batch of ``job_record_stream``, with a row for each file without content.

    A file without any byte is in no batch; those lying in the folder now are added.
    """
    rows = parse_pieces(batch, keep) if multi_line else batch
    reader = batch.sparkSession.read
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    try:
        lying = listed_files(reader.text(path))
    except AnalysisException as exc:  # all files have been moved away
        if not (exc.getCondition() or "").startswith("PATH_NOT_FOUND"):
            raise
        lying = batch.select("source_file").limit(0)
    lying = lying.join(file_states(batch.sparkSession, path, glob), "source_file", "left_anti")
    seen = batch.select("source_file").distinct()
    return rows.unionByName(without_rows(lying.unionByName(seen).distinct(), rows))


def write_job_records(df: DataFrame, path: str, mode: str = "append") -> None:
    """Append job records as JSON lines (null fields omitted, like absent keys)."""
    df.select(*[c for c in JOB_COLUMNS if c in df.columns]).write.mode(mode).json(path)

"""Copy verification: row count plus an order-insensitive content hash.

The fingerprint of a table is ``(count(*), sum(xxhash64(row)))`` with the
sum taken as ``decimal(38,0)`` so it cannot overflow under ANSI mode. It is
a plain aggregate: partial sums per task, one tiny shuffle, no sort, so it
costs one scan at any size. Columns are hashed in name order, which makes
the hash insensitive to column order (a copy may move partition columns to
the end). ``xxhash64`` skips nulls, does not mark where an array ends and
rejects maps, so null marks of columns, fields and elements and the sizes of
arrays are hashed along with the values, and maps as their sorted entries, at any depth.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.identifiers import quote_name


_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _widened(t: T.DataType) -> T.DataType:
    """``t`` with every number and timestamp inside it in its widest form."""
    if isinstance(t, _INTEGERS):
        return T.LongType()
    if isinstance(t, T.FloatType):
        return T.DoubleType()
    if isinstance(t, T.TimestampType):
        return T.TimestampNTZType()
    if isinstance(t, T.ArrayType):
        return T.ArrayType(_widened(t.elementType))
    if isinstance(t, T.MapType):
        return T.MapType(_widened(t.keyType), _widened(t.valueType))
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, _widened(f.dataType)) for f in t.fields])
    return t


#: Null marks of so many columns or fields share a number.
MARKS = 60


def _null_marks(columns: Sequence[Column]) -> list[Column]:
    """Which of ``columns`` are null, as numbers with a bit for each."""
    marks = []
    for start in range(0, len(columns), MARKS):
        mark = F.lit(0).cast("long")
        for k, c in enumerate(columns[start : start + MARKS]):
            mark = mark + F.when(c.isNull(), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long"))
        marks.append(mark)
    return marks


def _is_nested(t: T.DataType) -> bool:
    return isinstance(t, (T.ArrayType, T.MapType, T.StructType))


def _marked(c: Column, t: T.DataType) -> Column:
    """A nested value in a form of which ``xxhash64`` leaves nothing out; null if it is null itself.

    A struct gets the null marks of its fields before them, an array its size
    and the null marks of its elements, a map becomes the array of its entries in order.
    """
    if isinstance(t, T.StructType):
        fields = [c.getField(f.name) for f in t.fields]
        marks = [m.alias(f"_null{k}") for k, m in enumerate(_null_marks(fields))]
        inner = [_marked(v, f.dataType).alias(f"_{k}") for k, (v, f) in enumerate(zip(fields, t.fields))]
        return F.when(c.isNotNull(), F.struct(F.lit(len(fields)).alias("_fields"), *marks, *inner))
    if isinstance(t, T.ArrayType):
        values = F.transform(c, lambda x: _marked(x, t.elementType)) if _is_nested(t.elementType) else c
        nulls = F.transform(c, lambda x: x.isNull())
        return F.when(c.isNotNull(), F.struct(F.size(c).alias("_size"), nulls.alias("_nulls"), values.alias("_values")))
    if isinstance(t, T.MapType):

        def entry(e: Column) -> Column:
            key, value = e["key"], e["value"]
            return F.struct(
                _marked(key, t.keyType).alias("key"), value.isNull().alias("null"), _marked(value, t.valueType).alias("value")
            )

        entries = F.array_sort(F.transform(F.map_entries(c), entry))
        return F.when(c.isNotNull(), F.struct(F.size(c).alias("_size"), entries.alias("_values")))
    return c


def _hashable(field: T.StructField) -> Column:
    """A column in a form that survives the type changes a target may make.

    Catalogs may widen integers (byte/short -> int), floats, or return a
    ``timestamp_ntz`` as ``timestamp``; hashing integers as ``bigint``,
    floats as ``double`` and both timestamp kinds as wall-clock microseconds
    keeps the fingerprint equal for equal values. Nested values are cast as a
    whole.
    """
    c = F.col(quote_name([field.name]))
    t = field.dataType
    if _is_nested(t):
        wide = _widened(t)
        return _marked(c if wide == t else c.cast(wide), wide)
    if isinstance(t, _INTEGERS):
        return c.cast("long")
    if isinstance(t, T.FloatType):
        return c.cast("double")
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        # wall-clock microseconds (session zone for TIMESTAMP): integer math,
        # no per-row text formatting
        ntz = c if isinstance(t, T.TimestampNTZType) else c.cast("timestamp_ntz")
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ntz)
    return c


def row_hash(df: DataFrame) -> Column:
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    marks = _null_marks([F.col(quote_name([f.name])) for f in fields])
    return F.xxhash64(*marks, *[_hashable(f) for f in fields])


def fingerprint_columns(df: DataFrame) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(row_hash(df).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("hash_sum"),
    ]


def fingerprint(df: DataFrame) -> DataFrame:
    """One row ``(rows, hash_sum)`` for the whole DataFrame."""
    return df.agg(*fingerprint_columns(df))


def observed_fingerprint(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Attach the fingerprint as an observation filled by the write itself."""
    obs = Observation(name)
    return df.observe(obs, *fingerprint_columns(df)), obs


def compare(source: DataFrame, target: DataFrame) -> dict:
    """Fingerprint both sides (two single-row aggregates) and compare."""
    s = fingerprint(source).first()
    t = fingerprint(target).first()
    return {
        "source_rows": s["rows"],
        "target_rows": t["rows"],
        "source_hash": s["hash_sum"],
        "target_hash": t["hash_sum"],
        "matched": s["rows"] == t["rows"] and s["hash_sum"] == t["hash_sum"],
    }


def reconcile_tables(
    spark: SparkSession,
    source_namespace: str,
    target_namespace: str,
    tables: Sequence[str],
) -> DataFrame:
    """Compare existing copies: ``(table, source_rows, target_rows, matched)``.

    All fingerprints are single-row aggregates unioned into one frame, so
    the tables are scanned in one Spark job (each scan partially
    aggregated, nothing but one row per side shuffled). A table missing on
    either side yields ``matched = false`` with null counts for that side.
    """
    from ..functions.identifiers import split_name

    def side(ns: str, t: str, label: str) -> DataFrame | None:
        name = quote_name(split_name(ns) + [t])
        if not spark.catalog.tableExists(name):
            return None
        return fingerprint(spark.read.table(name)).select(
            F.lit(t).alias("table"), F.lit(label).alias("side"), "rows", "hash_sum"
        )

    parts = [p for t in dict.fromkeys(tables) for p in (side(source_namespace, t, "source"),
                                                         side(target_namespace, t, "target")) if p is not None]
    names = spark.createDataFrame([(t,) for t in dict.fromkeys(tables)], "table string")
    if not parts:
        return names.select("table", F.lit(None).cast("long").alias("source_rows"),
                            F.lit(None).cast("long").alias("target_rows"), F.lit(False).alias("matched"))
    fp = parts[0]
    for p in parts[1:]:
        fp = fp.unionByName(p)
    wide = fp.groupBy("table").pivot("side", ["source", "target"]).agg(
        F.first("rows").alias("rows"), F.first("hash_sum").alias("hash")
    )
    out = names.join(wide, "table", "left")
    return out.select(
        "table",
        F.col("source_rows").alias("source_rows"),
        F.col("target_rows").alias("target_rows"),
        F.coalesce(
            (F.col("source_rows") == F.col("target_rows")) & (F.col("source_hash") == F.col("target_hash")),
            F.lit(False),
        ).alias("matched"),
    )

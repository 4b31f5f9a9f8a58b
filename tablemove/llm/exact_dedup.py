"""Exact dedup by an extendible-hash index on shared files; DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemove.llm.common import join_small, key_partitions, materialise

#: Entries that a bucket holds before it is split, and the most bits that the directory uses.
CAPACITY, MOST_BITS = 4096, 20
#: Hashes have so many bits and are never negative.
HASH_BITS = 63
#: What normalising deletes.
BLANKS = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """The text without ASCII blanks; null counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), BLANKS, "")


def text_hash(norm: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(norm), 64 - HASH_BITS)


def directory(spark: SparkSession, hashes: DataFrame, capacity: int = CAPACITY, most_bits: int = MOST_BITS) -> DataFrame:
    """(top, depth, bucket) for every occupied slot of a directory of ``most_bits`` bits over the column ``h``.

    Starts as one bucket of depth 0. As long as a bucket holds more than
    ``capacity`` hashes the directory doubles, that is, addresses get a bit more,
    and overfull buckets are split in two; the others keep their depth and
    are shared by the slots that agree on so many bits. Buckets that are
    overfull at ``most_bits`` stay: their entries chain. ``bucket`` is the first slot
    that the bucket serves. Hashes are counted once, map-side, by slot; a round
    works on those counts, and one number a round reaches the driver.
    """
    slot = F.shiftright("h", HASH_BITS - most_bits).alias("top")
    state = hashes.groupBy(slot).agg(F.count(F.lit(1)).alias("n")).withColumn("depth", F.lit(0)).withColumn("bucket", F.lit(0).cast("long"))
    state = materialise(spark, state, "exact-slots")
    for bits in range(most_bits):
        over = state.where(F.col("depth") == bits).groupBy("bucket").agg(F.sum("n").alias("held")).where(F.col("held") > capacity)
        over = materialise(spark, over.select(F.col("bucket").alias("_b")), "exact-overfull")
        if over.isEmpty():
            break
        split = join_small(state.withColumn("_b", F.col("bucket")), over.withColumn("_hit", F.lit(True)), ["_b"])
        hit = F.coalesce("_hit", F.lit(False)) & (F.col("depth") == bits)
        rest = most_bits - bits - 1
        half = F.shiftleft(F.shiftright("top", rest), rest)
        state = materialise(
            spark,
            split.select("top", "n", F.when(hit, F.lit(bits + 1)).otherwise(F.col("depth")).alias("depth"), F.when(hit, half).otherwise(F.col("bucket")).alias("bucket")),
            "exact-slots",
        )
    return state.select("top", "depth", "bucket")


def build_index(
    spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, hash_of: Callable[[Column], Column] = text_hash
) -> DataFrame:
    """The index on shared files: one entry per distinct normalised text.

    Columns ``h``, ``norm``, ``keep_id``, ``group_size``, and ``top``. The aggregation that makes the entries
    compares the texts byte by byte and combines copies map-side: a text with very many
    copies reaches one owner as one row per task. Owner tasks then each take a
    range of hashes, sort it and write it, so that a bucket is a run of one
    owner's file, which readers find by the file's own minima and maxima.
    """
    words = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (-F.char_length(words)).alias("less"), normalised(F.col(text)).alias("norm"))
    rank = F.struct("less", F.col("id").isNull().alias("none"), "id")
    entries = rows.groupBy("norm").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("group_size"))
    entries = entries.select(hash_of(F.col("norm")).alias("h"), "norm", F.col("first.id").alias("keep_id"), F.col("first.less").alias("less"), "group_size")
    owned = entries.repartitionByRange(key_partitions(spark), "h").sortWithinPartitions("h")
    return materialise(spark, owned, "exact-index")


def exact_duplicates(
    spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, hash_of: Callable[[Column], Column] = text_hash
) -> DataFrame:
    """One row per document: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``, ``bucket``, ``depth``.

    Texts are equal when identical without ASCII blanks; a null text counts as
    empty. Of equal texts the row with the most code points stays, then the
    smallest id (null ids last). Repeated rows tie: those that equal the row that stays, id and
    code points alike, are all marked ``kept``. An empty table gives no rows; other columns are not read.

    A document finds its entry by hash. Where entries of different texts chain
    at one hash, the texts decide; only such documents carry theirs to the
    index. The join is a plain one, whose large partitions (the documents of one
    text) adaptive execution splits.
    """
    index = build_index(spark, docs, id_col=id_col, text=text, capacity=capacity, hash_of=hash_of)
    slots = directory(spark, index.select("h"), capacity)
    chains = materialise(spark, index.groupBy("h").agg(F.count(F.lit(1)).alias("chained")).where("chained > 1"), "exact-chains")
    entries = index.select("h", "norm", "keep_id", F.col("less").alias("keep_less"), "group_size", F.shiftright("h", HASH_BITS - MOST_BITS).alias("top"))
    entries = join_small(entries, slots, ["top"]).drop("top")
    words = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (-F.char_length(words)).alias("less"), normalised(F.col(text)).alias("norm"))
    rows = rows.withColumn("text_sha256", F.sha2("norm", 256)).withColumn("h", hash_of(F.col("norm")))
    if chains.isEmpty():
        found = rows.drop("norm").join(entries.drop("norm"), "h")
    else:
        chained = chains.select("h")
        alone = rows.drop("norm").join(join_small(entries, chained, ["h"], "left_anti").drop("norm"), "h")
        both = join_small(rows, chained, ["h"], "left_semi").join(join_small(entries, chained, ["h"], "left_semi"), ["h", "norm"])
        found = alone.unionByName(both.select(*alone.columns))
    stays = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("less") == F.col("keep_less"))
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", stays.alias("kept"), "text_sha256", "bucket", "depth")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
r AS (SELECT *, first_value(doc_id) OVER w AS keep_id, first_value(points) OVER w AS keep_points, count(*) OVER (PARTITION BY norm) AS group_size
  FROM d WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AND points = keep_points AS kept, sha256(norm) AS text_sha256 FROM r
"""

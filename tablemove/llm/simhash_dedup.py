"""SimHash near-dedup with a covering family of bit masks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemove.llm.common import in_blocks, local_roots, materialise, small_batches, whole_groups
from tablemove.llm.components import connected_components

SEED = 42
#: Groups of up to so many members are compared all at once by shifted columns, larger ones row block by row block.
SMALL_GROUP = 32
BLOCK_ROWS = 2048


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Unsigned 64-bit SimHash of a whole text.

    A-Z are lowered, words are runs outside ``[\\x20\\x09-\\x0D]``, features are
    all runs of ``shingle`` words joined by a space (fewer words: all of them;
    none: the fingerprint is zero). A bit is 1 if it is set in over half of the
    features' XXH64 values.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII rules only
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size).tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(ends), 65536):
        some = [digest(joined[a:b], SEED) for a, b in zip(starts[at : at + 65536], ends[at : at + 65536])]
        counts += np.unpackbits(np.array(some, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(ends)).tobytes(), "big")


def masks(distance: int) -> list[int]:
    """Bit masks of which every pair within ``distance`` agrees on at least one.

    Bit i has the nonzero vector phi(i) of ``distance + 1`` bits; mask v, for
    each nonzero v, holds the bits with odd <phi(i), v>. At most ``distance``
    differing bits span at most ``distance`` dimensions, so some nonzero v is
    orthogonal to all of them, and its mask holds none of them.
    """
    whole = (1 << (distance + 1)) - 1
    return [sum(1 << i for i in range(64) if bin((i % whole + 1) & v).count("1") & 1) for v in range(1, whole + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(spark: SparkSession, docs: DataFrame, *, text: str = "text", shingle: int = 4) -> DataFrame:
    """``docs`` with a long column ``fp``: the bits of the fingerprint, signed."""
    small_batches(spark)

    @F.pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series([_signed(fingerprint(x, shingle)) for x in s], dtype="int64")

    return docs.withColumn("fp", of(F.col(text).cast("string")))


def near_links(spark: SparkSession, fps: DataFrame, distance: int = 4, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Edges (u, v) that connect distinct fingerprints ``fp`` of at most ``distance`` differing bits.

    Every pair within the distance shares a bucket of some mask and is compared
    there. What leaves a group is one edge from each linked member to the
    smallest member that it reaches there, not every pair: the components are
    the same, and rows stay in proportion to members.
    """
    table = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks(distance)])).alias("mask", "key")
    rows = fps.select("fp", table).select(F.col("mask").cast("short").alias("mask"), "key", "fp")
    dealt = in_blocks(spark, rows, ["mask", "key"], "fp", block_rows, "simhash")
    keys = ["mask", "key", "bi", "bj"]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, starts in whole_groups(batches, keys):
            i, j = linked_pairs(frame["fp"].to_numpy().view(np.uint64), frame["own"].to_numpy(), starts, distance)
            if len(i):
                fp = frame["fp"].to_numpy()
                _, at = np.unique(fp, return_inverse=True)
                values = np.sort(np.unique(fp))
                root = local_roots(len(values), at[i], at[j])
                own = np.flatnonzero(root != np.arange(len(values)))
                yield pd.DataFrame({"u": values[own], "v": values[root[own]]})

    return dealt.select(*keys, "own", "fp").mapInPandas(compare, "u long, v long")


def linked_pairs(fp: np.ndarray, own: np.ndarray, starts: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of the same group within the distance; of two blocks, only pairs across them."""
    size = np.diff(starts)
    group = np.repeat(np.arange(len(size)), size)
    two = np.zeros(len(size), dtype=bool)
    if len(size):
        two = np.maximum.reduceat(own, starts[:-1]) != np.minimum.reduceat(own, starts[:-1])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for d in range(1, min(SMALL_GROUP, int(size.max(initial=1)))):
        i = np.flatnonzero((group[d:] == group[:-d]) & (size[group[d:]] <= SMALL_GROUP))
        if not len(i):
            break
        i = i[(np.bitwise_count(fp[i] ^ fp[i + d]) <= distance) & (~two[group[i]] | (own[i] != own[i + d]))]
        found.append((i, i + d))
    for g in np.flatnonzero(size > SMALL_GROUP):
        at = np.arange(starts[g], starts[g + 1])
        first = own[at] == own[at].min()
        a, b = (at[first], at[~first]) if two[g] else (at, at)
        for k in range(0, len(a), 256):
            x, y = np.nonzero(np.bitwise_count(fp[a[k : k + 256], None] ^ fp[None, b]) <= distance)
            x, y = a[k + x], b[y]
            found.append((x[x != y], y[x != y]))
    if not found:
        return np.empty(0, int), np.empty(0, int)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def near_duplicates(
    spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", shingle: int = 4, distance: int = 4
) -> DataFrame:
    """One row per document: id, ``fp``, ``fingerprint`` (16 hex digits), ``component_id``, ``kept``, ``text_hash``.

    Equal fingerprints link; so do those of at most ``distance`` differing
    bits. ``component_id`` is the smallest id reachable; ``kept`` marks the row
    with that id (of several, that with the smallest XXH64 of the text). A null
    text counts as empty, and texts without words all have fingerprint zero.
    Repeated rows come out as often as they came in and are kept alike. Null
    ids come last: only a component without any other id has the
    ``component_id`` null. An empty table gives no rows. Other columns of
    ``docs`` are not read.
    """
    got = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("t"))
    got = fingerprints(spark, got.withColumn("text_hash", _text_hash("t")), text="t", shingle=shingle)
    got = materialise(spark, got.select("id", "text_hash", "fp"), "simhash-fp")
    order = F.struct(F.col("id").isNull().alias("null"), "id", "text_hash")
    classes = materialise(spark, got.groupBy("fp").agg(F.min(order).alias("first")), "simhash-class")
    roots = connected_components(spark, near_links(spark, classes.select("fp"), distance), "simhash-cc")
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    rooted = materialise(spark, rooted.withColumn("root", F.coalesce("root", "fp")), "simhash-root")
    firsts = rooted.groupBy("root").agg(F.min("first").alias("stays"))
    named = materialise(spark, rooted.join(firsts, "root").select("fp", "stays"), "simhash-named")
    return got.join(named, "fp").select(
        F.col("id").alias(id_col),
        "fp",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("stays.id").alias("component_id"),
        (F.col("id").eqNullSafe(F.col("stays.id")) & (F.col("text_hash") == F.col("stays.text_hash"))).alias("kept"),
        "text_hash",
    )


def _text_hash(column: str):
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))


def keep_one(
    spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", shingle: int = 4, distance: int = 4
) -> DataFrame:
    """``docs``, all its columns, with one document of each component of near copies (see :func:`near_duplicates`)."""
    near = near_duplicates(spark, docs, id_col=id_col, text=text, shingle=shingle, distance=distance)
    gone = near.where(~F.col("kept")).select(F.col(id_col).alias("_gone"), F.col("text_hash").alias("_hash")).distinct()
    gone = materialise(spark, gone, "simhash-gone")
    same = docs[id_col].eqNullSafe(gone["_gone"]) & (F.xxhash64(F.coalesce(docs[text].cast("string"), F.lit(""))) == gone["_hash"])
    return docs.join(gone, same, "left_anti")

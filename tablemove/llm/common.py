"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemove.session import ensure_checkpoint_dir, scratch_path

#: Bytes that one Arrow batch to a Python worker may hold (more only for a single larger row).
ARROW_BYTES = 4_000_000
#: A table is broadcast only if a count finds at most so many rows of a few numbers each (about 16 MB).
BROADCAST_ROWS = 500_000


def materialise(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back.

    Cuts lineage: a lost executor costs the tasks that ran on it, never the
    jobs before. Unlike a cache, the copy does not live on executors.
    """
    ensure_checkpoint_dir(spark)
    path = scratch_path(spark, "llm", tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch, so that long texts fit in a worker's memory.

    The setting stays on the session, because frames run after the operator
    has returned. A smaller value that a user has set is kept.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("b")
    if not now.isdigit() or int(now) > ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join with a written table that is broadcast only if counted to be small.

    Beyond the bound Spark's shuffle join gives the same rows, and adaptive
    execution splits its skewed partitions.
    """
    rows = small.limit(BROADCAST_ROWS + 1).count()
    return big.join(F.broadcast(small) if rows <= BROADCAST_ROWS else small, on, how)


def key_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_blocks(spark: SparkSession, rows: DataFrame, keys: list[str], member: str, block_rows: int, tag: str) -> DataFrame:
    """Deal ``rows`` out so that members of one bucket can be compared.

    Adds ``bi`` and ``bj``, partitions by ``keys, bi, bj`` and sorts. A bucket
    of up to ``block_rows`` members is one group, (0, 0). A larger one is cut
    into blocks by a hash of ``member``; each block meets each other block, and
    itself, in a group of its own, so that no task ever holds more than two
    blocks and no pair of members is left out. ``own`` is the row's own block.
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block_rows)
    sizes = materialise(spark, sizes.withColumn("_g", F.ceil(F.col("_n") / block_rows).cast("int")).drop("_n"), f"{tag}-hot")
    dealt = (
        join_small(rows, sizes, keys)
        .withColumn("_g", F.coalesce("_g", F.lit(1)))
        .withColumn("own", F.pmod(F.xxhash64(member), F.col("_g")).cast("int"))
        .withColumn("_o", F.explode(F.expr("sequence(0, _g - 1)")))
        .withColumn("bi", F.least("own", "_o"))
        .withColumn("bj", F.greatest("own", "_o"))
        .drop("_o", "_g")
    )
    order = [*keys, "bi", "bj"]
    return dealt.repartition(key_partitions(spark), *order).sortWithinPartitions(*order)


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Re-cut batches of a sorted partition at group borders.

    Yields frames that hold whole groups, with the row at which each group
    starts (and the number of rows at the end). Only the group at the border
    is carried over.
    """
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        if (held[0][keys].iloc[0] == batch[keys].iloc[-1]).all():
            continue
        frame = pd.concat(held, ignore_index=True)
        starts = _starts(frame, keys)
        yield frame.iloc[: starts[-2]], starts[:-1]
        held = [frame.iloc[starts[-2] :]]
    if held:
        frame = pd.concat(held, ignore_index=True)
        yield frame, _starts(frame, keys)


def _starts(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    new = np.zeros(len(frame), dtype=bool)
    new[0] = True
    for k in keys:
        v = frame[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), len(frame))


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index that each of ``n`` items reaches over the links ``i[k] - j[k]``."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new

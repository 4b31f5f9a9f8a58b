"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemove.llm.common import materialise


def connected_components(spark: SparkSession, edges: DataFrame, tag: str = "cc") -> DataFrame:
    """(node, root) for every node of ``edges`` (``u``, ``v``, longs); root is the smallest node reachable.

    Large star: a node hands its larger neighbours to its smallest one. Small
    star: it hands its smaller neighbours, and itself, to the smallest. Both
    alternate until no edge changes, which takes a number of rounds that grows
    with the logarithm of the longest path. Minima are combined map-side; the
    joins are plain equi-joins, whose partitions adaptive execution splits where
    one node has very many edges. Each round is written to the shared folder,
    so that a lost executor never costs more than the round that runs. Nothing
    but two numbers a round reaches the driver. Null ends and loops are ignored;
    no edges give no rows.
    """
    now = materialise(
        spark,
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        tag,
    )
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(
                F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
            ).alias("e")
        )
        now = materialise(spark, small.select("e.u", "e.v").where("u <> v").distinct(), tag)
        before, state = state, _state(now)
        if state == before:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
    ).first()
    return row.n, int(row.h or 0)

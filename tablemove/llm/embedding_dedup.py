"""Embedding near-dedup: random hyperplanes, exact cosine, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemove.llm.common import in_blocks, local_roots, materialise, whole_groups
from tablemove.llm.components import connected_components

#: Hyperplanes per table at least, distinct vectors per bucket aimed at, and share of the pairs at the threshold itself that collide in a table.
BITS, PER_BUCKET, RECALL = 14, 64, 0.9977
BLOCK_ROWS = 2048


def table_plan(rows: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """``(tables, bits)`` for so many vectors: bits grow with the logarithm of the rows, so that buckets don't grow, and tables keep the recall.

    Two vectors at the threshold agree on a hyperplane's side with a probability set by their angle (0.9 at cosine 0.95), on all
    bits of a table with its power. At 0.95 that makes 24 tables of 14 bits up to a million vectors, 54 of 21 at 134 million.
    """
    bits = max(BITS, math.ceil(math.log2(max(1, rows) / PER_BUCKET)))
    same = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    if same < 0.004:
        raise ValueError(f"threshold {threshold} would take over 1,500 tables; give tables and bits")
    return (1 if same == 1 else math.ceil(math.log(1 - recall) / math.log(1 - same))), bits


def hyperplanes(dim: int, tables: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, tables * bits))


def signatures(vectors: np.ndarray, tables: int, bits: int, seed: int) -> np.ndarray:
    """Row by row, ``tables`` numbers of ``bits`` sign bits each."""
    side = (vectors @ hyperplanes(vectors.shape[1], tables, bits, seed)) >= 0
    return side.reshape(len(vectors), tables, bits) @ (1 << np.arange(bits))


def near_duplicates(
    spark: SparkSession, vectors: DataFrame, *, id_col: str = "vec_id", vector: str = "embedding",
    threshold: float = 0.95, tables: int | None = None, bits: int | None = None, seed: int = 7, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per vector: id, ``n_links``, ``component_id``, ``kept``.

    Vectors that share a signature in some table (``tables`` of ``bits`` hyperplanes, by :func:`table_plan` from
    the number of rows unless given) are compared by cosine in
    double precision and link at ``threshold`` or more. Equal vectors form one
    class first and always link. ``n_links`` counts the other rows that a row
    links with, each once: a pair counts only in the first table in which it
    collides. ``component_id`` is the smallest id reachable. A vector that is
    null, empty, zero or holds a null or a component that is not finite, or
    whose id is null, links with nothing and is its own component; so do
    vectors of different lengths among each other. Repeated rows, and rows that share an id, are vectors of
    their own. An empty table gives no rows; other columns are not read.
    """
    if tables is None or bits is None:
        planned = table_plan(vectors.count(), threshold)
        tables, bits = tables or planned[0], bits or planned[1]
    kind = vectors.schema[vector].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    form = np.dtype("<f4" if single else "<f8")  # holds each component as it is

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            vecs = [None if v is None else np.array([np.nan if x is None else x for x in v], dtype=np.float64) for v in frame["v"]]
            good = np.array([v is not None and len(v) > 0 and np.isfinite(v).all() and v.any() for v in vecs], dtype=bool)
            good &= frame["id"].notna().to_numpy()
            out_v, out_s = [None] * len(frame), [None] * len(frame)
            dims = np.array([len(v) if ok else 0 for v, ok in zip(vecs, good)], dtype=int)
            for dim in np.unique(dims[good]):
                at = np.flatnonzero(good & (dims == dim))
                part = np.stack([vecs[k] for k in at]) + 0.0  # -0.0 becomes 0.0, so that equal vectors have equal bytes
                unit = part / np.abs(part).max(1, keepdims=True)
                got = signatures(unit, tables, bits, seed)
                for k, v, s in zip(at, part, got):
                    out_v[k], out_s[k] = v.astype(form).tobytes(), s.astype(np.int32).tolist()
            yield pd.DataFrame({"id": frame["id"], "vec": out_v, "sigs": out_s})

    id_kind = vectors.schema[id_col].dataType.simpleString()
    picked = vectors.select(F.col(id_col).alias("id"), F.col(vector).alias("v"))
    signed = materialise(spark, picked.mapInPandas(sign, f"id {id_kind}, vec binary, sigs array<int>"), "emb-sign")
    classes = signed.where("vec is not null").groupBy("vec").agg(
        F.min("sigs").alias("sigs"), F.min("id").cast("long").alias("low"), F.count(F.lit(1)).alias("m")
    )
    classes = materialise(spark, classes.withColumn("node", F.monotonically_increasing_id()), "emb-class")
    width = F.length("vec").cast("int").alias("width")
    rows = classes.select(F.posexplode("sigs").alias("tab", "sig"), width, "node", "m", "vec", "sigs")
    keys = ["tab", "sig", "width", "bi", "bj"]
    dealt = in_blocks(spark, rows, keys[:3], "node", block_rows, "emb").select(*keys, "own", "node", "m", "vec", "sigs")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, starts in whole_groups(batches, keys):
            nodes, weight, own = (frame[c].to_numpy() for c in ("node", "m", "own"))
            vecs, sigs, tabs = frame["vec"].tolist(), frame["sigs"].tolist(), frame["tab"].to_numpy()
            for a, b in zip(starts[:-1], starts[1:]):
                if b - a < 2:
                    continue
                unit = np.frombuffer(b"".join(vecs[a:b]), dtype=form).astype(np.float64).reshape(b - a, -1)
                unit = unit / np.abs(unit).max(1, keepdims=True)
                unit = unit / np.sqrt((unit * unit).sum(1, keepdims=True))
                i, j = _pairs(unit, np.array(sigs[a:b])[:, : tabs[a]], own[a:b], threshold)
                if len(i):
                    links = np.zeros(b - a, dtype=np.int64)
                    np.add.at(links, i, weight[a:b][j])
                    np.add.at(links, j, weight[a:b][i])
                    order = np.argsort(nodes[a:b], kind="stable")  # so that the smallest index is the smallest node
                    rank = np.empty_like(order)
                    rank[order] = np.arange(b - a)
                    root = local_roots(b - a, rank[i], rank[j])
                    at = np.flatnonzero(links)
                    ids = nodes[a:b]
                    yield pd.DataFrame({"u": ids[at], "links": links[at], "v": ids[order[root[rank[at]]]]})

    found = materialise(spark, dealt.mapInPandas(compare, "u long, links long, v long"), "emb-links")
    roots = connected_components(spark, found.select("u", "v"), "emb-cc")
    links = found.groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    lows = roots.join(classes.select("node", "low"), "node").groupBy("root").agg(F.min("low").alias("least"))
    roots = materialise(spark, roots.join(lows, "root").select("node", "least"), "emb-least")
    named = classes.join(links, "node", "left").join(roots, "node", "left").select(
        "vec", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least", "low").alias("component_id")
    )
    named = materialise(spark, named, "emb-named")
    return signed.join(named, "vec", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", F.col("id").cast("long")).alias("component_id"),
        (F.col("id") == F.coalesce("component_id", F.col("id").cast("long"))).alias("kept"),
    )


def _pairs(unit: np.ndarray, earlier: np.ndarray, own: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs at the threshold or above that share no earlier table's signature; of two blocks, only pairs across them."""
    n, low = len(unit), own.min()
    two = low != own.max()
    a = np.flatnonzero(own == low) if two else np.arange(n)
    b = np.flatnonzero(own != low) if two else a
    out_i, out_j = [], []
    for k in range(0, len(a), 512):
        x, y = np.nonzero(unit[a[k : k + 512]] @ unit[b].T >= threshold)
        x, y = a[k + x], b[y]
        if not two:
            x, y = x[x < y], y[x < y]
        if earlier.shape[1] and len(x):
            new = np.concatenate([~(earlier[x[c : c + 65536]] == earlier[y[c : c + 65536]]).any(1) for c in range(0, len(x), 65536)])
            # links that an earlier table has counted still hold the component together there
            x, y = x[new], y[new]
        out_i.append(x)
        out_j.append(y)
    return np.concatenate(out_i), np.concatenate(out_j)


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS MATERIALIZED (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
link AS MATERIALIZED (
  SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) >= 0.95),
reach(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x),
comp AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT c.vec_id, (SELECT count(*) FROM link WHERE link.x = c.vec_id) AS n_links, component_id, c.vec_id = component_id AS kept FROM comp c
"""

"""Vector code compression: a codebook per part position, learnt by ball k-means on whole numbers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemove.llm.common import BROADCAST_ROWS, materialise, small_batches

#: Steps of a component's scale, parts of a vector, entries of a codebook (two hex digits hold 256), rounds.
SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Components of more than this, after scaling, are refused: squared distances of 2,048 of them still fit in 64 bits.
LARGEST = 1 << 25


def first_assignment(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each part (lowest index on ties) and its squared distance, by comparing all of them."""
    cross = parts @ book.T
    dist = (parts * parts).sum(1)[:, None] - 2 * cross + (book * book).sum(1)
    own = dist.argmin(1)
    return own, dist[np.arange(len(parts)), own]


def ball_assignment(parts: np.ndarray, own: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``first_assignment``, from the entries ``own`` to which the parts belonged before ``book`` moved.

    An entry and its parts form a ball, whose radius is the distance to its
    farthest part. Only entries within twice the radius are its neighbours: any other is
    farther from every part of the ball than the ball's own entry. Parts nearer to their entry than half the
    way to the nearest neighbour are the stable core and stay without a comparison. The neighbours, by distance,
    cut the rest into rings: a part compares itself only with those within twice its own
    distance, the k nearest ones in the k-th ring. Bounds are inclusive and all numbers whole, so ties are
    found and go to the lower index.
    """
    between = ((book[:, None] - book[None]) ** 2).sum(2)
    order = between.argsort(1, kind="stable")
    ordered = np.take_along_axis(between, order, 1)
    dist = ((parts - book[own]) ** 2).sum(1)
    by_ball = own.argsort(kind="stable")
    ball_starts = np.searchsorted(own[by_ball], np.arange(len(book) + 1))
    ring = np.zeros(len(parts), dtype=np.int64)
    for e in range(len(book)):
        members = by_ball[ball_starts[e] : ball_starts[e + 1]]
        if len(members):
            radius = dist[members].max()
            neighbours = ordered[e, : np.searchsorted(ordered[e], 4 * radius, side="right")]  # itself among them
            ring[members] = np.searchsorted(neighbours, 4 * dist[members], side="right")
    moving = np.flatnonzero(ring > 1)
    moving = moving[(-ring[moving]).argsort(kind="stable")]
    rings = -ring[moving]
    at, balls = parts[moving], own[moving]
    best, entry = dist[moving].copy(), balls.copy()
    for k in range(int(-rings[0]) if len(rings) else 0):
        m = int(np.searchsorted(rings, -k, side="left"))  # parts whose ring reaches the k-th neighbour
        other = order[balls[:m], k]
        d = ((at[:m] - book[other]) ** 2).sum(1)
        nearer = (d < best[:m]) | ((d == best[:m]) & (other < entry[:m]))
        best[:m][nearer], entry[:m][nearer] = d[nearer], other[nearer]
    own, dist = own.copy(), dist.copy()
    own[moving], dist[moving] = entry, best
    return own, dist


def compress(
    spark: SparkSession, vectors: DataFrame, *, id_col: str = "vec_id", vector: str = "embedding", label: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> DataFrame:
    """One row per kept vector: id, ``code``, ``error``, ``label_error``, ``codebooks_sha256``.

    Vectors that are null or empty, or hold null or non-finite components, are
    dropped. Components become floor(scale * x); vectors are cut into ``parts``
    equal parts. Codebooks start as the parts of the ``entries`` smallest ids (null ids last, equal
    ids by their components; with fewer vectors, fewer entries). A round assigns each part to its nearest entry, ties to
    the lower index, and replaces entries by the floor of their parts' means; entries without parts
    stay. After the last round parts are assigned once more. ``code`` is two hex digits a part, ``error`` the sum of
    its squared distances, ``label_error`` that over all vectors of the label, null labels together, and ``codebooks_sha256``
    the digest of all entries. Repeated rows are vectors of their own. An empty table gives no rows; other columns are not read.
    Vectors of different lengths, a length that ``parts`` does not divide, and components beyond
    ``LARGEST`` raise ValueError.

    The driver holds the codebooks only, ``parts * entries`` short rows.
    Vectors are assigned in Arrow batches. A ball's radius is taken over its parts in the batch: no larger than
    that over all, so the neighbours are fewer and the result the same. Sums
    combine per batch, then map-side. Each assignment is written, so that a lost executor costs
    its running tasks only.
    """
    if not 0 < entries <= 256:
        raise ValueError("two hex digits hold at most 256 entries")
    small_batches(spark)
    kind, label_kind = (vectors.schema[c].dataType.simpleString() for c in (id_col, label))

    def scaled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            whole = []
            for v in frame["v"]:
                x = np.empty(0) if v is None else np.floor(scale * np.array([np.nan if c is None else c for c in v], dtype=np.float64))
                ok = len(x) > 0 and np.isfinite(x).all()
                if ok and np.abs(x).max() > LARGEST:
                    raise ValueError(f"a component is beyond {LARGEST / scale}")
                whole.append(x.astype(np.int32) if ok else None)
            frame = frame.assign(v=whole)
            yield frame[[v is not None for v in whole]]

    picked = vectors.select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    now = materialise(spark, picked.mapInPandas(scaled, f"id {kind}, label {label_kind}, v array<int>"), "codes-scaled")
    sizes = now.agg(F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high")).first()
    if sizes.low is not None and (sizes.low != sizes.high or sizes.low % parts):
        raise ValueError(f"vectors of {sizes.low} to {sizes.high} components can't be cut into {parts} equal parts")
    start = [r.v for r in now.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(entries).collect()]
    width = (sizes.low or 0) // parts
    books = np.array(start, dtype=np.int64).reshape(len(start), parts, width).transpose(1, 0, 2)

    def assigned(books: np.ndarray, first: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in batches:
                if not len(frame):
                    continue
                cut = np.stack(frame["v"].to_list()).astype(np.int64).reshape(len(frame), parts, width)
                code = np.zeros((len(frame), parts), dtype=np.int64)
                if not first:
                    code[:] = np.frombuffer(b"".join(frame["code"]), dtype=np.uint8).reshape(code.shape)
                error = np.zeros(len(frame), dtype=np.int64)
                for p in range(parts):
                    at = np.ascontiguousarray(cut[:, p])
                    code[:, p], dist = first_assignment(at, books[p]) if first else ball_assignment(at, code[:, p], books[p])
                    error += dist
                packed = code.astype(np.uint8)
                yield frame.assign(code=[c.tobytes() for c in packed], error=error)

        return run

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = np.arange(parts) * len(start)
        for frame in batches:
            if not len(frame):
                continue
            cut = np.stack(frame["v"].to_list()).astype(np.int64).reshape(-1, width)
            slot = (np.frombuffer(b"".join(frame["code"]), dtype=np.uint8).reshape(-1, parts) + place).ravel()
            order = slot.argsort(kind="stable")
            used, first, n = np.unique(slot[order], return_index=True, return_counts=True)
            total = np.add.reduceat(cut[order], first)
            yield pd.DataFrame({
                "slot": np.repeat(used, width), "component": np.tile(np.arange(width), len(used)), "total": total.ravel(), "n": np.repeat(n, width)
            })

    schema = f"id {kind}, label {label_kind}, v array<int>, code binary, error long"
    for k in range(rounds + 1):
        now = materialise(spark, now.mapInPandas(assigned(books, k == 0), schema), "codes-assigned")
        if k < rounds:
            sums = now.mapInPandas(summed, "slot long, component int, total long, n long").groupBy("slot", "component")
            books = books.copy()
            for r in sums.agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
                books[r.slot // len(start), r.slot % len(start), r.component] = r.total // r.n
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    by_label = materialise(spark, now.groupBy("label").agg(F.sum("error").alias("label_error")), "codes-labels").withColumnRenamed("label", "_label")
    small = by_label.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    out = now.join(F.broadcast(by_label) if small else by_label, F.col("label").eqNullSafe(F.col("_label")))
    return out.select(
        F.col("id").alias(id_col), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )


def _sql() -> str:
    """The rounds as DuckDB SQL; numbers are whole and small enough to be exact as doubles."""
    nearest = """(SELECT p.r, p.pos, min((p.pp - 2 * list_dot_product(p.x, c.x) + list_dot_product(c.x, c.x))::BIGINT * 64 + c.entry) AS near
  FROM p JOIN {book} c ON p.pos = c.pos GROUP BY p.r, p.pos)"""
    moved = """(SELECT c.pos, c.entry, coalesce(m.x, c.x) AS x FROM {book} c LEFT JOIN (
    SELECT pos, entry, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) AS x FROM (
      SELECT p.pos, a.near % 64 AS entry, i, sum(p.x[i]::BIGINT)::BIGINT AS s, count(*) AS n
      FROM p JOIN {near} a ON a.r = p.r AND a.pos = p.pos CROSS JOIN range(1, 1 + (SELECT any_value(len(x)) FROM p)) t(i) GROUP BY 1, 2, 3)
    GROUP BY pos, entry) m ON m.pos = c.pos AND m.entry = c.entry)"""
    return f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (
  SELECT *, list_dot_product(x, x) AS pp FROM (SELECT r, vec_id, pos, v[pos * len(v) // 16 + 1 : (pos + 1) * len(v) // 16] AS x FROM k CROSS JOIN range(16) t(pos))),
b0 AS MATERIALIZED (SELECT pos, entry, x FROM (SELECT pos, x, row_number() OVER (PARTITION BY pos ORDER BY vec_id, x) - 1 AS entry FROM p) WHERE entry < 64),
a0 AS MATERIALIZED {nearest.format(book="b0")},
b1 AS MATERIALIZED {moved.format(book="b0", near="a0")},
a1 AS MATERIALIZED {nearest.format(book="b1")},
b2 AS MATERIALIZED {moved.format(book="b1", near="a1")},
a2 AS MATERIALIZED {nearest.format(book="b2")},
coded AS (SELECT r, string_agg(printf('%02x', near % 64), '' ORDER BY pos) AS code, sum(near // 64)::BIGINT AS error FROM a2 GROUP BY r),
digest AS (SELECT sha256(string_agg(x[i]::BIGINT::VARCHAR, ',' ORDER BY pos, entry, i)) AS h FROM b2 CROSS JOIN range(1, 1 + (SELECT any_value(len(x)) FROM p)) t(i))
SELECT k.vec_id, code, error, (sum(error) OVER (PARTITION BY k.label))::BIGINT AS label_error, h AS codebooks_sha256 FROM k JOIN coded USING (r) CROSS JOIN digest
"""


ORACLE_SQL = _sql()

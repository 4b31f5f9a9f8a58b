"""Quality classifier: Bradley-Terry ranking of documents, cut at a quantile of the scores."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablemove.llm.common import join_small, key_partitions, materialise, small_batches
from tablemove.llm.features import N_STYLE, features, labelled_sample, sample_features

#: Labelled rows that are fitted at most (drawn by a hash of the id), and opponents that each meets.
SAMPLE_ROWS, OPPONENTS = 8_000, 6
#: Score at and above which a document counts as good.
CUT = 0.3


@dataclass(frozen=True)
class Ranking:
    """weights . (features - centre) is a document's strength; ``cut`` is the strength whose score is ``CUT``."""

    centre: np.ndarray
    weights: np.ndarray
    cut: float
    quantile: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return (x - self.centre) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        over = np.clip(self.strength(x) - self.cut, -30, 30)
        return np.where(over >= 0, *_squash(over))


def _squash(over: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logistic curve through ``CUT`` at zero; the two halves so that zero gives ``CUT`` exactly."""
    odds = CUT / (1 - CUT) * np.exp(over)
    value = odds / (1 + odds)
    return np.maximum(value, CUT), np.minimum(value, np.nextafter(CUT, 0))


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learnt from: crc32 of the id as text leaves 0 at division by 5. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(x: np.ndarray, y: np.ndarray, *, ridge: float = 1.0, seed: int = 11) -> Ranking:
    """Bradley-Terry strengths from preference pairs.

    Every good document is preferred to ``OPPONENTS`` bad ones and every bad
    one is beaten by as many good ones, drawn by seeded permutations. The loss
    is log(1 + exp(-w . (x_good - x_bad))) with a ridge, minimised by Newton
    steps. The cut is a quantile of the training strengths: that which parts the
    two labels with the smallest mean error, in the middle of the equally good
    ones. With only one label, or none, all strengths are zero and the cut
    takes everything (only good labels, or none) or nothing.
    """
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        zero = np.zeros(x.shape[1] if x.ndim == 2 and x.shape[1] else N_STYLE)
        return Ranking(zero, zero, 1.0 if len(bad) else -1.0, float(len(bad) > 0))
    rng = np.random.default_rng(seed)
    spread = x.std(0)
    use = spread > 1e-9
    z = np.where(use, (x - x.mean(0)) / np.where(use, spread, 1), 0)
    n = max(len(good), len(bad))
    pairs = [(good[rng.permutation(n) % len(good)], bad[rng.permutation(n) % len(bad)]) for _ in range(OPPONENTS)]
    d = np.concatenate([z[a] - z[b] for a, b in pairs])
    w = np.zeros(x.shape[1])

    def loss(w: np.ndarray) -> float:
        return np.logaddexp(0, -(d @ w)).sum() + 0.5 * ridge * w @ w

    now = loss(w)
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        hess = (d * (p * (1 - p))[:, None]).T @ d + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, d.T @ p - ridge * w)
        while (after := loss(w + step)) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        if after > now:
            break
        w, now = w + step, after
        if np.abs(step).max() < 1e-6:
            break
    weights = np.where(use, w / np.where(use, spread, 1), 0)
    strength = (x - x.mean(0)) @ weights
    cut, quantile = best_quantile(strength, y)
    return Ranking(x.mean(0), weights, cut, quantile)


def best_quantile(strength: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The cut between two neighbouring strengths with the smallest mean of both labels' errors, and its quantile."""
    order = np.argsort(strength, kind="stable")
    s, good = strength[order], (y[order] == 1)
    lost = np.concatenate([[0], np.cumsum(good)]) / max(1, good.sum())
    passed = 1 - np.concatenate([[0], np.cumsum(~good)]) / max(1, (~good).sum())
    edges = np.concatenate([[s[0] - 1], (s[1:] + s[:-1]) / 2, [s[-1] + 1]])
    error = lost + passed
    error[1:-1][s[1:] == s[:-1]] = np.inf
    best = np.flatnonzero(error <= error.min() + 1e-12)
    k = best[len(best) // 2]
    return float(edges[k]), float(k / len(s))


def balanced_sample(docs: DataFrame, labels: DataFrame, rows: int, *, id_col: str = "doc_id") -> DataFrame:
    """``labelled_sample`` of half the rows from each label ``_y``, or of all rows that a rarer one has and more of the other."""
    n = {r._y: r.n for r in labels.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_good = min(n.get(1, 0), max(rows // 2, rows - n.get(0, 0)))
    good, bad = (labelled_sample(docs, labels.where(F.col("_y") == y), k, id_col=id_col) for y, k in ((1, n_good), (0, rows - n_good)))
    return good.unionByName(bad)


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> Ranking:
    """Fit on labelled rows that are not held out, ``sample_rows`` at most, and cut at a quantile of all of them.

    The sample takes half of its rows from each label, or all that a rarer one has. Whatever its size, the cut is placed by all
    labelled rows. An id with several labels counts as good if their mean is 0.5 or more; null labels are ignored.
    """
    small_batches(spark)
    one = labels.where(~held_out(id_col)).where("quality is not null").groupBy(id_col).agg((F.avg("quality") >= 0.5).cast("int").alias("_y"))
    one = materialise(spark, one, "quality-labels")
    picked = docs.select(id_col, text)
    x, y = sample_features(spark, balanced_sample(picked, one, sample_rows, id_col=id_col), text, "_y")
    ranking = fit(x, np.array(y))
    if len(set(y)) < 2:
        return ranking  # no pairs, so no strengths to cut
    return cut_over_all(spark, picked, one, ranking, id_col=id_col, text=text)


def cut_over_all(spark: SparkSession, docs: DataFrame, labels: DataFrame, ranking: Ranking, *, id_col: str = "doc_id", text: str = "text") -> Ranking:
    """``ranking`` with its cut placed by the strengths of all rows of ``labels`` (id, ``_y``).

    The cut is again the quantile that parts the two labels with the smallest mean error: every place between two neighbouring
    distinct strengths is tried. Labels are counted per strength, map-side first; the strengths are dealt out
    in ranges, whose running counts start from the totals of the ranges before. The driver gets a row a range.
    """

    @F.pandas_udf("double")
    def strength(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series(np.round(ranking.strength(features(s)), 9))  # alike in every batch

    rows = join_small(docs, labels, [id_col], "inner").select(strength(F.col(text).cast("string")).alias("s"), F.col("_y").alias("y"))
    counts = rows.groupBy("s").agg(F.count_if(F.col("y") == 0).alias("bad"), F.count_if(F.col("y") == 1).alias("good"))
    counts = materialise(spark, counts, "quality-strengths")
    ranged = counts.repartitionByRange(key_partitions(spark), "s").withColumn("part", F.spark_partition_id())
    ranged = materialise(spark, ranged, "quality-ranges")
    totals = ranged.groupBy("part").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.min("s").alias("low")).orderBy("low").collect()
    all_bad, all_good = sum(r.bad for r in totals), sum(r.good for r in totals)
    if not all_bad or not all_good:
        return ranking
    starts, bad, good = [], 0, 0
    for r in totals:
        starts.append((r.part, bad, good))
        bad, good = bad + r.bad, good + r.good
    upto = Window.partitionBy("part").orderBy("s")
    kinds = {"part": pa.int32(), "bad_before": pa.int64(), "good_before": pa.int64()}
    before = pa.table({c: pa.array(v, kinds[c]) for c, v in zip(kinds, zip(*starts))})  # from a list of rows Spark makes an RDD, for which each executor starts more Python processes
    below = ranged.join(F.broadcast(spark.createDataFrame(before)), "part").select(
        "s", (F.col("bad_before") + F.sum("bad").over(upto)).alias("bad"), (F.col("good_before") + F.sum("good").over(upto)).alias("good")
    )
    # errors as whole numbers, so that equally good places are told exactly
    wide = "decimal(18,0)"
    error = (F.col("good").cast(wide) * F.lit(all_bad).cast(wide) + (all_bad - F.col("bad")).cast(wide) * F.lit(all_good).cast(wide)).alias("error")
    below = materialise(spark, below.select("s", "bad", "good", error), "quality-cuts")
    least = below.agg(F.min("error")).first()[0]
    if least >= all_bad * all_good:  # no place is better than to take everything
        return replace(ranking, cut=float(totals[0].low) - 1, quantile=0.0)
    at = below.where(F.col("error") == least).agg(F.percentile_approx("s", 0.5, 10_000)).first()[0]
    place = below.where(F.col("s") == at).first()
    above = below.where(F.col("s") > at).agg(F.min("s")).first()[0]
    cut = at + 1 if above is None else (at + above) / 2
    return replace(ranking, cut=float(cut), quantile=float((place.bad + place.good) / (all_bad + all_good)))


def score_documents(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` (0 to 1, higher is better) and ``predicted`` (1 if score >= 0.3).

    Only the text enters a score. A null text counts as empty and gets the score of
    an empty one. Repeated rows score alike. Input columns of these three names
    are replaced; all others stay. Without usable labels every score is over
    0.3. An empty table gives no rows.
    """
    ranking = learn(spark, docs, labels, id_col=id_col, text=text, sample_rows=sample_rows)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series(ranking.score(features(s)))

    scored = docs.withColumn("score", score(F.col(text).cast("string")))
    return scored.withColumn("held_out", held_out(id_col)).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with the columns of ``docs``."""
    names = docs.columns
    wrapped = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(options.get("id_col", "doc_id")), F.col(options.get("text", "text")))
    return score_documents(spark, wrapped, labels, **options).where("predicted = 1").select("_row.*")

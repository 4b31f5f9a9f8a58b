"""Soft-membership mixing: domain posteriors, then document rates that meet domain token targets."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemove.llm.common import materialise, small_batches
from tablemove.llm.features import N_STYLE, features, labelled_sample, sample_features
from tablemove.llm.quality import held_out

#: Labelled rows that are fitted at most, drawn by a hash of the id; words that serve as features.
SAMPLE_ROWS, VOCABULARY = 8_000, 96
ROUNDS, TOLERANCE = 200, 1e-6
#: Share of all tokens aimed at by which a domain may miss its target without a warning.
MISS = 1e-3
_LOG = logging.getLogger(__name__)


@dataclass(frozen=True)
class Domains:
    """A softmax classifier of texts: ``names``, marked words, scaling and weights (features + 1 x domains)."""

    names: tuple[str, ...]
    vocabulary: tuple[bytes, ...]
    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray

    def posteriors(self, texts: pd.Series) -> np.ndarray:
        x = (features(texts, self.vocabulary) - self.centre) / self.spread
        logit = np.c_[x, np.ones(len(x))] @ self.weights
        e = np.exp(logit - logit.max(1, keepdims=True, initial=-np.inf))
        return e / e.sum(1, keepdims=True)


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of a label table: ``toxic``, else ``clean`` or ``junk`` by quality. An id with several labels takes their means; rows without both labels are ignored."""
    one = labels.where("doc_id is not null and quality is not null and toxic is not null")
    one = one.groupBy("doc_id").agg(F.avg("quality").alias("q"), F.avg("toxic").alias("t"))
    return one.select("doc_id", F.when(F.col("t") >= 0.5, "toxic").when(F.col("q") >= 0.5, "clean").otherwise("junk").alias("domain"))


def marked_words(sample: DataFrame, text: str, size: int) -> tuple[bytes, ...]:
    """The words whose document counts differ most between domains, by chi-square; counted in Spark."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tablemove.llm.features import words_of

        for frame in batches:
            sets = [words_of(t) for t in frame["t"]]
            yield pd.DataFrame({"d": np.repeat(frame["d"].to_numpy(), [len(s) for s in sets]), "w": [w for s in sets for w in s]})

    words = sample.select(F.col(text).cast("string").alias("t"), F.col("domain").alias("d")).mapInPandas(split, "d string, w binary")
    totals = {r.domain: r["count"] for r in sample.groupBy("domain").count().collect()}
    if len(totals) < 2:
        return ()
    counts = words.groupBy("w").agg(*[F.count(F.when(F.col("d") == k, 1)).alias(f"c{i}") for i, k in enumerate(sorted(totals))])
    n = sum(totals.values())
    held = sum(F.col(f"c{i}") for i in range(len(totals)))
    expected = [held * (totals[k] / n) for k in sorted(totals)]
    chi = sum((F.col(f"c{i}") - e) ** 2 / e for i, e in enumerate(expected)) * (n / (n - held + 1))
    top = counts.where(held >= 5).select("w", F.round(chi, 6).alias("chi")).orderBy(F.desc("chi"), "w").limit(size)
    return tuple(bytes(r.w) for r in top.collect())


def fit_domains(x: np.ndarray, y: list[str], names: tuple[str, ...], vocabulary: tuple[bytes, ...], ridge: float = 3.0) -> Domains:
    """Softmax regression by Newton steps. Domains without a labelled row get (nearly) no posterior; with no rows at all the posteriors are even."""
    width = N_STYLE + len(vocabulary)
    k = len(names)
    weights = np.zeros((width + 1, k))
    if not len(y):
        return Domains(names, vocabulary, np.zeros(width), np.ones(width), weights)
    centre, spread = x.mean(0), x.std(0)
    spread = np.where(spread > 1e-9, spread, 1e9)
    z = np.c_[(x - centre) / spread, np.ones(len(x))]
    target = np.array([[float(v == name) for name in names] for v in y])
    start = np.r_[np.zeros((width, k)), np.log(target.mean(0) + 1e-9)[None]]
    weights = start
    penalty = np.r_[np.full(width, ridge), 1e-3]

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        s = z @ w
        e = np.exp(s - s.max(1, keepdims=True))
        p = e / e.sum(1, keepdims=True)
        return -np.log(np.maximum((p * target).sum(1), 1e-300)).sum() + 0.5 * (penalty[:, None] * (w - start) ** 2).sum(), p

    now, p = loss(weights)
    for _ in range(30):
        gradient = z.T @ (target - p) - penalty[:, None] * (weights - start)
        hess = np.zeros((k * (width + 1), k * (width + 1)))
        for a in range(k):
            for b in range(a, k):
                h = (z * (p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ z
                at_a, at_b = slice(a * (width + 1), (a + 1) * (width + 1)), slice(b * (width + 1), (b + 1) * (width + 1))
                hess[at_a, at_b] = h
                hess[at_b, at_a] = h.T
        hess += np.diag(np.tile(penalty, k))
        step = np.linalg.solve(hess, gradient.T.ravel()).reshape(k, width + 1).T
        size = 1.0
        while size > 1e-4 and (after := loss(weights + size * step))[0] > now:
            size /= 2
        if size <= 1e-4 or now - after[0] < 1e-6 * max(1.0, now):
            break
        weights, (now, p) = weights + size * step, after
    return Domains(names, vocabulary, centre, spread, weights)


def learn_domains(
    spark: SparkSession, docs: DataFrame, labelled: DataFrame, names: tuple[str, ...], *, id_col: str = "doc_id", text: str = "text",
    sample_rows: int = SAMPLE_ROWS,
) -> Domains:
    """Fit on rows of ``labelled`` (id, domain) that are not held out and whose domain is among ``names``."""
    small_batches(spark)
    usable = labelled.where(F.col("domain").isin(*names)).where(~held_out(id_col))
    sample = labelled_sample(docs.select(id_col, text), usable, sample_rows, id_col=id_col)
    sample = materialise(spark, sample, "mix-sample")
    vocabulary = marked_words(sample, text, VOCABULARY)
    x, y = sample_features(spark, sample, text, "domain", vocabulary)
    return fit_domains(x, y, names, vocabulary)


def rates(p: np.ndarray, history: np.ndarray, most: float = np.inf) -> np.ndarray:
    """Projected steps for a block of documents: from 1, against ``p . step``, back into [0, most].

    A row of ``history`` is a gradient and a step. A document that is at a bound and that the gradient pushes outwards stays there.
    """
    r, k = np.full(len(p), min(1.0, most)), p.shape[1]
    for row in history:
        way = p @ row[:k]
        held = ((r <= 0) & (way > 0)) | ((r >= most) & (way < 0))
        r = np.where(held, r, np.clip(r - p @ row[k:], 0, most))
    return r


def fit_rates(spark: SparkSession, memberships: DataFrame, target: np.ndarray, most: float = np.inf, rounds: int = ROUNDS) -> np.ndarray:
    """The steps that :func:`fit_totals` finds."""
    return fit_totals(spark, memberships, target, most, rounds)[0]


def fit_totals(spark: SparkSession, memberships: DataFrame, target: np.ndarray, most: float = np.inf, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Projected least squares; the steps that :func:`rates` replays, and the domains' totals that those rates give.

    With tokens t and posteriors p, rates r minimise
    sum_k (sum_d t_d r_d p_dk - target_k)^2 / T_k over 0 <= r <= most, where T_k is the
    domain's total at r = 1. A document's step is the gradient over t_d, so
    that long and short documents move alike; a step of 1 never raises the sum, since the
    matrix that multiplies the residual has column sums of 1 at most. Where rare domains or soft
    posteriors would make such steps slow, a Newton step over the documents within their bounds is tried first, and
    kept if it takes a tenth off the sum. A round is one pass over the written table that sums a few numbers per domain, and only
    those reach the driver. Rates need no table between rounds: each row replays
    the few steps so far. Stops once all totals together miss by less than a millionth, when a plain step gains
    less than a ten-thousandth, or after ``rounds``; the totals say what is missed.
    """
    k = len(target)

    def sums(past: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Totals at the rates so far, and sum_d t_d p_dk p_dl over the documents that are within their bounds (at first, all)."""

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, square = np.zeros(k), np.zeros((k, k))
            for frame in batches:
                p, t = np.array(frame["p"].tolist()).reshape(-1, k), frame["tokens"].to_numpy()
                r = rates(p, past, most)
                total += (t * r) @ p
                free = t * ((r > 0) & (r < most)) if len(past) else t
                square += (p * free[:, None]).T @ p
            yield pd.DataFrame([np.r_[total, square.ravel()]], columns=names)

        names = [f"s{i}" for i in range(k + k * k)]
        got = memberships.mapInPandas(part, ", ".join(f"{n} double" for n in names)).agg(*[F.sum(n) for n in names]).first()
        got = np.array([x or 0.0 for x in got])
        return got[:k], got[k:].reshape(k, k)

    def worth(now: np.ndarray) -> float:
        return float(((now - target) ** 2 / totals).sum())

    history = np.zeros((0, 2 * k))
    now, square = sums(history)
    totals = np.maximum(now, 1e-9)
    left = rounds - 1
    while left > 0 and np.abs(now - target).sum() >= TOLERANCE * max(1.0, target.sum()):
        gradient, root = (now - target) / totals, np.sqrt(totals)
        newton = np.linalg.lstsq(square / np.outer(root, root), (now - target) / root, rcond=1e-9)[0] / root
        for step, share in ((newton, 0.9), (gradient, 1 - 1e-4)):
            tried = np.vstack([history, np.r_[gradient, step]])
            after = sums(tried)
            left -= 1
            better = worth(after[0]) <= worth(now) * share
            if better or left <= 0:
                break
        if worth(after[0]) < worth(now):
            history, (now, square) = tried, after
        if not better:
            break
    return history, now


def report_totals(names: tuple[str, ...], target: np.ndarray, got: np.ndarray) -> str:
    """Expected tokens, target and miss of each domain as a line, which is logged; as a warning if a domain misses by over ``MISS`` of all tokens aimed at."""
    line = "; ".join(f"{n} {g:.1f} of {t:.1f} tokens aimed at ({g - t:+.1f})" for n, t, g in zip(names, target, got))
    if np.abs(got - target).max(initial=0) > MISS * max(1.0, target.sum()):
        _LOG.warning("mixing misses its targets: %s", line)
    else:
        _LOG.info("mixing: %s", line)
    return line


def assign(
    spark: SparkSession, docs: DataFrame, labelled: DataFrame, weights: dict[str, float], *, total: float | str | None = None, most: float = np.inf,
    id_col: str = "doc_id", text: str = "text", seed: int = 5, sample_rows: int = SAMPLE_ROWS, rounds: int = ROUNDS,
) -> DataFrame:
    """Per document: id, ``draw``, ``tokens``, one ``p_<domain>`` each, ``rate`` and ``copies``.

    ``weights`` are target shares of tokens by domain (domains not named are
    ignored in ``labelled``). ``total`` is the number of tokens aimed at; a
    domain's name means: so many that this domain keeps what it has; None: the
    tokens there are. Rates end at ``most``, without a bound if not given. What
    the rates give and miss of each target is logged, as a warning if it is over a thousandth. ``copies`` is the rate rounded up or down by a hash of id
    and text (``draw``), so that its mean is the rate and a rerun draws the same.

    Tokens are words between ASCII blanks. A null text counts as empty: no
    tokens, and a rate from its posterior like any other. Repeated rows get the
    same rate and copies. Without labels the posteriors are even and all rates
    alike. An empty table gives no rows. Other columns are not read.
    """
    names = tuple(sorted(weights))
    domains = learn_domains(spark, docs, labelled, names, id_col=id_col, text=text, sample_rows=sample_rows)

    @F.pandas_udf("tokens long, p array<double>")
    def member(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in texts:
            yield pd.DataFrame({"tokens": [len((t or "").encode("utf-8", "surrogatepass").split()) for t in s], "p": list(domains.posteriors(s))})

    table = docs.select(F.col(id_col), _draw(docs, id_col, text, seed).alias("draw"), member(F.col(text).cast("string")).alias("m"))
    table = materialise(spark, table.select(id_col, "draw", "m.tokens", "m.p"), "mix-members")
    sums = table.agg(*[F.sum(F.col("tokens") * F.col("p")[i]).alias(f"s{i}") for i in range(len(names))]).first()
    have = np.array([x or 0.0 for x in sums])
    share = np.array([weights[n] for n in names], dtype=float) / sum(weights.values())
    if isinstance(total, str):
        at = names.index(total)
        amount = have[at] / share[at]
    else:
        amount = float(have.sum() if total is None else total)
    history, got = fit_totals(spark, table.select("tokens", "p"), share * amount, most, rounds)
    report_totals(names, share * amount, got)

    @F.pandas_udf("double")
    def rate(ps: pd.Series) -> pd.Series:
        return pd.Series(rates(np.array(ps.tolist()).reshape(-1, len(names)), history, most))

    rate = rate.asNondeterministic()  # else a filter on copies computes it a second time, with a second Python worker for each core
    u = F.pmod(F.xxhash64("draw"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    got = table.withColumn("rate", rate("p"))
    copies = (F.floor("rate") + (u < F.col("rate") - F.floor("rate")).cast("int")).cast("int")
    return got.select(id_col, "draw", "tokens", *[F.col("p")[i].alias(f"p_{n}") for i, n in enumerate(names)], "rate", copies.alias("copies"))


def _draw(docs: DataFrame, id_col: str, text: str, seed: int):
    return F.xxhash64(F.lit(seed), docs[id_col], F.coalesce(docs[text].cast("string"), F.lit("")))


def mix(spark: SparkSession, docs: DataFrame, labelled: DataFrame, weights: dict[str, float], *, id_col: str = "doc_id", text: str = "text", seed: int = 5, **options) -> DataFrame:
    """``docs``, its columns only, each row as often as :func:`assign` says (also not at all)."""
    copies = assign(spark, docs, labelled, weights, id_col=id_col, text=text, seed=seed, **options)
    copies = copies.where("copies > 0").select(F.col(id_col).alias("_id"), F.col("draw").alias("_draw"), F.col("copies").alias("_copies"))
    copies = materialise(spark, copies.distinct(), "mix-copies")
    same = docs[id_col].eqNullSafe(copies["_id"]) & (_draw(docs, id_col, text, seed) == copies["_draw"])
    rows = docs.join(copies, same).withColumn("_n", F.explode(F.sequence(F.lit(1), copies["_copies"])))
    return rows.select(*[docs[f"`{c}`"] for c in docs.columns])

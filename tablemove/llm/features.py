"""Text features that the classifiers share: how a text is written, and which marked words it holds."""

from __future__ import annotations

from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PUNCTUATION = np.array([i for i in range(33, 127) if not chr(i).isalnum()])
_SPACES = bytes.maketrans(bytes(_PUNCTUATION.astype(np.uint8)), b" " * len(_PUNCTUATION))
#: Size, mean word length, distinct words, repeats, capitals, digits, blanks, line ends, other bytes; then one per punctuation mark.
N_STYLE = 9 + len(_PUNCTUATION)


def style(text: str | None) -> np.ndarray:
    """How a whole text is written: ``N_STYLE`` numbers, all zero for a null or empty text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(N_STYLE)
    words = raw.split()
    if not words:
        return out
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, m = len(raw), len(words)
    letters = max(1, int(count[65:91].sum() + count[97:123].sum()))
    out[0] = np.log1p(m) / 10
    out[1] = min(4.0, (n - count[32]) / m / 10)
    out[2] = len(set(words)) / m ** 0.9
    out[3] = sum(map(eq, words, words[1:])) / m
    out[4] = count[65:91].sum() / letters
    out[5] = count[48:58].sum() / n
    out[6] = count[32] / n
    out[7] = np.sqrt(count[10] / n)
    out[8] = count[128:].sum() / n
    out[9:] = np.sqrt(count[_PUNCTUATION] / n)  # a root, so that rare marks count
    return out


def words_of(text: str | None) -> set[bytes]:
    """Distinct words, A-Z lowered, ASCII punctuation taken as blanks."""
    return set((text or "").encode("utf-8", "surrogatepass").lower().translate(_SPACES).split())


def features(texts: pd.Series, vocabulary: tuple[bytes, ...] = ()) -> np.ndarray:
    """A row per text: its style, then 1 for each word of ``vocabulary`` that it holds."""
    place = {w: N_STYLE + k for k, w in enumerate(vocabulary)}
    out = np.zeros((len(texts), N_STYLE + len(vocabulary)))
    for k, text in enumerate(texts):
        out[k, :N_STYLE] = style(text)
        if place:
            for w in place.keys() & words_of(text):
                out[k, place[w]] = 1
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, *, id_col: str = "doc_id") -> DataFrame:
    """``docs`` joined with at most ``rows`` rows of ``labels``, drawn by a hash of the id.

    A training sample: its bound is what lets the fit run on the driver and the
    drawn labels be broadcast. Several labels of an id must have been made one.
    """
    drawn = labels.where(F.col(id_col).isNotNull()).orderBy(F.xxhash64(F.lit("sample"), id_col), id_col).limit(rows)
    return docs.join(F.broadcast(drawn), id_col)


def sample_features(spark: SparkSession, sample: DataFrame, text: str, target: str, vocabulary: tuple[bytes, ...] = ()) -> tuple[np.ndarray, list]:
    """Features and targets of a bounded sample; the features are computed on the executors. Rows come in a fixed order."""

    def of(batches):
        for frame in batches:
            yield pd.DataFrame({"x": list(features(frame["t"], vocabulary)), "y": frame["y"]})

    kind = sample.schema[target].dataType.simpleString()
    got = sample.select(F.col(text).cast("string").alias("t"), F.col(target).alias("y")).mapInPandas(of, f"x array<double>, y {kind}").toPandas()
    if not len(got):
        return np.empty((0, N_STYLE + len(vocabulary))), []
    x, y = np.array(got["x"].tolist()), got["y"].tolist()
    order = np.lexsort([*x.T, np.array([str(v) for v in y])])
    return x[order], [y[k] for k in order]

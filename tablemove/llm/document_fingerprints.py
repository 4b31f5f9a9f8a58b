"""Document fingerprints from prefix polynomial hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemove.llm.common import key_partitions, materialise, small_batches

#: Two prime moduli and bases: a span's hash is a residue of each, 62 bits together.
MODULI = (2_147_483_647, 2_147_483_629)
BASES = (1_103_515_245, 1_664_525_013)
#: Code points of a span that the sketch samples, and how many distinct span hashes it keeps.
SPAN, SKETCH = 16, 32
#: Code points whose products are worked out at once.
STEP = 1 << 16


class Powers:
    """Powers of the bases and of their inverses, extended as longer texts come."""

    def __init__(self):
        self.up = [np.ones(1, dtype=np.uint64) for _ in MODULI]
        self.down = [np.ones(1, dtype=np.uint64) for _ in MODULI]

    def reach(self, n: int) -> None:
        for table, bases in ((self.up, BASES), (self.down, [pow(b, -1, m) for b, m in zip(BASES, MODULI)])):
            for k, (b, m) in enumerate(zip(bases, MODULI)):
                while len(table[k]) < n:
                    have = table[k]
                    table[k] = np.concatenate([have, have * np.uint64(pow(b, len(have), m)) % np.uint64(m)])


POWERS = Powers()


class PrefixHashes:
    """A text's prefix arrays: entry k holds the sum of (code point + 1) * base^i over i < k, modulo each prime.

    Memory is in proportion to the text: 20 bytes a code point.
    """

    def __init__(self, text: str):
        self.points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.n = n = len(self.points)
        POWERS.reach(n + 1)
        self.sums = []
        for up, m in zip(POWERS.up, MODULI):
            sums = np.zeros(n + 1, dtype=np.uint64)
            for s in range(0, n, STEP):
                e = min(n, s + STEP)
                sums[s + 1 : e + 1] = (sums[s] + np.cumsum((self.points[s:e].astype(np.uint64) + np.uint64(1)) * up[s:e] % np.uint64(m))) % np.uint64(m)
            self.sums.append(sums)

    def span(self, start: int, end: int) -> tuple[int, ...]:
        """The hash of text[start:end], the same wherever the span lies."""
        return tuple(int(s[end] + np.uint64(m) - s[start]) * int(d[start]) % m for s, d, m in zip(self.sums, POWERS.down, MODULI))

    def spans(self, size: int) -> np.ndarray:
        """The hashes of all spans of ``size`` code points, mixed to 32 bits, in order."""
        n = self.n - size + 1
        out = np.empty(max(0, n), dtype=np.uint32)
        for s in range(0, n, STEP):
            e = min(n, s + STEP)
            parts = [
                (sums[s + size : e + size] + np.uint64(m) - sums[s:e]) % np.uint64(m) * down[s:e] % np.uint64(m)
                for sums, down, m in zip(self.sums, POWERS.down, MODULI)
            ]
            out[s:e] = mixed(*parts) >> np.uint64(32)
        return out

    def extension(self, other: PrefixHashes, i: int = 0, j: int = 0) -> int:
        """The length of the longest common extension of this text from ``i`` and the other from ``j``, by binary search."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            middle = (low + high + 1) // 2
            if self.span(i, i + middle) == other.span(j, j + middle):
                low = middle
            else:
                high = middle - 1
        return low

    @cached_property
    def fingerprint(self) -> bytes:
        """Length and whole hash, 8 bytes each; then 4 bytes a rung (hashes of the prefixes of ``rungs`` lengths); then the sketch.

        The sketch is the ``SKETCH`` smallest of the distinct hashes of all spans of ``SPAN`` code points (of the whole text, if shorter).
        """
        at = rungs(self.n)
        whole = mixed(self.sums[0][-1:], self.sums[1][-1:])
        ladder = (mixed(self.sums[0][at], self.sums[1][at]) >> np.uint64(32)).astype(np.uint32)
        values = self.spans(min(SPAN, self.n)) if self.n else np.empty(0, dtype=np.uint32)
        few = values
        if len(values) > 8 * SKETCH:
            few = np.partition(values, 4 * SKETCH)[: 4 * SKETCH]
        few = np.unique(few)
        if len(few) < SKETCH < len(values):
            few = np.unique(values)
        return b"".join(x.astype(t).tobytes() for x, t in ((np.array([self.n]), ">u8"), (whole, ">u8"), (ladder, ">u4"), (few[:SKETCH], ">u4")))


def mixed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Both residues as one number of 64 well-spread bits."""
    x = (first << np.uint64(32)) | second
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def rungs(n: int) -> np.ndarray:
    """Prefix lengths below ``n`` that a fingerprint holds: from 1, each a quarter longer than the last, one at least."""
    out, at = [], 1
    while at < n:
        out.append(at)
        at = max(at + 1, at * 5 // 4)
    return np.array(out, dtype=np.int64)


def likeness(a: bytes, b: bytes) -> float:
    """How alike two fingerprinted texts are, 0 to 1: 1 for equal ones, else the larger of two measures.

    The prefix that both share, found by binary search over the rungs, as a share
    of the longer text; and the estimated share of distinct spans that both
    hold, from the sketches. Both stay below 1. An empty text is like empty ones only.
    """
    if a[:16] == b[:16]:
        return 1.0
    n, m = int.from_bytes(a[:8]), int.from_bytes(b[:8])
    if not n or not m:
        return 0.0
    at = rungs(min(n, m))
    low, high = 0, len(at)
    while low < high:
        middle = (low + high + 1) // 2
        place = slice(12 + 4 * middle, 16 + 4 * middle)
        if a[place] == b[place]:
            low = middle
        else:
            high = middle - 1
    prefix = int(at[low - 1]) / max(n, m) if low else 0.0
    x, y = (np.frombuffer(f, dtype=">u4", offset=16 + 4 * len(rungs(k))) for f, k in ((a, n), (b, m)))
    lowest = np.union1d(x, y)[:SKETCH]
    both = np.isin(lowest, x, assume_unique=True) & np.isin(lowest, y, assume_unique=True)
    return max(prefix, min(float(both.mean()), 1 - 1 / max(n, m, 2)))


def edited(text: str, following: str) -> str:
    """``text`` with its last third (rounded down) replaced by as many first code points of ``following``, or all."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _row(text: str, mine: bytes, following: str, next_print: bytes) -> tuple:
    changed = edited(text, following)
    at = PrefixHashes(changed)
    return (
        len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), mine, at.fingerprint,
        likeness(mine, at.fingerprint), likeness(mine, next_print), PrefixHashes(text).extension(at),
    )


def fingerprints(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``, ``common_prefix``.

    The edited text is the text with its last third replaced by the start of
    the next document's, in descending order of ids, null ids last; the first document follows the last. ``near_edited`` and
    ``near_next`` are the likeness of the text's fingerprint to those of the edited text and of the next document;
    ``common_prefix`` is the longest common extension of text and edited text from their starts. Null texts
    count as empty. Rows of one id are ordered by a hash of their texts; equal rows follow each other in any
    order. A single document is its own next one. An empty table gives no rows; other columns are not read.

    One range shuffle orders the texts; ids with very many rows are spread over
    partitions by the hash and by row. A task holds two texts at a time. The first and the last row of each
    partition wait for each other in a written table, two rows a partition.
    """
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row")
    ).withColumn("hash", F.xxhash64("text"))
    order = [F.col("id").desc_nulls_last(), F.col("hash"), F.col("row")]
    ordered = rows.repartitionByRange(key_partitions(spark), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    result = f"id {kind}, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, common_prefix long"
    names = [c.split()[0] for c in result.split(", ")]
    schema = f"part int, edge string, text string, {result}"

    def in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = None
        for frame in batches:
            out = []
            for part, key, now in zip(frame["part"], frame["id"], frame["text"]):
                key, mine = None if pd.isna(key) else key, PrefixHashes(now).fingerprint
                if before:
                    out.append((part, None, None, before[0], *_row(before[1], before[2], now, mine)))
                else:
                    out.append((part, "first", now, key, None, None, mine, None, None, None, None))
                before = key, now, mine, part
            if out:
                yield pd.DataFrame(out, columns=["part", "edge", "text", *names]).astype({"n_chars": "Int64", "common_prefix": "Int64"})
        if before:
            last = (before[3], "last", before[1], before[0], None, None, before[2], None, None, None, None)
            yield pd.DataFrame([last], columns=["part", "edge", "text", *names])

    done = materialise(spark, ordered.select("part", "id", "text").mapInPandas(in_order, schema), "prints")
    firsts = done.where("edge = 'first'").select("part", F.col("text").alias("following"), F.col("fingerprint").alias("next_print"))
    parts = sorted(r.part for r in firsts.select("part").collect())  # one number a partition
    follows = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next_part int")
    lasts = done.where("edge = 'last'").select("part", "id", "text", "fingerprint").join(follows, "part")
    pairs = lasts.join(firsts.withColumnRenamed("part", "next_part"), "next_part").select("id", "text", "fingerprint", "following", "next_print")

    def at_edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = [(None if pd.isna(k) else k, *_row(*rest)) for k, *rest in frame[["id", "text", "fingerprint", "following", "next_print"]].itertuples(index=False)]
            if out:
                yield pd.DataFrame(out, columns=names)

    whole = done.where("edge is null").select(*names).unionByName(pairs.mapInPandas(at_edges, result))
    hexed = [F.lower(F.hex(c)).alias(c) if c.endswith("fingerprint") else F.col(c) for c in names[1:]]
    return whole.select(F.col("id").alias(id_col), *hexed)

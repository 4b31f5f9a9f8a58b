"""Cross-tokenizer alignment by diagonal run skipping over token ends."""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablemove.llm.common import materialise, small_batches

BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: An id pair is one number: A's id times this, plus B's id.
SHIFT = 1 << 32
#: Links of a document that are spread out at once; a document with more goes through them by classes of A ids.
LINKS_AT_ONCE = 1 << 21
#: Texts encoded at once, and the code points after which a call is made anyway.
TEXTS_AT_ONCE, POINTS_AT_ONCE = 64, 200_000
#: How the byte-level pre-tokenizer cuts (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Most counted pairs that are broadcast (16 bytes of numbers each, about 200 MB as a hash table); more are joined by a shuffle.
BROADCAST_PAIRS = 3_000_000


#: Tokens that are compared first from a common boundary; each probe after it takes twice as many.
PROBE = 8


def align(ends_a: Sequence[int], ends_b: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Cut two tokenisations of the same bytes where both have a token end.

    ``ends`` are the byte offsets at which tokens end, ascending, the last ones
    equal. Returns, for each group, the index after its last A token and after its
    last B token. From a common boundary the ends are compared at the current
    index shift over 8, 16, 32, ... tokens; a stretch that agrees is one-to-one and
    jumped, and halving finds where the first window that differs departs. There
    the shorter side is advanced until both meet, which makes one irregular group,
    and its token counts give the new shift.
    """
    first_a, last_a, first_b, last_b = [], [], [], []
    i = j = 0
    n = len(ends_a)
    while i < n:
        step = PROBE
        while (ahead := ends_a[i : i + step]) == ends_b[j : j + step]:
            i, j = i + len(ahead), j + len(ahead)
            if i == n:
                break
            step *= 2
        else:
            while step > 1:  # the departure lies in the next ``step`` tokens
                step //= 2
                if ends_a[i : i + step] == ends_b[j : j + step]:
                    i, j = i + step, j + step
        if i == n:
            break
        first_a.append(i)
        first_b.append(j)
        x, y = ends_a[i], ends_b[j]
        while x != y:
            if x < y:
                i += 1
                x = ends_a[i]
            else:
                j += 1
                y = ends_b[j]
        last_a.append(i)
        last_b.append(j)
        i, j = i + 1, j + 1
    return _cuts(n, first_a, last_a), _cuts(len(ends_b), first_b, last_b)


def _cuts(n: int, first: list[int], last: list[int]) -> np.ndarray:
    """1 to ``n`` without what lies within an irregular group from token ``first`` to token ``last``."""
    inside = np.zeros(n + 1, dtype=np.int64)
    inside[first] += 1
    inside[last] -= 1
    return np.flatnonzero(np.cumsum(inside)[:n] == 0) + 1


def groups_text(a: np.ndarray, b: np.ndarray, cuts_a: np.ndarray, cuts_b: np.ndarray) -> bytes:
    """``a1,a2|b1;a3|b2,b3``: decimal ids of the groups in order. Each id takes a row of digits and the mark after it; blanks of short ids go at the end."""
    starts_a, starts_b = np.append(0, cuts_a[:-1]), np.append(0, cuts_b[:-1])
    at_a = np.arange(len(a)) + np.repeat(starts_b, cuts_a - starts_a)
    at_b = np.arange(len(b)) + np.repeat(cuts_a, cuts_b - starts_b)
    digits = _digits(int(max(a.max(), b.max())) + 1)
    rows = np.empty((len(a) + len(b), digits.shape[1] + 1), dtype=np.uint8)
    rows[at_a, :-1], rows[at_b, :-1] = digits[a], digits[b]
    rows[:, -1] = ord(",")
    rows[at_a[cuts_a - 1], -1] = ord("|")
    rows[at_b[cuts_b - 1], -1] = ord(";")
    return rows[rows != 0].tobytes()[:-1]


_DIGITS = np.empty((0, 0), dtype=np.uint8)


def _digits(n: int) -> np.ndarray:
    """The decimal digits of 0 to n - 1 at least, a row each with zero bytes after them, made once a worker."""
    global _DIGITS
    if len(_DIGITS) < n:
        shown = np.array(list(map(str, range(max(n, 65_536)))), dtype=bytes)
        _DIGITS = shown.view(np.uint8).reshape(len(shown), -1)
    return _DIGITS


def linked_pairs(
    a: np.ndarray, b: np.ndarray, cuts_a: np.ndarray, cuts_b: np.ndarray, at_once: int = LINKS_AT_ONCE
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(pairs, times) with every linked id pair of a document once, and how many links it has.

    One yield for a document of up to ``at_once`` links. With more, ids are
    counted within their groups before they are paired, and the A ids are gone through in
    classes, so that the yields share no pair and each spreads out about ``at_once`` pairs
    (one A id alone pairs with no more than the document's B tokens).
    """
    starts_a, starts_b = np.append(0, cuts_a[:-1]), np.append(0, cuts_b[:-1])
    n_a, n_b = cuts_a - starts_a, cuts_b - starts_b
    if (n_a * n_b).sum() <= at_once:
        mine, at = _spread(np.repeat(starts_b, n_a), np.repeat(n_b, n_a))
        yield np.unique(a[mine] * SHIFT + b[at], return_counts=True)
        return
    groups = np.arange(len(n_a))
    ua, ca = np.unique(np.repeat(groups, n_a) * SHIFT + a, return_counts=True)
    ub, cb = np.unique(np.repeat(groups, n_b) * SHIFT + b, return_counts=True)
    group, ids = ua // SHIFT, ua % SHIFT
    first = np.searchsorted(ub, groups * SHIFT)
    width = np.diff(first, append=len(ub))
    classes = -(-int(width[group].sum()) // at_once)
    for c in range(classes):
        pick = np.flatnonzero(ids % classes == c)
        if len(pick):
            mine, at = _spread(first[group[pick]], width[group[pick]])
            pairs, where = np.unique(ids[pick][mine] * SHIFT + ub[at] % SHIFT, return_inverse=True)
            times = np.zeros(len(pairs), dtype=np.int64)
            np.add.at(times, where, ca[pick][mine] * cb[at])
            yield pairs, times


def _spread(first: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each k, ``width[k]`` rows (k, first[k]), (k, first[k] + 1), ..."""
    mine = np.repeat(np.arange(len(width)), width)
    return mine, np.arange(len(mine)) + np.repeat(first - (np.cumsum(width) - width), width)


def byte_alphabet() -> dict[str, int]:
    """The characters in which a byte-level vocabulary writes bytes: printable Latin-1 as it is, the others from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in set(plain)]
    return {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(rest)}


class Tokenizers:
    """Both tokenizers of a worker, made from the contents of their public files, with the bytes of every token."""

    def __init__(self, byte_level: str, pieces: bytes, use_ranks: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task a core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        alphabet = byte_alphabet()
        vocabulary = self.a.get_vocab()
        self.bytes_a = [b""] * (1 + max(vocabulary.values()))
        for token, k in vocabulary.items():
            if all(c in alphabet for c in token):
                self.bytes_a[k] = bytes(map(alphabet.__getitem__, token))
        self.bytes_b = []
        for k in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(k)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(k) else piece.replace("▁", " ").encode())
        self.lengths_a, self.lengths_b = (np.array(list(map(len, x)), dtype=np.int64) for x in (self.bytes_a, self.bytes_b))
        self.by_rank = None
        if use_ranks:
            import tiktoken

            ranks = {token: k for k, token in enumerate(self.bytes_a) if token}
            self.by_rank = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ranks_agree(self, byte_level: str) -> bool:
        """Whether an encoder that merges whatever pair makes the token of lowest id encodes as A does.

        So it is if A cuts by the byte-level pattern and changes nothing, ids follow the order of its merges, and each
        token, met alone, is encoded as itself: then a pair that makes a token is always that of its rule.
        """
        made = json.loads(byte_level)
        split, merges = made.get("pre_tokenizer") or {}, made["model"].get("merges") or []
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        if (
            made.get("normalizer") is not None or split.get("type") != "ByteLevel" or not split.get("use_regex") or split.get("add_prefix_space")
            or [vocabulary.get(x + y) for x, y in pairs] != list(range(256, 256 + len(pairs)))
        ):
            return False
        pieces = regex.compile(PATTERN).findall
        for k, token in enumerate(self.bytes_a[: 256 + len(pairs)]):
            text = token.decode("utf-8", "replace")
            if text.encode() == token and pieces(text) == [text] and self.a.encode(text, add_special_tokens=False).ids != [k]:
                return False
        return True

    unusual = re.compile(r"[^\x00-\u024f]|\s{400}").search

    def quick(self, text: str) -> bool:
        """Whether the quicker encoder takes a text: not with characters that are not long classified the same way in Unicode, nor with very long words."""
        return self.by_rank is not None and not self.unusual(text) and max(map(len, text.split()), default=0) < 400

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of each text by both; None for an empty text or where joined token bytes differ from a blank and the text."""
        quicks = list(map(self.quick, texts))
        slow = iter(self.a.encode_batch_fast([" " + t for t, quick in zip(texts, quicks) if not quick], add_special_tokens=False))
        for text, quick, b in zip(texts, quicks, self.b.encode(texts, num_threads=1)):
            raw = b" " + text.encode()
            a = self.by_rank(" " + text) if quick else next(slow).ids  # the quicker encoder cuts bytes and never changes them
            same = text and b"".join(map(self.bytes_b.__getitem__, b)) == raw and (quick or b"".join(map(self.bytes_a.__getitem__, a)) == raw)
            yield (np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)) if same else None


def _sub_batches(texts: list[str]) -> Iterator[list[str]]:
    held, points = [], 0
    for t in texts:
        held.append(t)
        points += len(t)
        if len(held) == TEXTS_AT_ONCE or points >= POINTS_AT_ONCE:
            yield held
            held, points = [], 0
    if held:
        yield held


#: A worker's tokenizers outlive a task.
_READY: dict[str, Tokenizers] = {}


def align_texts(
    spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text: str = "text",
    byte_level: str = BYTE_LEVEL, pieces: str = PIECES, at_once: int = LINKS_AT_ONCE,
) -> DataFrame:
    """The alignment of every whole text, written to the shared folder.

    Columns ``row`` (a number of its own for each row of ``docs``), the id,
    ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups_sha256``, and the
    distinct linked id pairs, ``pairs`` (A's id times 2^32 plus B's) with
    ``times``, how often each is linked. A document of very many links has further rows
    with other pairs of it, whose numbers are null.

    The files are read on the driver and sent to the workers, which need no
    folder of their own for them. Where A's merges allow it, a quicker encoder of the same
    vocabulary stands in for it.
    """
    small_batches(spark)
    with open(byte_level, encoding="utf-8") as f, open(pieces, "rb") as g:
        files, name = (f.read(), g.read()), uuid.uuid4().hex
    shared = spark.sparkContext.broadcast((*files, Tokenizers(*files).ranks_agree(files[0])))

    def aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if name not in _READY:
            _READY.clear()
            _READY[name] = Tokenizers(*shared.value)
        both = _READY[name]
        for frame in batches:
            texts = [t or "" for t in frame["text"]]
            coded = (x for part in _sub_batches(texts) for x in both.encode(part))
            out, size = [], 0
            for row, key, ids in zip(frame["row"], frame["key"], coded):
                key = None if pd.isna(key) else key
                if not ids:
                    out.append((row, key, 0, 0, 0, 0, "", [], []))
                    continue
                a, b = ids
                cuts_a, cuts_b = align(np.cumsum(both.lengths_a[a]).tolist(), np.cumsum(both.lengths_b[b]).tolist())
                digest = hashlib.sha256(groups_text(a, b, cuts_a, cuts_b)).hexdigest()
                n_links = int((np.diff(cuts_a, prepend=0) * np.diff(cuts_b, prepend=0)).sum())
                numbers = (key, len(a), len(b), len(cuts_a), n_links, digest)
                for pairs, times in linked_pairs(a, b, cuts_a, cuts_b, at_once):
                    out.append((row, *numbers, pairs, times))
                    numbers = (None,) * 6
                    size += len(pairs)
                    if size > at_once:
                        yield pd.DataFrame(out, columns=names)
                        out, size = [], 0
            if out:
                yield pd.DataFrame(out, columns=names)

    kind = docs.schema[id_col].dataType.simpleString()
    names = ["row", "key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
    schema = f"row long, key {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("key"), F.col(text).cast("string").alias("text"))
    return materialise(spark, rows.mapInPandas(aligned, schema), "align").withColumnRenamed("key", id_col)


def pair_counts(spark: SparkSession, aligned: DataFrame) -> DataFrame:
    """(``pair``, ``n_docs``, ``best``) of every linked id pair: how many documents hold it, and the most of any pair of its A id.

    Counts combine map-side. The window holds the partners of one A id, at most B's vocabulary.
    """
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n_docs"))
    of_a = Window.partitionBy(F.shiftright("pair", 32))
    return materialise(spark, counts.withColumn("best", F.max("n_docs").over(of_a)), "align-pairs")


def alignment_report(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", broadcast_pairs: int = BROADCAST_PAIRS, **options) -> DataFrame:
    """One row per row of ``docs``: id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``.

    A text is encoded by both tokenizers without special tokens, whose strings
    in a text are plain text. Byte offsets at which tokens of both end cut it into groups; all pairs of an A
    and a B token of a group are linked. A pair's count is the number of
    rows that hold it linked. ``n_best`` counts the links whose pair has its A id's highest count, ties
    included; ``count_sum`` adds the counts over all links. Texts that are
    null or empty, or that a tokenizer does not give back byte by byte, have no
    tokens: zeros and ''. Repeated rows, also those without an id, are documents of their own. An empty table gives no
    rows; other columns are not read.

    The table of pair counts grows with the variety of the texts, not with their
    number. Pairs of one document have the count 1 and stay out of it; what is left
    is counted, and broadcast up to ``broadcast_pairs``, else joined by a shuffle. The highest counts are one row per A id, at most its vocabulary.
    """
    aligned = align_texts(spark, docs, id_col=id_col, **options)
    counts = pair_counts(spark, aligned)
    often = counts.where("n_docs > 1").select("pair", "n_docs")
    best = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("best").alias("best"))
    if often.count() <= broadcast_pairs:
        often = F.broadcast(often)
    links = aligned.select("row", F.inline(F.arrays_zip("pairs", "times"))).toDF("row", "pair", "times")
    links = links.withColumn("a", F.shiftright("pair", 32)).join(often, "pair", "left").join(F.broadcast(best), "a")
    n = F.coalesce("n_docs", F.lit(1))
    sums = links.groupBy("row").agg(
        F.sum(F.when(n == F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(n * F.col("times")).alias("count_sum")
    )
    return aligned.where("n_a is not null").drop("pairs", "times").join(sums, "row", "left").select(
        id_col, "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256",
    )

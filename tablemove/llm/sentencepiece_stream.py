"""SentencePiece encoding and decoding by a streaming Viterbi search."""

from __future__ import annotations

import math
import re
import uuid
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemove.llm.common import small_batches

BLANK = "▁"  # how SentencePiece writes a blank
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: A character without a piece scores so much below the lowest piece, as in SentencePiece.
UNKNOWN_PENALTY = 10.0
#: Scores are rounded to multiples of its inverse: their sums are then exact, whatever the order, and ties are true ties.
GRAIN = 1 << 16
#: Characters fed to a search at a time.
STEP = 1024
#: Stretches whose ids a worker remembers at most, twice (about 180 bytes each; just under what a Python dict holds before it doubles).
MEMORY = 87_000
#: Longest stretch that is remembered.
SHORT = 64
#: New short stretches are searched in lockstep, from so many on and so many at a time.
FEW, MANY = 64, 8_192
#: Texts whose stretches are looked up together hold about so many characters (more only for a single longer text).
TOGETHER = 1 << 19
#: Lists of about so many ids are decoded together (more only for a single longer list): whole batches would take ten times their size.
DECODED = 1 << 16


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with scores; ``bytes_at`` is the id of each byte piece, or the unknown id if there are none."""

    pieces: dict[str, tuple[int, float]]
    surfaces: tuple[bytes, ...]
    bytes_at: tuple[int, ...]
    longest: int
    starts: dict[str, float]  # scores of the pieces; what only starts some: minus infinity, or as unknown if one character
    unknown_score: float

    @staticmethod
    def load(model_file: str) -> Vocabulary:
        """Read a public model file on the driver. Control and unknown pieces are never matched in a text.

        A unigram model's scores are log probabilities. A BPE model's are merge ranks, all whole numbers
        from 0 down; by Zipf's law a piece of rank r gets the log probability -log(2 + r), but for a constant.
        """
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=model_file)
        normal, surfaces, at = [], [], [m.unk_id()] * 256
        for i in range(m.get_piece_size()):
            piece = m.id_to_piece(i)
            if m.is_byte(i):
                at[int(piece[3:5], 16)] = i
                surfaces.append(bytes([int(piece[3:5], 16)]))
            elif m.is_control(i) or m.is_unknown(i) or m.is_unused(i):
                surfaces.append("�".encode() if m.is_unknown(i) else b"")
            else:
                normal.append((piece, i, float(m.get_score(i))))
                surfaces.append(piece.encode())
        if all(score == int(score) <= 0 for _, _, score in normal):
            normal = [(p, i, -math.log(2 - score)) for p, i, score in normal]
        return Vocabulary.of(normal, surfaces, at)

    @staticmethod
    def of(normal: Iterable[tuple[str, int, float]], surfaces: Iterable[bytes], bytes_at: Iterable[int]) -> Vocabulary:
        pieces = {p: (i, round(s * GRAIN) / GRAIN) for p, i, s in normal}
        lowest = min((s for _, s in pieces.values()), default=0.0)
        unknown = lowest - UNKNOWN_PENALTY
        starts = {p[:k]: -math.inf if k > 1 else unknown for p in pieces for k in range(1, len(p))} | {p: score for p, (_, score) in pieces.items()}
        return Vocabulary(pieces, tuple(surfaces), tuple(bytes_at), max(map(len, pieces), default=1), starts, unknown)

    def stretches(self) -> re.Pattern:
        """Cuts a text, its blanks unreplaced, where no piece can cross: before blanks that follow another character, if no
        piece has a blank after one, and around line ends, if no piece holds one. Else the whole text is one stretch."""
        if any(BLANK in p.lstrip(BLANK) for p in self.pieces):
            return re.compile("(?s).+")
        if any("\n" in p and p != "\n" for p in self.pieces):
            return re.compile(" +[^ ]*|[^ ]+")
        return re.compile("\n| +[^ \n]*|[^ \n]+")

    def pairs(self) -> set[str]:
        """Neighbouring characters within pieces. No piece can cross any other two neighbours in a text."""
        return {p[k : k + 2] for p in self.pieces for k in range(len(p) - 1)}

    @cached_property
    def tree(self) -> Tree:
        return Tree.of(self)


@dataclass(frozen=True)
class Tree:
    """A vocabulary's starts of pieces as arrays. Nodes are numbered from 1, 0 is none; so are the characters."""

    kinds: np.ndarray  # number of each character by code point; the last entry stands for all beyond
    first: np.ndarray  # node of each character that starts a piece
    width: int  # a node's number times this, and the next character's, make an edge
    edges: np.ndarray  # hash table of edges, -1 if free
    nodes: np.ndarray  # the node an edge leads to
    scores: np.ndarray  # of nodes, as in ``starts``; of 0 as for an unknown character
    ids: np.ndarray  # of nodes that are pieces, else -1

    @staticmethod
    def of(v: Vocabulary) -> Tree:
        node = {s: k for k, s in enumerate(v.starts, 1)}
        kind = {c: k for k, c in enumerate(sorted(set().union(*v.starts)), 1)}
        kinds = np.zeros(max(map(ord, kind), default=0) + 2, np.int32)
        kinds[[*map(ord, kind)]] = [*kind.values()]
        first = np.zeros(len(kind) + 1, np.int32)
        size = 1 << (4 * len(node) + 64).bit_length()
        edges, nodes = [-1] * size, [0] * size
        for s, k in node.items():
            if len(s) == 1:
                first[kind[s]] = k
                continue
            edge = node[s[:-1]] * len(first) + kind[s[-1]]
            at = Tree.place(edge, size)
            while edges[at] >= 0:
                at = (at + 1) % size
            edges[at], nodes[at] = edge, k
        ids = [-1] + [v.pieces[s][0] if s in v.pieces else -1 for s in node]
        scores = np.array([v.unknown_score, *v.starts.values()])
        return Tree(kinds, first, len(first), np.array(edges, np.int64), np.array(nodes, np.int32), scores, np.array(ids))

    @staticmethod
    def place(edge, size: int):
        return (edge * 0x9E3779B1 >> 15) & (size - 1)

    def down(self, node: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """The nodes that characters lead to from nodes, 0 if none."""
        edge = node.astype(np.int64) * self.width + kind
        at = self.place(edge, len(self.edges))
        there = self.edges[at]
        found = np.where(there == edge, self.nodes[at], 0)
        open_ = np.flatnonzero((there != edge) & (there >= 0))
        while open_.size:
            at[open_] = (at[open_] + 1) & (len(self.edges) - 1)
            there = self.edges[at[open_]]
            hit = there == edge[open_]
            found[open_[hit]] = self.nodes[at[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
        return found

    def search(self, stretches: list[str], code: str) -> list[bytes | None]:
        """Packed ids of many stretches (none empty, blanks unreplaced): the search of ``StreamingViterbi`` in lockstep,
        all paths of all stretches extended by a character at a time. None where a best path has a character without a piece."""
        n = len(stretches)
        size = np.fromiter(map(len, stretches), np.int64, n)
        order = np.argsort(-size, kind="stable")
        size, begin = size[order], (np.cumsum(size) - size)[order]
        # Boundaries lie in rows by their place in the stretch, the longest stretch first: place j has the first wide[j] stretches.
        wide = np.searchsorted(-size, -np.arange(size[0] + 2), side="right")
        row = np.append(0, np.cumsum(wide))
        points = np.frombuffer("".join(stretches).replace(" ", BLANK).encode("utf-32-le", "surrogatepass"), np.uint32)
        points = self.kinds[np.minimum(points, len(self.kinds) - 1)]
        kind = np.zeros(row[-1], np.int32)  # of the character after each boundary, 0 at the end
        here = np.ones(row[-1], bool)
        for j, w in enumerate(wide[1:].tolist()):
            kind[row[j] : row[j] + w] = points[begin[:w] + j]
            here[row[j] + w : row[j + 1]] = False
        after = (np.arange(row[-1]) + np.repeat(wide, wide)).astype(np.int32)  # the next boundary of the same stretch
        start = np.flatnonzero(here).astype(np.int32)
        node, end, steps = self.first[kind[start]], after[start], []
        while start.size:
            value = self.scores[node]
            real = np.flatnonzero(value > -math.inf)
            steps.append((start[real], end[real], value[real], node[real]))
            go = np.flatnonzero((node > 0) & (kind[np.minimum(end, len(kind) - 1)] > 0))
            start, end, node = start[go], end[go], node[go]
            node = self.down(node, kind[end])
            go = np.flatnonzero(node)
            start, end, node = start[go], after[end[go]], node[go]
        score, back, by = np.full(row[-1], -math.inf), np.zeros(row[-1], np.int32), np.zeros(row[-1], np.int32)
        score[:n] = 0
        parts = [(*s, np.searchsorted(s[0], row).tolist()) for s in steps]
        for j in range(size[0]):
            for start, end, value, node, cut in parts:
                a, b = cut[j], cut[j + 1]
                if a < b:
                    total, to = score[start[a:b]] + value[a:b], end[a:b]
                    more = np.flatnonzero(total > score[to])
                    to = to[more]
                    score[to], back[to], by[to] = total[more], start[a:b][more], node[a:b][more]
        at, column, found = row[size] + np.arange(n), np.arange(n), []
        while column.size:
            found.append((column, self.ids[by[at]]))
            at = back[at]
            go = np.flatnonzero(at >= n)
            at, column = at[go], column[go]
        column, ids = (np.concatenate(x) for x in zip(*found))
        turn = np.repeat(np.arange(len(found)), [len(c) for c, _ in found])
        many = np.bincount(column, minlength=n)
        stop = np.cumsum(many)
        packed = np.empty(len(ids), code)
        packed[stop[column] - 1 - turn] = np.maximum(ids, 0)
        whole, each = packed.tobytes(), packed.itemsize
        out: list[bytes | None] = [None] * n
        for k, a, b in zip(order.tolist(), ((stop - many) * each).tolist(), (stop * each).tolist()):
            out[k] = whole[a:b]
        for k in order[np.unique(column[ids < 0])].tolist():
            out[k] = None
        return out


@dataclass
class StreamingViterbi:
    """Feeds on text piece by piece and gives out ids as soon as they are certain.

    The segmentation has the largest sum of scores; of equal ones, that whose
    last piece is longest, and so on backwards. Kept are the characters and back
    pointers since the last committed boundary, and open ends within the longest
    piece. When the paths to all open ends run through one boundary, what lies
    before it is committed and forgotten.
    """

    vocabulary: Vocabulary
    text: str = ""  # since the last committed boundary
    score: list[float] = field(default_factory=lambda: [0.0])
    back: list[int] = field(default_factory=lambda: [0])  # where the last piece starts
    done: int = 0  # starts up to here have been extended
    reach: int = 0  # the farthest open end
    wait: int = 0  # no search for a shared boundary before so many starts are extended
    held: int = 0  # most characters ever held

    def push(self, more: str, last: bool = False) -> list[int]:
        """Ids that are certain after ``more``; with ``last``, all the rest."""
        v, out = self.vocabulary, []
        self.text += more
        self.score += [-math.inf] * (len(self.text) + 1 - len(self.score))
        self.back += [0] * (len(self.text) + 1 - len(self.back))
        longest = v.longest
        if last and not self.done and len(self.text) <= 4 * longest:  # fits in the window: committed at the end
            self._extend(len(self.text))
            return self._commit(len(self.text))
        behind = 0 if last else longest - 1  # starts whose longest piece may not have come yet
        while self.done < len(self.text) - behind:
            self.held = max(self.held, len(self.text))
            self._extend(min(self.done + longest, len(self.text) - behind))
            if self.reach == self.done or self.done >= max(2 * longest, self.wait):
                out += self._commit(self._meeting())
                self.wait = 2 * self.done  # what stays open is walked again only when it has doubled
        return out + self._commit(len(self.text)) if last else out

    def _extend(self, stop: int) -> None:
        """Extend the paths to all starts before ``stop`` by each piece that comes next, or one unknown character."""
        text, score, back, reach = self.text, self.score, self.back, self.reach
        get, unknown, ends = self.vocabulary.starts.get, self.vocabulary.unknown_score, len(text) + 1
        for at in range(self.done, stop):
            here, end = score[at], at + 1
            value = get(text[at])
            total = here + (unknown if value is None else value)
            if total > score[end]:
                score[end], back[end] = total, at
            if value is not None:
                for end in range(at + 2, ends):
                    value = get(text[at:end])
                    if value is None:
                        end -= 1
                        break
                    total = here + value
                    if total > score[end]:
                        score[end], back[end] = total, at
            if end > reach:
                reach = end
        self.done, self.reach = stop, reach

    def _meeting(self) -> int:
        """The last boundary that the best paths to all open ends share."""
        ends = {e for e in range(self.done, self.reach + 1) if self.score[e] > -math.inf}
        while len(ends) > 1:
            far = max(ends)
            ends.remove(far)
            ends.add(self.back[far])
        return ends.pop()

    def _commit(self, to: int) -> list[int]:
        if not to:
            return []
        ids: list[int] = []
        at, pieces = to, self.vocabulary.pieces
        while at:
            start = self.back[at]
            piece = pieces.get(self.text[start:at])
            if piece:
                ids.append(piece[0])
            else:
                ids.extend(self.vocabulary.bytes_at[b] for b in reversed(self.text[start:at].encode("utf-8", "replace")))
            at = start
        self.text = self.text[to:]
        self.score = self.score[to:]
        self.back = [max(0, s - to) for s in self.back[to:]]
        self.done, self.reach = max(0, self.done - to), max(0, self.reach - to)
        return ids[::-1]


class Codec(dict):
    """Encodes and decodes whole texts; remembers the ids of stretches between certain boundaries, as packed integers.

    Holds at most ``memory`` stretches twice: when full, it starts anew and
    takes over what is met again from the last filling. Stretches are kept with their blanks, as
    Python stores most of them with a byte a character then, and ids of two bytes where all fit.
    """

    def __init__(self, vocabulary: Vocabulary, memory: int | None = None):
        super().__init__()
        self.vocabulary, self.cut, self.pairs, self.before = vocabulary, vocabulary.stretches().findall, vocabulary.pairs(), {}
        self.memory = MEMORY if memory is None else memory
        known = {*(i for i, _ in vocabulary.pieces.values()), *vocabulary.bytes_at}
        self.code = "H" if all(0 <= i < 1 << 16 for i in known) else "i"

    def __missing__(self, stretch: str) -> bytes:
        packed = self.before.get(stretch)
        if packed is None:
            pairs, marked = self.pairs, stretch.replace(" ", BLANK)
            cuts = [k for k in range(1, len(marked)) if marked[k - 1 : k + 1] not in pairs]
            if cuts:
                packed = b"".join([self[stretch[i:j]] for i, j in zip([0, *cuts], [*cuts, len(stretch)])])
            else:
                search, ends = StreamingViterbi(self.vocabulary), range(STEP, len(stretch) + STEP, STEP)
                packed = b"".join([array(self.code, search.push(marked[e - STEP : e], e >= len(marked))).tobytes() for e in ends])
        self._remember(stretch, packed)
        return packed

    def _remember(self, stretch: str, packed: bytes) -> None:
        if len(stretch) <= SHORT:
            if len(self) >= self.memory:
                self.before = dict(self)
                self.clear()
            self[stretch] = packed

    def _known(self, stretches: Iterable[str]) -> dict[str, bytes]:
        """Packed ids of each distinct stretch: remembered ones, new short ones by searches in lockstep, others one at a time."""
        known = dict.fromkeys(stretches)
        known = dict(zip(known, map(self.get, known)))
        new = [s for s, packed in known.items() if packed is None]
        short = [s for s in new if len(s) <= SHORT and s not in self.before]
        if len(short) >= FEW:
            for k in range(0, len(short), MANY):
                part = short[k : k + MANY]
                known.update(zip(part, self.vocabulary.tree.search(part, self.code)))
        for s in new:
            packed = known[s] or self.before.get(s)
            if packed:
                self._remember(s, packed)
            known[s] = packed or self[s]
        return known

    def encode_all(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """Ids of each text: a blank is put before it, blanks become U+2581; nothing else is normalised. An empty text has none."""
        waiting: list[list[str]] = []
        size = 0
        for text in chain(texts, [None]):
            if text is not None:
                waiting.append(self.cut(" " + text.replace(BLANK, " ")) if text else [])
                size += len(text)
            if size >= TOGETHER or text is None:
                find = self._known(chain.from_iterable(waiting)).__getitem__
                for stretches in waiting:
                    yield np.frombuffer(b"".join(map(find, stretches)), dtype=self.code).astype(np.intc)
                waiting, size = [], 0

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_all([text]))

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: the leading blank goes, U+2581 becomes a blank, bytes that are no UTF-8 become U+FFFD."""
        text = b"".join(map(self.vocabulary.surfaces.__getitem__, ids)).decode("utf-8", "replace").replace(BLANK, " ")
        return text[1:] if text[:1] == " " else text


_CODECS: dict[tuple, Codec] = {}


def _codec(key: tuple, vocabulary: Vocabulary) -> Codec:
    """The worker's codec for a vocabulary: its memory outlives a task, so that the next one starts with common words known."""
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(vocabulary)
    return _CODECS[key]


def _decoded(lists: pa.Array, surfaces: pa.Array) -> pa.Array:
    """``Codec.decode`` of each list, whole arrays at a time; the last surface is empty, for ids that are passed over."""
    ids = pc.cast(lists.flatten(), pa.float64(), safe=False).to_numpy(zero_copy_only=False)
    ids = np.where((ids >= 0) & (ids < len(surfaces) - 1), ids, len(surfaces) - 1).astype(np.int32)
    ends = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)))
    parts = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), surfaces.take(pa.array(ids)))
    joined = pc.binary_join(parts, pa.scalar(b"", surfaces.type))
    try:
        text = joined.cast(pa.large_string())
    except pa.ArrowInvalid:  # bytes that are no UTF-8
        text = pa.array([b.decode("utf-8", "replace") for b in joined.to_pylist()], pa.large_string())
    text = pc.replace_substring(text, BLANK, " ")
    return pc.if_else(pc.starts_with(text, " "), pc.utf8_slice_codeunits(text, 1), text)


def encode(spark: SparkSession, docs: DataFrame, *, text: str = "text", model_file: str = MODEL, ids: str = "ids", memory: int | None = None) -> DataFrame:
    """``docs`` with an array column ``ids``: the ids of each whole text (null or empty: no ids).

    A text of any length takes memory in proportion to itself only. Repeated
    rows get equal ids. An input column of that name is replaced, all others
    stay; an empty table gives no rows. The vocabulary (some 10,000 pieces, as
    the model file has them) goes to the workers with the task. A worker remembers ``MEMORY`` stretches,
    twice, also for the tasks that follow; new short ones of many texts are searched together. With ``memory``, each task remembers so many of its own, twice, and forgets them at its
    end: the worker, which lives on into other jobs, does not keep them. The ids are the same.
    """
    small_batches(spark)
    vocabulary = Vocabulary.load(model_file)
    _ = vocabulary.tree  # made once, and sent along
    shared, key = spark.sparkContext.broadcast(vocabulary), (model_file, uuid.uuid4().hex)

    @F.pandas_udf("array<int>")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(key, shared.value) if memory is None else Codec(shared.value, memory)
        for s in texts:
            yield pd.Series([*codec.encode_all(t or "" for t in s)], dtype=object)

    return docs.withColumn(ids, of(F.col(text).cast("string")))


def decode(spark: SparkSession, rows: DataFrame, *, ids: str = "ids", text: str = "text", model_file: str = MODEL) -> DataFrame:
    """``rows`` with a text column made from ``ids`` (null: empty; ids that the vocabulary lacks, or null, are passed over)."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(Vocabulary.load(model_file).surfaces)

    @F.arrow_udf("string")
    def of(lists: Iterator[pa.Array]) -> Iterator[pa.Array]:
        surfaces = pa.array([*shared.value, b""], pa.large_binary())
        for x in lists:
            ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(x), 0).cast(pa.int64())).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(ends // DECODED)) + 1).tolist(), len(x)]
            yield pa.concat_arrays([_decoded(x[a:b], surfaces).cast(pa.string()) for a, b in zip(cuts, cuts[1:])])

    return rows.withColumn(text, of(F.col(ids)))

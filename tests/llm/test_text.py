"""Quality, mixing, SentencePiece and chat formatting."""

import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablemove.llm import chat, mixing, quality, sentencepiece_stream as sp
from tests.llm.helpers import LABELS, ODD, SF, docs, good_and_bad


# ------------------------------------------------------------------ quality
def test_quality_held_out_accuracy(spark):
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.score_documents(spark, d, labels).join(labels, "doc_id").select("held_out", "predicted", "quality").collect()
    held = [r.predicted == r.quality for r in got if r.held_out]
    assert len(held) > 10 and np.mean(held) >= 0.9


def test_quality_odd_rows(spark):
    rows, labels = good_and_bad()
    table = docs(spark, rows + ODD)
    marks = spark.createDataFrame(labels + [(100, None, 0), (101, 0, 0), (101, 1, 0), (None, 1, 1)], LABELS)
    out = quality.score_documents(spark, table, marks)
    assert set(out.columns) == set(table.columns) | {"held_out", "score", "predicted"}
    got = out.select("doc_id", "score", "predicted", "held_out").collect()
    assert len(got) == len(rows) + len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1  # null, empty and blank alike
    by = {r.doc_id: r.predicted for r in got}
    assert np.mean([by[i] == q for i, q, _ in labels]) >= 0.95
    kept = quality.keep_good(spark, table, marks)
    assert kept.columns == table.columns and kept.count() == sum(r.predicted for r in got)


def test_quality_learns_nothing_from_held_out(spark):
    rows, labels = good_and_bad()
    marks = spark.createDataFrame(labels, LABELS)
    table = docs(spark, rows)
    flipped = marks.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.learn(spark, table, m) for m in (marks, flipped))
    assert (a.weights == b.weights).all() and a.cut == b.cut


@pytest.mark.parametrize("keep", ["none", "good"])
def test_quality_one_or_no_label(spark, keep):
    rows, labels = good_and_bad(20)
    marks = spark.createDataFrame([x for x in labels if keep == "good" and x[1] == 1], LABELS)
    got = quality.score_documents(spark, docs(spark, rows), marks).collect()
    assert len(got) == 20 and all(r.predicted == 1 for r in got)
    assert quality.score_documents(spark, docs(spark, []), marks).count() == 0


def test_quantile_between_labels():
    s, y = np.array([0.0, 1, 2, 3, 4, 5]), np.array([0, 0, 0, 1, 1, 1])
    assert quality.best_quantile(s, y) == (2.5, 0.5)


def test_quality_cut_is_placed_by_all_labels(spark):
    """With a small sample, the fit is the sample's, but the cut is the best over all labelled rows."""
    rows = [(i, " ".join("brook%" if (i * 7 + k * 37) % 100 < i % 100 else "brook" for k in range(100))) for i in range(400)]
    labels = [(i, int(i % 100 < 50), 0) for i in range(400)]
    table, marks = docs(spark, rows), spark.createDataFrame(labels, LABELS)
    one = marks.where(~quality.held_out()).select("doc_id", F.col("quality").alias("_y"))
    sample = quality.sample_features(spark, quality.balanced_sample(table.select("doc_id", "text"), one, 12), "text", "_y")
    part, whole = quality.fit(sample[0], np.array(sample[1])), quality.learn(spark, table, marks, sample_rows=12)
    assert (part.weights == whole.weights).all() and part.cut != whole.cut
    x, y = quality.sample_features(spark, quality.labelled_sample(table.select("doc_id", "text"), one, 400), "text", "_y")
    y = np.array(y)
    error = lambda cut: np.mean(whole.strength(x)[y == 1] < cut) + np.mean(whole.strength(x)[y == 0] >= cut)
    assert error(whole.cut) < error(part.cut)
    assert abs(error(whole.cut) - error(quality.best_quantile(whole.strength(x), y)[0])) < 1e-9
    assert abs(whole.quantile - np.mean(whole.strength(x) < whole.cut)) < 1e-9


# ------------------------------------------------------------------ mixing
def test_rates_meet_targets(spark):
    rng = np.random.default_rng(8)
    p = rng.dirichlet([0.2, 0.3, 0.4], 400)
    tokens = rng.integers(0, 500, 400)
    table = spark.createDataFrame([(int(t), [float(v) for v in x]) for t, x in zip(tokens, p)], "tokens long, p array<double>")
    for share in ([0.5, 0.3, 0.2], [0.1, 0.1, 0.8]):
        target = np.array(share) * tokens.sum()
        r = mixing.rates(p, mixing.fit_rates(spark, table, target, 50.0), 50.0)
        assert (r >= 0).all() and np.abs((tokens * r) @ p - target).max() < 1e-3 * tokens.sum()


def test_rates_with_targets_out_of_reach_are_least_squares(spark):
    p, tokens, target = np.eye(2)[[0, 0, 1]], np.array([10, 10, 10]), np.array([5.0, 90.0])
    table = spark.createDataFrame([(int(t), x.tolist()) for t, x in zip(tokens, p)], "tokens long, p array<double>")
    r = mixing.rates(p, mixing.fit_rates(spark, table, target, 2.0), 2.0)
    assert np.allclose(r, [0.25, 0.25, 2.0], atol=1e-4)


def test_mix_meets_the_target_of_a_rare_domain(spark, caplog):
    """A domain with under an eighth of its target share is repeated as often as it takes; a caller's bound is told of."""
    rows, labels = good_and_bad(300)
    table = docs(spark, [(i, t if x[2] else f"{t} " * 20) for (i, t), x in zip(rows, labels)])
    marks = mixing.label_domains(spark.createDataFrame(labels, LABELS))
    weights = {"clean": 0.5, "junk": 0.2, "toxic": 0.3}
    for bound, met in (({}, True), ({"most": 2.0}, False)):
        caplog.clear()
        got = mixing.assign(spark, table, marks, weights, **bound).collect()
        total = sum(r.tokens for r in got)
        shares = {k: sum(r.tokens * r.rate * r[f"p_{k}"] for r in got) / total for k in weights}
        assert sum(r.tokens * r.p_toxic for r in got) / total < 0.3 / 8
        assert all(abs(shares[k] - weights[k]) < 1e-3 for k in weights) == met, shares
        assert max(r.rate for r in got) > 8 if met else max(r.rate for r in got) == 2
        assert ("mixing misses its targets" in caplog.text and "toxic" in caplog.text) != met


def test_mix_odd_rows(spark):
    rows, labels = good_and_bad(90)
    table, marks = docs(spark, rows + ODD), spark.createDataFrame(labels + [(None, 1, 0), (100, None, 1)], LABELS)
    got = mixing.assign(spark, table, mixing.label_domains(marks), {"clean": 0.5, "junk": 0.4, "toxic": 0.1}).collect()
    assert len(got) == len(rows) + len(ODD)
    assert all(abs(r.p_clean + r.p_junk + r.p_toxic - 1) < 1e-9 and r.rate >= 0 and abs(r.copies - r.rate) < 1 for r in got)
    want = {i: "toxic" if t else "clean" if q else "junk" for i, q, t in labels}
    hit = [max(("clean", "junk", "toxic"), key=lambda k: r[f"p_{k}"]) == want[r.doc_id] for r in got if r.doc_id in want]
    assert np.mean(hit) > 0.9
    total = sum(r.tokens for r in got)
    assert abs(sum(r.tokens * r.rate * r.p_junk for r in got) / total - 0.4) < 0.01
    again = mixing.assign(spark, table, mixing.label_domains(marks), {"clean": 0.5, "junk": 0.4, "toxic": 0.1}).collect()
    assert sorted(map(str, [(r.doc_id, r.copies) for r in got])) == sorted(map(str, [(r.doc_id, r.copies) for r in again]))
    out = mixing.mix(spark, table, mixing.label_domains(marks), {"clean": 0.5, "junk": 0.4, "toxic": 0.1})
    assert out.columns == table.columns
    assert out.where("doc_id >= 100").count() == sum(r.copies for r in got if (r.doc_id or 0) >= 100)


def test_mix_without_labels_or_rows(spark):
    none = mixing.label_domains(spark.createDataFrame([], LABELS))
    got = mixing.assign(spark, docs(spark, ODD), none, {"clean": 1.0, "junk": 1.0}).collect()
    assert len(got) == len(ODD) and len({round(r.rate, 9) for r in got}) == 1
    assert mixing.mix(spark, docs(spark, []), none, {"clean": 1.0}).count() == 0


# ------------------------------------------------------------------ SentencePiece
@pytest.fixture(scope="module")
def vocabulary():
    return sp.Vocabulary.load(sp.MODEL)


def brute_viterbi(v, text):
    """Plain search over the whole text; of equal sums, the longest last piece."""
    best = [(0.0, 0, -1)] + [(-np.inf, 0, -1)] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - v.longest), end):
            hit = v.pieces.get(text[start:end], (-1, v.unknown_score) if end == start + 1 else None)
            if hit and best[start][0] + hit[1] > best[end][0]:
                best[end] = (best[start][0] + hit[1], start, hit[0])
    ids, at = [], len(text)
    while at:
        _, start, piece = best[at]
        ids += [piece] if piece >= 0 else [v.bytes_at[b] for b in reversed(text[start:at].encode())]
        at = start
    return ids[::-1]


TEXTS = ["a", "  a  b\n\tc ", "Étion dans la vie", "中文 \U0001f600 é", "thonblean | restat.\nFor ▁ it", "x" * 50, "\n\n", "aaaa bbbb" * 9, "\x00\x1c", "(a) b, c.d... &&&x -- \"it's\"\n.\n,a ,a | .", "a" + "." * 300 + "b"]


@pytest.mark.parametrize("text", TEXTS)
def test_encode_equals_whole_text_search(vocabulary, text):
    codec = sp.Codec(vocabulary)
    assert codec.encode(text).tolist() == brute_viterbi(vocabulary, sp.BLANK + text.replace(" ", sp.BLANK))
    assert codec.decode(codec.encode(text)) == text.replace(sp.BLANK, " ")


def test_stream_in_pieces_of_any_size_and_bounded_window():
    rng = random.Random(9)
    letters = "abc"
    pieces = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(1, 6))) for _ in range(60)} | set("ab"))
    v = sp.Vocabulary.of([(p, i, -rng.randrange(1, 40) * len(p) ** 0.5) for i, p in enumerate(pieces)], [p.encode() for p in pieces] + [b"?"] * 256, range(1000, 1256))
    for _ in range(60):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 400)))
        stream, ids, at = sp.StreamingViterbi(v), [], 0
        while at < len(text):
            step = rng.randrange(1, 30)
            ids += stream.push(text[at : at + step])
            at += step
        ids += stream.push("", last=True)
        assert ids == brute_viterbi(v, text)
    stream = sp.StreamingViterbi(v)
    for _ in range(3000):
        stream.push("".join(rng.choice(letters) for _ in range(10)))
    assert stream.held < 500  # of 30,000 characters


def test_memory_is_bounded_and_changes_no_ids(vocabulary, monkeypatch):
    monkeypatch.setattr(sp, "MEMORY", 50)
    rng, codec = random.Random(4), sp.Codec(vocabulary)
    for _ in range(400):
        text = " ".join("".join(rng.choice("aeinst") for _ in range(rng.randrange(1, 4))) for _ in range(5))
        assert codec.encode(text).tolist() == brute_viterbi(vocabulary, sp.BLANK + text.replace(" ", sp.BLANK))
        assert len(codec) <= 50 and len(codec.before) <= 50


def test_memory_is_dense(vocabulary):
    """A remembered word takes under 100 bytes besides its place in the dict (about 120 with wide characters and ids)."""
    rng, codec = random.Random(6), sp.Codec(vocabulary)
    for _ in range(200):
        codec.encode(" ".join("".join(rng.choice("aeinstrblm") for _ in range(rng.randrange(4, 9))) for _ in range(20)))
    assert len(codec) > 3000
    assert sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in codec.items()) < 100 * len(codec)


def test_ids_over_two_bytes_are_kept():
    v = sp.Vocabulary.of([("a", 7, -1.0), (sp.BLANK, 70_000, -1.0)], [b"?"], range(256))
    assert sp.Codec(v).encode("a a").tolist() == sp.Codec(v, 1).encode("a a").tolist() == [70_000, 7, 70_000, 7]


def test_a_small_memory_gives_the_same_ids(spark):
    table = spark.createDataFrame([(i, f"word{i} and other{i * 7} things, {'x' * (i % 90)}") for i in range(600)], "doc_id long, text string")
    wide, small = (sp.encode(spark, table, **m).collect() for m in ({}, {"memory": 50}))
    assert sorted(wide) == sorted(small)


def test_new_words_are_searched_together(vocabulary, monkeypatch):
    """A search of its own for each new word set op3's cost: 1,500 words of these texts took as many."""
    pushed, push = [], sp.StreamingViterbi.push
    monkeypatch.setattr(sp.StreamingViterbi, "push", lambda self, *a: pushed.append(a[0]) or push(self, *a))
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choice("aeinstrblm.,'") for _ in range(rng.randrange(4, 12))) for _ in range(30)) for _ in range(50)]
    odd = ["", " ", "zß中文 \U0001f600\ud7ff a\U0001f600b", "x" * 64 + " " + "y" * 63 + "  " + "ab" * 70, *texts[:2], "\n\n a"]
    got = [x.tolist() for x in sp.Codec(vocabulary).encode_all(texts + odd)]
    assert len(pushed) < 50
    assert got == [brute_viterbi(vocabulary, sp.BLANK + t.replace(" ", sp.BLANK)) if t else [] for t in texts + odd]
    assert got == [x.tolist() for x in sp.Codec(vocabulary, 40).encode_all(texts + odd)]


def test_lockstep_equals_whole_text_search_where_sums_tie():
    rng = random.Random(12)
    for _ in range(30):
        pieces = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(40)})
        v = sp.Vocabulary.of([(p, i, -float(rng.randrange(1, 3))) for i, p in enumerate(pieces)], [p.encode() for p in pieces] + [b"?"] * 256, range(1000, 1256))
        words = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 40))) for _ in range(100)]
        want = [brute_viterbi(v, w) for w in words]
        unknown = [any(i >= 1000 for i in ids) for ids in want]
        assert [None if x is None else np.frombuffer(x, "i").tolist() for x in v.tree.search(words, "i")] == [None if u else ids for u, ids in zip(unknown, want)]


def test_decode_whole_batches(vocabulary, spark):
    """Bytes that are no UTF-8, nulls and strange ids are as in ``Codec.decode``."""
    codec, rng = sp.Codec(vocabulary), random.Random(3)
    lists = [codec.encode(t).tolist() for t in TEXTS] + [[rng.choice(vocabulary.bytes_at) for _ in range(9)] for _ in range(20)] + [[], [vocabulary.bytes_at[b] for b in " ▁a".encode()]]
    want = {k: codec.decode(x) for k, x in enumerate(lists)}
    for kind in ("int", "bigint", "double"):
        rows = [(k, [float(i) if kind == "double" else i for i in x]) for k, x in enumerate(lists)]
        table = spark.createDataFrame(rows, f"k int, ids array<{kind}>").coalesce(1)
        got = sp.decode(spark, table)
        assert {r.k: r.text for r in got.collect()} == want
    odd = spark.createDataFrame([(0, [None, -1, 10**12, lists[0][0], None]), (1, None), (2, [None])], "k int, ids array<bigint>")
    assert {r.k: r.text for r in sp.decode(spark, odd).collect()} == {0: codec.decode(lists[0][:1]), 1: "", 2: ""}


def test_decode_long_lists_of_one_batch(vocabulary, spark):
    texts = [f"{k} word, " * n for k, n in enumerate((1, 20_000, 3, 12_000, 0, 30_000, 2))]
    codec = sp.Codec(vocabulary)
    table = spark.createDataFrame([(t, codec.encode(t).tolist()) for t in texts] + [(None, None)], "t string, ids array<int>").coalesce(1)
    assert max(len(codec.encode(t)) for t in texts) > sp.DECODED
    assert sp.decode(spark, table).where("text <> coalesce(t, '')").count() == 0


def test_the_library_decodes_our_ids(vocabulary):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)
    codec = sp.Codec(vocabulary)
    for text in [t for t in TEXTS if sp.BLANK not in t]:
        assert m.decode(codec.encode(text).tolist()) == text
    words = "the quick brown fox and this is what they were saying about it".split()
    assert sum(codec.encode(w).tolist() == m.encode(w) for w in words) >= 10  # most common words have a piece of their own


def test_encode_table(spark):
    table = docs(spark, ODD)
    coded = sp.encode(spark, table)
    assert set(coded.columns) == set(table.columns) and coded.count() == len(ODD)
    back = {(r.doc_id, r.text): r for r in sp.decode(spark, coded, text="back").collect()}
    assert all(r.back == (t or "").replace(sp.BLANK, " ") for (_, t), r in back.items())
    assert back[1, None].ids == [] and back[2, ""].ids == []
    odd = spark.createDataFrame([([5, None, 99999, -1],), (None,), ([],)], "ids array<int>")
    assert [len(r.text) for r in sp.decode(spark, odd).collect()] == [1, 0, 0]
    assert sp.encode(spark, docs(spark, [])).count() == 0


# ------------------------------------------------------------------ chat
def brute_chat(rows, stretch):
    rows = sorted({(c, t, "unknown" if r is None else r, x or "") for c, t, r, x in rows}, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    out = {}
    for conv in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == conv]
        for who in {r[2] for r in own} - {"system"}:
            for _, turn, speaker, said in own:
                key = (conv, who, None if turn is None else turn // stretch * stretch)
                text, mask = out.get(key, ("", []))
                kind = "assistant" if speaker == who else "system" if speaker == "system" else f"user name={speaker.replace('<|', '< |')}"
                head, body = f"<|im_start|>{kind}\n", said.replace("<|", "< |") + "<|im_end|>"
                if speaker == who:
                    mask = mask + [f"{len(text) + len(head)}-{len(text) + len(head) + len(body)}"]
                out[key] = (text + head + body + "\n", mask)
    return {k: (t, ",".join(m)) for k, (t, m) in out.items()}


CHAT = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hé <|im_end|>\U0001f600"), (1, 2, "assistant", None), (1, 3, "bob", "hi"), (1, 3, "amy", "hi"),
    (1, 3, "amy", "hi"), (2, 0, "system", "alone"), (None, None, None, None), (3, None, "user", "late"), (3, 200, "user", "far"), (3, -5, "bot", "x" * 100_000),
]


def test_chat_equals_brute_force(spark):
    table = spark.createDataFrame([(*r, "x", "x") for r in CHAT], "conv_id long, turn long, role string, text string, segment string, perspective string")
    got = chat.rotate(spark, table).collect()
    want = {k: v for k, v in brute_chat(CHAT, 64).items()}
    assert {(r.conv_id, r.perspective, r.first_turn): (r.text, r.mask) for r in got} == want and len(got) == len(want)
    assert all(r.part == 0 for r in got)
    assert chat.rotate(spark, table.limit(0)).count() == 0


def test_chat_keeps_the_order_in_a_crowded_stretch(spark):
    rows = [(1, 3, "a" if k % 2 else "b", f"m{k}") for k in range(400)] + [(1, 4, "a", "end"), (1, 0, "system", "start"), (1, 70, "b", "later"), (1, 2, None, "who")]
    rows += [(c, t, "a" if k % 3 else "c", f"m{k}") for c, t in ((None, 5), (2, None)) for k in range(130)] + [(3, 1, "a", "few")] + rows[:9]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(chat.rotate(spark, table, most=50).collect(), key=lambda r: (r.first_turn or 0, r.part))
    want = brute_chat(rows, 64)
    joined, learnt = {}, {}
    for r in got:
        k = (r.conv_id, r.perspective, r.first_turn)
        ofs = len(joined.get(k, ""))
        joined[k] = joined.get(k, "") + r.text
        learnt.setdefault(k, []).extend(f"{int(x.split('-')[0]) + ofs}-{int(x.split('-')[1]) + ofs}" for x in r.mask.split(",") if x)
    assert {k: (t, ",".join(learnt[k])) for k, t in joined.items()} == want
    assert max(r.n_messages for r in got) == 50 and {r.first_turn for r in got if r.conv_id == 1} == {0, 64}
    assert sorted(r.part for r in got if r.perspective == "a" and r.conv_id == 1 and r.first_turn == 0) == list(range(9))


def test_cut_does_not_depend_on_the_sample(spark):
    """Few good rows among many bad ones of few distinct strengths: any sample size parts them."""
    good, bad = "plain quiet words about rivers and stones here.", ["| %% || && ##", "%% | && | ##  ||", "|| || ## && %%"]
    rows = [(1000 + k, f"{good} {k % 3}" if k % 100 == 7 else bad[k % 3]) for k in range(2000)]
    labels = spark.createDataFrame([(i, int(t.startswith("plain")), 0) for i, t in rows], LABELS)
    table = docs(spark, rows)
    for sample_rows in (60, 500, 8_000):
        scored = quality.score_documents(spark, table, labels, sample_rows=sample_rows)
        assert scored.where((F.col("predicted") == 1) != F.col("text").startswith("plain")).count() == 0


def test_cut_against_brute_force(spark):
    rows, marks = good_and_bad(150)
    labels = spark.createDataFrame([(i, q if k % 7 else 1 - q, t) for k, (i, q, t) in enumerate(marks)], LABELS)  # some labels are wrong
    table = docs(spark, rows)
    got = quality.learn(spark, table, labels)
    used = {r.doc_id: r.quality for r in labels.where(~quality.held_out("doc_id")).collect()}
    texts = [(t, used[i]) for i, t in rows if i in used]
    strength = got.strength(quality.features([t for t, _ in texts]))
    y = [q for _, q in texts]

    def error(cut):
        lost = sum(q == 1 and s <= cut for s, q in zip(strength, y)) / sum(y)
        return lost + sum(q == 0 and s > cut for s, q in zip(strength, y)) / (len(y) - sum(y))

    least = min(error(c) for c in [min(strength) - 1, *strength])
    assert abs(error(got.cut) - least) < 1e-12

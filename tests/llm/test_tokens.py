"""Cross-tokenizer alignment against a brute-force statement of its contract."""

import collections
import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tablemove.llm import queries
from tablemove.llm import token_alignment as ta
from tests.llm.helpers import ODD, SF, docs

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def brute(rows):
    """(doc_id, text) rows -> result rows, from sets of ends and all pairs of tokens of a group."""
    tok = Tokenizer.from_file(ta.BYTE_LEVEL)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=ta.PIECES)
    alphabet = ta.byte_alphabet()
    done, held = [], collections.Counter()
    for key, text in rows:
        groups = []
        if text:
            a = tok.encode(" " + text, add_special_tokens=False).ids
            b = sp.encode(text)
            raw_a = [bytes(alphabet[c] for c in tok.id_to_token(i)) for i in a]
            raw_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
                ends_a, ends_b = np.cumsum([len(x) for x in raw_a]).tolist(), np.cumsum([len(x) for x in raw_b]).tolist()
                cuts = sorted(set(ends_a) & set(ends_b))
                place = {e: k for k, e in enumerate(cuts)}
                groups = [([], []) for _ in cuts]
                for side, ids, ends in ((0, a, ends_a), (1, b, ends_b)):
                    g = 0
                    for i, e in zip(ids, ends):
                        groups[g][side].append(i)
                        g += e in place
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        held.update(set(links))
        done.append((key, groups, links))
    best = collections.Counter()
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    for key, groups, links in done:
        shown = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        yield (
            key, sum(len(g) for g, _ in groups), sum(len(g) for _, g in groups), len(groups), len(links),
            sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(shown.encode()).hexdigest() if groups else "",
        )


def order(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_align_on_random_ends():
    rng = random.Random(3)
    for _ in range(2000):
        total = rng.randint(1, 60)
        cut = lambda p: sorted({total, *(k for k in range(1, total) if rng.random() < p)})
        a = cut(rng.choice([0.1, 0.5, 0.95, 1]))
        b = a if rng.random() < 0.1 else cut(rng.choice([0.1, 0.5, 0.95, 1]))
        cuts_a, cuts_b = ta.align(a, b)
        common = sorted(set(a) & set(b))
        assert [a[k - 1] for k in cuts_a] == common and [b[k - 1] for k in cuts_b] == common


def test_a_long_agreeing_run_is_jumped():
    class Counting(list):
        looks = 0

        def __getitem__(self, k):
            Counting.looks += 1
            return super().__getitem__(k)

    n = 100_000
    ends = list(range(1, n + 1))
    other = ends[: n // 2] + ends[n // 2 + 1 :]
    cuts_a, cuts_b = ta.align(Counting(ends), Counting(other))
    assert len(cuts_a) == len(cuts_b) == n - 1 and Counting.looks < 200


def test_quicker_encoder_agrees():
    byte_level, pieces = open(ta.BYTE_LEVEL, encoding="utf-8").read(), open(ta.PIECES, "rb").read()
    slow, rng = ta.Tokenizers(byte_level, pieces), random.Random(6)
    assert slow.ranks_agree(byte_level)
    quick = ta.Tokenizers(byte_level, pieces, use_ranks=True)
    texts = ["".join(rng.choice("abcdeinorstu  '.,\n\t0123éñŒ\xa0\x1c\x85") for _ in range(rng.randint(1, 200))) for _ in range(3000)]
    texts += [w for t in texts[:300] for w in (t.title(), t.upper(), t.replace(" ", ""))] + ["a" * 399, "b" * 5000, " " * 5000]
    assert sum(map(quick.quick, texts)) > 3000 and not any(map(slow.quick, texts))
    for x, y in zip(quick.encode(texts), slow.encode(texts)):
        assert (x is None) == (y is None) and (x is None or x[0].tolist() == y[0].tolist())
    changed = byte_level.replace('"use_regex": true', '"use_regex": false').replace('"use_regex":true', '"use_regex":false')
    assert not slow.ranks_agree(changed)


def test_pairs_in_classes_equal_pairs_at_once():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 9, 400), rng.integers(0, 7, 300)
    cuts_a, cuts_b = np.array([1, 2, 200, 390, 400]), np.array([1, 5, 100, 299, 300])
    (whole,) = ta.linked_pairs(a, b, cuts_a, cuts_b)
    parts = list(ta.linked_pairs(a, b, cuts_a, cuts_b, at_once=50))
    assert len(parts) > 1
    together = {int(k): int(n) for p in parts for k, n in zip(*p)}
    assert together == {int(k): int(n) for k, n in zip(*whole)} and sum(len(p[0]) for p in parts) == len(together)


def test_query_against_brute_force(spark):
    got = queries.op11_token_alignment(spark, SF).select(COLUMNS).collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert order(got) == order(brute(rows))


@pytest.mark.parametrize("options", [{}, {"at_once": 50, "broadcast_pairs": 0}])
def test_odd_rows(spark, options):
    rows = [*ODD, (10, "<|endoftext|> </s> <unk> <0x0A>"), (11, " leading  and   many blanks "), (12, "1234567 3.14159 1e-9"), (13, "ﬁ Å ① ％")]
    got = ta.alignment_report(spark, docs(spark, rows), **options).select(COLUMNS).collect()
    assert order(got) == order(brute(rows))


def test_empty_table(spark):
    assert ta.alignment_report(spark, docs(spark, [])).collect() == []

"""Prefix-hash fingerprints: span equality and extensions against string comparison, the query against brute force."""

import hashlib
import random

import pytest

from tablemove.llm import document_fingerprints as df
from tablemove.llm import queries
from tests.llm.helpers import ODD, SF, WORDS, docs

NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_prefix"]


def naive_fingerprint(text):
    """A text's fingerprint from sums over its characters, without prefix arrays."""
    def value(s):
        return [sum((ord(c) + 1) * pow(b, i, m) for i, c in enumerate(s)) % m for b, m in zip(df.BASES, df.MODULI)]

    def mix(x, y):
        z = x << 32 | y
        z = (z ^ z >> 29) * 0x9E3779B97F4A7C15 % 2**64
        return z ^ z >> 32

    out = len(text).to_bytes(8) + mix(*value(text)).to_bytes(8)
    at = 1
    while at < len(text):
        out += (mix(*value(text[:at])) >> 32).to_bytes(4)
        at = max(at + 1, at * 5 // 4)
    size = min(df.SPAN, len(text))
    spans = {mix(*value(text[i : i + size])) >> 32 for i in range(len(text) - size + 1)} if text else ()
    return out + b"".join(x.to_bytes(4) for x in sorted(spans)[: df.SKETCH])


def shared(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def test_spans_and_extensions():
    rng = random.Random(8)
    for _ in range(40):
        text = "".join(rng.choice("ab\U0001f600") for _ in range(rng.randint(1, 60)))
        other = text[: rng.randint(0, len(text))] + "".join(rng.choice("ab") for _ in range(20))
        x, y = df.PrefixHashes(text), df.PrefixHashes(other)
        for _ in range(30):
            i, j = rng.randint(0, len(text)), rng.randint(0, len(other))
            size = rng.randint(0, min(len(text) - i, len(other) - j))
            assert (x.span(i, i + size) == y.span(j, j + size)) == (text[i : i + size] == other[j : j + size])
            assert x.extension(y, i, j) == shared(text[i:], other[j:])


def test_blocks_do_not_show(monkeypatch):
    text = WORDS * 20 + "é中\x00\U0001f600"
    whole = df.PrefixHashes(text)
    monkeypatch.setattr(df, "STEP", 37)
    parts = df.PrefixHashes(text)
    assert (whole.spans(16) == parts.spans(16)).all() and whole.fingerprint == parts.fingerprint


@pytest.mark.parametrize("text", ["", "a", "ab", WORDS[:16], WORDS[:17], "x" * 400, WORDS * 3, "Größe 中文 \U0001f600\x00"])
def test_fingerprint_is_that_of_the_text(text):
    assert df.PrefixHashes(text).fingerprint == naive_fingerprint(text)


def test_likeness():
    prints = {t: df.PrefixHashes(t).fingerprint for t in ("", "a", WORDS, WORDS.upper(), WORDS * 2, "zz" + WORDS)}
    for t, f in prints.items():
        for u, g in prints.items():
            near = df.likeness(f, g)
            assert 0 <= near <= 1 and (near == 1) == (t == u) and near == df.likeness(g, f)
    assert df.likeness(prints[""], prints["a"]) == 0
    assert df.likeness(prints[WORDS], prints["zz" + WORDS]) > 0.8 > 0.1 > df.likeness(prints[WORDS], prints[WORDS.upper()])


def brute(rows):
    """(doc_id, text) rows with distinct ids or equal rows -> result rows."""
    rows = sorted(((k, t or "") for k, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    prints = {}

    def of(t):
        if t not in prints:
            prints[t] = df.PrefixHashes(t).fingerprint
        return prints[t]

    for (k, t), (_, u) in zip(rows, rows[1:] + rows[:1]):
        n = len(t)
        changed = t[: n - n // 3] + u[: n // 3]
        yield (
            k, n, hashlib.sha256(changed.encode()).hexdigest(), of(t).hex(), of(changed).hex(),
            df.likeness(of(t), of(changed)), df.likeness(of(t), of(u)), shared(t, changed),
        )


def order(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_query_against_brute_force(spark):
    got = queries.op13_document_fingerprints(spark, SF)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = got.select(NAMES).collect()
    assert order(found) == order(brute(rows))
    edited, following = sorted(r.near_edited for r in found), sorted(r.near_next for r in found)
    assert edited[len(edited) // 20] > 0.5 > following[-len(following) // 20]


def test_odd_rows(spark):
    rows = [*ODD, (-1, None), (20, "ab"), (21, "abc"), (22, "abcdef" * 10), (23, "")]
    got = df.fingerprints(spark, docs(spark, rows)).select(NAMES).collect()
    assert order(got) == order(brute(rows))


def test_one_id_on_most_rows(spark):
    rows = [(7, WORDS)] * 300 + [(k, f"{WORDS} {k}") for k in range(6)] + [(9, "end " * 30)]
    got = df.fingerprints(spark, docs(spark, rows).repartition(6)).select(NAMES).collect()
    assert order(got) == order(brute(rows))


def test_one_and_no_row(spark):
    assert df.fingerprints(spark, docs(spark, [])).collect() == []
    (row,) = df.fingerprints(spark, docs(spark, [(5, "abcdef")])).select(NAMES).collect()
    assert (row.doc_id, row.near_next, row.edited_sha256) == (5, 1.0, hashlib.sha256(b"abcdab").hexdigest())

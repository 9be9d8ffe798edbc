"""Repeated 400-byte strings against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from opslens.llm import suffixes
from opslens.llm.suffixes import COVER, V, without_repeats


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def texts():
    rng = np.random.default_rng(3)
    word = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8)).decode()
    passage, other = word(400), word(1500)
    out = [word(n) for n in (0, 1, 399, 400, 401, 900)]
    out += [word(31) + passage + word(77), word(200) + passage, passage, passage[:399] + "é", "é" + passage[1:]]
    out += [other, other[:700] + "X" + other[701:], other[100:520] + other[90:510], word(350) + other[1000:1450] + word(9)]
    out += ["ab" * 400, "a" * 5000, None, "", None, "ü" * 300, word(20_000) + other + word(30_000)]
    return out


@pytest.mark.parametrize("length", [400, 274])
def test_brute_force(spark, monkeypatch, length):
    """Many small chunks and ranges, so that names meet across tasks."""
    monkeypatch.setattr(suffixes, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(suffixes, "RANGE_NAMES", 300)
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as chunk", "2 as n_bytes").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in without_repeats(docs, length=length).collect()}
    assert got == dict(enumerate(brute([t for _, t in rows], length)))


def test_repeated_rows_null_ids_and_empty_table(spark):
    text = "x".join(map(str, range(300)))
    docs = spark.createDataFrame([(None, text), (4, text), (4, text)], "doc_id long, text string")
    rows = without_repeats(docs).collect()
    assert [(r.n_removed == r.n_bytes, bytes(r.kept)) for r in rows] == [(True, b"")] * 3
    assert without_repeats(docs.limit(0)).count() == 0


def test_cover_is_perfect():
    assert {(a - b) % V for a in COVER for b in COVER} == set(range(V))
    with pytest.raises(ValueError):
        without_repeats(None, length=273)


def test_planted_passages_are_removed_from_400_bytes_on(spark):
    """Passages of over 50 words in two documents each: those that hold a string of 400 bytes go, the others and clean documents stay."""
    rng = np.random.default_rng(8)
    words = lambda n: " ".join(bytes(rng.integers(97, 123, k, dtype=np.uint8)).decode() for k in rng.integers(2, 10, n))
    passages = [words(n) for n in range(51, 81)]
    rows = [(2 * i + k, words(40) + "AC"[k] + p + "BD"[k] + words(60)) for i, p in enumerate(passages) for k in (0, 1)]
    rows += [(i, words(150)) for i in range(2 * len(passages), 3 * len(passages))]
    got = {r.doc_id: r.n_removed for r in without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    long = [len(p) if len(p) >= 400 else 0 for p in passages]
    assert 5 < sum(x > 0 for x in long) < 25
    assert got == {i: long[i // 2] if i < 2 * len(passages) else 0 for i, _ in rows}

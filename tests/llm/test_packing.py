"""Packing: every piece once, sequences without gaps, and nearly as few as the tokens need."""

import zlib

import numpy as np
import pytest

from opslens.llm import packing
from opslens.llm.packing import best_fit, packed_pieces
from opslens.llm.tokens import Encoder, public_path

PATH = public_path("byte_bpe_50k.json")


def plain_ids(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 0]


def check(rows, docs, length):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(docs)
    for doc, pieces in by_doc.items():
        ids = plain_ids(docs[doc])
        pieces.sort(key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        at = 0
        for r in pieces:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids) and all(r.length == length for r in pieces[1:])
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        at = 0
        for r in pieces:
            assert r.offset == at
            at += r.length
        assert at <= length
    return len(by_sequence)


def test_pieces_and_sequences(spark):
    docs = {i: " ".join(f"word{j}" for j in range(i * 7 % 90)) for i in range(120)}
    docs |= {500: None, 501: "", 502: "  \n\n ", 503: "x <|endoftext|> y 日本", 504: "long " * 5000}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").selectExpr("*", "1 as item", "2 as length", "3 as bin")
    rows = packed_pieces(frame, PATH, length=64).collect()
    assert len({(r.doc_id, r.piece) for r in rows}) == len(rows)
    assert check(rows, docs, 64) <= 1.03 * sum(r.length for r in rows) / 64 + 1


def test_rounds_merge_bins_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(packing, "MAX_ITEMS", 50)
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 400, 3000)
    items = spark.createDataFrame([(i, int(s)) for i, s in enumerate(sizes)], "item long, length long")
    rows = packing.pack(items, 1000).collect()
    assert sorted(r.item for r in rows) == list(range(3000))
    bins = {}
    for r in rows:
        bins.setdefault(r.bin, []).append((r.offset, int(sizes[r.item])))
    for held in bins.values():
        held.sort()
        assert [o for o, _ in held] == [0, *np.cumsum([s for _, s in held])[:-1].tolist()] and sum(s for _, s in held) <= 1000
    assert len(bins) <= 1.02 * sizes.sum() / 1000 + 1


def test_repeated_rows_and_empty_table(spark):
    frame = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    rows = packed_pieces(frame, PATH, length=8).collect()
    assert sorted((r.doc_id or -1, r.length) for r in rows) == [(-1, 2), (1, 3), (1, 3)]
    assert packed_pieces(frame.limit(0), PATH).count() == 0


@pytest.mark.parametrize("sizes", [[], [5], [10] * 4, [6, 4, 5, 5, 9, 1]])
def test_best_fit(sizes):
    where, offset, fill = best_fit(np.array(sizes, np.int64), 10)
    assert len(fill) == -(-sum(sizes) // 10) and fill.sum() == sum(sizes)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library(name):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_path(name))
    made = Encoder(public_path(name), kept=7)
    for text in ["I'll  don't\n\n  tab\there  's x''s", "<|endoftext|> <|EndOfText|>", "日本 éÉ İx ŉ ĳ ª² ½", "x\u0085z  q\x1c", "", "a" * 3000, "Ça̧ é"]:
        assert list(made.ids(text)) == plain.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library_over_lots_and_blocks(name, monkeypatch):
    """Words are looked up and put together across texts, and forgotten; a new word costs one call of the library, a known one none."""
    from tokenizers import Tokenizer

    from opslens.llm import tokens

    plain = Tokenizer.from_file(public_path(name))
    rng = np.random.default_rng(5)
    words = ["été", "it's", "a,b", "(x)", "12", "don't!", "ß", " ", "\x85", "one", "two", "x-y", "ŵ", "日", "\x1d", "…", "\n", "<|end", "<|endoftext|>"]
    texts = [None, "", " ", *(" ".join(rng.choice(words, n)) for n in rng.integers(0, 30, 300)), "one,two" * 900]
    for lot, block, kept in ((1, 1, 3), (200, 10, 8), (1 << 20, 40, 800)):
        monkeypatch.setattr(tokens, "LOT", lot)
        monkeypatch.setattr(tokens, "BLOCK", block)
        made = Encoder(public_path(name), kept=kept)
        for _ in range(2):
            for text, ids in zip(texts, made.ids_of(texts), strict=True):
                assert ids.tolist() == plain.encode(text or "", add_special_tokens=False).ids, text
        assert kept == 800 or len(made.known) <= kept
    calls, merges = [], made.merges
    made.merges = lambda word: calls.append(word) or merges(word)
    again = ["one two three", "three,two;four"] * 50
    assert [x.tolist() for x in made.ids_of(again)] == [plain.encode(x, add_special_tokens=False).ids for x in again]
    assert len(calls) == len(set(calls)) <= 5

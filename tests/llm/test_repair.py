"""Token files: exact round trips of the grammar, of shards and of whole tables."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from opslens.llm import repair
from opslens.llm.tokens import public_path

PATH = public_path("word_bpe_49k.json")


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), max_size=60), max_size=8))
def test_shard_round_trip(docs):
    arrays = [np.array(d, np.uint32) for d in docs]
    read = repair.Shard(repair.write_shard(arrays))
    assert read.docs == len(docs)
    for i, ids in enumerate(arrays):
        assert read.ids(i).tolist() == ids.tolist()
        for a in range(0, len(ids), 7):
            assert read.slice(i, a, min(len(ids), a + 11)).tolist() == ids[a : a + 11].tolist()


def test_frequent_pairs_become_rules():
    rng = np.random.default_rng(0)
    phrases = [rng.integers(0, 49_000, 12, dtype=np.uint32) for _ in range(20)]
    docs = [np.concatenate([phrases[i] for i in rng.integers(0, 20, 40)]) for _ in range(60)]
    data = repair.write_shard(docs)
    read = repair.Shard(data)
    assert len(data) < 4 * sum(map(len, docs)) / 4 and len(read.rules) and read.lengths.max() >= 8
    assert all((read.ids(i) == d).all() for i, d in enumerate(docs))
    assert (read.slice(3, 100, 333) == docs[3][100:333]).all()


def test_runs_of_one_symbol():
    ids = np.zeros(1001, np.uint32)
    assert (repair.Shard(repair.write_shard([ids])).ids(0) == ids).all()


def test_broken_shard():
    data = repair.write_shard([np.arange(5, dtype=np.uint32)])
    for bad in (data[:-4], b"", b"\0" * len(data)):
        with pytest.raises(ValueError):
            repair.Shard(bad)


def test_files_of_a_table(spark, tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(PATH)
    docs = {i: " ".join(f"Word{j % 9} it's" for j in range(i)) for i in range(0, 90, 3)}
    docs |= {200: None, 201: "", 202: "<|endoftext|> 日本 É", 203: "many words " * 4000}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").selectExpr("*", "1 as shard", "2 as ids").repartition(3)
    repair.write_shards(frame, str(tmp_path / "files"), PATH, 2, shard_ids=500)
    rows = sorted(repair.read_documents(spark.read.parquet(str(tmp_path / "files"))).collect())
    start = 0
    for row, (doc, text) in zip(rows, sorted(docs.items()), strict=True):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        assert tuple(row) == (doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_repeated_and_null_ids_and_empty_table(spark, tmp_path):
    frame = spark.createDataFrame([(1, "a b"), (None, "c"), (1, "a b")], "doc_id long, text string")
    repair.write_shards(frame, str(tmp_path / "a"), PATH, 2)
    assert sorted((r.doc_id or 0, r.start, r.n_tokens) for r in repair.read_documents(spark.read.parquet(str(tmp_path / "a"))).collect()) == [(0, 0, 2), (1, 2, 3), (1, 5, 3)]
    repair.write_shards(frame.limit(0), str(tmp_path / "b"), PATH, 2)
    assert repair.read_documents(spark.read.parquet(str(tmp_path / "b"))).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=50), min_size=1, max_size=6), st.integers(2, 4))
def test_pairs_counted_around_replaced_places_are_those_of_a_whole_count(docs, least):
    """After every round the counts carried on equal a count of the whole sequence, runs and separators included."""
    flat = np.array([x for d in docs for x in [*d, repair.SEPARATOR]], np.uint32)
    seen, plain = [], repair.recounted

    def run(pairs, counts, gone, new, least):
        out = plain(pairs, counts, gone, new, least)
        seen.append(out)
        return out

    repair.recounted = run
    try:
        for rounds in range(1, 6):
            seen.clear()
            sequence = repair.compress(flat, rounds, least).sequence
            if len(seen) == rounds:
                pairs, counts = repair.frequent_pairs(sequence, least)
                assert seen[-1][0].tolist() == pairs.tolist() and seen[-1][1].tolist() == counts.tolist()
    finally:
        repair.recounted = plain


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=60, unique=True), st.integers(0, 3))
def test_disjoint_pairs_are_those_taken_one_by_one(drawn, turns):
    """Chains of pairs longer than the turns included."""
    for listed in (drawn, [(i, i + 1) for i in range(len(drawn))]):
        used, want = set(), []
        for a, b in listed:
            if not used & {a, b}:
                used |= {a, b}
                want.append(a << 32 | b)
        plain, repair.TURNS = repair.TURNS, turns
        try:
            assert repair.disjoint(np.array([a << 32 | b for a, b in listed], np.uint64)).tolist() == want
        finally:
            repair.TURNS = plain


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=60), max_size=8))
def test_a_whole_shard_is_read_at_once(docs):
    read = repair.Shard(repair.write_shard([np.array(d, np.uint32) for d in docs]))
    ids, bounds = read.all_ids()
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == docs

"""Windows against an exhaustive choice of cuts, and packed rows against the tokenizers library."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from opslens.llm import windows as w
from opslens.llm.queries import op12_windows
from opslens.llm.tokens import public_path

VOCABULARY = "word_bpe_49k.json"


def padding(length, capacity):
    return 0 if length & (length - 1) == 0 or length == capacity else capacity - length


def cheapest(ends, penalty, capacity):
    """Least cost over all choices of cuts, each end tried with every start."""
    best = {0: 0}
    for end, p in zip(ends, penalty, strict=True):
        best[end] = min(best[s] + padding(end - s, capacity) + p for s in best if 0 < end - s <= capacity)
    return best[ends[-1]]


@pytest.mark.parametrize("capacity", [7, 16, 64])
def test_windows_cost_as_little_as_possible(capacity):
    rng = random.Random(capacity)
    for _ in range(200):
        sizes = np.array([rng.randint(1, 3 * capacity) for _ in range(rng.randint(1, 9))])
        total = int(sizes.sum())
        sentences = np.array(sorted(rng.sample(range(1, total + 1), rng.randint(0, total // 3))), np.int64)
        ends, penalty = w.possible_ends(sizes, sentences, run=capacity, grain=min(capacity, 5), sentence=2, within=9)
        assert ends[-1] == total and len(set(ends.tolist())) == len(ends) and np.diff(np.append(0, ends)).max() <= capacity
        cuts = w.window_ends(ends, penalty, capacity)
        of = dict(zip(ends.tolist(), penalty.tolist(), strict=True))
        cost = sum(of[b] + padding(b - a, capacity) for a, b in zip([0, *cuts], cuts, strict=False))
        assert cuts[-1] == total and cost == cheapest(ends.tolist(), penalty.tolist(), capacity)


def faults(pieces, ids_of, capacity=2048, end_id=1):
    """What is wrong with rows (doc_id, start, length, crc, doc_tokens, sequence, offset) of distinct documents."""
    found, by_doc, by_sequence = [], {}, {}
    for row in pieces:
        by_doc.setdefault(row[0], []).append(row)
        by_sequence.setdefault(row[5], []).append(row)
    for key, ids in ids_of.items():
        at, whole = 0, np.array([*ids, end_id], "<u4")
        for _, start, length, crc, tokens, _, _ in sorted(by_doc.pop(key, []), key=lambda r: r[1]):
            if start != at or length < 1 or tokens != len(whole) or crc != zlib.crc32(whole[start : start + length].tobytes()):
                found.append(("piece", key, start))
            at += length
        if at != len(whole):
            found.append(("whole", key))
    found += [("unknown", key) for key in by_doc]
    for number, rows in by_sequence.items():
        at = 0
        for row in sorted(rows, key=lambda r: r[6]):
            if row[6] != at:
                found.append(("gap", number))
            at += row[2]
        if at > capacity:
            found.append(("long", number))
    return found


def padded(pieces, capacity=2048):
    fill = {}
    for row in pieces:
        fill[row[5]] = fill.get(row[5], 0) + row[2]
    return sum(padding(n, capacity) for n in fill.values()) / sum(fill.values())


def library_ids(texts):
    tokenizer = Tokenizer.from_file(public_path(VOCABULARY))
    return {k: tokenizer.encode(t or "", add_special_tokens=False).ids for k, t in texts.items()}


def test_query_packs_every_id_once(spark, tmp_path):
    rng = random.Random(3)
    words = ["river", "naïve.", "Stone!", "一二", "over", "why?", "12", "end."]
    texts = {i: " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 50, 400]))) for i in range(400)}
    texts |= {400: None, 401: "", 402: "word " * 30_000, 403: "a. " * 9_000, 404: "<|endoftext|> x", 405: texts[3]}
    frame = spark.createDataFrame([(k, t, 1, "s") for k, t in texts.items()], "doc_id long, text string, start int, ids string")
    path = str(tmp_path / "t")
    frame.coalesce(1).write.parquet(f"{path}/documents.parquet")
    out = op12_windows(spark, path)
    pieces = [tuple(r) for r in out.collect()]
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert faults(pieces, library_ids(texts)) == []
    assert padded(pieces) < 0.01
    order = [r[0] for r in sorted(pieces, key=lambda r: (r[5], r[6]))]
    stored = [r[0] for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id").collect()]
    assert list(dict.fromkeys(order)) == stored
    none = str(tmp_path / "none")
    frame.limit(0).write.parquet(f"{none}/documents.parquet")
    assert op12_windows(spark, none).count() == 0


def test_blocks_repeated_rows_and_ids(spark):
    rng = random.Random(9)
    rows = [(rng.choice([None, 1, 2]), "so it goes. " * rng.randint(0, 60)) for _ in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = w.windows(frame, public_path(VOCABULARY), capacity=64, block=500, ids=True).collect()
    assert sum(r["start"] == 0 for r in out) == 300
    assert all(len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in out)
    assert sum(r["length"] for r in out) == sum(len(x) + 1 for x in library_ids(dict(enumerate(t for _, t in rows))).values())
    fill = {}
    for r in out:
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in v) <= 64 and [o for o, _ in sorted(v)] == [sum(n for o2, n in v if o2 < o) for o, _ in sorted(v)] for v in fill.values())

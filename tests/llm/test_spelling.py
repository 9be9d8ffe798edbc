"""Spelling variants against a brute-force version over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from opslens.llm import spelling
from opslens.llm.queries import op13_spelling


def brute_words(rows, noise):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if noise and h % noise == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1:]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(counts):
    near = {w: [v for v in counts if v != w and one_edit(v, w)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return out


def words_of(seed, n):
    """Words that share halves, chains of forms, repeated letters and letters beyond A to Z."""
    rng = random.Random(seed)
    made = {}
    for _ in range(n):
        w = list("inter" if rng.random() < 0.5 else "aaaaa") + [rng.choice("abçÉ×") for _ in range(rng.randint(0, 4))]
        if rng.random() < 0.3:
            w[rng.randrange(len(w))] = rng.choice("xyz")
        made["".join(w)] = rng.choice([3, 3, 4, 6, 8, 13, 27, 60])
    return made


@pytest.mark.parametrize("crowded", [20, 20_000])
def test_equals_brute_force_whatever_is_cut_further(spark, crowded):
    counts = words_of(crowded, 400) | {"a": 5, "b": 9, "ab": 30, "x" * 300: 3, "x" * 299 + "y": 7, "x" * 301: 20}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert {tuple(r) for r in spelling.variants(frame, crowded=crowded).collect()} == brute(counts)


def test_each_pair_once(spark):
    frame = spark.createDataFrame([("aaaaa", 3), ("aaaaaa", 3), ("aaaab", 4)], "word string, n long")
    assert sorted((r["a"], r["b"]) for r in spelling.near_pairs(frame).collect()) == [("aaaaa", "aaaaaa"), ("aaaaa", "aaaab")]


def test_query_equals_brute_force_with_odd_rows(spark, tmp_path):
    rng = random.Random(5)
    vocabulary = ["Stream", "stream", "streams", "Écrire", "écrire", "ecrire", "naïve", "naive", "knives", "ab×cd", "tables", "table", "tablet"]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))), "x") for i in range(300)]
    rows += [(7, rows[7][1], "again"), (None, "tables tables tables", None), (8, None, "null"), (9, "", "empty"), (10, "1234 -- 一", ""), (11, "stream" * 5000, "long")]
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, "doc_id long, text string, word string").write.parquet(f"{path}/documents.parquet")
    got = [tuple(r) for r in op13_spelling(spark, path).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(brute_words([r[:2] for r in rows], 97))
    empty = str(tmp_path / "empty")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{empty}/documents.parquet")
    assert op13_spelling(spark, empty).count() == 0

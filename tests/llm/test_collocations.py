"""Phrases and automata against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from opslens.llm import collocations as c
from opslens.llm.automata import Automaton, prefixes
from opslens.llm.queries import op11_collocations


def brute(rows, least=30, percent=80, top=2000, longest=4):
    counts = Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            counts[lang, ()] += len(words)
            counts.update((lang, tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    found = {}
    for (lang, phrase), a in counts.items():
        if len(phrase) < 2 or a < least:
            continue
        longer = [f for (other, p), f in counts.items() if other == lang and f >= least and len(p) > len(phrase) and any(p[i : i + len(phrase)] == phrase for i in range(len(p)))]
        if any(100 * f >= percent * a for f in longer):
            continue
        sides = [(counts[lang, phrase[:k]], counts[lang, phrase[k:]]) for k in range(1, len(phrase))]
        score, _, (l, r) = min((2_000_000 * a // (x + y), k, (x, y)) for k, (x, y) in enumerate(sides))
        found.setdefault(lang, []).append((-score, -a, " ".join(phrase).encode(), l, r))
    return [
        (lang, rank, phrase.decode(), -a, l, r, counts[lang, ()], -score)
        for lang, some in found.items() for rank, (score, a, phrase, l, r) in enumerate(sorted(some)[:top], 1)
    ]


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["new", "York", "city", "a", "of", "the", "État", "état", "x y", "\x01", "zz"]
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", "!"]) for _ in range(rng.randint(0, 60)))
        rows.append((rng.choice(["en", "en", "en", None, "und", ""]), text))
    return rows + [("en", None), (None, ""), ("de", " .. \t"), rows[0], rows[0]]


def test_automaton_keeps_unites_and_finds_weights():
    rng = random.Random(4)
    for _ in range(100):
        words = [bytes([97 + i]) for i in range(rng.randint(1, 5))]
        parts = []
        for _ in range(3):
            parts.append(Counter())
            for _ in range(rng.randint(1, 30)):
                parts[-1][tuple(rng.choice(words) for _ in range(rng.randint(1, 4)))] += rng.randint(1, 3)
        made = []
        for part in parts:
            rows = np.array(sorted([words.index(w) + 1 for w in path] + [0] * (4 - len(path)) for path in part), np.int32)
            weights = [part[tuple(words[k - 1] for k in row if k)] for row in rows.tolist()]
            made.append(Automaton.load(Automaton.build(rows, np.array(weights), words).dump()))
            assert all(made[-1].weight(path) == f for path, f in part.items()) and made[-1].weight([b"?"]) is None
        rows, weights, names = Automaton.union(made)
        total = sum(parts, Counter())
        assert {tuple(names[k - 1] for k in row if k): f for row, f in zip(rows.tolist(), weights.tolist(), strict=True)} == total
        starts = Counter()
        for path, f in total.items():
            starts.update({path[:k]: f for k in range(1, len(path) + 1)})
        got = {tuple(names[k - 1] for k in rows[i, :n]): f for n, first, w in prefixes(rows, weights) for i, f in zip(first.tolist(), w.tolist(), strict=True)}
        assert got == starts


def test_equal_futures_are_one_state():
    rows = np.array([[1, 3], [1, 4], [2, 3], [2, 4]], np.int32)
    made = Automaton.build(rows, np.array([5, 6, 5, 6]), [b"a", b"b", b"c", b"d"])
    assert [len(bounds) - 1 for bounds, _, _ in made.levels] == [1, 1]


@pytest.mark.parametrize("how", [{}, {"stride": 40, "per_range": 2, "shard": 50}, {"stride": 30, "per_range": 2, "shard": 70, "fan": 3, "united": 60}])
def test_equals_brute_force_whatever_the_ranges(spark, how):
    rows = corpus(len(how), 150)
    frame = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    got = sorted(map(tuple, c.collocations(frame, least=8, top=40, **how).collect()))
    assert got == sorted(brute(rows, least=8, top=40)) and len(got) > 50


def test_rounds_split_evenly_and_in_small_lots(spark, monkeypatch):
    assert [c._rounds(n, 256) for n in (1, 256, 257, 800, 65_536, 65_537)] == [(1, 2), (1, 256), (2, 17), (2, 29), (2, 256), (3, 41)]
    rng = random.Random(3)
    rows = [("en", " ".join(f"w{rng.randrange(400)}" for _ in range(100))) for _ in range(60)]
    texts = spark.createDataFrame(rows, "lang string, text string").repartition(2)
    bounds = c.range_bounds(texts, 4, 60, 4)
    monkeypatch.setattr(c, "staged", lambda df, name: pytest.fail("parts of whole shards are written"))
    parts = c.range_automata(texts, bounds, 4, shard=300, fan=len(bounds) - 1, united=1000, range_chars=240)
    got = parts.collect()
    assert len({r["range"] for r in got}) == len(bounds) + 1 > 50
    unions = [Automaton.union([Automaton.load(r["automaton"]) for r in got if r["range"] == n]) for n in range(len(bounds) + 1)]
    assert sum(int(weights.sum()) for _, weights, _ in unions) == 6000
    rounds, fan = c._rounds(len(bounds) + 1, len(bounds) - 1)
    assert rounds == 2 and fan < 20


def test_long_text_in_parts(spark, monkeypatch):
    monkeypatch.setattr(c, "PART", 64)
    text = ("one two three four. " * 30 + "w" * 200 + " five six ") * 5
    assert [w for part in c._parts(text) for w in part if w] == [w for w in re.sub(r"\.", " \n ", text).encode().split(b" ") if w]
    shards = list(c._shards(iter([("en", text), ("fr", "a b"), ("en", "c d e f g")]), 4, 7))
    counts = Counter()
    for rows, weights, words in shards:
        for row, f in zip(rows.tolist(), weights.tolist(), strict=True):
            counts[tuple(words[k - 1] for k in row if k)] += f
    whole = Counter()
    for rows, weights, words in c._shards(iter([("en", text), ("fr", "a b"), ("en", "c d e f g")]), 4, 10**9):
        for row, f in zip(rows.tolist(), weights.tolist(), strict=True):
            whole[tuple(words[k - 1] for k in row if k)] += f
    assert len(shards) > 5 and counts == whole


def test_query_over_its_table(spark, tmp_path):
    rows = corpus(11, 250)
    path = str(tmp_path / "t")
    spark.createDataFrame([(lang, text, 1, "x") for lang, text in rows], "lang string, text string, f int, range string").write.parquet(f"{path}/documents.parquet")
    out = op11_collocations(spark, path)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, out.collect())) == sorted(brute(rows))
    none = str(tmp_path / "none")
    spark.createDataFrame([], "lang string, text string").write.parquet(f"{none}/documents.parquet")
    assert op11_collocations(spark, none).count() == 0

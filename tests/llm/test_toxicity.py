"""The word field: marginals against enumeration, spans, held-out accuracy, and odd inputs."""

import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from opslens.llm import toxicity
from opslens.llm.toxicity import Model, Tagger, clean_documents, fit, is_held_out, score, train

BAD = ["idiot", "scum", "moron", "trash"]


def corpus(n, seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("abcdefghij", k=rnd.randint(2, 7))) for _ in range(400)]
    rows = []
    for i in range(n):
        text = rnd.choices(words, k=rnd.randint(5, 200))
        label = int(rnd.random() < 0.2)
        if label:
            for _ in range(rnd.randint(1, 6)):
                text.insert(rnd.randrange(len(text)), rnd.choice([*BAD, "zorgel" + rnd.choice(words)]))
        rows.append((i, " ".join(text), label))
    return rows


def test_marginals_equal_enumeration():
    model = Model({"wbad": 3.0, "wgood": -1.0}, -2.0, (0.3, -0.4), (0.5, -0.5, -0.2, 0.9), (1.0, 1.0, 1.0, -1.0))
    for text in ("bad", "x bad", "x x good bad bad x x", "bad x x x bad x", "good x x x x"):
        words = text.split()
        weight = {"bad": 3.0, "good": -1.0}
        total, toxic = 0.0, np.zeros(len(words))
        for states in itertools.product((0, 1), repeat=len(words)):
            s = model.start[states[0]] + sum(model.moves[2 * a + b] for a, b in itertools.pairwise(states))
            s += sum(model.bias + weight.get(w, 0.0) for w, y in zip(words, states) if y)
            total += math.exp(s)
            toxic += math.exp(s) * np.array(states)
        at, p, n = Tagger(model).marginals(text)
        assert n == len(words) and [words[i] in weight for i in at] == [True] * len(at)
        np.testing.assert_allclose(p, (toxic / total)[at], rtol=1e-9)


def test_held_out_accuracy_and_spans():
    rows = corpus(1500, 1)
    model = fit([(t, y) for _, t, y in rows[:1000]], (800, 200))
    tagger = Tagger(model)
    found = [tagger.score(t) >= 0.7 for _, t, _ in rows[1000:]]
    assert np.mean(np.array(found) == np.array([bool(y) for _, _, y in rows[1000:]])) > 0.98
    text = "a quiet start, then IDIOT scum; and more. " + "é " * 5000 + "moron"
    assert [text[s["start"] : s["end"]] for s in tagger.spans(text)] == ["IDIOT scum", "moron"]
    assert tagger.spans(None) == tagger.spans("") == [] and tagger.score(None) == tagger.score("") < 0.7


@pytest.fixture(scope="module")
def tables(spark):
    rows = corpus(900, 2)
    docs = [(i, t, "x") for i, t, _ in rows] + [(None, "scum idiot " * 3, "x"), (5000, None, "x"), (5001, "", "x"), (5002, "word " * 20_000 + "scum moron trash idiot", "x"), (3, rows[3][1], "x")]
    labels = [(i, y, 1) for i, _, y in rows] + [(None, 1, 1), (1, None, 1), (2, 7, 1), (9999, 1, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int, spans int")


def test_scores_of_every_row(spark, tables):
    docs, labels = tables
    model = train(docs, labels)
    out = {r.doc_id: r for r in score(docs, model).withColumn("held_out", is_held_out("doc_id")).collect()}
    assert score(docs, model).count() == docs.count() == 905
    for i, r in out.items():
        assert r.held_out == (zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 1) and 0 <= r.score <= 1
    assert out[None].score >= 0.7 > max(out[5000].score, out[5001].score)
    kept = clean_documents(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if r.score < 0.7}


def test_held_out_labels_change_nothing(spark, tables):
    docs, labels = tables
    flipped = labels.withColumn("toxic", F.when(is_held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert train(docs, flipped) == train(docs, labels)


def test_without_labels(spark, tables):
    docs, labels = tables
    for some in (labels.limit(0), labels.filter("toxic = 0")):
        rows = score(docs.limit(5), train(docs, some)).collect()
        assert len(rows) == 5 and all(r.score < 0.7 for r in rows)
    assert score(docs.limit(0), train(docs.limit(0), labels)).count() == 0


def test_sample_is_bounded(spark, tables, monkeypatch):
    docs, labels = tables
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda sample, totals: seen.append((len(sample), totals)))
    train(docs, labels, max_toxic=10, max_clean=20)
    assert 25 <= seen[0][0] <= 30 and sum(seen[0][1]) > 500

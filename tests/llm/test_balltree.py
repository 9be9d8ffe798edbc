"""Exact top-k against brute force."""

import math

import numpy as np
import pytest

from opslens.llm.balltree import top_k

SCHEMA = "vec_id long, embedding array<double>, score string"


def brute(rows, asked, k):
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in whole:
        if q in asked:
            found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole if i != q and len(a) == len(b))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(found[:k], 1)]
    return sorted(out)


def vectors():
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=8) * rng.choice([0.01, 1, 30])).tolist()) for i in range(400)]
    rows += [(1000 + i, [0.5] * 8) for i in range(150)] + [(2000 + i, [1.0, 2.0]) for i in range(3)]
    rows += [(3000, None), (3001, [0.1] * 7 + [None]), (3002, [float("nan")] * 8), (3003, [float("inf")] * 8), (3004, []), (3005, [0.0] * 8), (None, [1.0] * 8)]
    return rows + [(3006, [1e9, -1e9] + [0.0] * 6)]


@pytest.mark.parametrize(("shard", "block"), [(100_000, 2048), (40, 5)])
def test_brute_force(spark, shard, block):
    rows = vectors()
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = top_k(frame, frame.filter("vec_id % 25 = 0"), shard=shard, block=block)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, {i for i, _ in rows if i is not None and i % 25 == 0}, 10)


def test_empty_and_repeated(spark):
    frame = spark.createDataFrame([(1, [1.0], ""), (2, [1.0], ""), (2, [1.0], "")], SCHEMA)
    assert top_k(frame.limit(0), frame).count() == 0
    assert top_k(frame, frame.limit(0)).count() == 0
    assert sorted(map(tuple, top_k(frame, frame).collect())) == [(1, 1, 2, 1 << 20), (1, 2, 2, 1 << 20), (2, 1, 1, 1 << 20)]


def test_repeated_rows_of_a_query_do_not_push_out_others(spark):
    rows = [(1, [2.0])] * 6 + [(i, [1.0]) for i in range(2, 8)]
    frame = spark.createDataFrame([(*r, "") for r in rows], SCHEMA)
    got = top_k(frame, frame.filter("vec_id = 1"), k=3)
    assert sorted(map(tuple, got.collect())) == [(1, r, r + 1, 2 << 20) for r in (1, 2, 3)]

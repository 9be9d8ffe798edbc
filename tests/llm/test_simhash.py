"""SimHash components against a brute-force version."""

import re
from itertools import combinations

import pytest
import xxhash

from opslens.llm.simhash import simhash_components

TEXTS = [
    "The quick brown fox jumps over the lazy dog near the river bank today",
    "The QUICK brown fox jumps over the lazy dog near the river bank today",
    "The quick brown fox jumps over the lazy dog near the river bank tonight",
    "", None, "  \t\n", "one", "one two", "ONE two", "éa éb éc Éd",
    *(" ".join(f"w{(i * k) % 41}" for i in range(60)) + f" tail{k % 3}" for k in range(1, 12)),
    *(" ".join(["same"] * 400 + [f"end{k}"]) for k in range(4)),
    "word " * 30_000,
]


def brute(rows, size=3, radius=2):
    prints = []
    for _, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        parts = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
        hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    label = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= radius and label[i] != label[j]:
            label = [label[i] if x == label[j] else x for x in label]
    least = {c: min(r[0] for r, x in zip(rows, label) if x == c) for c in label}
    return sorted((r[0], f"{p:016x}", least[c]) for r, p, c in zip(rows, prints, label))


@pytest.mark.parametrize("radius", [2, 12])
def test_components_match_brute_force(spark, radius):
    rows = [(100 - 2 * i, t) for i, t in enumerate(TEXTS)] + [(100, TEXTS[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as fingerprint", "1 as component_id", "2 as fp")
    got = simhash_components(docs, radius=radius).drop("component_fingerprint")
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect())) == brute(rows, radius=radius)


def test_links_inside_many_shards(spark):
    """Random and clustered fingerprints, with shards and leaves far smaller than the input."""
    import numpy as np

    from opslens.llm import simhash

    rng = np.random.default_rng(5)
    points = rng.integers(0, 1 << 64, 3000, dtype=np.uint64)
    near = points[:300] ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    points = np.unique(np.concatenate([points, near]))
    full = np.bitwise_count(points[:, None] ^ points[None, :]) <= 2
    parent = np.arange(len(points))
    simhash.unite(parent, *np.nonzero(full))
    assert (simhash.link(points, 2) == parent).all()
    nodes = simhash.shard_tree(points[::7], 4)
    parts = dict(simhash.shards_of(points, nodes, 4, 2))
    assert len(parts) == 16 and max(map(len, parts.values())) < len(points) / 2
    held = np.zeros_like(full)
    for at in parts.values():
        held[np.ix_(at, at)] = True
    assert (held | ~full).all()


def test_empty_table(spark):
    assert simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (None, "z y x")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in simhash_components(docs).collect()}
    assert got == {(None, 7), (7, 7), (None, None)}

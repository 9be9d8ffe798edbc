"""SimHash near-duplicates: fingerprints dealt to shards by a vantage-point tree, linked by exact distance.

At every node of the tree a set S is split by the distance d to its vantage point: ``d <= mu + radius``
goes inside and ``d > mu`` outside.  By the triangle inequality two fingerprints within ``radius`` of each
other always share a side: if one has d <= mu, the other has d <= mu + radius.  Only the fingerprints
between mu and mu + radius are held twice, and every link is found in at least one leaf.  The upper levels
of the tree are the shards; inside a shard the same split goes on until a leaf is compared directly.
A shard gives at most one edge per fingerprint (to the smallest one it is connected with), so a dense
group does not become all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.llm.common import staged
from opslens.llm.components import components, unite

SEED = 42
#: Distinct fingerprints aimed at in a shard, and fingerprints sampled for each shard to place the tree's splits.
SHARD = 16_384
SAMPLE_PER_SHARD = 64
LEAF = 256


def fingerprint(text: bytes | None, size: int) -> int:
    """Bit i is set if it is set in over half of the shingles' XXH64; no words: 0."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < size:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles))
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """One row (id, fingerprint as signed long) per row of ``docs``; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            made = np.fromiter((fingerprint(t.as_py(), size) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, fp long")


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def vantage(points: np.ndarray) -> tuple[np.uint64, int]:
    """The candidate that spreads the distances most, and their median."""
    candidates = points[:: max(1, len(points) // 8)][:8]
    probe = points[:: max(1, len(points) // 1024)]
    best = max(candidates, key=lambda c: float(np.std(distance(probe, c))))
    return best, int(np.median(distance(probe, best)))


def split(points: np.ndarray, vp: np.uint64, mu: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    d = distance(points, vp)
    return d <= mu + radius, d > mu


def shard_tree(sample: np.ndarray, depth: int) -> list[tuple[int, int]]:
    """(vantage point, mu) of the nodes of a complete binary tree, root first; node i has 2i+1 and 2i+2."""
    nodes: list[tuple[int, int]] = []
    parts = [sample]
    for _ in range(depth):
        below = []
        for part in parts:
            vp, mu = vantage(part) if len(part) else (np.uint64(0), 32)
            nodes.append((int(vp), mu))
            near = distance(part, vp) <= mu
            below += [part[near], part[~near]]
        parts = below
    return nodes


def shards_of(points: np.ndarray, nodes: list[tuple[int, int]], depth: int, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, indices of the points that belong to it)."""
    level = [np.arange(len(points))]
    for k in range(depth):
        below = []
        for j, at in enumerate(level):
            vp, mu = nodes[(1 << k) - 1 + j]
            inside, outside = split(points[at], np.uint64(vp), mu, radius)
            below += [at[inside], at[outside]]
        level = below
    yield from enumerate(level)


def link_leaf(points: np.ndarray, at: np.ndarray, radius: int, parent: np.ndarray) -> None:
    for i in range(0, len(at), LEAF):
        block = at[i : i + LEAF]
        for j in range(i, len(at), 16 * LEAF):
            other = at[j : j + 16 * LEAF]
            a, b = np.nonzero(distance(points[block][:, None], points[other][None, :]) <= radius)
            unite(parent, block[a], other[b])


def link(points: np.ndarray, radius: int) -> np.ndarray:
    """For each of the distinct ``points`` the index of the smallest point it is connected with (points sorted)."""
    parent = np.arange(len(points))
    todo = [np.arange(len(points))]
    while todo:
        at = todo.pop()
        if len(at) > LEAF:
            inside, outside = split(points[at], *vantage(points[at]), radius)
            if max(inside.sum(), outside.sum()) <= 0.9 * len(at):
                todo += [at[inside], at[outside]]
                continue
        link_leaf(points, at, radius, parent)
    return parent


def fingerprint_links(distinct: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints (column fp) within ``radius`` of each other."""
    total = distinct.count()
    depth = max(0, int(np.ceil(np.log2(max(1, total) / SHARD))))
    want = SAMPLE_PER_SHARD << depth
    # Which fingerprints are sampled only moves the splits: any tree gives the same links.
    picked = distinct.filter(F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < F.lit(int(np.ceil(2 * want / max(1, total) * (1 << 20)))))
    sample = np.array([r[0] for r in picked.limit(want).collect()], np.int64).view(np.uint64) if depth else np.zeros(0, np.uint64)
    nodes = shard_tree(sample, depth)

    def deal(batches):
        for batch in batches:
            values = np.asarray(batch.column(0)).view(np.uint64)
            for shard, at in shards_of(values, nodes, depth, radius):
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), shard, np.int32)), pa.array(values[at].view(np.int64))], ["shard", "fp"])

    def inside(table: pa.Table) -> pa.Table:
        points = np.unique(table.column("fp").to_numpy().view(np.uint64))
        root = link(points, radius)
        moved = root != np.arange(len(points))
        return pa.table({"a": points[moved].view(np.int64), "b": points[root[moved]].view(np.int64)})

    return distinct.mapInArrow(deal, "shard int, fp long").groupBy("shard").applyInArrow(inside, "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 2) -> DataFrame:
    """(id, fingerprint hex, component_id, component_fp) for every row: the documents reachable over links.

    component_id is the smallest id of the component.  Null and empty texts have fingerprint zero and are
    linked like any other; rows that share an id keep a row each; a null id never names a component unless
    all its ids are null.  An empty table gives no rows.
    """
    rows = staged(fingerprints(docs, id_col, text_col, size), "fingerprints")
    groups = staged(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    joined = components(fingerprint_links(groups.select("fp"), radius))
    named = groups.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of = named.select("fp", "component").join(names, "component")
    return rows.join(of, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id",
        F.lpad(F.lower(F.hex("component")), 16, "0").alias("component_fingerprint"),
    )

"""Exact top-k by inner product: a ball tree per shard, searched by branch and bound.

No vector of a ball has a larger inner product with a query q than ``q.centre + |q| radius``.  Nodes are visited
in the order of that bound, and a node is left out once its bound lies below the query's k-th score so far.

Vectors are dealt to shards and queries to blocks; a task searches one shard for one block.  The k-th score is
shared in two rounds: every query is first searched in one shard, which gives a k-th score that holds for the
whole table, and all other shards begin with it.  A shard then returns only what can still enter the top k.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opslens.llm.common import staged

#: Vectors in a shard and queries in a block, about; a task holds one of each.
SHARD, BLOCK = 16_384, 2048
LEAF = 64
#: Integer products are exact in 64 bits below these sizes; larger components are computed with Python's integers.
SAFE = 1 << 26


class Ball:
    __slots__ = ("at", "below", "centre", "radius")

    def __init__(self, points: np.ndarray, at: np.ndarray):
        self.at, self.below = at, ()
        own = points[at]
        self.centre = own.mean(axis=0)
        self.radius = float(np.sqrt(((own - self.centre) ** 2).sum(axis=1).max()))


def ball_tree(points: np.ndarray) -> Ball:
    """Balls split between two far points until they are small or hold one point many times."""
    root = Ball(points, np.arange(len(points)))
    todo = [root]
    while todo:
        ball = todo.pop()
        if len(ball.at) <= LEAF or ball.radius == 0:
            continue
        own = points[ball.at]
        one = own[((own - ball.centre) ** 2).sum(axis=1).argmax()]
        other = own[((own - one) ** 2).sum(axis=1).argmax()]
        near = own @ (one - other) > ((one + other) / 2) @ (one - other)
        if near.all() or not near.any():
            continue
        ball.below = (Ball(points, ball.at[near]), Ball(points, ball.at[~near]))
        todo += ball.below
    return root


def search(tree: Ball, vectors: np.ndarray, ids: np.ndarray, query: np.ndarray, own_id: int, k: int, floor: int | None) -> list[tuple[int, int]]:
    """The k best (score, id) among ``vectors``, ties to the smaller id, of those not below ``floor``."""
    q = query.astype(float)
    length = float(np.sqrt(q @ q))
    bound = lambda ball: float(q @ ball.centre) + length * ball.radius + 1e-9 * (1 + length * (ball.radius + float(np.abs(ball.centre).sum())))
    best: list[tuple[int, int]] = []  # heap of (score, -id), the worst first
    queue = [(-bound(tree), 0, tree)]
    number = 1
    while queue:
        negative, _, ball = heapq.heappop(queue)
        least = best[0][0] if len(best) == k else None
        least = floor if least is None else least if floor is None else max(least, floor)
        if least is not None and -negative < least:
            break
        if ball.below:
            for part in ball.below:
                heapq.heappush(queue, (-bound(part), number, part))
                number += 1
            continue
        scores = vectors[ball.at] @ query
        maybe = np.arange(len(scores)) if least is None else np.flatnonzero(scores >= least)
        maybe = maybe[ids[ball.at[maybe]] != own_id]
        if len(maybe) > k:
            maybe = maybe[np.lexsort((ids[ball.at[maybe]], -scores[maybe]))[:k]]
        for i in maybe.tolist():
            at = ball.at[i]
            entry = (int(scores[i]), -int(ids[at]))
            if len(best) < k:
                heapq.heappush(best, entry)
            elif entry > best[0]:
                heapq.heapreplace(best, entry)
    return [(s, -i) for s, i in sorted(best, reverse=True)]


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """The floors of the components as exact integers."""
    flat = np.floor(column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
    return flat.astype(np.int64) if not len(flat) or np.abs(flat).max() < SAFE else np.array([[int(x) for x in row] for row in flat], object)


def scaled(df: DataFrame, id_col: str, vector_col: str, scale: int = 1024) -> DataFrame:
    """(id, dim, v): scale * x of every component; vectors that are null or hold null, NaN or infinity are left out.

    For a scale that is a power of two the product is exact, and a task takes its floor.
    """
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    scaled_up = F.transform(v, lambda x: x.cast("double") * scale)
    rows = df.filter(F.col(id_col).isNotNull() & v.isNotNull()).filter(~bad)
    return rows.select(F.col(id_col).cast("long").alias("id"), F.size(v).alias("dim"), scaled_up.alias("v"))


def _run(k: int):
    def task(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        dim = key[0].as_py()
        if left.num_rows and right.num_rows and dim:
            points, queries = _matrix(left.column("v"), dim), _matrix(right.column("v"), dim)
            ids, query_ids = left.column("id").to_numpy(), right.column("id").to_numpy()
            tree = ball_tree(points.astype(float))
            floors = right.column("floor").to_pylist()
            for query, query_id, floor in zip(queries, query_ids, floors, strict=True):
                for score, at in search(tree, points, ids, query, int(query_id), k, None if floor is None else int(floor)):
                    out[0].append(int(query_id))
                    out[1].append(at)
                    out[2].append(score)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.int64())})

    return task


def _top(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of every query with the vectors of other ids.

    Only vectors of the query's own number of components are compared; vectors without components take no part.
    A repeated id keeps every row as a candidate.  Rows of a query id that repeats are one query, with the
    smallest vector.  A score beyond 64 bits ends the job.  Empty tables give no rows.
    """
    points = staged(scaled(vectors, id_col, vector_col, scale).filter("dim > 0"), "vectors")
    asked = scaled(queries, id_col, vector_col, scale).filter("dim > 0")
    asked = staged(asked.groupBy("id").agg(F.min(F.struct("dim", "v")).alias("q")).select("id", "q.dim", "q.v"), "queries")
    shards = max(1, round(points.count() / shard))
    blocks = max(1, -(-asked.count() // block))
    held = points.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    dealt = held.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = asked.withColumn("block", F.pmod(F.xxhash64(F.col("id") + 1), F.lit(blocks)).cast("int"))
    keys = ["dim", "shard", "block"]
    schema = "query_id long, vec_id long, score long"

    def searched(of: DataFrame, questions: DataFrame) -> DataFrame:
        return of.groupBy(*keys).cogroup(questions.groupBy(*keys)).applyInArrow(_run(k), schema)

    home = F.pmod(F.xxhash64(F.col("id") + 2), F.lit(shards)).cast("int")
    first = staged(searched(dealt, asked.withColumn("shard", home).withColumn("floor", F.lit(None).cast("long"))), "first-round")
    kth = _top(first, k).groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") == k, F.min("score")).alias("floor"))
    others = asked.join(kth, "id", "left").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).filter(F.col("shard") != home)
    found = first if shards == 1 else first.union(searched(dealt, others))
    return _top(found, k).select("query_id", "rank", "vec_id", "score")

"""Benchmark items contained in documents, found by size-partitioned MinHash sketches and checked exactly.

An item of n distinct shingles is contained at ``similarity`` t if at least need = ceil(t * n) of them occur in
the document.  Then a document that contains it holds at least one of any n - need + 1 of its shingles, so the
sketch of an item is its n - need + 1 smallest shingle hashes (a bottom-k MinHash).  Items are partitioned by
size, as k depends on n: every partition's sketch is exactly as long as its sizes require, and no contained item
is missed however long the document is.  Candidates are checked against the whole shingle set.

If the items' shingle sets are small (``local_hashes``, by count) every task gets them and looks its documents
up in one pass without a shuffle; larger benchmarks go by joins on the hashes, with the same rows as result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opslens.llm.common import with_row_id
from opslens.llm.shingles import Powers, shingled

#: Largest number of item shingles that is sent to every task (8 bytes each, and an item number).
LOCAL_HASHES = 1_000_000


def need_of(n: np.ndarray, similarity: float) -> np.ndarray:
    return np.maximum(1, np.ceil(np.asarray(n) * similarity - 1e-9).astype(np.int64))


def shingle_rows(df: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, hash) of every distinct shingle of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for part in shingled(batch.column(1), size, powers):
                n = len(part.bounds) - 1
                owner = np.repeat(np.arange(n), np.diff(part.bounds))
                if not len(owner):
                    continue
                order = np.lexsort((part.hashes, owner))
                o, h = owner[order], part.hashes[order]
                new = np.concatenate(([True], (o[1:] != o[:-1]) | (h[1:] != h[:-1])))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(o[new] + part.first)), pa.array(h[new].view(np.int64))], ["id", "hash"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, hash long")


class Items:
    """Shingle sets of the items as one sorted array of distinct hashes, and which items hold each of them."""

    def __init__(self, item: np.ndarray, hashes: np.ndarray, similarity: float):
        self.ids, number = np.unique(item, return_inverse=True)
        n = np.bincount(number, minlength=len(self.ids))
        self.need = need_of(n, similarity)
        order = np.lexsort((hashes, number))
        rank = np.arange(len(order)) - np.concatenate(([0], np.cumsum(n)))[number[order]]
        sketched = np.zeros(len(order), bool)
        sketched[order] = rank < (n - self.need + 1)[number[order]]
        by_hash = np.argsort(hashes, kind="stable")
        self.hashes, first = np.unique(hashes[by_hash], return_index=True)
        self.bounds = np.append(first, len(hashes))
        self.owner = number[by_hash]
        self.sketch = np.unique(hashes[sketched])

    def contained(self, shingles: np.ndarray) -> list[int]:
        """Items contained in a document of the given distinct shingles."""
        at = np.searchsorted(self.hashes, shingles)
        at = at[(at < len(self.hashes)) & (self.hashes[np.minimum(at, len(self.hashes) - 1)] == shingles)]
        owners = np.concatenate([self.owner[self.bounds[i] : self.bounds[i + 1]] for i in at])
        counts = np.bincount(owners, minlength=len(self.ids))
        return [int(i) for i in self.ids[counts >= self.need]]

    def matches(self, column: pa.Array, size: int, powers: Powers) -> Iterator[tuple[int, list[int]]]:
        """(row, its items) of the rows that contain any."""
        if not len(self.sketch):
            return
        low = (self.sketch >> np.uint64(48)).astype(np.int64)
        coarse = np.zeros(1 << 16, bool)
        coarse[low] = True
        for part in shingled(column, size, powers):
            maybe = np.flatnonzero(coarse[part.hashes >> np.uint64(48)])
            h = part.hashes[maybe]
            at = np.minimum(np.searchsorted(self.sketch, h), len(self.sketch) - 1)
            hit = maybe[self.sketch[at] == h]
            for row in np.unique(np.searchsorted(part.bounds, hit, "right") - 1):
                if items := self.contained(np.unique(part.hashes[part.bounds[row] : part.bounds[row + 1]])):
                    yield part.first + int(row), items


def local_items(items: DataFrame, similarity: float, local_hashes: int) -> Items | None:
    """The item shingles (id, hash) on the driver if they are few enough, else None."""
    rows = items.limit(local_hashes + 1).toArrow()
    if rows.num_rows > local_hashes:
        return None
    return Items(rows.column("id").to_numpy(), rows.column("hash").to_numpy().view(np.uint64), similarity)


def joined_matches(docs: DataFrame, items: DataFrame, similarity: float) -> DataFrame:
    """(id, item) by joins, from distinct (id, hash) rows of the documents and of the items."""
    n = items.groupBy("id").agg(F.count("*").alias("n"))
    need = n.withColumn("need", F.greatest(F.lit(1), F.ceil(F.col("n") * similarity - 1e-9)))
    items = items.join(need, "id").select(F.col("id").alias("item"), "hash", "n", "need")
    ranked = items.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy("hash")))
    sketch = ranked.filter("rank <= n - need + 1").select("item", "hash")
    found = docs.join(sketch, "hash").select("id", "item").distinct()
    whole = found.join(items, "item").join(docs, ["id", "hash"]).groupBy("id", "item", "need").agg(F.count("*").alias("held"))
    return whole.filter("held >= need").select("id", "item")


def _items(items: DataFrame, item_col: str, text_col: str, size: int) -> DataFrame:
    return shingle_rows(items.filter(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("id"), F.col(text_col).alias("text")), "id", "text", size).distinct()


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", size: int = 5, similarity: float = 0.8, local_hashes: int = LOCAL_HASHES) -> DataFrame:
    """(id, items): the documents that contain benchmark items, with the items' ids in ascending order.

    Null and empty texts contain nothing and are contained nowhere, items of a null id are left out, and an item
    of fewer than ``size`` words is one shingle, its whole sequence.  Rows of one item id count as one text set;
    rows of one document id keep a row each.  Empty tables give no rows.
    """
    hashed = _items(items, item_col, text_col, size)
    small = local_items(hashed, similarity, local_hashes)
    kind = docs.schema[id_col].dataType.simpleString()
    if small is None:
        numbered, row = with_row_id(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "numbered")
        found = joined_matches(shingle_rows(numbered, row, "text", size), hashed, similarity)
        found = found.groupBy(F.col("id").alias(row)).agg(F.sort_array(F.collect_set("item")).alias("items"))
        return numbered.join(found, row).select(F.col("id").alias(id_col), "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            found = list(small.matches(batch.column(1), size, powers))
            rows = pa.array([r for r, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array([x for _, x in found], pa.list_(pa.int64()))], ["id", "items"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, items array<long>").withColumnRenamed("id", id_col)


def clean_documents(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", size: int = 5, similarity: float = 0.8, local_hashes: int = LOCAL_HASHES) -> DataFrame:
    """The documents that contain no benchmark item, with all their columns."""
    hashed = _items(items, item_col, text_col, size)
    small = local_items(hashed, similarity, local_hashes)
    if small is None:
        numbered, row = with_row_id(docs, "numbered")
        found = joined_matches(shingle_rows(numbered, row, text_col, size), hashed, similarity)
        return numbered.join(found.select(F.col("id").alias(row)).distinct(), row, "left_anti").drop(row)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for row, _ in small.matches(batch.column(at).cast(pa.binary()), size, powers):
                keep[row] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)

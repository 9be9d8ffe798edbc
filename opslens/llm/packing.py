"""Best-fit packing of documents into sequences of a fixed number of tokens, by hierarchical residual rounds.

A document longer than a sequence is cut into full sequences, its first piece holding the remainder.  Only the
remainders need packing.  Each task packs its pieces best-fit, longest first, and emits the bins that are nearly
full.  The underfull bins become items themselves: in every following round fewer tasks take the bins of several
tasks of the round before (a tree) and pack them best-fit again, until a round leaves nothing that fits together
or no longer improves.  A task never takes more than ``MAX_ITEMS`` items; only lengths and numbers are shuffled.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.llm.common import staged
from opslens.llm.tokens import encoder

FAN_IN = 8
MAX_ITEMS = 100_000
#: A bin with at most this share of the sequence free is emitted before the last round.
NEARLY = 0.002


def pieces(docs: DataFrame, path: str, length: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every piece of every row; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(path)
        for batch in batches:
            row, piece, start, size, crc = [], [], [], [], []
            for r, ids in enumerate(made.ids_of(text.as_py() for text in batch.column(1))):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                cuts = [0, *range((len(ids) - 1) % length + 1, len(ids) + 1, length)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    row.append(r)
                    piece.append(k)
                    start.append(a)
                    size.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32())]
            columns += [pa.array(x, pa.int64()) for x in (start, size, crc)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of every item and the fill of every bin: longest item first, into the fullest bin it fits."""
    order = np.argsort(-sizes, kind="stable").tolist()
    room_of: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by free room
    rooms: list[int] = []  # the rooms that have bins, ascending
    where, offset, fill = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    for i in order:
        size = int(sizes[i])
        k = bisect_left(rooms, size)
        if k == len(rooms):
            b, room = len(fill), capacity
            fill.append(0)
        else:
            room = rooms[k]
            b = room_of[room].pop()
            if not room_of[room]:
                rooms.pop(k)
        where[i], offset[i] = b, fill[b]
        fill[b] += size
        room -= size
        if room:
            if not room_of[room]:
                rooms.insert(bisect_left(rooms, room), room)
            room_of[room].append(b)
    return where, offset, np.array(fill, np.int64)


def _round(items: DataFrame, number: int, capacity: int) -> DataFrame:
    """(item, bin, offset, fill) of every (item, length), packed within each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        context = TaskContext.get()
        base = (number << 56) + ((context.partitionId() if context else 0) << 32)
        for keys, sizes in _gathered(batches):
            where, offset, fill = best_fit(sizes, capacity)
            columns = [keys, base + made + where, offset, fill[where]]
            made += len(fill)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["item", "bin", "offset", "fill"])

    return items.mapInArrow(run, "item long, bin long, offset long, fill long")


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of a partition in lots of MAX_ITEMS at least, the last one whole."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        if sum(len(k) for k, _ in held) >= MAX_ITEMS:
            yield np.concatenate([k for k, _ in held]), np.concatenate([s for _, s in held])
            held = []
    if held:
        yield np.concatenate([k for k, _ in held]), np.concatenate([s for _, s in held])


def pack(items: DataFrame, capacity: int) -> DataFrame:
    """(item, bin, offset) for rows of (item: unique long, length: 1 to capacity)."""
    total = items.count()
    tasks = max(1, min(-(-total // 2000), -(-total // MAX_ITEMS) * FAN_IN))
    placed, number, left = None, 0, total
    current = items.select("item", "length")
    while True:
        # Dealt by length, round about: every task gets the same mix of lengths.
        dealt = current.repartition(tasks) if tasks > 1 else current.coalesce(1)
        packed = staged(_round(dealt, number, capacity), "packed")
        step = packed.select("item", "bin", "offset")
        placed = step if placed is None else placed.join(
            step.select(F.col("item").alias("bin"), F.col("bin").alias("to"), F.col("offset").alias("by")), "bin", "left"
        ).select("item", F.coalesce("to", "bin").alias("bin"), (F.col("offset") + F.coalesce("by", F.lit(0))).alias("offset"))
        placed = staged(placed, "placed") if number else placed
        under = packed.filter(F.col("fill") < capacity * (1 - NEARLY)).select(F.col("bin").alias("item"), F.col("fill").alias("length")).distinct()
        counted = under.agg(F.count("*").alias("n"), F.min("length").alias("least")).first()
        best = under.filter(F.col("length") <= capacity - (counted["least"] or 0)).count() if counted["n"] else 0
        # Done if no bin fits with the smallest one, or if the last, widest round has been packed.
        if best <= 1 or tasks == 1 or (number and counted["n"] > 0.98 * left):
            return placed
        left, current, number = counted["n"], under, number + 1
        tasks = max(-(-tasks // FAN_IN), -(-left // MAX_ITEMS))


def packed_pieces(docs: DataFrame, path: str, length: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are a piece of the end id alone; rows that share an id are packed each on its own; an
    empty table gives no rows.  Every sequence holds at most ``length`` tokens, without gaps from 0.
    """
    cut = pieces(docs, path, length, end_id, id_col, text_col)
    cut = staged(cut.withColumn("item", F.monotonically_increasing_id()), "pieces")
    full = cut.filter(F.col("length") == length).withColumn("sequence_id", -1 - F.col("item")).withColumn("offset", F.lit(0).cast("long"))
    rest = cut.filter(F.col("length") < length)
    placed = pack(rest.select("item", "length"), length).select("item", F.col("bin").alias("sequence_id"), "offset")
    columns = [F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return full.select(*columns).union(rest.join(placed, "item").select(*columns))

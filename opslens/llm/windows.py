"""Order-preserving packing: a stream of documents is cut into windows by dynamic programming.

The documents of a partition stand one behind the other, in their order.  A window may end behind a document, behind a
sentence, or, within a run of more than ``RUN`` tokens without either, behind every ``GRAIN``-th token.  What a window
costs is its padding (none for a full window or a power of two) and a penalty for the kind of its end:

    best(j) = penalty(j) + min over i, with length = end(j) - end(i) <= capacity, of best(i) + padding(length)

For padded windows the minimum is over ``best(i) + end(i)`` in a window that only moves forward, kept in a monotone
queue; for powers of two the few ends at that distance are looked up.  So the work grows with the number of ends.

A partition goes through in blocks of some hundred thousand tokens.  The last windows of a block are not emitted: their
documents open the next block, where the cuts are chosen again with what follows.  Nothing is shuffled.
"""

from __future__ import annotations

import itertools
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.llm.tokens import encoder

RUN, GRAIN = 128, 32
#: Tokens of padding that a cut behind a sentence, or within one, may save at most.
SENTENCE, WITHIN = 2, 16
BLOCK = 400_000
COLUMNS = ("id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
#: Windows at a block's end that are cut again with the next block.
HELD = 8


def window_ends(ends: np.ndarray, penalty: np.ndarray, capacity: int) -> list[int]:
    """The cheapest choice among ``ends`` (ascending, the last one closes the stream) for windows that start at 0."""
    ends = np.concatenate([[0], ends]).astype(np.int64)
    later, exact = _ends_apart(ends, sorted({1 << k for k in range(capacity.bit_length())} | {capacity}))
    first = np.searchsorted(later, np.arange(len(ends) + 1)).tolist()
    exact = exact.tolist()
    place, cost = ends.tolist(), [0, *penalty.tolist()]
    best, came = [0] * len(place), [0] * len(place)
    queue: deque[int] = deque([0])
    for j in range(1, len(place)):
        here = place[j]
        while place[queue[0]] < here - capacity:
            queue.popleft()
        i = queue[0]
        least = best[i] + place[i] + capacity - here
        for k in exact[first[j] : first[j + 1]]:
            if best[k] <= least:
                least, i = best[k], k
        best[j], came[j] = least + cost[j], i
        weight = best[j] + here
        while queue and best[queue[-1]] + place[queue[-1]] >= weight:
            queue.pop()
        queue.append(j)
    out, j = [], len(place) - 1
    while j:
        out.append(place[j])
        j = came[j]
    return out[::-1]


def _ends_apart(ends: np.ndarray, distances: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(j, i) of the ends that stand exactly one of the distances apart, by j."""
    later, earlier = [], []
    for distance in distances:
        at = ends - distance
        i = np.searchsorted(ends, at)
        j = np.flatnonzero(ends[i] == at)
        later.append(j)
        earlier.append(i[j])
    later, earlier = np.concatenate(later), np.concatenate(earlier)
    order = np.argsort(later, kind="stable")
    return later[order], earlier[order]


def possible_ends(sizes: np.ndarray, sentences: np.ndarray, run: int = RUN, grain: int = GRAIN, sentence: int = SENTENCE, within: int = WITHIN) -> tuple[np.ndarray, np.ndarray]:
    """(ends, penalty) of a stream of documents of ``sizes`` tokens with sentence ends at ``sentences`` of the stream."""
    documents = np.cumsum(sizes)
    # A sentence end just before the end id is left to the document's own end.
    natural = np.union1d(documents, sentences[~np.isin(sentences + 1, documents)])
    start = np.concatenate([[0], natural[:-1]])
    extra = np.where(natural - start > run, (natural - start - 1) // grain, 0)
    step = np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra) + 1
    inner = np.repeat(start, extra) + step * grain
    ends = np.concatenate([natural, inner])
    penalty = np.concatenate([np.where(np.isin(natural, documents), 0, sentence), np.full(len(inner), within)])
    order = np.argsort(ends, kind="stable")
    return ends[order], penalty[order]


class _Stream:
    """Documents that are not wholly emitted yet: their ids in a row, and where each begins."""

    def __init__(self, closing: np.ndarray, capacity: int, penalties: tuple[int, int]):
        self.closing, self.capacity, self.penalties = closing, capacity, penalties
        self.keys: list[tuple[int, int]] = []  # (batch, row) of each document
        self.done: list[int] = []  # ids of each that earlier windows hold
        self.ids: list[np.ndarray] = []  # the ids that are left
        self.whole: list[int] = []  # ids of each in total
        self.held, self.windows = 0, 0

    def add(self, key: tuple[int, int], ids: np.ndarray) -> None:
        self.keys.append(key)
        self.done.append(0)
        self.ids.append(ids)
        self.whole.append(len(ids))
        self.held += len(ids)

    def cut(self, last: bool) -> list[tuple]:
        """Pieces (key, start, ids, whole, window, offset); without ``last`` the newest windows are held back."""
        if not self.ids:
            return []
        ids, sizes = np.concatenate(self.ids), np.array([len(x) for x in self.ids])
        sentences = np.flatnonzero(self.closing[ids]) + 1
        run, grain = min(RUN, self.capacity), min(GRAIN, self.capacity)
        chosen = window_ends(*possible_ends(sizes, sentences, run, grain, *self.penalties), self.capacity)
        if not last:
            chosen = chosen[:-HELD]
        begins = np.concatenate([[0], np.cumsum(sizes)])
        end = chosen[-1] if chosen else 0
        starts = np.array([0, *chosen], np.int64)
        edges = np.union1d(begins[begins <= end], starts)
        document, window = (np.searchsorted(x, edges[:-1], "right") - 1 for x in (begins, starts))
        inside, offset = edges[:-1] - begins[document], edges[:-1] - starts[window]
        out = []
        for a, b, d, at, w, o in zip(*(x.tolist() for x in (edges[:-1], edges[1:], document, inside, window, offset)), strict=True):
            out.append((self.keys[d], self.done[d] + at, ids[a:b], self.whole[d], self.windows + w, o))
        self.windows += len(chosen)
        self._forget(end, begins)
        return out

    def _forget(self, end: int, begins: np.ndarray) -> None:
        d = int(np.searchsorted(begins, end, "right")) - 1
        for name in ("keys", "done", "ids", "whole"):
            setattr(self, name, getattr(self, name)[d:])
        if self.ids:
            self.done[0] += end - int(begins[d])
            self.ids[0] = self.ids[0][end - int(begins[d]) :]
        self.held -= end


def closing_ids(tokenizer) -> np.ndarray:
    """Whether each id of a vocabulary closes a sentence: a full stop, question or exclamation mark that ends a word."""
    vocabulary = tokenizer.get_vocab()
    suffix = "</w>" if any(token.endswith("</w>") for token in vocabulary) else ""
    closing = np.zeros(max(vocabulary.values()) + 1, bool)
    for token, number in vocabulary.items():
        closing[number] = token.endswith(tuple(mark + suffix for mark in ".!?"))
    return closing


def windows(
    docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
    sentence: int = SENTENCE, within: int = WITHIN, block: int = BLOCK, ids: bool = False,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, with ``ids`` its token ids too.

    Documents keep the order in which their partition stores them.  A document is its ids and ``end_id``; null and empty
    texts are the end id alone, so every row gives a piece; rows that share an id stand each for itself; an empty table
    gives no rows.  Pieces lie in windows of at most ``capacity`` tokens without gaps.  A document of any length goes
    through, in as many windows as it needs; its ids are held at once.
    """

    columns_out = (*COLUMNS, "ids") if ids else COLUMNS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, context = encoder(path), TaskContext.get()
        base = (context.partitionId() if context else 0) << 40
        stream = _Stream(closing_ids(made.tokenizer), capacity, (sentence, within))
        names: dict[int, pa.Array] = {}  # id column of the batches that documents are held from

        def emitted(last: bool) -> Iterator[pa.RecordBatch]:
            for number, some in itertools.groupby(stream.cut(last), lambda piece: piece[0][0]):
                keys, start, parts, whole, window, offset = zip(*some, strict=True)
                columns = [start, map(len, parts), map(zlib.crc32, parts), whole, (base + w for w in window), offset]
                out = [names[number].take(pa.array([row for _, row in keys], pa.int64()))]
                out += [pa.array(list(c), pa.int64()) for c in columns]
                if ids:
                    out.append(pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(out, list(columns_out))
            needed = {number for number, _ in stream.keys}
            for number in [n for n in names if n not in needed]:
                del names[number]

        for number, batch in enumerate(batches):
            names[number] = batch.column(0)
            for row, found in enumerate(made.ids_of(text.as_py() for text in batch.column(1))):
                stream.add((number, row), np.append(found, np.uint32(end_id)).astype("<u4"))
                if stream.held >= block + HELD * capacity:
                    yield from emitted(False)
        yield from emitted(True)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(run, f"id {kind}, " + ", ".join(f"{c} long" for c in COLUMNS[1:]) + (", ids array<int>" if ids else ""))
    return out.withColumnRenamed("id", id_col)

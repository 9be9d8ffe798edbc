"""Token ids as binary shards, compressed by Re-Pair grammars.

A shard holds the ids of documents in ascending order.  Its grammar is found by Re-Pair: the most frequent
pairs of neighbouring symbols are replaced by nonterminals, again and again, until no pair is frequent enough.
Pairs that share no symbol with each other do not compete for an occurrence, so a round takes the frequent pairs
in the order of their counts and replaces all whose symbols are not yet used in the round.  A pair never spans
two documents, so each document is a range of the shard's sequence and can be decoded alone; the expansion
length of every symbol gives random access inside a document without decoding what comes before.

File format (a shard is the binary value of one row): little-endian unsigned 32-bit numbers
  magic, first nonterminal, number of rules R, number of documents D, length of the sequence S,
  R pairs (left, right), R expansion lengths, D + 1 sequence bounds of the documents, D token counts, S symbols.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.llm.common import task_partitions
from opslens.llm.tokens import encoder, ranges

MAGIC = 0x31525052
#: Ids in a shard, about; a longer document is a shard of its own.
SHARD_IDS = 1_000_000
ROUNDS = 12
LEAST = 8
#: Pairs counted by hash before the exact count of the frequent ones.
CELLS = 1 << 20
#: Turns in which pairs that do not compete are taken at once.
TURNS = 32
SEPARATOR = 0xFFFFFFFF
#: Stands for no partner; no symbol is that large.
NONE = 0xFFFFFFFE


class Grammar(NamedTuple):
    first: int  # symbols below are ids
    rules: np.ndarray  # (R, 2)
    lengths: np.ndarray  # ids that each nonterminal stands for
    sequence: np.ndarray


def keys_at(seq: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The pairs (left << 32 | right) at these places that hold no separator."""
    left, right = seq[at].astype(np.uint64), seq[at + 1].astype(np.uint64)
    return (left << np.uint64(32) | right)[(left != SEPARATOR) & (right != SEPARATOR)]


def counted(keys: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, counts) of the pairs that occur at least ``least`` times, in ascending order; sorts ``keys``."""
    keys.sort()
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    pairs, counts = keys[new], np.diff(np.append(new, len(keys)))
    often = counts >= least
    return pairs[often], counts[often]


def frequent_pairs(seq: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`counted` of all pairs of a sequence."""
    seq = seq.astype(np.int64)
    cell = seq[:-1] * 0x9E3779B1
    cell += seq[1:]
    cell &= CELLS - 1
    maybe = (np.bincount(cell, minlength=CELLS) >= least)[cell]
    inside = seq != SEPARATOR
    maybe &= inside[:-1] & inside[1:]
    keys = (seq[:-1] << 32 | seq[1:])[maybe]
    return counted(keys.view(np.uint64), least)


def around(at: np.ndarray, size: int, after: int) -> np.ndarray:
    """The places of a sequence's pairs from one before ``at`` to ``after`` behind, each once; ``at`` ascends, by more than ``after``."""
    before = at - 1
    apart = np.diff(at, prepend=-1) > after + 1
    apart[:1] = at[:1] > 0
    near = np.concatenate([before[apart], *(at + k for k in range(after + 1))])
    return near[near < size - 1]


def recounted(pairs: np.ndarray, counts: np.ndarray, gone: np.ndarray, new: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The frequent pairs after a round in which the pairs ``gone`` went and ``new`` ones came.

    Every new pair holds a symbol of the round, so a pair that was not frequent cannot become so, and only the places
    around the replaced ones are counted.
    """
    gone.sort()
    counts = counts - (np.searchsorted(gone, pairs, "right") - np.searchsorted(gone, pairs))
    more, times = counted(new, least)
    stay = counts >= least
    pairs, counts = np.concatenate([pairs[stay], more]), np.concatenate([counts[stay], times])
    order = np.argsort(pairs, kind="stable")
    return pairs[order], counts[order]


def disjoint(pairs: np.ndarray) -> np.ndarray:
    """The pairs whose symbols no earlier taken pair uses, in order.

    A pair that comes first for both its symbols is taken, at once with all other such pairs; then pairs of used
    symbols go, and so on.  What is left after some turns (long chains of pairs) is taken one by one.
    """
    left, right = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
    size = int(max(left.max(), right.max())) + 1 if len(pairs) else 0
    first, used = np.zeros(size, np.int64), np.zeros(size, bool)
    rest, taken = np.arange(len(pairs)), [np.zeros(0, np.int64)]
    for _ in range(TURNS):
        if not len(rest):
            break
        a, b = left[rest], right[rest]
        # Of values put into one place the last one stays.
        first[np.stack([b[::-1], a[::-1]], 1).ravel()] = np.repeat(rest[::-1], 2)
        take = (first[a] == rest) & (first[b] == rest)
        used[a[take]] = used[b[take]] = True
        taken.append(rest[take])
        rest = rest[~(used[a] | used[b])]
    seen: set[int] = set()
    for k, a, b in zip(rest.tolist(), left[rest].tolist(), right[rest].tolist(), strict=True):
        if a not in seen and b not in seen:
            seen.update((a, b))
            taken.append(np.array([k]))
    return pairs[np.sort(np.concatenate(taken))]


def compress(seq: np.ndarray, rounds: int = ROUNDS, least: int = LEAST) -> Grammar:
    """Re-Pair of a sequence of ids and separators; separators stay where they are."""
    seq = seq.astype(np.int64)  # the type of places, so that tables are looked up without a cast
    ids = seq[seq != SEPARATOR]
    first = int(ids.max()) + 1 if len(ids) else 0
    rules, lengths = np.zeros((0, 2), np.uint32), np.zeros(0, np.uint32)
    pairs, counts = frequent_pairs(seq, least) if len(seq) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    for _ in range(rounds):
        if not len(pairs):
            break
        rarer = counts.max() - counts
        taken = disjoint(pairs[np.argsort(rarer.astype(np.min_scalar_type(rarer.max())), kind="stable")])
        a, b = (taken >> np.uint64(32)).astype(np.uint32), (taken & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        # A separator takes the last place of the tables, which has no partner.
        partner = np.full(first + len(rules) + 1, NONE, np.int64)
        name = np.zeros(first + len(rules) + 1, np.int64)
        partner[a], name[a] = b, np.arange(len(a)) + first + len(rules)
        size = np.concatenate([np.ones(first, np.uint32), lengths])
        rules, lengths = np.concatenate([rules, np.stack([a, b], 1)]), np.concatenate([lengths, size[a] + size[b]])
        at = np.flatnonzero(partner.take(seq[:-1], mode="clip") == seq[1:])
        # In a run of one symbol every second occurrence of (a, a) is taken.
        start = np.diff(at, prepend=-2) != 1
        if not start.all():
            run = np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
        gone = keys_at(seq, around(at, len(seq), 1))
        seq[at] = name[seq[at]]
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        seq = seq[stay]
        at = at - np.arange(len(at))
        pairs, counts = recounted(pairs, counts, gone, keys_at(seq, around(at, len(seq), 0)), least)
    return Grammar(first, rules, lengths, seq.astype(np.uint32))


def expand(symbols: np.ndarray, first: int, rules: np.ndarray) -> np.ndarray:
    """The ids that a run of symbols stands for."""
    out = symbols
    while len(at := np.flatnonzero(out >= first)):
        made = np.ones(len(out), np.int64)
        made[at] = 2
        place = np.cumsum(made) - made
        wide = np.repeat(out, made)
        wide[place[at]] = rules[out[at] - first, 0]
        wide[place[at] + 1] = rules[out[at] - first, 1]
        out = wide
    return out


def write_shard(docs: list[np.ndarray]) -> bytes:
    flat = np.full(sum(map(len, docs)) + len(docs), SEPARATOR, np.uint32)
    at = 0
    for ids in docs:
        flat[at : at + len(ids)] = ids
        at += len(ids) + 1
    g = compress(flat)
    ends = np.flatnonzero(g.sequence == SEPARATOR)
    bounds = np.concatenate(([0], ends - np.arange(len(ends))))
    head = [MAGIC, g.first, len(g.rules), len(docs), len(g.sequence) - len(ends)]
    parts = [head, g.rules.ravel(), g.lengths, bounds, [len(ids) for ids in docs], g.sequence[g.sequence != SEPARATOR]]
    return b"".join(np.asarray(p).astype("<u4").tobytes() for p in parts)


class Shard:
    """A shard read back; documents and ranges of ids are decoded on their own."""

    def __init__(self, data: bytes):
        words = np.frombuffer(data, "<u4")
        if len(words) < 5 or words[0] != MAGIC:
            raise ValueError("not a shard of token ids")
        self.first, rules, self.docs, length = (int(x) for x in words[1:5])
        cuts = np.cumsum([5, 2 * rules, rules, self.docs + 1, self.docs, length])
        if cuts[-1] != len(words):
            raise ValueError("a shard of token ids is cut off")
        parts = [words[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]
        self.rules, self.lengths, self.bounds, self.counts, self.sequence = parts[0].reshape(-1, 2), *parts[1:]

    def ids(self, doc: int) -> np.ndarray:
        return expand(self.sequence[self.bounds[doc] : self.bounds[doc + 1]], self.first, self.rules)

    def all_ids(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all documents in a row, and the bounds of each; every rule is expanded once."""
        made = expand(np.arange(self.first, self.first + len(self.rules)), self.first, self.rules).astype("<u4")
        begins = np.cumsum(self.lengths, dtype=np.int64) - self.lengths
        size = np.ones(len(self.sequence), np.int64)
        ruled = np.flatnonzero(self.sequence >= self.first)
        rule = self.sequence[ruled] - self.first
        size[ruled] = self.lengths[rule]
        ends = np.append(0, np.cumsum(size))
        out = np.repeat(self.sequence, size)
        out[ranges(ends[ruled], size[ruled])] = made[ranges(begins[rule], size[ruled])]
        return out, ends[self.bounds]

    def slice(self, doc: int, start: int, stop: int) -> np.ndarray:
        """ids(doc)[start:stop], expanding only the symbols that reach into it."""
        symbols = self.sequence[self.bounds[doc] : self.bounds[doc + 1]]
        size = np.ones(len(symbols), np.int64)
        ruled = symbols >= self.first
        size[ruled] = self.lengths[symbols[ruled] - self.first]
        ends = np.cumsum(size)
        i, j = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        before = int(ends[i - 1]) if i else 0
        return expand(symbols[i:j], self.first, self.rules)[start - before : stop - before]


def write_shards(docs: DataFrame, path: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> None:
    """Encode every row and write the shards as rows (part, shard, ids, doc_ids, data) of a Parquet folder.

    Documents are dealt by ranges of their id and sorted, so parts and shards ascend with the ids; a null id
    comes first, rows that share an id in any order.  Null text is the end id alone.
    """
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange(task_partitions(docs), "id").sortWithinPartitions("id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(vocabulary)
        shard, held, names, size = 0, [], [], 0

        def flush() -> pa.RecordBatch:
            columns = [pa.array([shard], pa.int32()), pa.array([size], pa.int64()), pa.array([names], pa.list_(names_type)), pa.array([write_shard(held)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["shard", "ids", "doc_ids", "data"])

        for batch in batches:
            names_type = batch.column(0).type
            for name, ids in zip(batch.column(0).to_pylist(), made.ids_of(text.as_py() for text in batch.column(1)), strict=True):
                ids = np.append(ids, np.uint32(end_id))
                if held and size + len(ids) > shard_ids:
                    yield flush()
                    shard, held, names, size = shard + 1, [], [], 0
                held.append(ids)
                size += len(ids)
                names.append(name)
        if held:
            yield flush()

    shards = ordered.mapInArrow(run, f"shard int, ids long, doc_ids array<{kind.simpleString()}>, data binary")
    shards.select(F.spark_partition_id().alias("part"), "*").write.parquet(path)


def read_documents(shards: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document of the shards, decoded from them.

    A shard's first id is the sum of the shards before it: one number per shard is added up on the driver.
    """
    sizes = shards.select("part", "shard", "ids").orderBy("part", "shard").collect()
    starts = np.concatenate(([0], np.cumsum([r["ids"] for r in sizes], dtype=np.int64)))
    start_of = {(r["part"], r["shard"]): int(s) for r, s in zip(sizes, starts, strict=False)}
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                start = start_of[batch.column(0)[r].as_py(), batch.column(1)[r].as_py()]
                read = Shard(batch.column(3)[r].as_buffer())
                ids, bounds = read.all_ids()
                sums = [zlib.crc32(ids[a:b]) for a, b in pairwise(bounds.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(2)[r].values, pa.array(start + bounds[:-1]), pa.array(np.diff(bounds)), pa.array(sums, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

    return shards.select("part", "shard", "doc_ids", "data").mapInArrow(run, f"id {kind}, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)

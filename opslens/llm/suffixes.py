"""Repeated strings of a fixed length, byte by byte, by a distributed difference-cover sample of the suffixes.

D is a difference cover modulo V: for any two positions i and j there is a shift s < V that brings both into the
sample (positions p, within their document, with p mod V in D).  With L = 400 and V = 273 the sampled suffixes
at i + s and j + s begin with the same L - V + 1 = 128 bytes if the strings at i and j are equal.

1. The sampled suffixes are named by the fingerprint of their first 128 bytes and dealt to tasks by ranges of the
   names, where sorting puts equal names side by side.  A name that occurs once needs no further look.
2. The recursion on names is one level deep, because only prefixes of L bytes matter: a repeated string starts at
   most V - 1 bytes before a sampled suffix whose name occurs again.  Only those suffixes are merged in.
3. They are named by all L bytes, dealt by ranges again, sorted, and adjacent names are compared.

Texts lie in chunks, compressed.  What is shuffled are sorted names as bytes, without positions: a task answers
each chunk with one bit per name, and the chunk's reader finds the positions again from its own text.  The
chunks are a bucketed table, so that the answers are joined to them without a shuffle of the texts.

Names are 64-bit fingerprints (48 bits for the first step, where a false match only costs time).
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from opslens.llm.common import shared_folder, staged
from opslens.llm.shingles import Powers, mix

# A perfect difference set, every residue modulo 273 is a difference of two of its members.
V = 273
COVER = (0, 1, 3, 7, 15, 31, 63, 90, 116, 127, 136, 181, 194, 204, 233, 238, 255)
CHUNK_BYTES = 2 << 20
#: Names in a range, about; a task holds one range.
RANGE_NAMES = 1 << 20


def chunks_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(chunk, ids, size, bounds, data): rows of about CHUNK_BYTES of text; a longer text is a chunk of its own."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0

        def flush() -> pa.RecordBatch:
            bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
            data = zlib.compress(b"".join(texts), 1)
            columns = [pa.array([ids], pa.list_(id_type)), pa.array([size], pa.int64()), pa.array([bounds.tobytes()], pa.binary()), pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["ids", "size", "bounds", "data"])

        for batch in batches:
            id_type = batch.column(0).type
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if texts and size + len(text) > CHUNK_BYTES:
                    yield flush()
                    ids, texts, size = [], [], 0
                ids.append(name)
                texts.append(text)
                size += len(text)
        if texts:
            yield flush()

    made = rows.mapInArrow(run, f"ids array<{kind}>, size long, bounds binary, data binary")
    return made.select(F.monotonically_increasing_id().alias("chunk"), "*")


class Chunk:
    """The texts of a chunk with prefix hashes; names are sorted and distinct, each with its positions."""

    def __init__(self, bounds: bytes, data: bytes, powers: Powers, length: int):
        self.bounds = np.frombuffer(bounds, np.int64)
        self.data = np.frombuffer(zlib.decompress(data), np.uint8)
        self.length = length
        powers.upto(len(self.data))
        self.down = powers.down
        self.prefix = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers.up[: len(self.data)], out=self.prefix[1:])
        self.ends = np.repeat(self.bounds[1:], np.diff(self.bounds))

    def _named(self, at: np.ndarray, length: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(names, index of each position's name, whether a name has several positions)."""
        names = mix((self.prefix[at + length] - self.prefix[at]) * self.down[at]) >> np.uint64(64 - bits)
        names, which, counts = np.unique(names, return_inverse=True, return_counts=True)
        return names, which, counts > 1

    def sampled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        cover = np.zeros(V, bool)
        cover[list(COVER)] = True
        starts = np.repeat(self.bounds[:-1], np.diff(self.bounds))
        at = np.arange(len(self.data))
        at = at[cover[(at - starts) % V] & (at + self.length - V + 1 <= self.ends)]
        return at, *self._named(at, self.length - V + 1, 48)

    def merged(self, again: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The suffixes that a sampled suffix of a repeated name can reach; again: positions of those samples."""
        change = np.zeros(len(self.data) + 1, np.int32)
        starts = self.bounds[np.searchsorted(self.bounds, again, "right") - 1]
        np.add.at(change, np.maximum(again - (V - 1), starts), 1)
        np.add.at(change, again + 1, -1)
        at = np.flatnonzero(np.cumsum(change[:-1]) > 0)
        at = at[at + self.length <= self.ends[at]]
        return at, *self._named(at, self.length, 64)


def _packed(names: np.ndarray, width: int) -> bytes:
    return names.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpacked(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def _cuts(names: np.ndarray, bits: int, ranges: int) -> np.ndarray:
    """Bounds of each range's names; ranges: a power of two."""
    return np.append(0, np.searchsorted(names >> np.uint64(bits - ranges.bit_length() + 1), np.arange(ranges), "right")) if ranges > 1 else np.array([0, len(names)])


def _ranged(chunk: int, names: np.ndarray, bits: int, ranges: int) -> Iterator[pa.RecordBatch]:
    cuts = _cuts(names, bits, ranges)
    some = np.flatnonzero(np.diff(cuts))
    data = [_packed(names[cuts[i] : cuts[i + 1]], bits // 8) for i in some]
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), chunk)), pa.array(data, pa.binary())], ["range", "chunk", "names"])


def _answered(names: np.ndarray, several: np.ndarray, bits: int, ranges: int, answers: list[dict]) -> np.ndarray:
    """Whether a name occurs again, in the chunk or in another one."""
    cuts = _cuts(names, bits, ranges)
    again = several.copy()
    for a in answers or ():
        i, j = cuts[a["range"]], cuts[a["range"] + 1]
        again[i:j] |= np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=int(j - i)).astype(bool)
    return again


def _compare(bits: int):
    def task(table: pa.Table) -> pa.Table:
        parts = [_unpacked(x.as_py(), bits // 8) for x in table.column("names")]
        names = np.concatenate(parts)
        order = np.argsort(names, kind="stable")
        same = names[order[1:]] == names[order[:-1]]
        again = np.zeros(len(names), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        ends = np.cumsum([len(p) for p in parts])
        flags = [np.packbits(again[e - len(p) : e]).tobytes() if again[e - len(p) : e].any() else None for p, e in zip(parts, ends, strict=True)]
        return pa.table({"chunk": table.column("chunk"), "range": table.column("range"), "bits": pa.array(flags, pa.binary())})

    return task


def _answers(names: DataFrame, bits: int, label: str) -> DataFrame:
    """(chunk, answers) for the chunks that hold a name that another chunk holds too."""
    found = names.groupBy("range").applyInArrow(_compare(bits), "chunk long, range int, bits binary").filter("bits is not null")
    return staged(found.groupBy("chunk").agg(F.collect_list(F.struct("range", "bits")).alias(label)), label)


def _per_chunk(chunks: DataFrame, schema: str, work) -> DataFrame:
    """``work(chunk, row)`` for every row of chunks, where row has the other columns as Python values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for r in range(batch.num_rows):
                yield from work({n: batch.column(n)[r].as_py() for n in batch.schema.names}, powers)

    return chunks.mapInArrow(run, schema)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept, kept_sha256) of every row: bytes covered by a string of ``length``
    bytes that also starts anywhere else are removed, judged on the input.

    Matches do not cross documents and may overlap themselves.  Null text is empty; rows that repeat are texts
    like any others, so each removes the other; ``length`` must be over the cover's period of 273.  An empty
    table gives no rows.
    """
    if length <= V:
        raise ValueError(f"length must be over {V}")
    spark = docs.sparkSession
    name = f"llm_chunks_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = chunks_of(docs, id_col, text_col)
    made.write.bucketBy(buckets, "chunk").option("path", f"{shared_folder(spark)}/llm/{name}").saveAsTable(name)
    chunks = spark.table(name)
    total = chunks.agg(F.sum("size")).first()[0] or 0
    ranges = 1 << max(0, int(np.ceil(np.log2(max(1, total * len(COVER) / V) / RANGE_NAMES))))
    name_rows = "range int, chunk long, names binary"

    def first(row: dict, powers: Powers) -> Iterator[pa.RecordBatch]:
        _, names, _, _ = Chunk(row["bounds"], row["data"], powers, length).sampled()
        yield from _ranged(row["chunk"], names, 48, ranges)

    sampled = _answers(_per_chunk(chunks.select("chunk", "bounds", "data"), name_rows, first), 48, "sampled")

    def second_names(row: dict, powers: Powers) -> tuple[Chunk, tuple]:
        chunk = Chunk(row["bounds"], row["data"], powers, length)
        at, names, which, several = chunk.sampled()
        again = at[_answered(names, several, 48, ranges, row["sampled"])[which]]
        return chunk, chunk.merged(again)

    def second(row: dict, powers: Powers) -> Iterator[pa.RecordBatch]:
        _, (_, names, _, _) = second_names(row, powers)
        yield from _ranged(row["chunk"], names, 64, ranges)

    known = chunks.join(sampled, "chunk", "left")
    merged = _answers(_per_chunk(known.select("chunk", "bounds", "data", "sampled"), name_rows, second), 64, "merged")

    def last(row: dict, powers: Powers) -> Iterator[pa.RecordBatch]:
        chunk, (at, names, which, several) = second_names(row, powers)
        starts = at[_answered(names, several, 64, ranges, row["merged"])[which]]
        change = np.zeros(len(chunk.data) + 1, np.int32)
        change[starts] += 1
        np.add.at(change, starts + length, -1)
        gone = np.cumsum(change[:-1]) > 0
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        inner = chunk.bounds[(chunk.bounds > 0) & (chunk.bounds < len(gone))]
        opens[inner] = gone[inner]
        removed = np.concatenate(([0], np.cumsum(gone)))[chunk.bounds]
        spans = np.concatenate(([0], np.cumsum(opens)))[chunk.bounds]
        kept = [chunk.data[i:j][~gone[i:j]].tobytes() for i, j in zip(chunk.bounds, chunk.bounds[1:], strict=False)]
        columns = [pa.array(np.diff(x)) for x in (chunk.bounds, removed, spans)]
        columns += [pa.array(kept, pa.binary()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
        yield pa.RecordBatch.from_arrays([pa.array(row["ids"], id_type), *columns], ["id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    id_type = to_arrow_type(docs.schema[id_col].dataType)
    kind = docs.schema[id_col].dataType.simpleString()
    both = known.join(merged, "chunk", "left").select("ids", "bounds", "data", "sampled", "merged")
    out = _per_chunk(both, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string", last)
    return out.withColumnRenamed("id", id_col)

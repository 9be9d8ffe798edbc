"""Lines repeated across documents, deleted from the later document where the two documents align.

1. Lines are hashed without outer white space; short ones (``min_words``) say nothing and are kept.
2. Exact copies of a text count once: a line's document frequency is taken over distinct texts.  A line is rare
   if it occurs in at most ``rare_share`` of them; only rare lines make two documents overlap.
3. A document is paired with the first holder (smallest id) of each of its rare lines.  A line of m documents
   gives m - 1 pairs with one holder instead of all pairs, and every repeated rare line is in a pair.
4. Patience alignment of a pair over all its lines, frequent ones too: lines unique in both are matched, the longest
   chain of matches that runs forward in both documents is kept, and so on between the matches; where no line is
   unique in both, a longest common subsequence is taken.
5. A document whose rare lines are not all aligned then is paired with their next holders, twice as many each time,
   until no holder is left.
6. Aligned lines go from the later document.  Texts without an aligned line stay as they are.

Only hashes and positions are shuffled for 1 to 5.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslens.llm.common import fresh, staged, with_row_id


def forward(unique: list[tuple[int, int]]) -> dict[int, int]:
    """The longest chain that ascends in both places; unique: (later, earlier) ascending by the first."""
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(unique)
    for i, (_, a) in enumerate(unique):
        k = bisect_left(tails, a)
        back[i] = ends[k - 1] if k else -1
        if k == len(tails):
            tails.append(a)
            ends.append(i)
        else:
            tails[k], ends[k] = a, i
    chain: dict[int, int] = {}
    i = ends[-1] if ends else -1
    while i >= 0:
        chain[unique[i][0]] = unique[i][1]
        i = back[i]
    return chain


def _common_lengths(x: list[int], y: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of ``x`` and each prefix of ``y``, by one bit a line of ``y``."""
    places: dict[int, list[int]] = {}
    for j, h in enumerate(y):
        places.setdefault(h, []).append(j)
    held = {}
    for h in set(x) & places.keys():
        bits = np.zeros(len(y), np.uint8)
        bits[places[h]] = 1
        held[h] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    full = (1 << len(y)) - 1
    v = full
    for h in x:
        if h in held:
            u = v & held[h]
            v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(-(-len(y) // 8), "little"), np.uint8), count=len(y), bitorder="little")
    return np.append(0, np.cumsum(1 - bits.astype(np.int64)))


def common_subsequence(x: list[int], y: list[int]) -> list[int]:
    """Places in ``x`` of a longest common subsequence of both, in space that grows with their lengths only."""
    found, todo = [], [(0, len(x), 0, len(y))]
    while todo:
        b, e, c, f = todo.pop()
        while b < e and c < f and x[b] == y[c]:
            found.append(b)
            b, c = b + 1, c + 1
        while b < e and c < f and x[e - 1] == y[f - 1]:
            e, f = e - 1, f - 1
            found.append(e)
        if b == e or c == f:
            continue
        if e - b == 1:
            found += [b] if x[b] in y[c:f] else []
            continue
        half = (b + e) // 2
        best = int((_common_lengths(x[b:half], y[c:f]) + _common_lengths(x[half:e][::-1], y[c:f][::-1])[::-1]).argmax())
        todo += [(b, half, c, c + best), (half, e, c + best, f)]
    return sorted(found)


def aligned(later: list[int], earlier: list[int]) -> list[int]:
    """Places in ``later`` of the lines that align with lines of ``earlier``."""
    found, todo = [], [(0, len(later), 0, len(earlier))]
    while todo:
        b, e, c, f = todo.pop()
        while b < e and c < f and later[b] == earlier[c]:
            found.append(b)
            b, c = b + 1, c + 1
        while b < e and c < f and later[e - 1] == earlier[f - 1]:
            e, f = e - 1, f - 1
            found.append(e)
        if b == e or c == f:
            continue
        own, other = Counter(later[b:e]), Counter(earlier[c:f])
        at = {h: c + j for j, h in enumerate(earlier[c:f]) if other[h] == 1}
        chain = forward([(b + i, at[h]) for i, h in enumerate(later[b:e]) if own[h] == 1 and h in at])
        if not chain:
            if own.keys() & other.keys():
                found += [b + i for i in common_subsequence(later[b:e], earlier[c:f])]
            continue
        found += chain
        for i, j in [*sorted(chain.items()), (e, f)]:
            todo.append((b, i, c, j))
            b, c = i + 1, j + 1
    return sorted(found)


def align(pairs: list[tuple[int, int, int]]) -> list[int]:
    """The first level of :func:`aligned` with blocks extended by their neighbours, for places that are given.

    Positions in the later text of the lines that align; pairs: (later position, earlier position, hash).
    """
    seen = Counter(h for _, _, h in pairs)
    chain = forward(sorted((b, a) for b, a, h in pairs if seen[h] == 1))
    equal = {(b, a) for b, a, h in pairs if seen[h] > 1}
    if equal:
        if not chain:
            # No line is unique in both: the first equal lines in order start the chain.
            b, a = min(equal)
            chain[b] = a
        for step in (1, -1):
            for b, a in list(chain.items()):
                b, a = b + step, a + step
                while (b, a) in equal and b not in chain:
                    chain[b] = a
                    b, a = b + step, a + step
    return sorted(chain)


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.trim(line), F.length(F.trim(line)))


def lines_of(df: DataFrame, keys: list[str], text_col: str, min_words: int) -> DataFrame:
    """(keys, pos, hash) of the lines that count."""
    rows = df.select(*keys, F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("pos", "line"))
    # At least min_words words: as many white space gaps between them as that takes.
    long_enough = F.col("line").rlike(r"(\S+\s+){%d}\S" % (min_words - 1)) if min_words > 1 else F.col("line").rlike(r"\S")
    return rows.filter(long_enough).select(*keys, "pos", line_hash(F.col("line")).alias("hash"))


def deletions(numbered: DataFrame, row: str, id_col: str, text_col: str, rare_share: float, min_words: int) -> DataFrame:
    """(row, gone): the positions of the lines to delete from a document."""
    # The order of documents: by id, rows of the same id by row number; a null id comes last.
    rank = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col(row).alias("row"))
    texts = numbered.filter(F.col(text_col).isNotNull()).select(rank.alias("rank"), F.col(row).alias("row"), F.xxhash64(text_col, F.length(text_col)).alias("copy"), F.col(text_col).alias("text"))
    lines = staged(lines_of(texts, ["rank", "row", "copy"], "text", min_words), "lines")
    total = texts.select("copy").distinct().count()
    # A line's first holder, how many distinct texts hold it, and whether any later document does.
    per_copy = lines.groupBy("hash", "copy").agg(F.min(F.struct("rank", "pos")).alias("first"), F.max("rank").alias("last"))
    held = per_copy.groupBy("hash").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.count("*").alias("texts"))
    most = max(2, int(total * rare_share))
    held = held.filter(F.col("last") != F.col("first.rank")).select("hash", F.col("first.rank.row").alias("holder"), (F.col("texts") <= most).alias("rare"))
    shared = staged(lines.join(held.hint("merge"), "hash"), "shared")
    sequences = staged(shared.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "hash"))).alias("lines")), "sequences")
    unpaired = shared.filter("rare and row <> holder").select("row", "rank", "pos", "hash", "holder")
    gone = taken = staged(aligned_lines(unpaired.select("row", "holder").distinct(), sequences), "aligned")
    left = staged(unpaired.join(taken, ["row", "pos"], "left_anti").drop("holder"), "unpaired")
    if not left.isEmpty():
        # The first rows of the distinct texts that hold a line, in their order.
        order = Window.partitionBy("hash").orderBy("held_by")
        holders = shared.join(left.select("hash").distinct(), "hash", "left_semi").groupBy("hash", "copy").agg(F.min("rank").alias("held_by"))
        holders = staged(holders.select("hash", "held_by", F.row_number().over(order).alias("place")), "holders")
        tried = 1
        while not left.isEmpty():
            places = F.explode(F.sequence(F.lit(tried + 1), F.lit(2 * tried + 1))).alias("place")
            upcoming = left.select("*", places).join(holders, ["hash", "place"]).filter("held_by < rank")
            upcoming = staged(upcoming.select("row", "rank", "pos", "hash", F.col("held_by.row").alias("holder")), "upcoming")
            taken = staged(aligned_lines(upcoming.select("row", "holder").distinct(), sequences), "aligned")
            gone = gone.union(taken)
            left = staged(upcoming.drop("holder").distinct().join(taken, ["row", "pos"], "left_anti"), "unpaired")
            tried = 2 * tried + 1
    return gone.groupBy("row").agg(F.collect_set("pos").alias("gone"))


def aligned_lines(pairs: DataFrame, sequences: DataFrame) -> DataFrame:
    """(row, pos) of the lines that align in the pairs (row, holder); sequences: (row, lines)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, gone = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
            for row, later, earlier in zip(*batch.columns, strict=True):
                at = aligned(later.values.field("hash").to_pylist(), earlier.values.field("hash").to_pylist())
                gone.append(later.values.field("pos").to_numpy()[at])
                rows.append(np.full(len(at), row.as_py(), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows)), pa.array(np.concatenate(gone))], ["row", "pos"])

    # Whole line sequences are never broadcast, however few they are: the plan is the same at every size.
    both = pairs.join(sequences.hint("merge"), "row").select("row", "holder", F.col("lines").alias("later"))
    both = both.join(sequences.select(F.col("row").alias("holder"), F.col("lines").alias("earlier")).hint("merge"), "holder")
    return both.select("row", "later", "earlier").mapInArrow(run, "row long, pos int").distinct()


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rare_share: float = 0.1, min_words: int = 3, removed_col: str | None = None) -> DataFrame:
    """All rows of ``docs`` with the aligned lines taken out of the later documents' texts.

    ``removed_col`` adds the number of deleted lines.  Null texts stay null and empty ones empty; of rows with
    one id the one read first is the earlier document; a document of a null id is later than all others.  A text
    whose lines all go becomes empty, and the row stays.  An empty table gives no rows.
    """
    numbered, row = with_row_id(docs, "numbered")
    gone = fresh(numbered, "gone")
    cut = deletions(numbered, row, id_col, text_col, rare_share, min_words).select(F.col("row").alias(row), F.col("gone").alias(gone))
    parts = F.split(F.col(text_col), "\n", -1)
    kept = F.array_join(F.filter(parts, lambda line, i: ~F.array_contains(F.col(gone), i)), "\n")
    out = numbered.join(cut.hint("merge"), row, "left")
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(kept)
    columns = [text.alias(c) if c == text_col else F.col(c) for c in docs.columns]
    if removed_col:
        columns.append(F.coalesce(F.size(gone), F.lit(0)).alias(removed_col))
    return out.select(*columns)

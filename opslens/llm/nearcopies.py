"""Near copies: SimHash links found by a vantage-point tree, and word shingles of a high exact Jaccard similarity.

With a ``radius`` the fingerprints of all texts are dealt by the vantage-point tree of :mod:`opslens.llm.simhash`, and
all that differ in at most so many bits are linked, none missed.

At a similarity of 0.8 two SimHash fingerprints differ in ten of 64 bits on average.  A vantage-point tree over
all documents cannot prune at such a radius: unrelated fingerprints all lie 32 +- 4 bits from any vantage point,
so every boundary shard overlaps every query.  For those pairs the documents are dealt to further shards by MinHash bands, and
the vantage point serves inside a shard, where the members are ordered by their distance to it and only members
whose distances differ by less than those found can be nearer (the triangle bound).  Each member is
linked to its nearest few members before it, so a dense group gives a few edges per member and shard, not all
its pairs.
Every edge of these shards is confirmed on the whole shingle sets.  The nearest few need not hold a member's near copy, so the
members of a shard that this leaves in several components are joined exactly, by the rare shingles that two
similar sets must share (prefix, length and position filter); only pairs of different components are formed.
The groups are the connected components of all SimHash links and confirmed edges.

With 16 bands of 4 a pair of similarity 0.8 shares no shard once in 5,000 times.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opslens.llm.common import staged, with_bucketed_row_id
from opslens.llm.components import components
from opslens.llm.shingles import BASE, Powers, mix, shingled
from opslens.llm.simhash import distance, fingerprint_links, fingerprints

BANDS, ROWS = 16, 4
#: Members before a member, in the order of their distance to the vantage point, among which its nearest is sought.
SPAN = 4096
NEAREST = 5
#: Prefixes with one shingle beyond which they are compared in blocks of rows, and bits of a set's map.
CROWD, BLOCK, BITS = 64, 2000, 1024


def sketches(rows: DataFrame, row: str, text_col: str, size: int) -> DataFrame:
    """(row, copy, fp, bands): hash of the word sequence, SimHash fingerprint, MinHash band keys."""
    factors = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for part in shingled(batch.column(1), size, powers):
                n = len(part.bounds) - 1
                some = np.flatnonzero(np.diff(part.bounds))
                first = part.bounds[some]
                place = np.arange(len(part.hashes)) - np.repeat(part.bounds[:-1], np.diff(part.bounds))
                copy, fp = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                bands = np.zeros((n, BANDS), np.uint64)
                if len(some):
                    copy[some] = np.add.reduceat(mix(part.hashes + place.astype(np.uint64) * np.uint64(BASE)), first)
                    bits = np.unpackbits(part.hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    ones = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
                    fp[some] = np.packbits(2 * ones > np.diff(part.bounds)[some, None], axis=1, bitorder="little").view(np.uint64).ravel()
                    for j, factor in enumerate(factors):
                        least = np.minimum.reduceat(part.hashes * factor, first)
                        bands[some, j // ROWS] = mix(bands[some, j // ROWS] * np.uint64(BASE) + least)
                keys = np.where(np.isin(np.arange(n), some), BANDS, 0)
                flat = pa.array(bands[some].ravel().view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(keys)).astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.first, n), pa.array(copy.view(np.int64)), pa.array(fp.view(np.int64)), lists], ["row", "copy", "fp", "bands"]
                )

    return rows.select(F.col(row).alias("row"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "row long, copy long, fp long, bands array<long>")


def nearest_before(prints: np.ndarray, nearest: int = NEAREST) -> tuple[np.ndarray, np.ndarray]:
    """Edges of each member to its ``nearest`` ones before it, in the order of distances to the first member."""
    d = distance(prints, prints[0]).astype(np.int64)
    order = np.argsort(d, kind="stable")
    p, d = prints[order], d[order]
    a, b = [], []
    for i in range(1, len(p)):
        low, j, worst = max(0, i - SPAN), i, 65
        at, far = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while j > low and (len(at) < nearest or d[i] - d[j - 1] < worst):
            k = max(low, j - 256)
            at = np.concatenate([at, np.arange(k, j)])
            far = np.concatenate([far, distance(p[k:j], p[i])])
            best = np.argsort(far, kind="stable")[:nearest]
            at, far, j = at[best], far[best], k
            worst = int(far.max())
        a.append(np.full(len(at), i))
        b.append(at)
    return order[np.concatenate(a)], order[np.concatenate(b)]


def candidate_edges(reps: DataFrame) -> DataFrame:
    """(a, b, crowd): rows worth comparing, a < b; with ``crowd``, row a of shard b, where not all pairs are given."""
    members = reps.select("row", "fp", F.posexplode("bands").alias("band", "key"))
    shards = members.groupBy("band", "key").agg(F.collect_list(F.struct("row", "fp")).alias("members")).filter(F.size("members") > 1)
    shards = shards.select("members", F.xxhash64("band", "key").alias("shard"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            flat, bounds = column.flatten(), column.offsets.to_numpy() - column.offsets[0].as_py()
            rows, prints = flat.field("row").to_numpy(), flat.field("fp").to_numpy().view(np.uint64)
            found: list[np.ndarray] = [np.zeros((2, 0), np.int64)]
            crowds: list[np.ndarray] = [np.zeros((2, 0), np.int64)]
            for i, j, shard in zip(bounds, bounds[1:], batch.column(1).to_pylist(), strict=False):
                by_row = np.argsort(rows[i:j])
                r, p = rows[i:j][by_row], prints[i:j][by_row]
                a, b = (np.array([1]), np.array([0])) if j - i == 2 else nearest_before(p)
                found.append(np.stack([np.minimum(r[a], r[b]), np.maximum(r[a], r[b])]))
                if j - i > NEAREST + 1:
                    crowds.append(np.stack([r, np.full(j - i, shard, np.int64)]))
            pairs, crowd = np.concatenate(found, axis=1), np.concatenate(crowds, axis=1)
            is_crowd = np.arange(pairs.shape[1] + crowd.shape[1]) >= pairs.shape[1]
            both = np.concatenate([pairs, crowd], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1]), pa.array(is_crowd)], ["a", "b", "crowd"])

    return shards.select("members", "shard").mapInArrow(run, "a long, b long, crowd boolean").distinct()


def unsettled(crowds: DataFrame, linked: DataFrame) -> DataFrame:
    """(row, component) of the members of the shards that hold several components; crowds: (row, shard)."""
    named = crowds.join(linked.select(F.col("node").alias("row"), "component"), "row", "left").withColumn("component", F.coalesce("component", "row"))
    parted = named.groupBy("shard").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("shard")
    return named.join(parted, "shard", "left_semi").select("row", "component").distinct()


def pairs_apart(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b: all pairs of different components that can have a Jaccard similarity of ``similarity``.

    Shingles are taken in one order, the rarest first.  Of sets of x <= y shingles with that similarity s, at least
    s * y and s / (1 + s) * (x + y) are common, so the first common one is among the first
    x - 2 * s / (1 + s) * x + 1 of the smaller and the first y - s * y + 1 of the larger set.

    Sets that meet in a shingle of more than ``CROWD`` prefixes are compared in blocks of rows, where a bit map of each
    set bounds what two can have in common; only pairs within that bound are written.
    """

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                tokens = np.frombuffer(batch.column(2)[k].as_buffer(), np.int64)
                same = [pa.array(np.full(len(tokens), v, np.int64)) for v in (batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), len(tokens))]
                yield pa.RecordBatch.from_arrays([*same, pa.array(tokens)], ["row", "component", "n", "token"])

    held = staged(sets.join(members, "row").select("row", "component", "shingles").mapInArrow(words, "row long, component long, n long, token long"), "tokens")
    seen = held.groupBy("token").agg(F.count("*").alias("df"))
    order = Window.partitionBy("row").orderBy("df", "token")
    n, place = F.col("n"), F.col("place")
    ranked = held.join(seen, "token").withColumn("place", F.row_number().over(order))
    ranked = ranked.filter(place <= n - F.ceil(similarity * n - 1e-6) + 1)
    ranked = staged(ranked.withColumn("index", place <= n - F.ceil(2 * similarity / (1 + similarity) * n - 1e-6) + 1), "prefixes")
    shared = ranked.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("token")
    ranked = staged(ranked.join(shared, "token", "left_semi"), "shared")
    crowded = staged(ranked.groupBy("token").agg(F.count("*").alias("m")).filter(F.col("m") > CROWD), "crowded")
    dense = pairs_in_blocks(ranked.join(crowded, "token"), sets, similarity)
    ranked = ranked.join(crowded, "token", "left_anti")
    small, large = (
        rows.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("component", "row", "n", "place"))) for rows, s in ((ranked.filter("index"), "x"), (ranked, "y"))
    )
    # Which components meet in a shingle comes first, so that no pair within a component is formed.
    meet = small.select("token", "component_x").distinct().join(large.select("token", "component_y").distinct(), "token").filter("component_x <> component_y")
    both = meet.join(small, ["token", "component_x"]).join(large, ["token", "component_y"])
    needed = F.ceil(similarity / (1 + similarity) * (F.col("n_x") + F.col("n_y")) - 1e-6)
    left = F.least(F.col("n_x") - F.col("place_x"), F.col("n_y") - F.col("place_y"))
    smaller = (F.col("n_x") < F.col("n_y")) | (F.col("n_x") == F.col("n_y")) & (F.col("row_x") < F.col("row_y"))
    fits = smaller & (F.col("n_x") >= similarity * F.col("n_y") - 1e-6) & (left + 1 >= needed)
    return both.filter(fits).select(F.least("row_x", "row_y").alias("a"), F.greatest("row_x", "row_y").alias("b")).union(dense).distinct()


def bit_maps(sets: DataFrame) -> DataFrame:
    """(row, bits): one of ``BITS`` bits for each shingle; two maps differ in no more bits than the sets in shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = []
            for value in batch.column(1):
                bits = np.zeros(BITS, np.uint8)
                bits[(mix(np.frombuffer(value.as_buffer(), np.uint64)) % np.uint64(BITS)).astype(np.int64)] = 1
                maps.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(maps, pa.binary())], ["row", "bits"])

    return sets.select("row", "shingles").mapInArrow(run, "row long, bits binary")


def pairs_in_blocks(rows: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): pairs of different components among the prefixes of a token that its m rows allow to be similar."""
    blocks = F.ceil(F.col("m") / BLOCK)
    wide = rows.join(bit_maps(sets.join(rows.select("row").distinct(), "row", "left_semi")), "row")
    wide = wide.withColumn("block", F.pmod(F.xxhash64("row"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    wide = wide.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))

    def compared(key: tuple, table: pa.Table) -> pa.Table:
        row, component, n, place, block = (table[c].to_numpy() for c in ("row", "component", "n", "place", "block"))
        bits = np.frombuffer(b"".join(table["bits"].to_pylist()), np.uint64).reshape(len(row), -1)
        across = key[1].as_py() != key[2].as_py()
        found = [np.zeros((2, 0), np.int64)]
        for x in np.flatnonzero(table["index"].to_numpy()):
            larger = (n > n[x]) | ((n == n[x]) & (row > row[x]))
            y = np.flatnonzero(larger & (component != component[x]) & (n[x] >= similarity * n - 1e-6))
            if across:
                y = y[block[y] != block[x]]
            needed = np.ceil(similarity / (1 + similarity) * (n[x] + n[y]) - 1e-6)
            left = np.minimum(n[x] - place[x], n[y] - place[y])
            common = (n[x] + n[y] - np.bitwise_count(bits[y] ^ bits[x]).sum(1, dtype=np.int64)) // 2
            y = y[(left + 1 >= needed) & (common >= needed)]
            found.append(np.stack([np.minimum(row[x], row[y]), np.maximum(row[x], row[y])]))
        pairs = np.concatenate(found, axis=1)
        return pa.table([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    columns = ["token", "i", "j", "row", "component", "n", "place", "index", "block", "bits"]
    return wide.select(*columns).groupBy("token", "i", "j").applyInArrow(compared, "a long, b long")


def shingle_sets(rows: DataFrame, row: str, text_col: str, size: int) -> DataFrame:
    """(row, shingles): the distinct shingle hashes in ascending order, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for part in shingled(batch.column(1), size, powers):
                n = len(part.bounds) - 1
                sets = [np.unique(part.hashes[part.bounds[i] : part.bounds[i + 1]]).tobytes() for i in range(n)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, n), pa.array(sets, pa.binary())], ["row", "shingles"])

    return rows.select(F.col(row).alias("row"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "row long, shingles binary")


def similar(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The edges whose shingle sets have a Jaccard similarity of ``similarity`` or more."""
    both = edges.join(sets.select(F.col("row").alias("a"), F.col("shingles").alias("x")), "a")
    both = both.join(sets.select(F.col("row").alias("b"), F.col("shingles").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= similarity * (len(x) + len(y) - common) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def simhash_edges(rows: DataFrame, row: str, text_col: str, radius: int, size: int = 3) -> DataFrame:
    """(a, b): edges that connect exactly the rows whose SimHash fingerprints can be reached in steps of ``radius`` bits.

    Rows of one fingerprint are linked to the first of them, and these by the vantage-point tree.
    """
    prints = staged(fingerprints(rows, row, text_col, size), "fingerprints")
    firsts = staged(prints.groupBy("fp").agg(F.min("id").alias("first")), "distinct-fingerprints")
    links = fingerprint_links(firsts.select("fp"), radius)
    for end in ("a", "b"):
        links = links.withColumnRenamed(end, "fp").join(firsts, "fp").drop("fp").withColumnRenamed("first", f"{end}_row")
    same = prints.join(firsts, "fp").filter("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    return same.union(links.select("a_row", "b_row"))


def groups(numbered: DataFrame, row: str, text_col: str = "text", size: int = 5, similarity: float = 0.8, radius: int | None = None) -> DataFrame:
    """(row, group) of every row: rows of one group are near copies of each other, or linked by near copies."""
    made = staged(sketches(numbered, row, text_col, size), "sketches")
    copies = made.groupBy("copy").agg(F.min("row").alias("rep"))
    reps = made.join(copies, made.row == copies.rep, "left_semi")
    found = staged(candidate_edges(reps), "candidates")
    edges = found.filter("not crowd").select("a", "b")
    wanted = edges.select(F.explode(F.array("a", "b")).alias(row)).distinct()
    sets = staged(shingle_sets(numbered.join(wanted, row, "left_semi"), row, text_col, size), "sets")
    near = similar(edges, sets, similarity)
    if radius is not None:
        distinct = numbered.join(reps.select(F.col("row").alias(row)), row, "left_semi")
        near = near.union(simhash_edges(distinct, row, text_col, radius))
    near = staged(near, "confirmed")
    linked = components(near)
    apart = staged(unsettled(found.filter("crowd").select(F.col("a").alias("row"), F.col("b").alias("shard")), linked), "unsettled")
    if not apart.isEmpty():
        more = staged(similar(staged(pairs_apart(apart, sets, similarity), "apart"), sets, similarity), "confirmed")
        if not more.isEmpty():
            linked = components(near.union(more))
    named = copies.join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("copy", F.coalesce("component", "rep").alias("group"))
    return made.select("row", "copy").join(named, "copy").select("row", "group")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8, radius: int | None = None) -> DataFrame:
    """The row with the smallest id of each group of near copies, with all its columns.

    Near copies are texts whose SimHash fingerprints (three words) differ in at most ``radius`` bits, where that is given,
    and texts whose shingles of ``size`` words have a Jaccard similarity of ``similarity`` or more.
    Exact copies have one word sequence, whatever their white space and the case of A-Z; texts without words,
    null included, are copies of each other.  A null id comes after all others; of rows with one id the one read
    first stays.  An empty table gives no rows.
    """
    numbered, row = with_bucketed_row_id(docs, "numbered")
    member = groups(numbered, row, text_col, size, similarity, radius)
    ids = numbered.select(F.col(row).alias("row"), F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"))
    ranked = staged(member.join(ids, "row"), "members")
    stays = ranked.groupBy("group").agg(F.min(F.struct("no_id", "id", "row")).alias("first"), F.count("*").alias("n"))
    gone = ranked.join(stays.filter("n > 1"), "group").filter("row <> first.row").select(F.col("row").alias(row))
    return numbered.join(gone, row, "left_anti").drop(row)

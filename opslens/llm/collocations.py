"""Phrases whose words stand together, from weighted automata of n-grams.

1. Every position of a text gives one path: its language and the words from there on, ``longest`` at most and within the
   piece.  A prefix of that path is an occurrence of a shorter phrase, so one path a word holds the counts of all
   lengths.  A task sorts the paths of a shard and builds their automaton, whose weights are counts.
2. The paths are dealt by ranges of equal text, so that a frequent first word or language is spread over several.
   A shard's automaton is written in parts by range; the parts of a range are united and their weights summed.
   With more than ``fan`` ranges that goes in rounds, all with about as many finer ranges for each coarse one: a round of
   two or three coarse ranges would move whole shards as one value.
3. A prefix that a range boundary cuts through has a part of its weight in several ranges: these are added up at last.
4. The frequent phrases are automata by range again; the two parts of every cut of a candidate are looked up there.

Ranges and shards decide who counts what, not the result.  The driver holds one boundary per range.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from opslens.llm.automata import END, Automaton, prefixes, summed
from opslens.llm.common import staged

LONGEST = 4
#: Words of a shard; bytes of text between two sampled paths; sampled paths of a range.
SHARD, STRIDE, RANGE = 1_500_000, 48 << 10, 256
FAN = 256
#: Requests that one task looks up; paths that it unites in a round; characters of text to a path, rather too few.
REQUESTS, UNITED, WORD = 200_000, 1_500_000, 4
PART = 1 << 20

Path = tuple[bytes, ...]
LANG = b"\n\n"

# Pieces end at these; A to Z in lower case; a tab separates words as a space does.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_BYTES = bytes.maketrans(_ENDS + b"\t" + bytes(range(65, 91)), b"\n" * len(_ENDS) + b" " + bytes(range(97, 123)))


def _parts(text: str) -> Iterator[list[bytes]]:
    """Words of a text, a newline between pieces and empty words in between; about a megabyte of text at a time."""
    data, at = text.encode().translate(_BYTES), 0
    while at < len(data):
        end = len(data)
        if end - at > PART:
            end = max(data.rfind(b" ", at, at + PART), data.rfind(b"\n", at, at + PART))
            if end <= at:  # one word longer than that
                end = min((i for i in (data.find(b" ", at + 1), data.find(b"\n", at + 1)) if i >= 0), default=len(data))
        yield data[at:end].replace(b"\n", b" \n ").split(b" ")
        at = end


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class _Shard:
    """Words of some texts as numbers; 0 is no word and 1 the end of a piece."""

    def __init__(self) -> None:
        self.numbers = _Numbers({b"": 0, b"\n": 1})
        self.words, self.langs, self.size = [], [], 0
        self.unfinished = 0  # words of a text that may go on

    def add(self, lang: bytes, words: list[bytes]) -> None:
        found = np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words))
        self.words.append(found[found > 0])
        self.langs.append((self.numbers[lang], len(self.words[-1])))
        self.size += len(self.words[-1])
        self.unfinished += len(self.words[-1])

    def end_text(self, lang: bytes) -> None:
        self.add(lang, [b"\n"])
        self.unfinished = 0

    def paths(self, longest: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Distinct sorted paths, their counts and the words; none for the places of :meth:`rest`."""
        vocabulary = list(self.numbers)[2:]
        order = sorted(range(len(vocabulary)), key=vocabulary.__getitem__)
        label = np.zeros(len(vocabulary) + 2, np.int32)
        label[np.array(order, np.int64) + 2] = np.arange(1, len(order) + 1)
        words = label[np.concatenate([*self.words, np.zeros(longest, np.int32)])]
        n = len(words) - longest
        rows = np.zeros((n, longest + 1), np.int32)
        rows[:, 0] = np.repeat([label[number] for number, _ in self.langs], [size for _, size in self.langs])
        rows[:, 1] = words[:n]
        for d in range(1, longest):
            rows[:, d + 1] = np.where(rows[:, d] != END, words[d : n + d], END)
        rows = rows[: n - len(self.rest(longest))]
        rows = rows[rows[:, 1] != END]
        return (*summed(rows, np.ones(len(rows), np.int64)), [vocabulary[i] for i in order])

    def rest(self, longest: int) -> list[bytes]:
        """The last words of an unfinished text, whose paths the next words may belong to."""
        left = min(self.unfinished, longest - 1)
        if not left:
            return []
        vocabulary = list(self.numbers)
        return [vocabulary[i] for i in np.concatenate(self.words)[-left:].tolist()]


def _key(lang: str | None) -> bytes:
    """A language as the first label of a path; no word holds a newline, and one alone is the end of a piece."""
    return LANG + ("und" if lang is None else lang).encode()


def _shards(rows: Iterator[tuple[str | None, str | None]], longest: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    shard = _Shard()
    for lang, text in rows:
        key = _key(lang)
        for words in _parts(text or ""):
            shard.add(key, words)
            if shard.size >= size:
                rest = shard.rest(longest)
                yield shard.paths(longest)
                shard = _Shard()
                shard.add(key, rest)
        shard.end_text(key)
    if shard.size:
        yield shard.paths(longest)


def _split(rows: np.ndarray, weights: np.ndarray, words: list[bytes], bounds: list[Path], numbers: range, lot: int) -> Iterator[tuple[int, int, bytes]]:
    """(number, lot, automaton) of the ranges between ``bounds`` that hold any of the sorted rows."""

    def path(i: int) -> Path:
        return tuple(words[k - 1] if k else b"" for k in rows[i].tolist())

    edges = [0, *(bisect.bisect_left(range(len(rows)), bound, key=path) for bound in bounds), len(rows)]
    for number, a, b in zip(numbers, edges, edges[1:], strict=False):
        if a < b:
            yield number, lot, Automaton.build(rows[a:b], weights[a:b], words).dump()


_PARTS = pa.schema([("range", pa.int64()), ("lot", pa.int64()), ("automaton", pa.binary())])


def _batch(some: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), _PARTS, strict=True)], schema=_PARTS)


def sampled_paths(texts: DataFrame, longest: int = LONGEST, stride: int = STRIDE) -> DataFrame:
    """A path from every ``stride`` bytes of the (lang, text) rows, one column per label: only for choosing ranges."""
    names = [f"p{d}" for d in range(longest + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        left = (context.partitionId() if context else 0) * 7919 % stride
        for batch in batches:
            out = []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                size = len(text or "")
                while left < size:
                    words = [w for w in next(_parts(text[left : left + 400]), [])[1:] if w]
                    piece = words[: words.index(b"\n")] if b"\n" in words else words
                    out.append([_key(lang), *(piece + [b""] * longest)[:longest]])
                    left += stride
                left -= size
            columns = [pa.array([row[d] for row in out], pa.binary()).cast(pa.string(), safe=False) for d in range(longest + 1)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return texts.mapInArrow(run, ", ".join(f"{n} string" for n in names))


def range_bounds(texts: DataFrame, longest: int = LONGEST, stride: int = STRIDE, per_range: int = RANGE) -> list[Path]:
    """Where one range of paths ends and the next begins; fewer where a path is so frequent that it fills ranges."""
    sample = staged(sampled_paths(texts, longest, stride), "sampled")
    ranges = -(-sample.count() // per_range)
    if ranges < 2:
        return []
    dealt = sample.repartitionByRange(ranges, *sample.columns).groupBy(F.spark_partition_id().alias("p"))
    least = dealt.agg(F.min(F.struct(*sample.columns)).alias("path")).collect()
    return sorted({tuple(x.encode() for x in r["path"]) for r in least})[1:]


def _rounds(ranges: int, fan: int) -> tuple[int, int]:
    """How many rounds reach that many ranges, and the least number of finer ranges per round that does."""
    rounds = 1
    while fan**rounds < ranges:
        rounds += 1
    while fan > 2 and (fan - 1) ** rounds >= ranges:
        fan -= 1
    return rounds, fan


def range_automata(
    texts: DataFrame, bounds: list[Path], longest: int = LONGEST, shard: int = SHARD, fan: int = FAN, united: int = UNITED, range_chars: int = STRIDE * RANGE
) -> DataFrame:
    """(range, lot, automaton): parts of the counts of all paths of (lang, text) rows; a range may have many.

    A range of ``range_chars`` characters holds a path for every ``WORD`` of them at most, or the same ones many times,
    so how many lots its parts are dealt to, in turns, is known before they are counted and nothing is kept for it.
    """
    rounds, fan = _rounds(len(bounds) + 1, fan)
    step = fan ** (rounds - 1)
    lots = lambda step: 1 if step == 1 else -(-step * range_chars // (WORD * united))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (pair for batch in batches for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        context = TaskContext.get()
        first = context.partitionId() if context else 0
        for turn, (paths, counts, words) in enumerate(_shards(rows, longest, shard), first):
            # Range numbers are those of the finest ranges: here the first one of each coarse range.
            if some := list(_split(paths, counts, words, bounds[step - 1 :: step], range(0, len(bounds) + 1, step), turn % lots(step))):
                yield _batch(some)

    kind = "range long, lot long, automaton binary"
    parts = texts.mapInArrow(counted, kind)
    while step > 1:
        coarse, step = step, step // fan
        parts = parts.groupBy("range", "lot").applyInArrow(_refined(bounds, coarse, step, lots(step)), kind)
    return parts


def _refined(bounds: list[Path], coarse: int, step: int, lots: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """Unites automata of one coarse range and splits them into its ranges of ``step`` fine ones."""

    def refined(key: tuple, table: pa.Table) -> pa.Table:
        first, lot = key[0].as_py(), key[1].as_py()
        merged = Automaton.union([Automaton.load(x.as_py()) for x in table["automaton"]])
        numbers = range(first, min(first + coarse, len(bounds) + 1), step)
        return pa.Table.from_batches([_batch(list(_split(*merged, bounds[first : first + coarse - 1][step - 1 :: step], numbers, lot % lots)))])

    return refined


def phrase_counts(texts: DataFrame, bounds: list[Path], least: int, longest: int = LONGEST, **how: int) -> DataFrame:
    """(lang, phrase, k, f) of all phrases of 1 to ``longest`` words with at least ``least`` occurrences.

    A row with k = 0 and an empty phrase holds all word occurrences of the language.
    """

    def united(key: tuple, table: pa.Table) -> pa.Table:
        rows, weights, words = Automaton.union([Automaton.load(x.as_py()) for x in table["automaton"]])
        out: list[list] = [[], [], [], []]
        for length, first, weight in prefixes(rows, weights):
            edge = (rows[first, :length] == rows[0, :length]).all(1) | (rows[first, :length] == rows[-1, :length]).all(1)
            kept = edge | (weight >= least) | (length == 1)
            for path, f in zip(rows[first[kept], :length].tolist(), weight[kept].tolist(), strict=True):
                out[0].append(words[path[0] - 1][len(LANG) :])
                out[1].append(b" ".join([words[k - 1] for k in path[1:]]))
                out[2].append(length - 1)
                out[3].append(f)
        columns = [pa.array(c, t) for c, t in zip(out, (pa.binary(), pa.binary(), pa.int32(), pa.int64()), strict=True)]
        return pa.table([columns[0].cast(pa.string()), columns[1].cast(pa.string()), *columns[2:]], ["lang", "phrase", "k", "f"])

    parts = range_automata(texts, bounds, longest, **how)
    kind = "lang string, phrase string, k int, f long"
    counted = parts.select("range", "automaton").groupBy("range").applyInArrow(united, kind)
    total = counted.groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f"))
    return staged(total.filter((F.col("f") >= least) | (F.col("k") == 0)), "phrases")


def _in_range(rows: DataFrame, bounds: list[Path], longest: int) -> DataFrame:
    """``rows`` with the range of their (lang, part)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, parts = batch.column("lang").to_pylist(), batch.column("part").to_pylist()
            at = [bisect.bisect_right(bounds, _path(lang, part, longest)) for lang, part in zip(langs, parts, strict=True)]
            yield batch.append_column("range", pa.array(at, pa.int64()))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, `range` long")


def _path(lang: str, phrase: str, longest: int) -> Path:
    words = phrase.encode().split(b" ")
    return (_key(lang), *words, *[b""] * (longest - len(words)))


def looked_up(requests: DataFrame, phrases: DataFrame, bounds: list[Path], longest: int = LONGEST, per_task: int = REQUESTS) -> DataFrame:
    """(phrase, a, ``lang``, part, cut, first) requests with the weight of their part.

    Requests for a frequent part all fall into one range: a range with many is dealt to several tasks, each of which
    gets the range's phrases.
    """
    names = requests.columns
    requests = staged(_in_range(requests, bounds, longest), "requests")
    lots = requests.groupBy("range").agg(F.ceil(F.count("*") / per_task).alias("lots"))
    asked = requests.join(lots, "range").withColumn("lot", F.pmod(F.xxhash64("phrase", "cut"), F.col("lots"))).drop("lots")
    known = _in_range(phrases.select("lang", F.col("phrase").alias("part"), "f"), bounds, longest)
    known = known.join(lots, "range").withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1))).drop("lots")

    def composed(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return left.select(names).append_column("weight", pa.array([], pa.int64()))
        found = sorted((_path(lang, part, longest), f) for lang, part, f in zip(*(right[c].to_pylist() for c in ("lang", "part", "f")), strict=True))
        words = sorted({word for path, _ in found for word in path if word})
        label = {word: i for i, word in enumerate(words, 1)} | {b"": END}
        rows = np.array([[label[word] for word in path] for path, _ in found], np.int32)
        automaton = Automaton.build(rows, np.array([f for _, f in found]), words)
        weights = [automaton.weight([w for w in _path(lang, part, longest) if w]) for lang, part in zip(left["lang"].to_pylist(), left["part"].to_pylist(), strict=True)]
        return left.select(names).append_column("weight", pa.array(weights, pa.int64()))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema[:-1])
    return asked.groupBy("range", "lot").cogroup(known.groupBy("range", "lot")).applyInArrow(composed, f"{kinds}, weight long")


def scored(phrases: DataFrame, bounds: list[Path], longest: int = LONGEST, scale: int = 2_000_000) -> DataFrame:
    """(lang, phrase, k, a, l, r, score) of the phrases of two words or more, by the lowest score over their cuts."""
    words = F.split("phrase", " ")
    parts = phrases.filter("k >= 2").select("lang", "phrase", "k", F.col("f").alias("a"), words.alias("w"), F.explode(F.expr("sequence(1, k - 1)")).alias("cut"))
    both = F.array(
        F.struct(F.lit(True).alias("first"), F.expr("array_join(slice(w, 1, cut), ' ')").alias("part")),
        F.struct(F.lit(False).alias("first"), F.expr("array_join(slice(w, cut + 1, k - cut), ' ')").alias("part")),
    )
    asked = parts.select("lang", "phrase", "k", "a", "cut", F.explode(both).alias("b")).select("lang", "phrase", "k", "a", "cut", "b.first", "b.part")
    found = looked_up(asked, phrases.filter(F.col("k").between(1, longest - 1)), bounds, longest)
    sides = [F.max(F.when((F.col("cut") == c) & (F.col("first") == side), F.col("weight"))).alias(f"{name}{c}") for c in range(1, longest) for side, name in ((True, "l"), (False, "r"))]
    wide = found.groupBy("lang", "phrase", "k", "a").agg(*sides)
    cuts = [
        F.when(F.col("k") > c, F.struct(
            F.expr(f"cast(a as decimal(20, 0)) * {scale} div (cast(l{c} as decimal(20, 0)) + r{c})").alias("score"), F.lit(c).alias("cut"), F.col(f"l{c}").alias("l"), F.col(f"r{c}").alias("r"),
        ))
        for c in range(1, longest)
    ]
    best = F.array_min(F.array_compact(F.array(*cuts)))
    return wide.withColumn("best", best).select("lang", "phrase", "k", "a", "best.l", "best.r", "best.score")


def without_fragments(candidates: DataFrame, phrases: DataFrame, percent: int = 80) -> DataFrame:
    """Candidates that are not contained in a longer phrase with at least ``percent`` of their occurrences."""
    words = F.split("phrase", " ")
    longer = phrases.filter("k >= 3").select("lang", "k", "f", words.alias("w"))
    inner = longer.withColumn("size", F.explode(F.expr("sequence(2, k - 1)"))).withColumn("at", F.explode(F.expr("sequence(1, k - size + 1)")))
    cover = inner.select("lang", F.expr("array_join(slice(w, at, size), ' ')").alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("cover"))
    joined = candidates.join(cover, ["lang", "phrase"], "left")
    covered = F.col("cover").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * percent
    return joined.filter(F.col("cover").isNull() | ~covered).drop("cover")


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, percent: int = 80, top: int | None = 2000,
    longest: int = LONGEST, stride: int = STRIDE, per_range: int = RANGE, **how: int,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's phrases, the best ``top`` or all.

    Null texts are empty and have no words, a null language is ``und``; repeated rows count as often as they are there;
    an empty table gives no rows.  Words are cut at spaces and tabs only and may be of any length.
    """
    texts = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    bounds = range_bounds(texts, longest, stride, per_range)
    phrases = phrase_counts(texts, bounds, least, longest, range_chars=per_range * stride, **how)
    kept = without_fragments(scored(phrases, bounds, longest), phrases, percent)
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    n = phrases.filter("k = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

"""Groups of spelling variants: words one edit apart, found by asymmetric q-chunks.

For a pair of words the shorter one contributes two disjoint chunks, its halves.  One edit touches one of them at
most, so the other stands unchanged in the longer word, shifted by one place at most.  The longer word contributes its
positional grams of that length; those further away than one shift can join no chunk and are not written.  A joined
pair is verified by its edit distance.

What a joined pair still may differ in is the part of the words outside the kept chunk.  Keys that many words share
(a common prefix, say) are therefore not joined as they are: the differing part is cut into two chunks again, one of
which must be kept too, and so on until the groups are small.  At the end of that road a key leaves one place open
and all its words of a length are near each other, so no group's pairs are formed beyond the links that exist.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.llm.common import staged

#: Letters of a word: A to Z, a to z and the Latin-1 letters (with the two signs between them).
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
#: A key with more possible pairs than this is cut further; results do not depend on it.
CROWDED = 20_000
SALTS = 16


def lowered(run: Column) -> Column:
    """A to Z in lower case, nothing else; ``lower`` does the same for runs without other letters, only faster."""
    return F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(
        F.translate(run, string.ascii_uppercase, string.ascii_lowercase)
    )


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 3, min_length: int = 5, noise: int | None = None) -> DataFrame:
    """(word, n): the words of all texts with at least ``min_length`` code points and ``least`` occurrences.

    ``noise`` damages words in a reproducible way, to have misspellings to find: where it divides the crc32 of
    ``<id>:<word>``, one code point of the word is deleted.  Null texts have no words, a null id counts as empty.
    """
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
        F.explode(F.expr(f"regexp_extract_all({_quoted(text_col)}, '{RUN}', 0)")).alias("run"),
    )
    words = runs.select("id", lowered(F.col("run")).alias("word"))
    if noise:
        words = words.filter(F.length("word") >= min_length)
        words = words.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "word").cast("binary")))
        cut = F.concat(F.expr("substr(word, 1, cast(h % length(word) as int))"), F.expr("substr(word, cast(h % length(word) as int) + 2)"))
        words = words.select(F.when(F.col("h") % noise == 0, cut).otherwise(F.col("word")).alias("word"))
    return words.filter(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _cut(rows: DataFrame) -> DataFrame:
    """Two rows for each: the differing part of the shorter word's length is halved, and either half is kept.

    Columns: word, n, longer (by this many code points than the words it looks for), size (their length), and the
    kept code points before and after the differing part.
    """
    open_part = F.col("size") - F.col("before") - F.col("after")
    half = F.floor(open_part / 2).cast("int")
    first = F.struct((F.col("before") + half).alias("before"), F.col("after").alias("after"))
    second = F.struct(F.col("before"), (F.col("after") + open_part - half).alias("after"))
    cut = rows.withColumn("kept", F.explode(F.array(first, second)))
    cut = cut.select("word", "n", "longer", "size", F.col("kept.before").alias("before"), F.col("kept.after").alias("after"))
    chunk = (F.expr("substr(word, 1, before)"), F.expr("substr(word, length(word) - after + 1)"))
    return cut.withColumn("key", F.xxhash64("size", "before", "after", *chunk))


def near_pairs(words: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(a, a_n, b, b_n), each pair of distinct (word, n) once, that differ by one inserted, deleted or replaced code point."""
    length = F.length("word")
    start = words.filter(length > 0).select("word", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("longer"))
    start = start.select("word", "n", "longer", (length - F.col("longer")).alias("size"), F.lit(0).alias("before"), F.lit(0).alias("after"))
    rows, found = staged(_cut(start.filter("size > 0")), "chunks"), None
    while True:
        per_key = rows.groupBy("key").agg(
            F.sum(F.expr("if(longer = 0, 1L, 0L)")).alias("chunks"), F.count("*").alias("grams"), F.max(F.col("size") - F.col("before") - F.col("after")).alias("open"),
        )
        hot = staged(per_key.filter(F.col("chunks") * F.col("grams") > crowded).filter("open > 1").select("key"), "crowded")
        again = not hot.isEmpty()
        calm, busy = rows, rows
        if again:
            salted = rows.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(SALTS)))
            keys = hot.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
            calm = salted.join(keys, ["key", "salt"], "left_anti")
            busy = salted.join(keys, ["key", "salt"], "left_semi").select(*rows.columns)
        pairs = staged(_joined(calm), "pairs")
        found = pairs if found is None else found.union(pairs)
        if not again:
            return found.distinct()
        rows = staged(_cut(busy), "chunks")


def _joined(rows: DataFrame) -> DataFrame:
    chunks = rows.filter("longer = 0").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    grams = rows.select("key", F.col("word").alias("b"), F.col("n").alias("b_n"), "longer")
    pairs = chunks.join(grams, "key").filter((F.col("longer") == 1) | (F.col("a") < F.col("b")))
    return pairs.filter(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n")


def variants(words: DataFrame, factor: int = 2, crowded: int = CROWDED) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for distinct words and their counts.

    A word's form is its near word of largest n (ties: the smallest in code-point order), if that n is at least
    ``factor`` times its own; root is where following forms ends.  No words give no rows.
    """
    words = staged(words.select("word", "n"), "words")
    pairs = near_pairs(words, crowded)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).union(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n"))
    )
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("down"), F.col("near"))).alias("best"))
    near = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("best.near").alias("form"), (-F.col("best.down")).alias("form_n"),
    )
    keeps = F.col("form_n") >= F.col("n") * factor
    judged = near.select("word", "n", "n_near", F.when(keeps, F.col("form")).alias("form"), F.when(keeps, F.col("form_n")).alias("form_n"))
    judged = staged(judged, "judged")
    ends = _followed(judged.filter("form is not null").select("word", F.col("form").alias("root")))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _followed(steps: DataFrame) -> DataFrame:
    """(word, root) at the end of each chain of (word, root) steps: every round doubles the steps taken.

    Counts grow by the factor with each step, so a chain is no longer than the logarithm of the largest count.
    """
    steps = staged(steps, "steps")
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = staged(steps.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "steps")
        if steps.filter("moved").isEmpty():
            return steps.select("word", "root")
        steps = steps.select("word", "root")

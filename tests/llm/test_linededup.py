"""Aligned lines leave the later document; brute force over all lines."""

import re
from collections import defaultdict

from opslens.llm.linededup import align, aligned, without_repeated_lines

A = "\n".join(f"line number {i} of the first text" for i in range(6))


def longest(pairs):
    """Length of the longest forward chain of lines that are unique in both, by exhaustion."""
    seen = defaultdict(int)
    for _, _, h in pairs:
        seen[h] += 1
    unique = sorted((b, a) for b, a, h in pairs if seen[h] == 1)
    best = [1] * len(unique)
    for i, (_, a) in enumerate(unique):
        best[i] = 1 + max((best[j] for j in range(i) if unique[j][1] < a), default=0)
    return max(best, default=0)


def test_align_keeps_the_longest_forward_chain():
    import random

    rnd = random.Random(7)
    for _ in range(60):
        earlier = rnd.sample(range(40), 25)
        later = rnd.sample(range(40), 25)
        pairs = [(b, earlier.index(h), h) for b, h in enumerate(later) if h in earlier]
        got = align(pairs)
        places = {b: a for b, a, _ in pairs}
        assert len(got) == longest(pairs) and [places[b] for b in got] == sorted(places[b] for b in got)


def test_align_extends_blocks_by_repeated_lines():
    assert align([(0, 5, 1), (1, 6, 2), (1, 8, 2), (3, 6, 2), (3, 8, 2)]) == [0, 1]
    assert align([(0, 0, 9), (0, 1, 9), (1, 0, 9), (1, 1, 9)]) == [0, 1]
    assert align([]) == []


def run(spark, rows, **options):
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, gone int").selectExpr("*", "'x' as row_id", "'y' as pos")
    out = without_repeated_lines(docs, **options)
    assert out.columns == docs.columns + ([options["removed_col"]] if "removed_col" in options else [])
    return out


def test_later_document_loses_aligned_lines(spark):
    later = "own words come first here\n" + A + "\nyes no\n\nand own words come last"
    backwards = "\n".join(reversed(A.split("\n")))
    rows = [(5, later), (1, A), (2, "unrelated words stay as they are\n\n  here "), (7, backwards), (8, None), (9, ""), (10, "yes no"), (11, "yes no")]
    got = {r.doc_id: (r.text, r.n) for r in run(spark, rows, rare_share=1.0, removed_col="n").collect()}
    assert got[1] == (A, 0) and got[2] == (rows[2][1], 0) and got[8] == (None, 0) and got[9] == ("", 0)
    assert got[10] == got[11] == ("yes no", 0)
    assert got[5] == ("own words come first here\nyes no\n\nand own words come last", 6)
    # Turned round, only one line can be on a forward chain.
    assert got[7][1] == 1


def test_frequent_lines_stay_and_copies_count_once(spark):
    common = "the same notice under every text"
    rows = [(i, f"text {i} has words of its own\n{common}") for i in range(20)] + [(100 + i, A) for i in range(10)]
    got = {r.doc_id: r.text for r in run(spark, rows, rare_share=0.2).collect()}
    assert all(got[i] == t for i, t in rows[:20])
    # Ten copies are one text of 21, so their lines are rare: the first stays, the others lose all lines.
    assert got[100] == A and all(got[100 + i] == "" for i in range(1, 10))


def test_repeated_rows_null_ids_long_text_empty_table(spark):
    long = "\n".join(f"a long text of many lines {i}" for i in range(20_000))
    rows = [(3, long), (4, "new line before it all\n" + long), (6, A), (6, A), (None, A)]
    got = [(r.doc_id, r.text) for r in run(spark, rows, rare_share=1.0).collect()]
    assert dict(got)[3] == long and dict(got)[4] == "new line before it all" and dict(got)[None] == ""
    assert sorted(t for i, t in got if i == 6) == ["", A]
    assert run(spark, rows).limit(0).count() == 0 and without_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_every_deleted_line_is_in_an_earlier_document(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    after = {r.doc_id: r.text for r in without_repeated_lines(docs).collect()}
    assert before.keys() == after.keys()
    first = {}
    removed = 0
    for i in sorted(before):
        old, new = before[i].split("\n"), after[i].split("\n") if after[i] else []
        rest = iter(old)
        kept = all(any(x == line for x in rest) for line in new)
        assert kept
        left = list(old)
        for line in new:
            left.remove(line)
        for line in left:
            assert line.strip(" ") in first and first[line.strip(" ")] < i and len(re.findall(r"\S+", line)) >= 3
        removed += len(left)
        for line in old:
            first.setdefault(line.strip(" "), i)
    assert removed > 100


def test_aligned_between_anchors_and_without_unique_lines():
    assert aligned(list("u12abc"), list("uxabczabc")) == [0, 3, 4, 5]
    assert aligned([1, 2] * 3 + [3], [2, 1] * 3) == [1, 2, 3, 4, 5]
    import random

    rnd = random.Random(4)
    for _ in range(200):
        x, y = (rnd.choices(range(4), k=rnd.randint(8, 20)) for _ in range(2))
        got = aligned(x, y)
        rest = iter(y)
        assert got == sorted(set(got)) and all(any(h == z for z in rest) for h in (x[i] for i in got))


def test_repeated_passage_between_anchors_goes(spark):
    u, x, a, b, c, z = (f"line {n} of three words" for n in "uxabcz")
    rows = [(1, "\n".join([u, x, a, b, c, z, a, b, c])), (2, "\n".join([u, "own line number one", "own line number two", a, b, c]))]
    assert {r.doc_id: r.text for r in run(spark, rows, rare_share=1.0).collect()} == {1: rows[0][1], 2: "own line number one\nown line number two"}


def test_frequent_line_inside_an_aligned_block_goes(spark):
    common = "the same notice under every text"
    block = A.split("\n")
    rows = [(i, f"text {i} has words of its own\n{common}") for i in range(20)]
    rows += [(100, "\n".join([*block[:3], common, *block[3:]])), (101, "\n".join(["one more line here", *block[:3], common, *block[3:]]))]
    got = {r.doc_id: r.text for r in run(spark, rows, rare_share=0.2).collect()}
    assert got == dict(rows[:21]) | {101: "one more line here"}


def test_lines_left_by_the_first_holder_align_with_a_later_one(spark):
    rows = [(1, "\n".join(reversed(A.split("\n")))), (2, "own line number two\n" + A), (3, "own line number three\n" + A)]
    got = {r.doc_id: r.text for r in run(spark, rows, rare_share=1.0).collect()}
    assert got[1] == rows[0][1] and len(got[2].split("\n")) == 6 and got[3] == "own line number three"


def test_one_line_repeated_in_two_long_texts(spark):
    line = "one line all over"
    rows = [(1, "\n".join([line] * 20_000)), (2, "\n".join(["a line of its own", *[line] * 20_000]))]
    assert {r.doc_id: r.text for r in run(spark, rows, rare_share=1.0).collect()} == {1: rows[0][1], 2: "a line of its own"}

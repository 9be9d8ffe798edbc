"""One document of each group of near copies, against all pairs."""

import random
import re
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from opslens.llm import nearcopies
from opslens.llm.nearcopies import nearest_before, one_of_each_group


def shingles(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a == b or (a and b and len(a & b) >= 0.8 * len(a | b)):
            label = [label[i] if x == label[j] else x for x in label]
    return sorted(min(r[0] for r, x in zip(rows, label) if x == c) for c in set(label))


def test_against_all_pairs(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choices("abcdefg", k=5))
    rows = []
    for g in range(25):
        base = [word() for _ in range(rnd.randint(40, 300))]
        for k in range(rnd.randint(1, 6)):
            own = list(base)
            for at in rnd.sample(range(len(own)), (k * len(own)) // 150):
                own[at] = word()
            rows.append((1000 - len(rows), " ".join(own)))
    rows += [(2000, "one two"), (2001, "ONE  two"), (2002, "one"), (2003, ""), (2004, None), (2005, "\n"), (2006, "word " * 40_000), (2007, "Word " * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as row_id", "2 as group", "3 as copy")
    out = one_of_each_group(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == brute(rows)


def test_large_group_of_near_copies(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*base[: i % 190], f"x{i}", *base[i % 190 + 1 :]])) for i in range(600)]
    assert [r.doc_id for r in one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [0]


def test_null_and_repeated_ids_and_empty_table(spark):
    rows = [(None, "a b c d e f"), (9, "a b c d e f"), (4, "g h i j k"), (4, "g h i j k"), (None, "l m n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.text) for r in one_of_each_group(docs).collect()) == [(-1, "l m n"), (4, "g h i j k"), (9, "a b c d e f")]
    assert one_of_each_group(docs.limit(0)).count() == 0


def test_nearest_before_is_the_nearest():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 1 << 64, 700, dtype=np.uint64)
    prints[300:] = prints[:400] ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))
    a, b = nearest_before(prints, 1)
    order = [0, *a.tolist()]
    for n, (i, j) in enumerate(zip(a, b), 1):
        earlier = prints[order[:n]]
        assert np.bitwise_count(prints[i] ^ prints[j]) == np.bitwise_count(earlier ^ prints[i]).min()


def test_pairs_among_many_nearer_texts_of_one_template(spark):
    rnd = random.Random(11)
    base = [f"t{i}" for i in range(200)]

    def changed(own, n):
        own = dict(own)
        while len(own) < n:
            own[rnd.randrange(200)] = f"x{rnd.random()}"
        return own

    first = [changed({}, 1) for _ in range(120)]
    changes = [changed(c, 3) for c in first for _ in range(2)]
    rows = [(i, " ".join(own.get(at, w) for at, w in enumerate(base))) for i, own in enumerate(changes)]
    got = sorted(r.doc_id for r in one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows) and len(got) < 240


def test_crowded_shingles_in_blocks_lose_no_pair(spark, monkeypatch):
    """The same pairs whether a shingle's rows are joined or compared in blocks, however small these are."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(60)] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(words)))
    numbered = spark.createDataFrame(rows, "row long, text string")
    sets = nearcopies.shingle_sets(numbered, "row", "text", 5)
    members = numbered.select("row", F.col("row").alias("component"))

    def found(crowd, block):
        monkeypatch.setattr(nearcopies, "CROWD", crowd)
        monkeypatch.setattr(nearcopies, "BLOCK", block)
        return {tuple(r) for r in nearcopies.similar(nearcopies.pairs_apart(members, sets, 0.8), sets, 0.8).collect()}

    shingles = [{tuple(t.split()[k : k + 5]) for k in range(56)} for _, t in rows]
    exact = {(a, b) for a in range(90) for b in range(a + 1, 90) if len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]) - 1e-9}
    assert len(exact) > 100 and found(10**9, 10) == exact and found(0, 25) == exact and found(5, 10**6) == exact


def test_fingerprints_within_the_radius_are_linked_whatever_their_shingle_sets(spark):
    """Repeats weigh in a fingerprint, not in a set: these texts have a low Jaccard similarity and one fingerprint but for two bits."""
    from opslens.llm.simhash import fingerprint

    loud = "one two three " * 400
    rows = [(5, loud), (6, loud + " ".join(f"w{i}" for i in range(40))), (7, loud.upper()), (8, " ".join(f"v{i}" for i in range(60))), (9, None), (10, "")]
    assert shingles(rows[0][1]) != shingles(rows[1][1]) and (fingerprint(loud.encode(), 3) ^ fingerprint(rows[1][1].encode(), 3)).bit_count() <= 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in one_of_each_group(docs).collect()) == [5, 6, 8, 9]
    assert sorted(r.doc_id for r in one_of_each_group(docs, radius=2).collect()) == [5, 8, 9]
    assert one_of_each_group(docs.limit(0), radius=2).count() == 0


def test_pipeline_groups_hold_every_link_of_the_simhash_operator(spark):
    """A group of the pipeline's stage is a union of whole components of op1's operator."""
    import corpus_pipeline
    from opslens.llm.simhash import simhash_components

    rnd = random.Random(5)
    base = [f"w{rnd.randrange(50)}" for _ in range(800)]
    rows = []
    for i in range(60):
        own = list(base) if i % 2 else [f"x{i}y{rnd.random()}" for _ in range(50)]
        own[rnd.randrange(50)] = f"z{i}"
        rows.append((i, " ".join(own * rnd.randint(1, 3))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()}
    components = {r.doc_id: r.component_id for r in simhash_components(docs).collect()}
    assert len(set(components.values())) < 60 and kept <= set(components.values())

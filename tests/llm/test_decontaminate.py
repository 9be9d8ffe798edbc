"""Containment of benchmark items against brute force, in one pass and by joins."""

import random
import re

import pytest

from opslens.llm.decontaminate import clean_documents, contamination


def shingles(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute(docs, items):
    out = []
    for doc, text in docs:
        own = shingles(text)
        found = sorted(i for i, t in items if i is not None and shingles(t) and len(shingles(t) & own) >= 0.8 * len(shingles(t)) - 1e-9)
        if found:
            out.append((doc, found))
    return sorted(out)


def case():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choices("abcdefgh", k=4))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((5, 8, 15, 40, 57, 3, 1, 10, 12))]
    items += [(90, None), (91, ""), (None, items[3][1]), (93, items[2][1].upper())]
    docs = []
    for i, (_, text) in enumerate(items[:9]):
        words = text.split()
        for k, edits in enumerate((0, 1, 2, 5)):
            own = list(words)
            for at in rnd.sample(range(len(own)), min(edits, len(own))):
                own[at] = word()
            docs.append((100 * i + k, " ".join([word() for _ in range(300 * (k % 2))] + own + [word() for _ in range(20)])))
    docs += [(2000, None), (2001, ""), (2002, items[3][1] + "\n" + items[4][1]), (2002, "clean"), (2003, " ".join(word() for _ in range(30_000)) + " " + items[4][1])]
    return docs, items


@pytest.mark.parametrize("local_hashes", [10**6, 3])
def test_brute_force(spark, local_hashes):
    docs, items = case()
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as items", "2 as hash")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as id")
    want = brute(docs, items)
    assert sorted((r[0], r[1]) for r in contamination(frame, bench, local_hashes=local_hashes).collect()) == want
    kept = clean_documents(frame, bench, local_hashes=local_hashes)
    assert kept.columns == frame.columns
    leaked = [d for d, _ in want]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, t in docs if d not in leaked or t == "clean")


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert contamination(docs.limit(0), items).count() == 0
    assert contamination(docs, items.limit(0)).count() == 0
    assert clean_documents(docs, items.limit(0)).count() == 1

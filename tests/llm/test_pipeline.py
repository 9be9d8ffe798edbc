"""The pipeline's stages on a small corpus, each against its brute-force version on its own input."""

import random

import pytest
from test_decontaminate import brute as leaks
from test_linededup import A
from test_nearcopies import brute as one_of_each
from test_packing import check as check_packing
from test_toxicity import corpus

import corpus_pipeline
from opslens.llm import toxicity
from opslens.llm.queries import QUERIES

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choices("klmnopq", k=5))
    rows = [(i, t) for i, t, _ in corpus(300, 5)]
    labels = [(i, 1, y) for i, _, y in corpus(300, 5)]
    base = [word() for _ in range(120)]
    rows += [(1000 + k, " ".join([*base[: 20 * k], word(), *base[20 * k + 1 :]])) for k in range(5)] + [(1010, " ".join(base))]
    rows += [(1100, A), (1101, "words before the shared lines\n" + A), (1102, A + "\nwords after the shared lines")]
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate((12, 30))]
    rows += [(1200, "start " + items[0][1] + " end"), (1201, items[1][1].upper()), (1202, None), (1203, ""), (1204, "long " + " ".join(word() for _ in range(6000)))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), items


def test_stages(spark, folder):
    path, items = folder
    steps, docs = {}, spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = f"{path}/out-{name}"
        stage(spark, docs, path).write.parquet(out)
        before, docs = docs, spark.read.parquet(out)
        steps[name] = (before, docs)
        assert name == "packing" or docs.columns == COLUMNS
    plain = lambda df: {r.doc_id: r.text for r in df.collect()}

    before, after = map(plain, steps["toxicity"])
    tagger = toxicity.Tagger(toxicity.train(steps["toxicity"][0], spark.read.parquet(f"{path}/labels.parquet")))
    assert set(after) == {i for i, t in before.items() if tagger.score(t) < 0.7} and 20 < len(before) - len(after) < 100

    before, after = map(plain, steps["line_dedup"])
    assert before.keys() == after.keys()
    assert {i for i in before if before[i] != after[i]} == {1101, 1102}
    assert after[1101] == "words before the shared lines" and after[1102] == "words after the shared lines"
    assert all(r.n_chars == len(r.text or "") for r in steps["line_dedup"][1].collect())

    before, after = map(plain, steps["simhash_near_dedup"])
    assert sorted(after) == one_of_each(list(before.items())) and {1000, 1202} <= set(after)

    before, after = map(plain, steps["decontamination"])
    assert set(before) - set(after) == {i for i, _ in leaks(list(before.items()), items)} == {1200, 1201}

    _, packed = steps["packing"]
    sequences = check_packing(packed.collect(), after, 2048)
    assert sequences <= 1.05 * packed.agg({"length": "sum"}).first()[0] / 2048 + 1


def test_run_and_registry(spark, folder):
    from __spark_entry__ import oracle_sql, queries

    path, _ = folder
    assert corpus_pipeline.run(spark, path).count() > 200
    assert QUERIES.keys() <= queries().keys() and "pipeline" in queries() and corpus_pipeline.ORACLE_SQL is None
    assert {n.split("_")[0] for n in QUERIES} == {f"op{n}" for n in range(1, 14)} and "op5_top_k" in oracle_sql()


def test_stages_keep_extra_columns_and_take_empty_tables(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").selectExpr("*", "1 as row_id", "'x' as removed", "2 as score")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), path).columns == docs.columns, name
        assert stage(spark, docs.limit(0), path).count() == 0
    assert corpus_pipeline.packing_stage(spark, docs.limit(0), path).count() == 0

import re

from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from keystrata.llm.shared import stored
from tests.llm.fixtures import documents, empty
from tests.llm.test_operators import SF, cut_of, leaks_of, roots
from tests.llm.test_similar import alike, shingles_of


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_each_stage_takes_effect_on_what_it_is_given(spark):
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    planted = [(5000 + i, f"Some words before it {t} and some behind.", "en", "s", 1) for i, (_, t) in enumerate(bench[:3])]
    docs = documents(spark, planted)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, out = rows_of(docs), stored(stage(spark, docs, SF), "t")
        after = rows_of(out)
        if name == "language ID":
            assert all(t and any(c.isalpha() for c in t) for _, t in after)
            gone = {t for _, t in before} - {t for _, t in after}
            without = {t for _, t in before if not (t and any(c.isalpha() for c in t))}
            assert without <= gone and len(before) - len(after) == sum(t in gone for _, t in before)
            assert all(set(t) == {"a"} or "▁" in t for t in gone - without)  # letters of no language
        elif name == "simhash near-dedup":
            sets, groups = [shingles_of(t) for _, t in before], {}
            for (i, _), k in zip(before, roots(sets, alike), strict=True):
                groups.setdefault(k, set()).add(i)
            assert {i for i, _ in after if i is not None} == {min(x for x in g if x is not None) for g in groups.values() if g != {None}}
        elif name == "suffix-array dedup":
            cut = {i: gone for i, _, gone, _, _ in cut_of(before)}
            texts = dict(before)
            for i, t in after:
                assert (t == texts[i]) == (cut[i] == 0) and len(t.encode()) >= len(texts[i].encode()) - cut[i]
            assert {i for i, _ in before} - {i for i, _ in after} <= {i for i in cut if cut[i]}
        elif name == "benchmark decontamination":
            assert {i for i, _ in after} == {x[0] for x in leaks_of(before, bench) if not x[-1]}
        else:
            assert sorted(after, key=repr) == sorted(before, key=repr)
        assert set(columns) <= set(out.columns)
        docs = out
    assert not [i for i, _ in after if i is not None and i >= 5000]


def test_stages_of_an_empty_table(spark):
    docs = empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), "t")
    assert docs.count() == 0


def test_run_and_registration(spark):
    queries = __spark_entry__.queries()
    assert all(any(re.match(rf"op{n}_", q) for q in queries) for n in range(1, 11)) and "pipeline" in queries
    out = corpus_pipeline.run(spark, SF)
    assert 0 < out.count() <= 200 and out.where(F.col("text") == "").count() == 0


def test_a_run_leaves_its_result_and_others_tables_alone(spark, folder):
    from keystrata.llm import shared

    before = set(shared._MADE)
    out = corpus_pipeline.run(spark, SF)
    left = [f for f in shared._MADE if f not in before]
    assert len(left) == 1 and out.count() > 0 and spark.read.parquet(f"{SF}/documents.parquet").count() == 200
    with shared.swept(spark) as keep:
        first, second = stored(spark.range(3), "a"), stored(spark.range(4), "b")
        keep.append(second)
    assert second.count() == 4
    spark.range(2).write.parquet(f"{folder}/keystrata/mine")  # a folder of the user's own, whatever its name
    shared.discard(spark.read.parquet(f"{folder}/keystrata/mine"))
    assert spark.read.parquet(f"{folder}/keystrata/mine").count() == 2
    assert not [f for f in shared._MADE if "/a-" in f and f not in before]

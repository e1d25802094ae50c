import random

import numpy as np
from pyspark.sql import functions as F

from keystrata.llm import langid
from tests.llm.fixtures import documents

SF = "/root/testdata/sf0.01"
FOREIGN = {
    "greek": "Η γρήγορη αλεπού πηδά πάνω από το τεμπέλικο σκυλί και τρέχει μακριά μέσα στο δάσος",
    "han": "快速的 棕色狐狸 跳过懒狗 然后跑进 森林里 没有人能 再找到它 因为天 已经黑了",
    "arabic": "الثعلب البني السريع يقفز فوق الكلب الكسول ثم يركض بعيدا في الغابة",
    "polish": "szybki brązowy lis przeskakuje nad leniwym psem i ucieka daleko do lasu gdzie nikt nie może go odnaleźć",
    "finnish": "nopea ruskea kettu hyppää laiskan koiran yli ja juoksee kauas metsään josta kukaan ei voi löytää sitä",
}


def test_foreign_and_junk_texts_are_rejected_and_clean_ones_are_not(spark):
    rng, docs = random.Random(2), spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.trained_on(docs)
    made = [" ".join(rng.choice(t.split()) for _ in range(60)) for t in FOREIGN.values() for _ in range(20)]
    made += [" ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(6)) for _ in range(60)) for _ in range(20)]
    strange = spark.createDataFrame([(t,) for t in made], "t string").select(langid.identify(F.col("t"), model)["rejected"].alias("r"))
    assert strange.where("r").count() >= 0.95 * len(made)
    for text in (F.col("text"), F.expr("substring(text, 1, 40)"), F.expr("substring(text, 1, 200)")):
        clean = docs.where(langid.held_out(F.col("doc_id"))).select(langid.identify(text, model)["rejected"].alias("r"))
        assert clean.where("r").count() <= 0.03 * clean.count()


def test_labelled_texts_without_letters_do_not_change_the_model(spark):
    docs = documents(spark).where("lang is not null").select(F.col("doc_id").alias("key"), "text", "lang")
    junk = spark.createDataFrame([(9000 + i, "123 !!! ###"[: 3 + i], "en") for i in range(8)], "key long, text string, lang string")
    a, b = langid.fit(docs), langid.fit(docs.union(junk))
    assert a.langs == b.langs and np.allclose(a.centroids, b.centroids) and np.allclose(a.floor, b.floor)

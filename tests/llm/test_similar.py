import random
import re

import numpy as np
from pyspark.sql import functions as F

from keystrata.llm import similar, simhash
from tests.llm.fixtures import documents, empty
from tests.llm.test_operators import roots


def shingles_of(text, n=5):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return {b" ".join(words[i : i + n]) for i in range(max(len(words) - n + 1, 1))} if words else set()


def alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def edited(rng, n, base, edits):
    """Texts of ``n`` words, each ``base`` with some words of its own."""
    out = []
    for i in range(n):
        words = list(base)
        for e in range(rng.randrange(1, edits + 1)):
            words[rng.randrange(len(words))] = f"own{i}x{e}"
        out.append(" ".join(words))
    return out


def test_near_duplicate_stage_keeps_one_of_each_component_of_similar_texts(spark, monkeypatch):
    rng = random.Random(4)
    more = [t for g in range(12) for t in edited(rng, 4, [f"w{g}x{i}" for i in range(60 + 30 * g)], 1 + g // 3)]
    docs = documents(spark, [(3000 + i, t, "en", "s", 1) for i, t in enumerate(more)])
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    sets = [shingles_of(t) for _, t in rows]
    groups = {}
    for r, k in zip(rows, roots(sets, alike), strict=True):
        groups.setdefault(k, []).append(r)
    expected = {min((i for i, _ in g if i is not None), default=None) for g in groups.values()}
    wide = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] != sets[b] and alike(sets[a], sets[b])]
    assert len(wide) > 20
    for block in (1000, 3):
        monkeypatch.setattr(similar, "BLOCK", block)
        out = simhash.keep_one(spark, docs, "")
        assert {r[0] for r in out.select("doc_id").collect()} == expected
    assert out.columns == docs.columns and out.where("doc_id = 0").count() == 3  # equal rows stay
    assert simhash.keep_one(spark, empty(spark), "").count() == 0


def test_band_keys_miss_few_pairs_at_the_least_similarity():
    rng, found = np.random.default_rng(5), 0
    for _ in range(2000):
        h = rng.integers(0, 1 << 63, 108, np.uint64)
        a, b = similar.band_keys(np.concatenate([h[:102], h[6:]]), np.array([102, 102]))  # 96 of 108 are shared
        found += bool((a == b).any())
        c = rng.integers(0, 1 << 63, 100, np.uint64)
        a, b = similar.band_keys(np.concatenate([c[:90], c[10:]]), np.array([90, 90]))  # 80 of 100
        found += bool((a == b).any())
    assert found >= 3998


def test_similarity_is_exact_at_the_border():
    h = np.concatenate([np.arange(90), np.arange(10, 100), np.arange(11, 101), [3, 3, 3]]).astype(np.uint64)
    owner = np.repeat(np.arange(4), (90, 90, 90, 3))
    close = similar.near(h, owner, 6, 0.8)
    assert close[0, 1] and not close[0, 2] and close[4, 5] and not close[3, 4] and close.diagonal().all()


def test_null_ids_are_dropped_only_where_another_row_stands_for_them(spark):
    alone, taken, twice = ("one two three four five six seven", "a b c d e f g h", "p q r s t u v w")
    rows = [(None, alone, 1), (None, taken, 2), (7, taken, 3), (9, taken, 4), (None, twice, 5), (None, twice, 6)]
    out = simhash.keep_one(spark, spark.createDataFrame(rows, "doc_id long, text string, n int"), "").select("doc_id", "text").collect()
    assert sorted(map(tuple, out), key=repr) == sorted([(None, alone), (7, taken), (None, twice)], key=repr)

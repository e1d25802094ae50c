"""Each registered corpus query with the arguments it passes, over a whole table, against its SQL or a brute-force version."""

import math
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from keystrata.llm import langid, registry
from tests.llm.test_operators import roots, simhash_of

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.sql("select doc_id, text from documents").fetchall())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    df, found = QUERIES[name](spark, SF), duck.sql(SQL[name])
    columns = sorted(found.columns)
    assert set(columns) <= set(df.columns)
    rows = lambda got: sorted((tuple(r) for r in got), key=repr)
    assert rows(df.select(columns).collect()) == rows(found.select(*columns).fetchall())


def test_simhash_query(spark, texts):
    ids = sorted(texts)
    prints = [simhash_of(texts[i]) for i in ids]
    root = roots(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    expected = {i: (f"{p:016x}", ids[k]) for i, p, k in zip(ids, prints, root, strict=True)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op1_simhash"](spark, SF).collect()} == expected


def test_token_counts_query(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    got = QUERIES["op3_token_counts"](spark, SF).orderBy("file", "start").collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in texts.items()}
    for a, b in zip(got, got[1:], strict=False):
        assert b["start"] == (a["start"] + a["n_tokens"] + 1 if a["file"] == b["file"] else 0)


def test_sentencepiece_query(spark, texts):
    library = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = QUERIES["op4_sentencepiece"](spark, SF).collect()
    assert {r["doc_id"]: r["decoded"] for r in got} == texts and all(r["lossless"] and r["n_pieces"] == len(r["pieces"]) for r in got)
    assert all(library.decode(r["pieces"]) == r["decoded"] for r in got if r["decoded"].isascii())
    plain = sum(len(library.encode(t)) for t in texts.values())
    assert sum(r["n_pieces"] for r in got) > plain  # sampled, not the best segmentation


def test_language_id_query(spark, texts):
    """Nearest centroid of the same model, computed a text and an n-gram at a time."""
    model = langid.trained_on(spark.read.parquet(f"{SF}/documents.parquet"))
    fold = lambda c: c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32
    got = {r["doc_id"]: r for r in QUERIES["op5_language_id"](spark, SF).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        r = got[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        if not t or not any(c.isalpha() for c in t):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        b, tf = bytes(fold(c) for c in t.encode()), {}
        for size in (1, 2, 3):
            for k in range(len(b) - size + 1):
                if b[k : k + size].strip(b" "):
                    slot = ((int.from_bytes(b[k : k + size], "big") + (size << 24)) * 2654435761 % 2**32) >> 20
                    tf[slot] = tf.get(slot, 0) + 1
        weight = {s: math.log1p(n) * float(model.idf[s]) for s, n in tf.items()}
        norm = math.sqrt(sum(w * w for w in weight.values()))
        cos = [sum(w * float(c[s]) for s, w in weight.items()) / norm for c in model.centroids]
        best = max(range(len(cos)), key=lambda j: (cos[j], -j))
        near = [model.langs[j] for j in range(len(cos)) if cos[j] > cos[best] - 1e-4]
        assert r["lang_pred"] in near and abs(r["score"] - min(max(cos[best], 0), 1)) < 1e-4


def test_token_file_query(spark, texts):
    library, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in QUERIES["op8_token_files"](spark, SF).collect()}
    for i in sorted(texts):
        ids = [*library.encode(texts[i] or "", add_special_tokens=False).ids, 2]
        assert got[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == len(texts)


def test_ann_query_of_repeated_and_null_ids(spark, folder):
    """Rows that share an id are candidates each and never results of that id; without an id a row takes no part."""
    rng = np.random.default_rng(9)
    v = rng.normal(size=(400, 8)).astype(np.float32)
    ids = [None if i % 50 == 7 else i // 2 for i in range(400)]
    spark.createDataFrame([(k, x.tolist()) for k, x in zip(ids, v, strict=True)], "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    got = {}
    for r in QUERIES["op10_ann"](spark, folder).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    x = v.astype(np.float64)
    for q in {k for k in ids if k is not None and k % 20 == 0}:
        asked = min((tuple(x[i]) for i in range(400) if ids[i] == q))
        scored = sorted(((-float(np.dot(asked, x[i])), ids[i]) for i in range(400) if ids[i] is not None and ids[i] != q))[:20]
        assert [k for _, k, _ in got[q]] == [k for _, k in scored] and np.allclose([s for *_, s in got[q]], [-s for s, _ in scored])
        assert [r for r, *_ in got[q]] == list(range(1, 21))


def test_names():
    assert all(sum(bool(re.match(rf"op{n}_", q)) for q in QUERIES) == 1 for n in range(1, 11)) and set(SQL) <= set(QUERIES)

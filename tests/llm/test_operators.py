import hashlib
import math
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from keystrata.llm import ann, bpe, components, decontam, langid, sentencepieces, sharding, simhash, suffix_dedup, token_counts, token_files, warc
from tests.llm.fixtures import documents, empty

SF = "/root/testdata/sf0.001"
BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# 1


def simhash_of(text, shingle=4):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + shingle]), 42) for k in range(max(len(words) - shingle + 1, 1))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(values, near):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_simhash_components(spark):
    docs = documents(spark)
    rows = docs.select("doc_id", "text").collect()
    prints = [simhash_of(r["text"]) for r in rows]
    root = roots(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for r, k in zip(rows, root, strict=True):
        ids = [x for x in (least.get(k), r["doc_id"]) if x is not None]
        least[k] = min(ids) if ids else None
    expected = sorted(((r["doc_id"], f"{p:016x}", least[k]) for r, p, k in zip(rows, prints, root, strict=True)), key=repr)
    found = simhash.near_duplicates(docs).select("doc_id", simhash.hex16(F.col("fp")), "component_id")
    assert collected(found) == expected
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_golay_keys_lose_no_pair():
    table, rng = simhash.golay_indices(), np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 400, np.uint64) * np.uint64(2) + rng.integers(0, 2, 400, np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for place in rng.choice(64, rng.integers(0, 5), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(place)
    keys = [defaultdict(set), defaultdict(set)]
    for held, x in zip(keys, (a, b), strict=True):
        for row, key in zip(*simhash.fuzzy_keys(x, table), strict=True):
            held[row].add(key)
    assert all(keys[0][i] & keys[1][i] for i in range(len(a)))


def test_finer_keys_lose_no_pair_of_a_key():
    table, rng = simhash.golay_indices(), np.random.default_rng(8)
    a = rng.integers(0, 1 << 63, 300, np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for place in rng.choice(64, 4, replace=False) if i % 3 else rng.choice(np.arange(22, 43) if i % 2 else np.arange(43, 64), 4, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(place)
    held = []
    for x in (a, b):
        row, key = simhash.fuzzy_keys(x, table)
        fine, finer = simhash.finer_keys(key, x[row], table)
        under = defaultdict(lambda: defaultdict(set))
        for r, k in zip(row[fine].tolist(), zip(key[fine].tolist(), finer.tolist(), strict=True), strict=True):
            under[r][k[0]].add(k[1])
        held.append(under)
    for i in range(len(a)):
        common = held[0][i].keys() & held[1][i].keys()
        assert common and all(held[0][i][k] & held[1][i][k] for k in common)


def test_large_groups_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 20)
    values = [1 << i | 1 << j for i in range(20) for j in range(i)] + [(1 << 63) - 1]
    distinct = spark.createDataFrame([(v,) for v in values], "fp long")
    found = components.components(simhash.links(distinct)).where("root = 3").count()
    assert found == len(values) - 1


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    got = dict(collected(components.components(spark.createDataFrame(edges, "u long, v long"))))
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# 2


def cut_of(rows, span=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - span + 1):
            x, key = b[k : k + span], math.inf if i is None else i
            first[x] = min(first.get(x, key), key)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - span + 1):
            if first[b[k : k + span]] < (math.inf if i is None else i):
                gone[k : k + span] = b"\1" * span
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bucket", [suffix_dedup.BUCKET_BYTES, 20_000])
def test_suffix_dedup(spark, monkeypatch, bucket):
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", bucket)
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", bucket)
    docs = documents(spark)
    assert collected(suffix_dedup.shared_spans(docs)) == cut_of([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert suffix_dedup.shared_spans(empty(spark)).count() == 0


def test_rows_that_share_a_key_are_told_apart(spark):
    """Null ids never count as earlier than others, and rows of one key never for each other, whatever their texts."""
    rng = np.random.default_rng(4)
    base = "".join(rng.choice(list("abcdefgh "), 200))
    rows = [(None, base), (None, base[:9]), (None, base[20:120] + "x"), (1, base[50:150]), (1, "y" + base[60:140]), (2, base[55:130]), (2, base), (None, None)]
    rows += [(None, "".join(rng.choice(list("ab"), 60))) for _ in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert collected(suffix_dedup.shared_spans(docs)) == cut_of(rows)


def test_common_seeds_are_ranked_without_pairing(spark, monkeypatch):
    """A passage shorter than a span in very many contexts: what repeats around it is found all the same."""
    monkeypatch.setattr(suffix_dedup, "COMMON", 3)
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    hot, sides = word(40), [word(30) for _ in range(6)]
    rows = [(i, f"{word(25)}{sides[i % 6]}{hot}{sides[(i * 5 + 1) % 6]}{word(25)}") for i in range(60)]
    assert collected(suffix_dedup.shared_spans(spark.createDataFrame(rows, "doc_id long, text string"))) == cut_of(rows)


def test_prefix_doubling_gives_the_same_rows(spark):
    docs = documents(spark).where("length(text) < 400 or text is null").select("doc_id", "text")
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans")
    doubled = collected(suffix_dedup.doubled_spans(docs).select(*columns))
    assert doubled == [r[:4] for r in cut_of([tuple(r) for r in docs.collect()])] and any(r[2] for r in doubled)
    assert doubled == collected(suffix_dedup.shared_spans(docs).select(*columns))
    assert suffix_dedup.doubled_spans(empty(spark)).count() == 0


def test_suffix_dedup_of_texts_cut_inside_characters(spark):
    tail = "é" * 40
    docs = spark.createDataFrame([(1, "xyz" + tail), (2, "qé" + tail + "w"), (3, tail)], "doc_id long, text string")
    assert collected(suffix_dedup.shared_spans(docs)) == cut_of([tuple(r) for r in docs.collect()])
    kept = dict(suffix_dedup.drop_shared(spark, docs, SF).collect())
    assert set(kept) == {1, 2} and kept[1] == "xyz" + tail and kept[2] == "qw"


# 3, 8


SPECIAL = ["<|endoftext|>", "<|endoftext|>a", "a <|endoftext|> b", "x<|endoftext|>y", "<|endoftext|><|endoftext|>", " <|endoftext|>", "<|endo", "ftext|>", "é<|endoftext|> é", "ends with <|endoftext|>"]


@pytest.mark.parametrize("special", [True, False])
def test_encoder_equals_the_library(spark, special):
    """By default the strings of special tokens become their ids; two halves in neighbouring texts do not."""
    library = Tokenizer.from_file(BPE)
    library.encode_special_tokens = not special
    rows = [r["text"] or "" for r in documents(spark).select("text").collect()] + ["  a  b　 c \x85 d", "x  y", " ", "\n\n", "ends with <|endoftext|> in it", "don't  'll \t're", *SPECIAL]
    raw = np.frombuffer("".join(rows).encode(), np.uint8)
    at = np.concatenate(([0], np.cumsum([len(t.encode()) for t in rows])))
    ids, n = bpe.Encoder(BPE, special).encode(raw, at)
    expected = [library.encode(t, add_special_tokens=False).ids for t in rows]
    assert n.tolist() == [len(e) for e in expected] and ids.tolist() == [i for e in expected for i in e]
    assert bool((ids == 50256).any()) == special


@pytest.mark.parametrize("block", [7, 64, 2048])
def test_range_coder_round_trip(block):
    rng = np.random.default_rng(block)
    for ids in (np.zeros(0, np.uint32), np.array([5]), np.full(1000, 7), rng.integers(0, 50257, 3000), rng.zipf(1.3, 3000) % 60000, np.array([0, 2**32 - 1, 65536, 65535, 2] * 50), np.tile([1, 2, 3], 400)):
        ids = ids.astype(np.uint32)
        assert (token_files.decode_blocks(token_files.encode_blocks(ids, block), len(ids), block) == ids).all()


def test_range_coder_compresses_and_blocks_are_checked():
    ids = np.tile(np.arange(100, dtype=np.uint32), 100)
    segment = token_files.pack_segment(np.array([1]), np.array([True]), np.array([len(ids)]), ids)
    assert len(segment) < len(ids)
    broken = bytearray(segment)
    broken[-9] ^= 255
    with pytest.raises(ValueError, match="checksum"):
        token_files.unpack_segment(memoryview(bytes(broken)), 0)


def with_special(spark):
    """The fixtures with a key of their own each, and texts that hold a special token's string."""
    docs = documents(spark).where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text")
    return docs.union(spark.createDataFrame([(9000 + i, t) for i, t in enumerate(SPECIAL)], "doc_id long, text string"))


def test_token_files(spark, folder):
    docs, library = with_special(spark), Tokenizer.from_file(BPE)
    start, expected = 0, []
    for i, t in sorted((r["doc_id"], r["text"] or "") for r in docs.collect()):
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    token_files.write_tokens(docs, f"{folder}/files", BPE, 2)
    read = token_files.read_tokens(spark, f"{folder}/files")
    assert sorted(tuple(r) for r in read.select("key", "start", "n_tokens", "ids_crc32").collect()) == expected


def test_flat_files_hold_the_ids_that_are_counted(spark, tmp_path):
    docs, library = with_special(spark).union(documents(spark).select("doc_id", "text")).repartition(3), Tokenizer.from_file(BPE)
    library.encode_special_tokens = True  # in a flat file the end id ends documents and nothing else
    token_counts.write_flat_tokens(docs, f"file://{tmp_path}/flat", BPE, 50256)
    files = {int(re.match(r"part-(\d+)", p.name)[1]): np.frombuffer(p.read_bytes(), "<u2") for p in (tmp_path / "flat" / "kind=ids").glob("part-*")}
    found = token_counts.scan_separators(spark, f"file://{tmp_path}/flat/{token_counts.IDS}", 50256)
    named = found.withColumn("file", token_counts._number(F.col("path"))).join(token_counts.read_names(spark, f"file://{tmp_path}/flat"), ["file", "place"]).collect()
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r["doc_id"]].append(library.encode(r["text"] or "", add_special_tokens=False).ids)
    got = defaultdict(list)
    for r in named:
        ids = files[r["file"]][r["at"] : r["at"] + r["n_tokens"] + 1].tolist()
        assert ids[-1] == 50256 and r["closed"]
        got[r["key"]].append(ids[:-1])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in texts.items()} and len(got[None]) > 1
    assert sorted(r["ordinal"] for r in named) == list(range(docs.count())) and sum(r["n_tokens"] + 1 for r in named) == sum(map(len, files.values()))


def test_flat_files_of_nothing_and_of_the_end_id(spark, folder):
    token_counts.write_flat_tokens(empty(spark), f"{folder}/none", BPE, 50256)
    assert token_counts.scan_separators(spark, f"{folder}/none/{token_counts.IDS}", 50256).count() == 0 and token_counts.read_names(spark, f"{folder}/none").count() == 0
    with pytest.raises(Exception, match="holds the end id"):
        token_counts.write_flat_tokens(spark.createDataFrame([(1, "!")], "doc_id long, text string"), f"{folder}/bad", BPE, 0)


@pytest.mark.parametrize(("width", "block", "end"), [(2, 5, 9), (2, 13, 0x0A0A), (2, 40, 0xBBEF), (4, 5, 9), (4, 13, 0x0A0A0A0A), (4, 40, 0x00BFBBEF), (2, 1 << 20, 256)])
def test_separators_wherever_files_are_cut(spark, tmp_path, monkeypatch, width, block, end):
    """Ids lie across blocks, line feeds and byte order marks are ids like any other, numbers in names count as numbers."""
    rng, expected, base, ordinal = np.random.default_rng(block), [], 0, 0
    (tmp_path / "flat").mkdir()
    for k, name in enumerate(("part-2", "part-10", "part-99999", "part-100000", "x0", "x1")):
        ids = rng.choice([9, 10, 0x0A0A, 0x0A01, 0x0100, 0x0900, 50256, 0xBBEF, 256, end], [50, 0, 17, 1, 20, 25][k]).astype(f"<u{width}")
        raw = ids.tobytes()
        if k in (2, 4):
            raw = token_counts.BYTE_ORDER_MARK + raw[3:]
            ids = np.frombuffer(raw, f"<u{width}")
        (tmp_path / "flat" / f"{name}.bin").write_bytes(raw)
        prior = -1
        for place, x in enumerate([*np.flatnonzero(ids == end).tolist(), len(ids)]):
            if x < len(ids) or prior + 1 < len(ids):
                expected.append((name, ordinal, place, base + prior + 1, prior + 1, x - prior - 1, x < len(ids)))
                ordinal, prior = ordinal + 1, x
        base += len(ids)

    def stored(df, what, real=token_counts.stored):
        out = real(df, what)
        for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
            spark.conf.unset(c)
        return out

    monkeypatch.setattr(token_counts, "stored", stored)
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    found = token_counts.scan_separators(spark, f"file://{tmp_path}/flat", end, width).orderBy("ordinal").collect()
    assert [(r["path"].rpartition("/")[2][:-4], *r[1:]) for r in found] == expected


def test_a_flat_file_cut_short_is_named(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"\1\0\2")
    with pytest.raises(Exception, match="does not divide"):
        token_counts.scan_separators(spark, f"file://{tmp_path}", 2).collect()


def test_files_count_by_number_beyond_five_digits(spark):
    names = [f"/a/part-{n:05d}-c1f0.c000.txt" for n in (0, 7, 99_999, 100_000, 100_001)]
    rows = spark.createDataFrame([(n,) for n in reversed(names)], "p string").orderBy(token_counts.in_natural_order(F.col("p"))).collect()
    assert [r["p"] for r in rows] == names and rows[-1]["p"] < rows[-3]["p"]


def test_token_files_of_nulls_repeats_and_nothing(spark, folder):
    docs = documents(spark)
    token_files.write_tokens(docs, f"{folder}/a", BPE, 2)
    got = token_files.read_tokens(spark, f"{folder}/a", ids=True).orderBy("start").collect()
    assert len(got) == docs.count() and [r["key"] is None for r in got[:3]] == [True, True, False]
    assert all(r["start"] == sum(x["n_tokens"] for x in got[:i]) for i, r in enumerate(got))
    token_files.write_tokens(empty(spark), f"{folder}/b", BPE, 2)
    assert token_files.read_tokens(spark, f"{folder}/b").count() == 0


def test_open_document_at_a_files_end(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(np.array([4, 5, 9, 9, 6], "<u4").tobytes())
    got = token_counts.scan_separators(spark, f"file://{tmp_path}", 9, 4).orderBy("ordinal").select("ordinal", "start", "n_tokens", "closed").collect()
    assert [tuple(r) for r in got] == [(0, 0, 2, True), (1, 3, 0, True), (2, 4, 1, False)]


# 4


def test_sentencepieces_are_lossless_reproducible_and_spread(spark):
    docs, library = documents(spark), SentencePieceProcessor(model_file=PIECES)
    coded = docs.select("doc_id", "text", sentencepieces.encode(F.col("doc_id"), F.col("text"), PIECES).alias("p"))
    rows = coded.withColumn("back", sentencepieces.decode(F.col("p"), PIECES)).collect()
    assert all(r["back"] == (r["text"] or "") for r in rows)
    assert all(library.decode(r["p"]) == r["text"] for r in rows if r["text"] and r["text"].isascii() and "\0" not in r["text"])
    again = collected(docs.repartition(7).select("doc_id", "text", sentencepieces.encode(F.col("doc_id"), F.col("text"), PIECES)))
    assert again == sorted(((r["doc_id"], r["text"], r["p"]) for r in rows), key=repr)
    assert collected(docs.select("doc_id", "text", sentencepieces.encode(F.col("doc_id"), F.col("text"), PIECES, seed=1))) != again
    digests = docs.select("doc_id", sentencepieces.digests(F.col("doc_id"), F.col("text"), PIECES).alias("d")).select("doc_id", "d.*").collect()
    assert all(r["lossless"] for r in digests)
    assert sorted((r["doc_id"] or -1, r["n_pieces"]) for r in digests) == sorted((r["doc_id"] or -1, len(r["p"])) for r in rows)


def test_samples_follow_the_lattice():
    model = sentencepieces.Lattices(PIECES)
    library, text = SentencePieceProcessor(model_file=PIECES), " there"
    pieces = {library.id_to_piece(i).replace("▁", " "): i for i in range(259, library.get_piece_size())}

    def segmentations(s):
        if not s:
            return [((), 1.0)]
        found = []
        for k in range(1, len(s) + 1):
            if s[:k] in pieces:
                i = pieces[s[:k]]
                found += [((i, *rest), model.weight[i] * x) for rest, x in segmentations(s[k:])]
        return found

    chances = dict(segmentations(text))
    total, n = sum(chances.values()), 20_000
    raw = np.frombuffer(text[1:].encode() * n, np.uint8)
    ids, counts = model.sample(raw, np.arange(n + 1) * (len(text) - 1), np.arange(n, dtype=np.uint64))
    seen, stop = defaultdict(int), np.cumsum(counts)
    for b, k in zip(stop, counts, strict=True):
        seen[tuple(ids[b - k : b].tolist())] += 1
    assert set(seen) <= set(chances)
    for pieces, w in chances.items():
        p = w / total
        assert abs(seen[pieces] - n * p) < 5 * math.sqrt(n * p * (1 - p)) + 2


def test_draws_do_not_depend_on_the_rest_of_a_batch(spark):
    model = sentencepieces.Lattices(PIECES)
    texts = [r["text"] or "" for r in documents(spark).select("text").collect()] + ["的一是不了人我在有他" * 40, "thereforewehave" * 30, "a" * 500, "漢字 and 漢字" * 20]
    raw = [t.encode() for t in texts]
    keys = np.arange(len(raw), dtype=np.uint64)
    draw = lambda a, b: model.sample(np.frombuffer(b"".join(raw[a:b]), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw[a:b]]))).astype(np.int64), keys[a:b])
    whole, n = draw(0, len(raw))
    for step in (1, 7):
        parts = [draw(a, min(a + step, len(raw))) for a in range(0, len(raw), step)]
        assert (np.concatenate([p[0] for p in parts]) == whole).all() and (np.concatenate([p[1] for p in parts]) == n).all()


def test_a_long_text_without_spaces_takes_bounded_time():
    model, rng = sentencepieces.Lattices(PIECES), np.random.default_rng(3)
    raw = np.frombuffer("".join(rng.choice(list("的一是不了人我在有他这中大来上国个到说们为子和你地出道也时年"), 1_700_000)).encode(), np.uint8)
    began = time.process_time()
    ids, n = model.sample(raw, np.array([0, len(raw)]), np.array([1], np.uint64))
    assert time.process_time() - began < 30 and (model.decode(ids, n)[0] == raw).all()


def test_parted_chunks_keep_the_lattices_chances():
    """Parts of a long chunk are drawn as the whole would be: the pieces of one character recur as often."""
    model = sentencepieces.Lattices(PIECES)
    text = (" there" * 3).replace(" ", "的").encode()  # 的 is in no longer piece, so it parts the chunk
    counts = {}
    for long in (1, 1 << 30):
        sentencepieces.LONG = long
        ids, n = model.sample(np.frombuffer(text * 4000, np.uint8), np.arange(4001) * len(text), np.arange(4000, dtype=np.uint64))
        counts[long] = np.bincount(ids, minlength=32_000)
    sentencepieces.LONG = 64
    a, b = counts.values()
    assert (np.abs(a - b) <= 5 * np.sqrt(a + b) + 2).all()


# 5


def test_language_id(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.trained_on(docs)
    found = docs.select("doc_id", "lang", langid.held_out(F.col("doc_id")).alias("h"), langid.identify(F.col("text"), model).alias("p")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found)
    held = [r for r in found if r["h"]]
    assert sum(r["p"]["lang"] == r["lang"] for r in held) >= 0.97 * len(held)
    assert len(set(model.langs)) == 4 and len(model.langs) > 4
    assert all(0 <= r["p"]["score"] <= 1 for r in found)
    edge = documents(spark).withColumn("p", langid.identify(F.col("text"), model)).select("text", "p.*").collect()
    for r in edge:
        if r["text"] is None or not any(c.isalpha() for c in r["text"]):
            assert (r["lang"], r["score"], r["rejected"]) == ("und", 0.0, True)
        else:
            assert r["lang"] in model.langs
    strange = spark.createDataFrame([("Ελληνικά γράμματα και λέξεις εδώ",), ("漢字漢字漢字",)], "t string").select(langid.identify(F.col("t"), model)["rejected"]).collect()
    assert all(r[0] for r in strange)
    nothing = langid.trained_on(empty(spark))
    assert {r[0] for r in documents(spark).select(langid.identify(F.col("text"), nothing)["lang"]).collect()} == {"und"}


# 6


def pages(spark):
    big, bigger = "<p>é</p>" * 150, "<b>x</b>" * 200
    rows = [(1, "http://www.A.com/x#f", big), (2, "https://b.org:443/y?q=1", big), (9, "http://a.com/x", big), (3, None, bigger), (4, "u", bigger), (5, "http://c.com", None), (6, "http://c.com/", ""), (7, "http://short", "s"), (8, "http://short", "s")]
    rows += [(None, "http://null", big), (12, "http://rn\r\nX: y", "\r\n\r\nWARC/1.1\r\n\r\n"), (9, "http://a.com/x", big)]
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, captured string")


def test_warc_round_trip(spark, folder):
    rows = pages(spark)
    expected, best = [], {}
    for i, _, h, _ in rows.collect():
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    for i, _, h, _ in rows.collect():
        b = (h or "").encode()
        again = len(b) >= 1000 and i != best[h or ""]
        expected.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", best[h or ""] if again else None))
    got = warc.archive(rows, f"{folder}/w")
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert collected(got.select(*columns)) == sorted(expected, key=repr)
    order = [tuple(r) for r in got.orderBy("index_pos").select(F.col("url_key"), "captured", F.coalesce("page_id", F.lit(-(1 << 63)))).collect()]
    assert order == sorted(order) and [r[0] for r in got.orderBy("index_pos").select("index_pos").collect()] == list(range(len(order)))
    assert warc.archive(rows.where("false"), f"{folder}/e").count() == 0


def test_index_merge_over_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_ENTRIES", 40)
    rows = [(i, "http://hot.com/" if i % 3 else f"http://h{i % 7}.com/{i}", f"2024-01-01T00:00:{i % 60:02d}Z", 1, "d", "response", None) for i in range(400)]
    got = warc.merge_index(spark.createDataFrame(rows, warc.ENTRY).repartition(5)).orderBy("index_pos").select("url_key", "captured", "page_id", "index_pos").collect()
    assert [r[3] for r in got] == list(range(400)) and [tuple(r)[:3] for r in got] == sorted(tuple(r)[:3] for r in got)


@pytest.mark.parametrize("n", range(1, 12))
def test_loser_tree(n):
    rng = np.random.default_rng(n)
    runs = [sorted(rng.integers(0, 30, rng.integers(0, 9)).tolist()) for _ in range(n)]
    assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_damaged_warc_is_named():
    with pytest.raises(ValueError, match="cut short"):
        list(warc.parse_warc(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"))


# 7


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_sharding(spark):
    docs = documents(spark)
    got = sharding.place(docs.select("doc_id", "block"), "doc_id", 8).collect()
    assert len(got) == docs.count()
    slots = defaultdict(list)
    for r in got:
        assert (r["shard"], r["grown_shard"]) == (jump(r["doc_id"] or 0, 8), jump(r["doc_id"] or 0, 9))
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.place(empty(spark).select("doc_id"), "doc_id", 8).count() == 0
    named = sharding.place(docs.select("key", "doc_id"), "key", 4).select("shard").distinct().count()
    assert named == 1


# 9


def leaks_of(docs, items, window=10):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    phrases = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(len(w) - window, 0) + 1 if w else 0):
            phrases[tuple(w[k : k + window])].add(i)
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(p) for p in phrases}:
            for k in range(len(w) - n + 1):
                if (p := tuple(w[k : k + n])) in phrases:
                    hit.update(range(k, k + n))
                    found |= phrases[p]
        names = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [decontam.PASS_BYTES, 100])
def test_decontamination(spark, monkeypatch, most):
    monkeypatch.setattr(decontam, "PASS_BYTES", most)
    docs = documents(spark)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [(1, " ".join(texts[4].split()[3:20])), (2, "ONE"), (3, None), (4, " .,; "), (5, texts[8]), (10, texts[8]), (None, texts[11]), (7, "never in any document at all " * 3), (11, "a" * 300)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert collected(decontam.contamination(docs, bench).drop("items")) == leaks_of([(r["doc_id"], r["text"]) for r in docs.collect()], items)
    assert decontam.contamination(empty(spark), bench).count() == 0
    assert decontam.contamination(docs, bench.where("false")).where("contaminated").count() == 0


def test_proximity(spark, folder):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "gamma x beta y alpha"), (3, "alpha beta z z z z z gamma"), (4, "alpha beta"), (5, "beta gamma alpha beta")], "doc_id long, text string")
    index = decontam.build_index(docs, f"{folder}/i")
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")

    def hits(slop):
        return {r["key"]: [(s["start"], s["end"]) for s in r["spans"]] for r in decontam.search(index, items, slop).collect() if r["spans"]}

    assert hits(None) == {1: [(0, 3)]}
    assert hits(0) == {1: [(0, 3)], 5: [(0, 3), (1, 4)]}
    assert set(hits(2)) == {1, 2, 5} and set(hits(5)) == {1, 2, 3, 5}


# 10


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 16))
    v = np.concatenate([centres[rng.integers(0, 6, 900)] + 0.05 * rng.normal(size=(900, 16)), rng.normal(size=(300, 16))])
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)]
    bad = [(2000, None, 0), (2020, [0.0] * 16, 0), (2040, [math.nan] * 16, 0), (2060, [None] * 16, 0), (2080, [math.inf] * 16, 0), (2100, [1.0], 0), (2120, [], 0), (2140, v[3].tolist(), 1)]
    frame = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, part int")
    kept = ann.usable(frame, "vec_id", "embedding")
    assert {r["key"] for r in kept.collect()} == {*range(1200), 2140}
    index, quantiser = ann.build(kept, block=256)
    ids, every = np.append(np.arange(1200), 2140), np.append(v, v[3:4], axis=0)
    for measure in ("ip", "cosine"):
        got = defaultdict(list)
        for r in ann.search(index, quantiser, kept.where("key % 20 = 0"), 20, rerank=64, measure=measure).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append((r["vec_id"], r["score"]))
        found = total = 0
        for q in ids[ids % 20 == 0]:
            x = every[ids == q][0]
            s = every @ x / (1 if measure == "ip" else np.linalg.norm(every, axis=1) * np.linalg.norm(x))
            s[ids == q] = -np.inf
            best = ids[np.lexsort((ids, -s))[:20]]
            assert len(got[q]) == 20 and q not in [i for i, _ in got[q]]
            assert np.allclose([y for _, y in got[q]], [s[ids == i][0] for i, _ in got[q]])
            assert [y for _, y in got[q]] == sorted((y for _, y in got[q]), reverse=True)
            found, total = found + len(set(best) & {i for i, _ in got[q]}), total + 20
        assert found >= 0.95 * total
    none = ann.usable(frame.where("false"), "vec_id", "embedding")
    assert ann.search(*ann.build(none), none, 20).count() == 0


def test_encoding_gets_closer_with_each_codebook():
    x = np.random.default_rng(2).normal(size=(2000, 8)).astype(np.float32)
    errors = []
    for books in (1, 3, 6):
        q = ann.train(x, books, 32)
        codes, norms = q.encode(x)
        back = sum(q.books[m][codes[:, m]] for m in range(books))
        assert np.allclose((back**2).sum(axis=1), norms, atol=1e-3)
        errors.append(((x - back) ** 2).sum(axis=1).mean())
    assert errors[0] > 2 * errors[1] > 4 * errors[2]

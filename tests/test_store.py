import random

import pytest
from pyspark.sql import functions as F

from keystrata.functions.columns import fnv1a, key_text, mix32, render
from keystrata.functions.values import BOOL, FLOAT, INT
from keystrata.kv import Command, InvalidArgument, KVStore, kv_command, parse_command
from keystrata.operators import indexes, log, merge
from keystrata.operators.merge import DELETE, PUT
from keystrata.sources import wal
from keystrata.sources.files import Files
from keystrata.streaming.ingest import ingest


def versions(spark, rows):
    return spark.createDataFrame(rows, "k string, seq long, op string, v string")


SCENARIO = [
    ("app:config", 1, PUT, "v1"), ("app:config", 5, PUT, "v2"), ("app:config", 9, PUT, "v3_dark_mode"), ("user:bob", 2, PUT, "b"), ("user:bob", 6, PUT, "b2"), ("user:bob", 10, DELETE, None), ("user:dave", 3, DELETE, None), ("user:dave", 7, PUT, "d"),
    ("user:alice", 4, PUT, "a"), ("user:alice", 8, PUT, "a2"), ("user:alice", 11, PUT, "a3"), ("app:theme", 12, PUT, "t"), ("user:eve", 13, PUT, "e"), ("user:frank", 14, PUT, "f"), ("user:charlie", 15, PUT, "c"),
]


def test_merge_and_report(spark):
    rows = versions(spark, SCENARIO)
    live = {r["k"]: r["v"] for r in merge.merged(rows).collect()}
    assert live == {"app:config": "v3_dark_mode", "user:dave": "d", "user:alice": "a3", "app:theme": "t", "user:eve": "e", "user:frank": "f", "user:charlie": "c"}
    assert tuple(merge.compaction_report(rows).first()) == (8, 5, 3)
    assert {r["k"]: r["action"] for r in merge.key_actions(rows).collect()}["user:bob"] == "tombstone_purge"
    assert tuple(merge.compaction_report(versions(spark, [])).first()) == (0, 0, 0) and merge.byte_size(versions(spark, [])).first()[0] == 0
    base, delta = versions(spark, SCENARIO[:1]).select("k", "v"), versions(spark, SCENARIO[1:])
    assert {r["k"]: r["v"] for r in merge.merge_on_read(base, delta).collect()} == live


def test_merge_equals_a_dictionary(spark):
    rng = random.Random(2)
    rows = [(f"k{rng.randrange(40)}", i, rng.choice([PUT, PUT, DELETE]), str(i)) for i in range(800)]
    held = {}
    for k, _, op, v in rows:
        held[k] = v if op == PUT else None
    rng.shuffle(rows)
    assert {r["k"]: r["v"] for r in merge.merged(versions(spark, rows)).collect()} == {k: v for k, v in held.items() if v is not None}


def test_kv(spark, folder):
    kv = KVStore(spark, f"{folder}/kv")
    for v in ("v1", "v2", "v3"):
        kv.put("key", v)
    assert kv.get("key") == "v3"
    kv.remove("key")
    kv.remove("absent")
    assert kv.get("key") is None
    for op in (kv.get, kv.remove, lambda k: kv.put(k, "x")):
        with pytest.raises(InvalidArgument):
            op("")
    kv.put("e", "")
    assert kv.get("e") == ""
    for k in ("b", "d", "c", "a", "c1"):
        kv.put(k, k.upper())
    assert [tuple(r) for r in kv.scan("b", "d").collect()] == [("b", "B"), ("c", "C"), ("c1", "C1"), ("d", "D")]
    kv.put("c", "C_new")
    kv.remove("c1")
    kv.flush()
    assert [tuple(r) for r in kv.scan("b", "d").collect()] == [("b", "B"), ("c", "C_new"), ("d", "D")] and kv.scan("d", "b").count() == 0


def test_kv_reopens_across_flushes(spark, folder):
    kv = KVStore(spark, f"{folder}/kv", flush_bytes=256)
    for i in range(30):
        kv.put(f"dk_{i}", "x" * 12)
    for i in range(15):
        kv.remove(f"dk_{i}")
    assert kv.segment_count() >= 1
    again = KVStore(spark, f"{folder}/kv")
    assert {r["k"] for r in again.frame().collect()} == {f"dk_{i}" for i in range(15, 30)}
    assert again.get("dk_3") is None and again.get("dk_20") == "x" * 12
    before = {tuple(r) for r in again.frame().collect()}
    again.compact()
    assert again.segment_count() == 1 and {tuple(r) for r in again.frame().collect()} == before
    assert again.stats().collect()[0]["entry_count"] == 15 and again.store.vacuum()


def test_kv_compacts_by_itself(spark, folder):
    kv = KVStore(spark, f"{folder}/kv", flush_bytes=64)
    for i in range(24):
        kv.put(f"ek_{i}", "y" * 8)
    assert kv.segment_count() < 4 and kv.frame().count() == 24
    assert tuple(kv.report().first()) == (24, 0, 0)
    kv.put_all(spark.createDataFrame([(f"b{i}", str(i)) for i in range(50)], "k string, v string"))
    assert kv.get("b7") == "7"


def test_all_deleted(spark, folder):
    kv = KVStore(spark, f"{folder}/kv")
    kv.put("a", "1")
    kv.remove("a")
    kv.compact()
    assert kv.frame().count() == 0 and kv.segment_count() == 0


def test_damaged_files_are_put_aside(spark, folder, tmp_path):
    kv = KVStore(spark, f"{folder}/kv")
    kv.put("a", "1")
    kv.flush()
    kv.put("b", "2")
    kv.put("c", "3")
    logs = sorted((tmp_path / "kv" / "wal").glob("*.log"))
    logs[1].write_bytes(logs[1].read_bytes()[:-1])
    for crc in (tmp_path / "kv" / "wal").glob(".*.crc"):
        crc.unlink()
    again = KVStore(spark, f"{folder}/kv")
    assert (again.get("a"), again.get("b"), again.get("c")) == ("1", "2", None) and again.store.quarantined
    again.put("d", "4")
    assert KVStore(spark, f"{folder}/kv").get("d") == "4"
    part = next((tmp_path / "kv").glob("seg-*/*.parquet"))
    part.write_bytes(b"nonsense")
    for crc in part.parent.glob(".*.crc"):
        crc.unlink()
    last = KVStore(spark, f"{folder}/kv")
    assert last.store.quarantined == ["seg-00000001"] and last.get("a") is None and last.get("b") == "2"


def test_text_commands(spark, folder):
    assert parse_command("put k  two words") == Command("PUT", "k", " two words") and parse_command("Get k") == Command("GET", "k")
    assert parse_command("SCAN a b") == Command("SCAN", "a", last="b") and parse_command("  ") == Command("UNKNOWN") and parse_command("PUT k") == Command("PUT", "k")
    kv = KVStore(spark, f"{folder}/kv")
    kv_command(kv, "PUT k hello there")
    assert kv_command(kv, "GET k") == "hello there" and kv_command(kv, "SCAN a z") == [("k", "hello there")]
    kv_command(kv, "DELETE k")
    assert kv_command(kv, "GET k") is None
    with pytest.raises(InvalidArgument):
        kv_command(kv, "FLY")


def test_log_codec():
    records = [(PUT, b"key1", b"v" * 100_000), (PUT, b"key2", b""), (DELETE, b"k" * 1000, b"")]
    data = b"".join(wal.encode(*r) for r in records)
    assert list(wal.decode(data)) == records
    assert list(wal.decode(data + b"\xde\xad" * 7)) == records and list(wal.decode(data[:-1])) == records[:2]
    flipped = bytearray(data)
    flipped[20] ^= 0xFF
    assert list(wal.decode(bytes(flipped))) == []
    assert wal.hex_dump(b"AB\x00").startswith("00000000  41 42 00")


def test_log_replay(spark):
    rows = versions(spark, SCENARIO).withColumn("crc", log.checksum(F.col("op"), F.col("k"), F.col("v")))
    for r in rows.collect():
        assert r["crc"] == int.from_bytes(wal.encode(r["op"], r["k"].encode(), (r["v"] or "").encode())[:4], "little")
    broken = rows.withColumn("crc", F.when(F.col("seq") == 9, F.col("crc") + 1).otherwise(F.col("crc")))
    assert log.valid_prefix(rows).count() == 15 and log.valid_prefix(broken).count() == 8
    assert {r["k"]: r["v"] for r in log.replay(broken).collect()}["user:bob"] == "b2"


def test_hashes_and_text(spark):
    keys = ["", "a", "hello", "é", "中文", "x" * 50]
    df = spark.createDataFrame([(k,) for k in keys] + [(None,)], "k string").select("k", fnv1a(F.col("k")).alias("a"), mix32(F.col("k")).alias("b"))
    for r in df.collect():
        assert (r["a"], r["b"]) == ((None, None) if r["k"] is None else indexes.hashes_of(r["k"].encode()))
    assert indexes.hashes_of(b"hello")[0] == 0x4F9F2CAB
    row = spark.createDataFrame([(-5, 2.5, True)], "i long, f double, b boolean").select(key_text(INT, F.col("i")), key_text(FLOAT, F.col("f")), render(BOOL, F.col("b")), render(FLOAT, F.lit(None).cast("double")))
    assert tuple(row.first()) == ("-000000005", "2.50", "TRUE", "NULL")


def test_bloom(spark):
    rows = spark.createDataFrame([(f"key_{i}",) for i in range(300)], "k string")
    made = indexes.BloomFilter.build(rows)
    assert rows.count() == made.probe(rows).where("maybe").count() and all(made.contains(f"key_{i}") for i in range(300))
    misses = spark.createDataFrame([(f"miss_{i}",) for i in range(2000)] + [(None,)], "k string")
    wrong = made.probe(misses).where("maybe").collect()
    assert len(wrong) < 60 and {r["k"] for r in wrong} == {f"miss_{i}" for i in range(2000) if made.contains(f"miss_{i}")}
    assert indexes.BloomFilter(3).bits == 64


def test_sparse_index_and_stats(spark):
    rows = spark.createDataFrame([(f"key_{i:06d}", i % 3) for i in range(1000)], "k string, s int")
    got = sorted(tuple(r) for r in indexes.sparse_index(rows).collect())
    assert got == [(f"key_{i:06d}", i) for i in range(0, 1000, 16)] and indexes.sparse_index(rows.where("false")).count() == 0
    assert tuple(indexes.segment_stats(rows.where("s = 1"), "s").first()) == (1, "key_000001", "key_000997", 333)


def test_stream_of_mutations(spark, folder):
    for part in (SCENARIO[:6], SCENARIO[6:]):
        versions(spark, part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    kv = KVStore(spark, f"{folder}/kv")
    stream = spark.readStream.schema("k string, seq long, op string, v string").parquet(f"{folder}/in")
    ingest(stream, kv, f"{folder}/ck").awaitTermination()
    assert kv.frame().count() == 7 and kv.get("user:bob") is None


def test_files(spark, folder):
    files = Files(spark, folder)
    files.write("a/x", b"1")
    files.write("a/x", b"\x00\xff2")
    assert files.read("a/x") == b"\x00\xff2" and files.list("a") == ["x"] and files.list("none") == []

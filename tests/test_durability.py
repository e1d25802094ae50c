import json
import random
import socket
import struct
import urllib.error
import urllib.request
from threading import Thread

import pytest

from keystrata.functions.columns import key_text, render
from keystrata.functions.values import BOOL, FLOAT, INT, TEXT, Value
from keystrata.functions import values
from keystrata.kv import KVStore
from keystrata.operators import indexes
from keystrata.operators.merge import latest
from keystrata.protocol import Client, Server, http_server, request
from keystrata.session import Session
from keystrata.sources import codec
from keystrata.sources.files import Files
from keystrata.streaming.ingest import ingest
from pyspark.sql import functions as F


class Crash(Exception):
    pass


@pytest.mark.parametrize("step", ["_rename", "delete", "write", "publish"])
@pytest.mark.parametrize("at", range(3))
def test_every_crash_point_keeps_what_was_acknowledged(spark, folder, monkeypatch, step, at):
    """The at-th call of a file operation fails, before or after its effect; whatever was acknowledged before is there afterwards."""
    kv, acknowledged, calls, real, armed = KVStore(spark, f"{folder}/kv", flush_bytes=60), {}, [0], getattr(Files, step), False

    def failing(self, *args):
        calls[0] += 1
        if armed and calls[0] > at:
            if calls[0] % 2:
                real(self, *args)
            raise Crash(step)
        return real(self, *args)

    monkeypatch.setattr(Files, step, failing)
    kv.put("a", "1")
    kv.remove("a")
    for i in range(4):
        kv.put(f"k{i}", "x" * 20)
        acknowledged[f"k{i}"] = "x" * 20
    calls[0], armed = 0, True
    tried = {}
    for act, change in ((lambda: kv.put("k1", "new"), {"k1": "new"}), (kv.flush, {}), (kv.compact, {}), (lambda: kv.put("k9", "y" * 80), {"k9": "y" * 80})):
        try:
            act()
        except Crash:
            tried = change  # may or may not be there
            break
        acknowledged.update(change)
    armed = False
    again = KVStore(spark, f"{folder}/kv")
    held = {r["k"]: r["v"] for r in again.frame().collect()}
    for k, v in acknowledged.items():
        assert held[k] in (v, tried.get(k)), (step, at, k)
    assert "a" not in held and set(held) <= {*acknowledged, *tried}
    again.put("later", "z")
    assert KVStore(spark, f"{folder}/kv").get("later") == "z"


def test_a_crash_between_deleting_and_renaming_can_not_lose_the_manifest(spark, folder):
    files = Files(spark, folder)
    for i in range(4):
        files.publish("m.json", str(i).encode())
    assert files.published("m.json") == b"3" and [n for n in files.list() if n.startswith("m.json")] == ["m.json.000000000003", "m.json.000000000004"]
    files.write("m.json.000000000005.tmp", b"half")
    assert files.published("m.json") == b"3" and files.published("none") is None


def test_memory_is_counted_as_it_changes(spark, folder):
    kv = KVStore(spark, f"{folder}/kv")
    for k, v in (("abc", "defgh"), ("é", "x"), ("abc", "xy")):
        kv.put(k, v)
    kv.remove("é")
    assert kv.store.memory_bytes == sum(len(k.encode()) + size for k, (_, _, _, size) in kv.store.memtable.items())
    kv.flush()
    assert kv.store.memory_bytes == 0 and kv.get("zzz") is None and kv.get("abc") == "xy"


def test_rendering_of_doubles_is_one_rule(spark):
    rng = random.Random(3)
    some = [0.125, 0.375, 2.675, 1.005, -0.001, 0.0, -0.0, 0.995, 2.0**52 + 0.5, 2.0**53, 1e17, 2.0**70, 1e30, -2.5, 4.5e13 + 0.015625, 2.0**62, 2.0**63, 5e-324, float("inf"), float("nan")]
    some += [rng.uniform(-10, 10) for _ in range(500)] + [rng.randrange(-(10**6), 10**6) / 8 for _ in range(500)] + [rng.random() * 10 ** rng.randrange(37) for _ in range(500)] + [rng.randrange(10**6) / 1000 for _ in range(500)]
    rows = spark.createDataFrame([(x,) for x in some], "f double").select("f", render(FLOAT, F.col("f")).alias("t"), key_text(FLOAT, F.col("f")).alias("k")).collect()
    assert all(r["t"] == r["k"] == values.render(FLOAT, r["f"]) for r in rows)


def test_float_keys_meet_from_files_and_statements(spark, folder):
    spark.createDataFrame([(0.125, "a"), (2.675, "b"), (0.375, "c")], "id double, v string").write.parquet(f"{folder}/ext")
    s = Session(spark, f"{folder}/db")
    s.register("b", f"{folder}/ext", "id")
    assert s.sql("INSERT INTO b VALUES (0.125, 'x')").message == "Duplicate PRIMARY KEY value: 0.12"
    assert s.sql("INSERT INTO b VALUES (2.675, 'x')").message == "Duplicate PRIMARY KEY value: 2.67"
    assert s.sql("INSERT INTO b VALUES (2.68, 'x')").ok


def test_columns_that_differ_in_case_alone(spark, folder):
    s = Session(spark, f"{folder}/db")
    assert "caseSensitive" in s.sql("CREATE TABLE t (id INT PRIMARY KEY, Id INT)").message
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        assert s.sql("CREATE TABLE t (id INT PRIMARY KEY, Id INT)").ok and s.sql("INSERT INTO t VALUES (1, 2)").ok
        assert s.sql("SELECT Id, id FROM t").rows == [(2, 1)]
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def test_no_request_ends_the_connection(spark, folder):
    rng, words = random.Random(1), ["SELECT", "*", "FROM", "t", "WHERE", "INSERT", "INTO", "VALUES", "(", ")", ",", "1", "'x'", "-", ";", "\x00", "ORDER", "BY", "LIMIT", "9" * 40, "CREATE", "TABLE", "id", "INT", "PRIMARY", "KEY", "=", "é", "NULL", "1e5", "DROP", "UPDATE", "SET"]
    with Server(KVStore(spark, f"{folder}/kv"), Session(spark, f"{folder}/db"), port=0).start() as server, Client(port=server.server_address[1]) as c:
        for _ in range(150):
            c.execute_sql(" ".join(rng.choice(words) for _ in range(rng.randrange(12))))
        c.socket.sendall(struct.pack("<BII", 5, 2, 0) + b"\xff\xfe")
        status, n = struct.unpack("<BI", c.socket.recv(5, socket.MSG_WAITALL))
        assert status == 2 and c.socket.recv(n, socket.MSG_WAITALL)
        c.socket.sendall(request(99, "k"))
        assert c.socket.recv(5, socket.MSG_WAITALL)[0] == 2
        c.socket.recv(len(b"unknown request"), socket.MSG_WAITALL)
        c.put("k", "v")
        assert c.get("k") == "v"
        server.shutdown()


def test_latest_is_a_hash_aggregation_without_payload(spark):
    rows = spark.range(100).selectExpr("cast(id % 7 as string) k", "id seq", "'PUT' op", "repeat('v', 9) v")
    plan = latest(rows, ties=False)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    assert {r["k"]: r["seq"] for r in latest(rows).collect()} == {str((99 - i) % 7): 99 - i for i in range(7)}
    tied = spark.createDataFrame([("a", 1, "PUT", "x"), ("a", 1, "PUT", "y"), (None, 2, "PUT", "n"), (None, 1, "PUT", "m")], "k string, seq long, op string, v string")
    assert sorted((tuple(r) for r in latest(tied).collect()), key=repr) == [("a", 1, "PUT", "y"), (None, 2, "PUT", "n")]


def test_row_codec():
    row = [Value(INT, -5), Value(FLOAT, 2.5), Value(TEXT, "é"), Value(BOOL, True), Value(BOOL, None), Value(TEXT, "")]
    data = codec.encode_row(row)
    assert codec.decode_row(data) == row and data[:4] == b"\x06\0\0\0" and data[4:10] == b"\x01\0\x08\0\0\0"
    for n in range(len(data)):
        with pytest.raises(ValueError):
            codec.decode_row(data[:n])


def test_large_and_small_filters_agree(spark, monkeypatch):
    rows = spark.createDataFrame([(f"key_{i}",) for i in range(300)], "k string")
    made, asked = indexes.BloomFilter.build(rows), rows.union(spark.createDataFrame([(f"miss_{i}",) for i in range(500)] + [(None,), ("key_1",)], "k string"))
    small = sorted((tuple(r) for r in made.probe(asked).collect()), key=repr)
    monkeypatch.setattr(indexes, "LITERAL", 0)
    assert sorted((tuple(r) for r in made.probe(asked).collect()), key=repr) == small


def test_a_change_evaluates_its_rows_once(spark, folder):
    s = Session(spark, f"{folder}/db")
    s.register("orders", "/root/testdata/sf0.001/orders.parquet", "o_orderkey")
    assert s.sql("UPDATE orders SET o_totalprice = 1 WHERE o_orderkey < 10").ok and s.sql("DELETE FROM orders WHERE o_totalprice > 1").ok
    assert {r["o_totalprice"] for r in s.table("orders").collect()} == {1.0}
    assert not [n for n in s.catalog.get("orders").store.files.list() if n.startswith("aside-")]


def test_late_and_repeated_records_of_a_stream(spark, folder):
    kv, schema = KVStore(spark, f"{folder}/kv"), "k string, seq long, op string, v string"
    parts = ([("a", 5, "PUT", "new"), ("b", 1, "PUT", "b1")], [("a", 3, "PUT", "late"), ("b", 1, "PUT", "b1"), ("b", 2, "DELETE", None), ("c", None, "PUT", "x")], [("b", 1, "PUT", "late"), ("d", 9, "PUT", "d")])
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        ingest(spark.readStream.schema(schema).parquet(f"{folder}/in"), kv, f"{folder}/ck").awaitTermination()
        kv = KVStore(spark, f"{folder}/kv")
    assert sorted(tuple(r) for r in kv.frame().collect()) == [("a", "new"), ("d", "d")]
    segments = kv.segment_count()
    again = spark.createDataFrame([("a", 99, "PUT", "retry")], "_key string, _seq long, _op string, v string")
    assert kv.store.append(again, (f"{folder}/ck", 2)) == 0 and kv.segment_count() == segments
    kv.put("a", "by hand")
    assert kv.get("a") == "by hand"
    kv.compact()
    assert sorted(tuple(r) for r in kv.frame().collect()) == [("a", "by hand"), ("d", "d")]


def test_a_point_lookup_and_a_range_reach_the_segments_scan(spark, folder):
    kv = KVStore(spark, f"{folder}/kv")
    kv.put_all(spark.range(1000).selectExpr("lpad(id, 6, '0') k", "cast(id as string) v"))
    for rows, pushed in ((kv.frame().where("k = '000500'"), "EqualTo(_key,000500)"), (kv.scan("000100", "000200"), "GreaterThanOrEqual(_key,000100)")):
        assert pushed in rows._jdf.queryExecution().toString()
    assert kv.get("000500") == "500" and kv.scan("000100", "000200").count() == 101


def test_a_statement_beyond_the_limit_is_answered(spark, folder):
    s = Session(spark, f"{folder}/db")
    s.sql("CREATE TABLE t (id INT PRIMARY KEY)")
    s.sql("INSERT INTO t VALUES (1)")
    for limit, code in ((0.0001, 500), (60, 200)):
        http = http_server(s, limit=limit)
        Thread(target=http.serve_forever, daemon=True).start()
        ask = urllib.request.Request(f"http://127.0.0.1:{http.server_address[1]}/api/sql", b'{"sql": "SELECT * FROM t"}')
        try:
            with urllib.request.urlopen(ask, timeout=60) as r:
                status, body = r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            status, body = e.code, json.loads(e.read())
        assert status == code and set(body) == {"ok", "message", "columns", "rows"}
        page = urllib.request.urlopen(f"http://127.0.0.1:{http.server_address[1]}/", timeout=60).read()
        assert b"<textarea" in page
        http.shutdown()

"""Registered queries that go through the store, the key-value interface, the log, the protocol and the servers.

Each puts rows of the driver's tables in and reads the outcome, so that SQL over the same tables can tell it.
"""

from __future__ import annotations

import io
import json
import urllib.error
import urllib.request
from contextlib import redirect_stdout
from threading import Thread

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.functions.values import BOOL, FLOAT, INT, TEXT, Value
from keystrata.kv import KVStore, kv_command, parse_command
from keystrata.operators import log, merge
from keystrata.plans import statements as S
from keystrata.protocol import Client, Server, http_server
from keystrata.queries import _VERSIONS, _frame, folder, mutations, session
from keystrata.session import Session
from keystrata.sources import codec, wal


def _nations(spark: SparkSession, sf_dir: str) -> list[tuple[str, str]]:
    """The 25 nations as keys and values; small whatever the scale."""
    return [(r[0], str(r[1])) for r in spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").select("n_name", "n_nationkey").collect()]


def _kv(spark: SparkSession, **options) -> KVStore:
    return KVStore(spark, folder(spark), **options)


_NATIONS = "select n_name k, n_nationkey::varchar v, n_nationkey n from nation"


# catalog


@_frame("schema_lookup", "select * from (values ('c_custkey', 'INT', true, true), ('c_name', 'TEXT', false, false), ('c_nationkey', 'INT', false, false), ('c_acctbal', 'FLOAT', false, false), ('c_mktsegment', 'TEXT', false, false)) t(name, kind, not_null, primary_key)")
def _lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = session(spark, sf_dir, "customer").catalog.get("customer")
    return spark.createDataFrame([(c.name, c.kind, c.not_null, c.primary_key) for c in t.columns], "name string, kind string, not_null boolean, primary_key boolean")


@_frame("catalog_reopened", "select * from (values ('nation', 'n_name', 'TEXT'), ('nation', 'n_nationkey', 'INT'), ('nation', 'n_regionkey', 'INT'), ('own', 'a', 'FLOAT'), ('own', 'b', 'BOOL'), ('own', 'k', 'TEXT')) t(table_name, column_name, type)")
def _reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables and columns as another session on the same folder finds them: schemas went through their file form."""
    root = folder(spark)
    first = Session(spark, root)
    first.register("nation", f"{sf_dir}/nation.parquet", "n_nationkey")
    first.sql("CREATE TABLE own (k TEXT PRIMARY KEY, a FLOAT, b BOOL)")
    again = Session(spark, root)
    return spark.createDataFrame([(n, c.name, c.kind) for n in again.catalog.names() for c in again.catalog.get(n).columns], "table_name string, column_name string, type string")


@_frame("row_numbers", "select * from (values (1::bigint, 'AFRICA'), (2, 'ASIA'), (3, 'last'), (7, 'own')) t(id, v) union all select 4, r_name from region where false")
def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a key get numbers from 1 on; a key of their own does not advance them, a new session goes on."""
    root = folder(spark)
    s = Session(spark, root)
    s.sql("CREATE TABLE t (id INT PRIMARY KEY, v TEXT)")
    for v in ("AFRICA", "ASIA"):
        s.insert_auto(S.Insert("t", ("v",), (Value(TEXT, v),)))
    s.sql("INSERT INTO t VALUES (7, 'own')")
    again = Session(spark, root)
    again.insert_auto(S.Insert("t", ("v",), (Value(TEXT, "last"),)))
    return again.table("t")


# key-value store


@_frame("kv_put", f"select k, case when n % 2 = 0 then v || '!' else v end v from ({_NATIONS}) union all select 'empty', ''")
def _put(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nation is put, every second one again; an empty value is a value."""
    kv, rows = _kv(spark), _nations(spark, sf_dir)
    for k, v in rows:
        kv.put(k, v)
    for k, v in rows:
        if int(v) % 2 == 0:
            kv.put(k, f"{v}!")
    kv.put("empty", "")
    return kv.frame()


@_frame("kv_remove", f"select k, v from ({_NATIONS}) where n >= 10")
def _remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removed keys are gone, also those that lie in a segment below; absent ones may be removed."""
    kv = _kv(spark)
    for k, v in _nations(spark, sf_dir):
        kv.put(k, v)
    kv.flush()
    for k, v in _nations(spark, sf_dir):
        if int(v) < 10:
            kv.remove(k)
    kv.remove("absent")
    return kv.frame()


@_frame("memtable_scan", f"select k, v from ({_NATIONS}) where k between 'C' and 'K' and n <> 3")
def _memtable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of what no segment holds yet."""
    kv = _kv(spark)
    for k, v in _nations(spark, sf_dir):
        kv.put(k, v)
        if v == "3":
            kv.remove(k)
    assert not kv.store.segments
    return kv.scan("C", "K")


@_frame("kv_api", f"select k, case when n < 5 then null when n < 8 then 'new' else v end v from ({_NATIONS})")
def _api(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key's get after puts, removals and overwrites across a flush; null where the key is gone."""
    kv, rows = _kv(spark), _nations(spark, sf_dir)
    for k, v in rows:
        kv.put(k, v)
    kv.flush()
    for k, v in rows:
        if int(v) < 5:
            kv.remove(k)
        elif int(v) < 8:
            kv.put(k, "new")
    return spark.createDataFrame([(k, kv.get(k)) for k, _ in rows], "k string, v string")


@_frame("kv_text_commands", f"select k, v from ({_NATIONS}) where k between 'A' and 'F' and n <> 0 union all select 'two words', 'a  b'")
def _text(spark: SparkSession, sf_dir: str) -> DataFrame:
    kv = _kv(spark)
    for k, v in _nations(spark, sf_dir):
        kv_command(kv, f"put {k.replace(' ', '_')} {v}")
    kv_command(kv, f"DELETE {next(k for k, v in _nations(spark, sf_dir) if v == '0')}")
    kv_command(kv, "PUT two a  b")
    rows = [*kv_command(kv, "SCAN A F"), ("two words", kv_command(kv, "GET two"))]
    return spark.createDataFrame(rows, "k string, v string")


@_frame("kv_command_parsing", "select * from (values ('put k  two words', 'PUT', 'k', ' two words', ''), ('Get k', 'GET', 'k', '', ''), ('DELETE k', 'DELETE', 'k', '', ''), ('SCAN a b', 'SCAN', 'a', '', 'b'), ('fly', 'UNKNOWN', '', '', '')) t(line, kind, key, value, last)")
def _parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = [(line, parse_command(line)) for line in ("put k  two words", "Get k", "DELETE k", "SCAN a b", "fly")]
    return spark.createDataFrame([(line, c.kind, c.key, c.value, c.last) for line, c in made], "line string, kind string, key string, value string, last string")


# segments


def _segmented(spark: SparkSession, sf_dir: str) -> KVStore:
    """The events' mutations in two segments, deletions among them."""
    every, kv = mutations(spark, sf_dir), _kv(spark)
    for part in (every.where("seq % 2 = 0"), every.where("seq % 2 = 1")):
        kv.store.append(merge.latest(part).select(F.col("k").alias("_key"), F.col("op").alias("_op"), "v"))
    return kv


_HALVES = f"(select k, seq % 2 part, arg_max(op, seq) op, case when arg_max(op, seq) = 'PUT' then arg_max(v, seq) end v from {_VERSIONS} group by k, seq % 2)"
_ABOVE = f"(select k, arg_max(v, part) v from {_HALVES} group by k having arg_max(op, part) = 'PUT')"


@_frame("segment_point_lookup", f"select k, v from {_ABOVE} where k in ('3', '17', '42', 'none')")
def _point(spark: SparkSession, sf_dir: str) -> DataFrame:
    kv = _segmented(spark, sf_dir)
    found = [(k, kv.get(k)) for k in ("3", "17", "42", "none")]
    return spark.createDataFrame([(k, v) for k, v in found if v is not None], "k string, v string")


@_frame("segment_range_scan", f"select k, v from {_ABOVE} where k between '2' and '5'")
def _range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segmented(spark, sf_dir).scan("2", "5")


@_frame("segment_full_read", f"select k, op, v, part::bigint + 1 as segment from {_HALVES}")
def _full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that the segments hold, deletions included, by the number of the segment."""
    number = F.regexp_extract(F.input_file_name(), r"seg-(\d+)", 1).cast("long").alias("segment")
    return _segmented(spark, sf_dir).store._segments().select(F.col("_key").alias("k"), F.col("_op").alias("op"), "v", number)


@_frame("segment_discovery", f"select part::bigint + 1 as segment, count(*)::bigint entry_count, min(k) min_key, max(k) max_key from {_HALVES} group by part")
def _discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments as a store that is opened again finds them in the manifest."""
    kv = _segmented(spark, sf_dir)
    again = KVStore(spark, kv.store.files.root)
    return spark.createDataFrame([(int(s["name"][4:]), s["rows"], s["low"], s["high"]) for s in again.store.segments], "segment long, entry_count long, min_key string, max_key string")


@_frame("segment_validation", f"select k, v, 'seg-00000001' as aside from ({_NATIONS}) where n >= 12")
def _validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A segment whose file is damaged is put aside when the store opens; the others' rows are there."""
    kv, rows = _kv(spark), _nations(spark, sf_dir)
    for k, v in rows:
        if v == "12":
            kv.flush()
        kv.put(k, v)
    kv.flush()
    files = kv.store.files
    for n in files.list("seg-00000001"):
        if n.endswith(".parquet"):
            files.write(f"seg-00000001/{n}", b"nonsense")
    again = KVStore(spark, files.root)
    return again.frame().withColumn("aside", F.lit(",".join(again.store.quarantined)))


@_frame("flush", f"select k, 'PUT' as op, v, count(*) over ()::bigint as held from ({_NATIONS}) where n < 20 union all select 'gone', 'DELETE', null, (select count(*) from nation where n_nationkey < 20)")
def _flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full memtable becomes a segment, its deletions too; what it held before is the number of keys."""
    kv = _kv(spark)
    for k, v in _nations(spark, sf_dir):
        if int(v) < 20:
            kv.put(k, v)
    held = len(kv.store.memtable)
    kv.remove("gone")
    kv.flush()
    assert not kv.store.memtable and not kv.store.files.list("wal")
    return kv.store._segments().select(F.col("_key").alias("k"), F.col("_op").alias("op"), "v", F.lit(held).cast("long").alias("held"))


@_frame("compaction_trigger", f"select k, v, true as few_segments from ({_NATIONS})")
def _trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a tiny memtable segments pile up; the fourth sets off a merge, so there are never more than three afterwards."""
    kv, few = _kv(spark, flush_bytes=40), True
    for k, v in _nations(spark, sf_dir):
        kv.put(k, v)
        few &= kv.segment_count() < 4
    return kv.frame().withColumn("few_segments", F.lit(few))


# log


@_frame(
    "wal_append",
    "select n_name k, '01' || hex_le(strlen(n_name)) || hex_le(strlen(n_nationkey::varchar)) || hex(n_name) || hex(n_nationkey::varchar) as payload from nation".replace("hex_le(strlen(n_name))", "printf('%02X', strlen(n_name)) || '000000'").replace("hex_le(strlen(n_nationkey::varchar))", "printf('%02X', strlen(n_nationkey::varchar)) || '000000'"),
)
def _append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the log's files hold after each put, without the checksums, which must be right."""
    kv = _kv(spark)
    for k, v in _nations(spark, sf_dir):
        kv.put(k, v)
    rows = []
    for name in kv.store.files.list("wal"):
        data = kv.store.files.read(f"wal/{name}")
        [(op, key, value)] = wal.decode(data)
        # the store's payload is a JSON list of one text
        body = wal.encode(op, key, json.loads(value)[0].encode())[4:]
        rows.append((key.decode(), body.hex().upper()))
    return spark.createDataFrame(rows, "k string, payload string")


@_frame("wal_recovered", f"select k, v from ({_NATIONS}) where n <> 4")
def _recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nothing was flushed: another store on the folder replays the log."""
    kv = _kv(spark)
    for k, v in _nations(spark, sf_dir):
        kv.put(k, v)
        if v == "4":
            kv.remove(k)
    return KVStore(spark, kv.store.files.root).frame()


@_frame("wal_payload", "select event_id, hex(unhex(case when event_type = 'error' then '02' else '01' end) || unhex(printf('%02X', strlen(user_id::varchar)) || '000000') || unhex(case when event_type = 'error' then '00000000' else printf('%02X', strlen(event_type)) || '000000' end) || encode(user_id::varchar) || encode(case when event_type = 'error' then '' else event_type end)) payload from events")
def _payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutations(spark, sf_dir).select(F.col("seq").alias("event_id"), F.hex(log.payload(F.col("op"), F.col("k"), F.col("v"))).alias("payload"))


@_frame("hex_dump", "select r_name, '00000000  ' || rpad(array_to_string(list_transform(range(1, length(r_name) + 1), lambda i: lower(hex(substr(r_name, i, 1)))), ' '), 48, ' ') || ' ' || r_name as dump from region")
def _dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [r[0] for r in spark.read.parquet(f"{sf_dir}/region.parquet").select("r_name").collect()]
    return spark.createDataFrame([(n, wal.hex_dump(n.encode())) for n in names], "r_name string, dump string")


_LE = "array_to_string(list_transform(range(0, 8), lambda i: printf('%02X', (n_nationkey::bigint >> (8 * i)) & 255)), '')"


@_frame("row_codec", f"select n_nationkey::bigint k, '0300000001000800000' || '0' || {_LE} || '0300' || printf('%02X', strlen(n_name)) || '000000' || hex(n_name) || '040001000000' || case when n_nationkey > 9 then '01' else '00' end as bytes from nation")
def _codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number, name and a flag of each nation as the bytes of a row, and back again."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("k"), "n_name")
    coded = nation.select("k", F.hex(codec.row_bytes([(INT, F.col("k")), (TEXT, F.col("n_name")), (BOOL, F.col("k") > 9)])).alias("bytes"))
    for r in coded.collect():
        cells = codec.decode_row(bytes.fromhex(r["bytes"]))
        assert cells[0] == Value(INT, r["k"]) and codec.encode_row(cells) == bytes.fromhex(r["bytes"])
    return coded


@_frame("little_endian", f"select n_nationkey::bigint k, {_LE} as bytes from nation")
def _le(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("k"), F.hex(codec._little(F.col("n_nationkey").cast("long"), 8)).alias("bytes"))


# statements


_SAID = [
    ("FOOBAR baz", False, "Parse error"), ("SELECT * FROM nope", False, "Table 'nope' does not exist"), ("CREATE TABLE t (a INT)", False, "Table must have a PRIMARY KEY"), ("CREATE TABLE t (id INT PRIMARY KEY, v TEXT NOT NULL)", True, "Table 't' created."),
    ("CREATE TABLE t (id INT PRIMARY KEY)", False, "Table 't' already exists"), ("CREATE TABLE u (id INT PRIMARY KEY, Id INT)", False, "columns whose names differ in case alone need spark.sql.caseSensitive"), ("INSERT INTO t VALUES (1, 'a')", True, "1 row inserted."), ("INSERT INTO t VALUES (1, 'b')", False, "Duplicate PRIMARY KEY value: 1"),
    ("INSERT INTO t (id) VALUES (2)", False, "Column 'v' cannot be NULL"), ("UPDATE t SET v = 'c'", True, "1 row(s) updated."), ("SELECT v FROM t ORDER BY id", False, "ORDER BY column 'id' must be in SELECT list"), ("SELECT * FROM t", True, "1 row(s) returned."), ("SELECT * FROM damaged", False, "Execution error"),
    ("DELETE FROM t", True, "1 row(s) deleted."), ("DROP TABLE t", True, "Table 't' dropped."), ("DROP TABLE IF EXISTS t", True, "OK"), ("", False, "Parse error"), ("SELECT \x00", False, "Parse error"),
]


@_frame("statements_never_raise", "select * from (values " + ", ".join(f"({i}::bigint, {str(ok).lower()}, '{message.replace(chr(39), chr(39) * 2)}')" for i, (_, ok, message) in enumerate(_SAID)) + ") t(n, ok, message)")
def _never(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each statement answers, in this order; of errors that carry a reason the kind alone."""
    s, rows = session(spark, sf_dir), []
    s.register("damaged", f"{sf_dir}/region.parquet", "r_regionkey")
    s.catalog.tables["damaged"].store.base = None  # a table that fails inside
    s.catalog.tables["damaged"].store.segments = [{"name": "nowhere", "rows": 1, "low": "", "high": "~"}]
    for n, (text, _, _) in enumerate(_SAID):
        r = s.sql(text)
        rows.append((n, r.ok, r.message.partition(":")[0] if r.message.startswith(("Parse error", "Execution error")) else r.message))
    return spark.createDataFrame(rows, "n long, ok boolean, message string")


@_frame("statement_values", "select n_name, n_nationkey::bigint n_nationkey from nation where n_regionkey = 2 or n_nationkey > 20 order by n_name limit 6")
def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A SELECT given as a value, not as text."""
    where = (S.Condition("n_regionkey", "=", Value(INT, 2)), S.Condition("n_nationkey", ">", Value(FLOAT, 20.9), "OR"))
    return session(spark, sf_dir, "nation").execute(S.Select("nation", ("n_name", "n_nationkey"), where, "n_name", limit=6)).df


@_frame("float_keys", "select * from (values (0.125::double, 'a'), (0.375, 'b'), (2.675, 'c'), (-0.001, 'd'), (1e17, 'e')) t(id, v)")
def _floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys at ties of two decimals meet whichever way they come: rows inserted at once, then each again as a statement."""
    s = session(spark, sf_dir)
    s.sql("CREATE TABLE f (id FLOAT PRIMARY KEY, v TEXT)")
    s.insert_rows("f", spark.createDataFrame([(0.125, "a"), (0.375, "b"), (2.675, "c"), (-0.001, "d"), (1e17, "e")], "id double, v string"))
    for text in ("0.125", "0.375", "2.675", "-0.001", "100000000000000000", "0.12", "2.67"):
        assert s.sql(f"INSERT INTO f VALUES ({text}, 'again')").message.startswith("Duplicate PRIMARY KEY")
    return s.table("f")


# access


def _nation_table(spark: SparkSession, sf_dir: str) -> Session:
    return session(spark, sf_dir, "nation")


@_frame("tcp", f"select k, v from ({_NATIONS}) where k between 'B' and 'J' and n <> 2 union all select 'SQL ' || n_name, n_nationkey::varchar from nation where n_regionkey = 1 union all select 'error', 'Table ''nope'' does not exist'")
def _tcp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Puts, a removal, a scan and statements over the wire."""
    rows: list[tuple[str, str]] = []
    with Server(_kv(spark), _nation_table(spark, sf_dir), port=0).start() as server, Client(port=server.server_address[1]) as c:
        for k, v in _nations(spark, sf_dir):
            c.put(k, v)
        gone = next(k for k, v in _nations(spark, sf_dir) if v == "2")
        c.delete(gone)
        assert c.get(gone) is None
        rows += c.scan("B", "J")
        rows += [(f"SQL {n}", k) for n, k in c.execute_sql("SELECT n_name, n_nationkey FROM nation WHERE n_regionkey = 1")["rows"]]
        rows.append(("error", c.execute_sql("SELECT * FROM nope")["message"]))
        server.shutdown()
    return spark.createDataFrame(rows, "k string, v string")


@_frame("http", "select 200::bigint code, r_name as said from region union all select * from (values (200, 'connected'), (400, 'Missing \"sql\" field'), (404, 'Not found'), (200, 'Table ''nope'' does not exist')) t")
def _http(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = http_server(session(spark, sf_dir, "region"))
    Thread(target=made.serve_forever, daemon=True).start()

    def ask(path: str, body: dict | None = None) -> tuple[int, dict]:
        data = None if body is None else json.dumps(body).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{made.server_address[1]}{path}", data), timeout=120) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    code, found = ask("/api/sql", {"sql": "SELECT r_name FROM region"})
    rows = [(code, r[0]) for r in found["rows"]]
    code, found = ask("/api/health")
    rows.append((code, found["status"]))
    for path, body in (("/api/sql", {}), ("/nope", None), ("/api/sql", {"sql": "SELECT * FROM nope"})):
        code, found = ask(path, body)
        rows.append((code, found["message"]))
    made.shutdown()
    made.server_close()
    return spark.createDataFrame(rows, "code long, said string")


@_frame("prompt_table", "select * from (values (0::bigint, '+-------------+-------------+'), (1, '| r_regionkey | r_name      |'), (2, '+-------------+-------------+'), (8, '+-------------+-------------+'), (9, '5 row(s) returned.')) t(n, line) union all select 3 + r_regionkey, '| ' || rpad(r_regionkey::varchar, 11, ' ') || ' | ' || rpad(r_name, 11, ' ') || ' |' from region")
def _prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = io.StringIO()
    with redirect_stdout(said):
        print(session(spark, sf_dir, "region").sql("SELECT * FROM region").table())
    return spark.createDataFrame(list(enumerate(said.getvalue().splitlines())), "n long, line string")




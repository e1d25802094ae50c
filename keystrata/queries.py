"""The engine's registered queries over the driver's tables, each with the DuckDB SQL that gives its result."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.functions.columns import fnv1a, mix32, render
from keystrata.functions.values import FLOAT
from keystrata.operators import indexes, log, merge
from keystrata.session import Session

#: Tables and their keys; no column set of lineitem is unique, so it is read-only.
TABLES = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": None, "events": "event_id",
    "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id", "labels": "doc_id", "conversations": None,
}

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """A new folder for a session's catalog, on the storage that ``spark.checkpoint.dir`` names; a local master may do without."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        made = tempfile.mkdtemp(prefix="keystrata-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        root = f"file://{made}"
    return f"{root.rstrip('/')}/keystrata/session-{uuid.uuid4().hex}"


def session(spark: SparkSession, sf_dir: str, *tables: str, lenient: bool = False) -> Session:
    made = Session(spark, folder(spark), lenient)
    for t in tables:
        made.register(t, f"{sf_dir}/{t}.parquet", TABLES[t])
    return made


def _select(name: str, table: str, text: str, oracle: str) -> None:
    """A SELECT of the dialect; without ORDER BY or LIMIT its rows have no order."""
    QUERIES[name] = lambda spark, sf_dir: session(spark, sf_dir, table).select(text)
    ORACLE[name] = oracle


def _after(name: str, table: str, statements: list[str], oracle: str) -> None:
    """The table after statements that change it."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = session(spark, sf_dir, table)
        for text in statements:
            result = s.sql(text)
            if not result.ok:
                raise ValueError(f"{text}: {result.message}")
        return s.table(table)

    QUERIES[name] = run
    ORACLE[name] = oracle


def _frame(name: str, oracle: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLE[name] = oracle
        return f

    return add


_NATION = "select n_nationkey::bigint n_nationkey, n_name, n_regionkey::bigint n_regionkey from nation"
_CUSTOMER = "select c_custkey, c_name, c_nationkey::bigint c_nationkey, c_acctbal, c_mktsegment from customer"
_REGION = "select r_regionkey::bigint r_regionkey, r_name from region"
_LINE = "select l_orderkey, l_linenumber::bigint l_linenumber, l_quantity, l_discount from lineitem"

_select("select_all", "nation", "SELECT * FROM nation", _NATION)
_select("select_columns", "customer", "SELECT c_name, c_acctbal, c_custkey FROM customer", "select c_name, c_acctbal, c_custkey from customer")
_select("select_other_types", "events", "SELECT * FROM events WHERE event_type = 'error'", "select * from events where event_type = 'error'")
_select("where_eq_text", "customer", "SELECT * FROM customer WHERE c_mktsegment = 'FURNITURE'", f"{_CUSTOMER} where c_mktsegment = 'FURNITURE'")
_select("where_eq_int_pk", "orders", "SELECT * FROM orders WHERE o_orderkey = 42", "select * from orders where o_orderkey = 42")
_select("where_ne", "orders", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'", "select o_orderkey, o_orderstatus from orders where not coalesce(o_orderstatus = 'F', false)")
_select("where_lt", "orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 1500.5", "select o_orderkey, o_totalprice from orders where o_totalprice < 1500.5")
_select("where_gt", "orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 450000", "select o_orderkey, o_totalprice from orders where o_totalprice > 450000")
_select("where_le", "lineitem", "SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE l_quantity <= 3", f"{_LINE} where l_quantity <= 3")
_select("where_ge", "lineitem", "SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE l_quantity >= 48", f"{_LINE} where l_quantity >= 48")
_select("where_and", "lineitem", "SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE l_quantity < 10 AND l_returnflag = 'R' AND l_linenumber = 2", f"{_LINE} where l_quantity < 10 and l_returnflag = 'R' and l_linenumber = 2")
_select("where_or_and_left_fold", "orders", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR o_orderstatus = 'O' AND o_totalprice > 300000", "select o_orderkey from orders where (o_orderstatus = 'F' or o_orderstatus = 'O') and o_totalprice > 300000")
_select("where_and_or", "orders", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000 OR o_orderpriority = '1-URGENT'", "select o_orderkey from orders where (o_orderstatus = 'F' and o_totalprice > 300000) or o_orderpriority = '1-URGENT'")
_select("where_int_col_float_literal", "orders", "SELECT o_orderkey FROM orders WHERE o_orderkey < 10.9", "select o_orderkey from orders where o_orderkey < 10")
_select("where_text_literal_on_int", "orders", "SELECT o_orderkey FROM orders WHERE o_orderkey = '12abc'", "select o_orderkey from orders where o_orderkey = 12")
_select("where_unparsable_literal", "customer", "SELECT c_custkey FROM customer WHERE c_custkey <= 'abc'", "select c_custkey from customer where c_custkey <= 0")
_select("where_text_vs_int", "orders", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority > 3", "select o_orderkey, o_orderpriority from orders where o_orderpriority > '3'")
_select("where_zero", "lineitem", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_discount = 0", "select l_orderkey, l_linenumber::bigint l_linenumber, l_quantity from lineitem where l_discount = 0")
_select("where_bool_literal_on_int", "orders", "SELECT o_orderkey FROM orders WHERE o_orderkey <= TRUE", "select o_orderkey from orders where o_orderkey <= 0")
_select("where_unknown_column", "nation", "SELECT * FROM nation WHERE nope = 1 OR n_regionkey = 2", f"{_NATION} where n_regionkey = 2")
_select("where_ne_null", "region", "SELECT * FROM region WHERE r_name != NULL", _REGION)
_select("where_eq_null", "region", "SELECT * FROM region WHERE r_name = NULL", f"{_REGION} where false")
_select("order_by_asc", "supplier", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal ASC", "select s_suppkey, s_acctbal from supplier order by s_acctbal")
_select("order_by_desc", "supplier", "SELECT s_suppkey, s_name FROM supplier ORDER BY s_name DESC", "select s_suppkey, s_name from supplier order by s_name desc")
_select("topk", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC LIMIT 10", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, printf('%010d', o_orderkey) limit 10")
_select("topk_filtered", "orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000 ORDER BY o_totalprice DESC LIMIT 10", "select o_orderkey, o_totalprice from orders where o_totalprice > 300000 order by o_totalprice desc, printf('%010d', o_orderkey) limit 10")
_select("limit_key_order", "customer", "SELECT * FROM customer LIMIT 25", f"{_CUSTOMER} order by printf('%010d', c_custkey) limit 25")
_select("limit_zero", "customer", "SELECT c_custkey FROM customer LIMIT 0", "select c_custkey from customer limit 0")

_after("update_where", "customer", ["UPDATE customer SET c_acctbal = 0, c_mktsegment = 'NONE' WHERE c_acctbal < 0"], "select c_custkey, c_name, c_nationkey::bigint c_nationkey, case when c_acctbal < 0 then 0 else c_acctbal end c_acctbal, case when c_acctbal < 0 then 'NONE' else c_mktsegment end c_mktsegment from customer")
_after("update_all", "part", ["UPDATE part SET p_size = 7.9"], "select p_partkey, p_name, p_brand, p_type, 7::bigint p_size, p_retailprice from part")
_after("update_twice", "supplier", ["UPDATE supplier SET s_acctbal = 1 WHERE s_suppkey < 50", "UPDATE supplier SET s_acctbal = 2 WHERE s_acctbal = 1 AND s_suppkey >= 25"], "select s_suppkey, s_name, s_nationkey::bigint s_nationkey, case when s_suppkey < 25 then 1.0::double when s_suppkey < 50 then 2.0::double else s_acctbal end s_acctbal from supplier where true")
_after("delete_where", "customer", ["DELETE FROM customer WHERE c_mktsegment = 'FURNITURE'"], f"{_CUSTOMER} where not coalesce(c_mktsegment = 'FURNITURE', false)")
_after("delete_or_fold", "orders", ["DELETE FROM orders WHERE o_orderstatus = 'F' OR o_orderstatus = 'O' AND o_totalprice > 300000"], "select * from orders where not ((o_orderstatus = 'F' or o_orderstatus = 'O') and o_totalprice > 300000)")
_after("delete_all", "nation", ["DELETE FROM nation"], f"{_NATION} where false")
_after("insert_then_select", "region", ["INSERT INTO region (r_name, r_regionkey) VALUES ('X', 99)"], f"{_REGION} union all select 99, 'X'")
_after("reinsert_after_delete", "nation", ["DELETE FROM nation WHERE n_nationkey = 3", "INSERT INTO nation VALUES (3, 'NEW', 1)"], "select n_nationkey::bigint n_nationkey, case when n_nationkey = 3 then 'NEW' else n_name end n_name, case when n_nationkey = 3 then 1::bigint else n_regionkey::bigint end n_regionkey from nation")


@_frame("show_tables", "select * from (values ('region'), ('nation'), ('customer'), ('supplier'), ('part'), ('orders'), ('lineitem'), ('events'), ('documents'), ('embeddings'), ('pages'), ('benchmark'), ('labels'), ('conversations')) t(table_name)")
def _show(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session(spark, sf_dir, *TABLES).sql("SHOW TABLES").df


@_frame("describe_table", "select * from (values ('id', 'INT', 'YES', 'YES'), ('name', 'TEXT', 'YES', 'NO'), ('salary', 'FLOAT', 'NO', 'NO'), ('active', 'BOOL', 'NO', 'NO')) t(column_name, type, not_null, primary_key)")
def _describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir)
    s.sql("CREATE TABLE staff (id INTEGER PRIMARY KEY, name VARCHAR(20) NOT NULL, salary REAL, active BOOLEAN)")
    return s.sql("DESCRIBE staff").df


@_frame("drop_table", "select 'kept' as table_name")
def _drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir)
    for text in ("CREATE TABLE kept (id INT PRIMARY KEY)", "CREATE TABLE gone (id INT PRIMARY KEY)", "INSERT INTO gone VALUES (1)", "DROP TABLE gone", "DROP TABLE IF EXISTS gone"):
        s.sql(text)
    return s.sql("SHOW TABLES").df


@_frame("created_table", "select * from (values (1::bigint, 'Widget', 14.99::double), (2, 'Gadget', 19.99::double)) t(id, name, price)")
def _created(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir)
    for text in ("CREATE TABLE products (id INT PRIMARY KEY, name TEXT NOT NULL, price FLOAT)", "INSERT INTO products VALUES (1, 'Widget', 9.99)", "INSERT INTO products VALUES (2, 'Gadget', 19.99)", "INSERT INTO products VALUES (3, 'Doohickey', 4.99)", "UPDATE products SET price = 14.99 WHERE id = 1", "DELETE FROM products WHERE id = 3"):
        s.sql(text)
    return s.table("products")


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as mutations: k the user, seq the event; an error deletes, anything else puts the value's text."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    gone = F.col("event_type") == "error"
    return e.select(F.col("user_id").cast("string").alias("k"), F.col("event_id").alias("seq"), F.when(gone, "DELETE").otherwise("PUT").alias("op"), F.when(~gone, F.col("event_type")).alias("v"))


_VERSIONS = "(select user_id::varchar k, event_id seq, case when event_type = 'error' then 'DELETE' else 'PUT' end op, case when event_type <> 'error' then event_type end v from events)"
_LATEST = f"select k, arg_max(v, seq) filter (where true) v from {_VERSIONS} group by k having arg_max(op, seq) = 'PUT'"
_LAST = f"select k, count(*) n, arg_max(op, seq) last from {_VERSIONS} group by k"


@_frame("kv_latest_wins", f"select k, v from ({_LATEST})")
def _latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merged(mutations(spark, sf_dir)).select("k", "v")


@_frame("kv_range_scan", f"select k, v from ({_LATEST}) where k between '10' and '40'")
def _range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.range_scan(merge.merged(mutations(spark, sf_dir)).select("k", "v"), "10", "40")


@_frame("kv_get", f"select k, v from ({_LATEST}) where k = '7'")
def _get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merged(mutations(spark, sf_dir)).where("k = '7'").select("k", "v")


@_frame("memtable_size", f"select sum(strlen(k) + coalesce(strlen(v), 0))::bigint size_bytes from {_VERSIONS}")
def _size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.byte_size(mutations(spark, sf_dir))


@_frame("compaction_output", f"select k, v from ({_LATEST})")
def _compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two segments written and merged into one by a store."""
    from keystrata.kv import KVStore

    every, store = mutations(spark, sf_dir), KVStore(spark, folder(spark))
    half = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.expr("cast(max(event_id) / 2 as long)")).first()[0]
    for part in (every.where(F.col("seq") <= half), every.where(F.col("seq") > half)):
        store.store.append(merge.latest(part).select(F.col("k").alias("_key"), F.col("op").alias("_op"), "v"))
    store.compact()
    return store.frame()


@_frame("compaction_report", f"select count(*)::bigint keys_processed, sum(case when last = 'PUT' then n - 1 else 0 end)::bigint duplicates_overwritten, sum(case when last = 'PUT' then 0 else n end)::bigint tombstones_purged from ({_LAST})")
def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.compaction_report(mutations(spark, sf_dir))


@_frame("key_actions", f"select k, case when last <> 'PUT' then 'tombstone_purge' when n > 1 then 'overwrite' else 'keep' end as action from ({_LAST})")
def _actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.key_actions(mutations(spark, sf_dir))


@_frame("segment_stats", "select event_type as segment, min(props) min_key, max(props) max_key, count(*)::bigint entry_count from events group by event_type")
def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexes.segment_stats(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("segment"), F.col("props").alias("k")), "segment")


@_frame("sparse_index", "select k, ordinal from (select printf('%010d', c_custkey) k, row_number() over (order by printf('%010d', c_custkey)) - 1 as ordinal from customer) where ordinal % 16 = 0")
def _sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexes.sparse_index(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.format_string("%010d", "c_custkey").alias("k")))


_BYTES = "list_transform(range(1, length(c_name) + 1), lambda i: ascii(substr(c_name, i, 1))::ubigint)"


@_frame("fnv1a_hash", f"select c_custkey, list_reduce(list_prepend(2166136261::ubigint, {_BYTES}), lambda h, c: (xor(h, c) * 16777619::ubigint) % 4294967296::ubigint)::bigint h from customer")
def _fnv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", fnv1a(F.col("c_name")).alias("h"))


_M = "1540483477::ubigint"
_W = "4294967296::ubigint"
_K = f"((c * {_M}) % {_W})"


@_frame("mix32_hash", f"select c_custkey, xor(g, g >> 15)::bigint h from (select c_custkey, (xor(h, h >> 13) * {_M}) % {_W} g from (select c_custkey, list_reduce(list_prepend({_M}, {_BYTES}), lambda h, c: xor((h * {_M}) % {_W}, (xor({_K}, {_K} >> 24) * {_M}) % {_W})) h from customer))")
def _mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", mix32(F.col("c_name")).alias("h"))


def _hashed(table: str) -> str:
    """SQL: k and both hashes of the ASCII texts k of ``table``."""
    octets = "list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i, 1))::ubigint)"
    fnv = f"list_reduce(list_prepend(2166136261::ubigint, {octets}), lambda h, c: (xor(h, c) * 16777619::ubigint) % {_W})"
    mixed = f"list_reduce(list_prepend({_M}, {octets}), lambda h, c: xor((h * {_M}) % {_W}, (xor({_K}, {_K} >> 24) * {_M}) % {_W}))"
    return f"(select k, a, xor(g, g >> 15) b, (select greatest(64, 10 * count(*)) from customer) m from (select k, a, (xor(h, h >> 13) * {_M}) % {_W} g from (select k, {fnv} a, {mixed} h from {table})))"


_PLACES = "list_transform(range(0, 7), lambda i: (a + i * b) % 4294967296 % m)"


@_frame(
    "bloom_probe",
    f"with ours as (select c_name k from customer), asked as (select k from ours union all select 'miss_' || c_custkey::varchar from customer), bits as (select distinct unnest({_PLACES}) p from {_hashed('ours')}) "
    f"select k, bool_and(p in (select p from bits)) maybe from (select k, unnest({_PLACES}) p from {_hashed('asked')}) group by k",
)
def _bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers' names, and as many keys that are not in the filter."""
    names = spark.read.parquet(f"{sf_dir}/customer.parquet")
    rows = names.select(F.col("c_name").alias("k"))
    return indexes.BloomFilter.build(rows).probe(rows.union(names.select(F.concat(F.lit("miss_"), F.col("c_custkey").cast("string")))))


def broken_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a log whose checksums are wrong from event 7000 on every thousandth record."""
    m = mutations(spark, sf_dir)
    right = log.checksum(F.col("op"), F.col("k"), F.col("v"))
    return m.withColumn("crc", F.when((F.col("seq") >= 7000) & (F.col("seq") % 1000 == 0), right + 1).otherwise(right))


@_frame("wal_valid_prefix", f"select k, seq, op, v from {_VERSIONS} where seq < 7000")
def _prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.valid_prefix(broken_log(spark, sf_dir)).select("k", "seq", "op", "v")


@_frame("wal_replay", f"select k, arg_max(v, seq) filter (where true) v from {_VERSIONS} where seq < 7000 group by k having arg_max(op, seq) = 'PUT'")
def _replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.replay(broken_log(spark, sf_dir))


@_frame("render_text", "select o_orderkey, printf('%.2f', o_totalprice) as text from orders")
def _render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", render(FLOAT, F.col("o_totalprice")).alias("text"))


@_frame("recovery_simulation", f"select k, arg_max(v, seq) filter (where true) v from {_VERSIONS} where seq < 500 group by k having arg_max(op, seq) = 'PUT'")
def _simulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A byte of event 500 is inverted: replay ends before it."""
    m = mutations(spark, sf_dir)
    return log.replay(log.flipped(m.withColumn("crc", log.checksum(F.col("op"), F.col("k"), F.col("v"))), 500))


from keystrata import interfaces  # noqa: E402, F401 (registers more)

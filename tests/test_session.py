import json
import urllib.error
import urllib.request
from threading import Thread

import pytest

from keystrata.functions.values import INT, TEXT, Value
from keystrata.kv import KVStore
from keystrata.plans import statements as S
from keystrata.protocol import Client, Server, http_server
from keystrata.session import Session

SF = "/root/testdata/sf0.001"


@pytest.fixture
def session(spark, folder):
    return Session(spark, f"{folder}/db")


def run(session, *texts):
    for text in texts:
        result = session.sql(text)
        assert result.ok, (text, result.message)
    return result


@pytest.fixture
def employees(session):
    run(session, "CREATE TABLE employees (id INT PRIMARY KEY, name TEXT NOT NULL, salary FLOAT, active BOOL)")
    for row in ("1, 'Alice', 75000.50, TRUE", "2, 'Bob', 82000.00, TRUE", "3, 'Charlie', 65000.00, FALSE"):
        assert run(session, f"INSERT INTO employees VALUES ({row})").message == "1 row inserted."
    return session


def test_selects(employees):
    q = employees.sql
    assert len(q("SELECT * FROM employees").rows) == 3 and q("SELECT * FROM employees").columns == ["id", "name", "salary", "active"]
    assert q("SELECT name, salary FROM employees").rows[0] == ("Alice", 75000.5)
    assert q("SELECT * FROM employees WHERE id = 1").message == "1 row(s) returned."
    assert len(q("SELECT * FROM employees WHERE salary > 70000").rows) == 2
    assert len(q("SELECT * FROM employees WHERE salary > 70000 AND active = TRUE").rows) == 2
    assert q("SELECT name FROM employees ORDER BY name DESC").rows == [("Charlie",), ("Bob",), ("Alice",)]
    assert q("SELECT salary, name FROM employees ORDER BY salary ASC").rows[0][1] == "Charlie"
    assert q("SELECT name FROM employees LIMIT 2").rows == [("Alice",), ("Bob",)]
    assert q("SELECT * FROM employees LIMIT 0").rows == [] and len(q("SELECT * FROM employees LIMIT -1").rows) == 3
    assert q("SELECT name, name FROM employees LIMIT 1").rows == [("Alice", "Alice")]


def test_errors(employees):
    q = employees.sql
    cases = {
        "FOOBAR baz": "Parse error: ", "SELECT * FROM nope": "Table 'nope' does not exist", "INSERT INTO nope VALUES (1)": "Table 'nope' does not exist", "UPDATE nope SET a = 1": "Table 'nope' does not exist", "DELETE FROM nope": "Table 'nope' does not exist",
        "DESCRIBE nope": "Table 'nope' does not exist", "DROP TABLE nope": "Table 'nope' does not exist", "CREATE TABLE x (a INT)": "Table must have a PRIMARY KEY", "CREATE TABLE x ()": "Table must have at least one column",
        "CREATE TABLE employees (id INT PRIMARY KEY)": "Table 'employees' already exists", "INSERT INTO employees VALUES (1)": "Column count (4) doesn't match value count (1)", "INSERT INTO employees (id, nope) VALUES (9, 1)": "Unknown column 'nope' in table 'employees'",
        "INSERT INTO employees (id) VALUES (9)": "Column 'name' cannot be NULL", "INSERT INTO employees (name) VALUES ('x')": "Column 'id' cannot be NULL", "INSERT INTO employees VALUES (1, 'A', 1, TRUE)": "Duplicate PRIMARY KEY value: 1",
        "SELECT nope FROM employees": "Unknown column 'nope'", "SELECT name FROM employees ORDER BY salary": "ORDER BY column 'salary' must be in SELECT list", "UPDATE employees SET nope = 1": "Unknown column 'nope'", "SELECT Name FROM employees": "Unknown column 'Name'",
        "INSERT INTO employees VALUES ('x', 'A', 1, TRUE)": "Column 'id' cannot hold x",
    }
    for text, message in cases.items():
        result = q(text)
        assert not result.ok and result.message.startswith(message), (text, result.message)
    assert q("DROP TABLE IF EXISTS nope").message == "OK"
    assert q("UPDATE employees SET nope = 1 WHERE id = 77").message == "0 row(s) updated."


def test_a_key_naming_no_column(session):
    run(session, "CREATE TABLE t (a INT, PRIMARY KEY (b))")
    assert session.sql("INSERT INTO t VALUES (1)").message == "PRIMARY KEY 'b' value required"


def test_changes(session):
    run(session, "CREATE TABLE products (id INT PRIMARY KEY, name TEXT NOT NULL, price FLOAT)", "INSERT INTO products VALUES (1, 'Widget', 9.99)", "INSERT INTO products VALUES (2, 'Gadget', 19.99)", "INSERT INTO products VALUES (3, 'Doohickey', 4.99)")
    assert run(session, "UPDATE products SET price = 14.99 WHERE id = 1").message == "1 row(s) updated."
    assert run(session, "UPDATE products SET price = 0.00 WHERE price < 15").message == "2 row(s) updated."
    assert run(session, "DELETE FROM products WHERE id = 3").message == "1 row(s) deleted."
    assert session.sql("SELECT id, price FROM products").rows == [(1, 0.0), (2, 19.99)]
    assert run(session, "DELETE FROM products WHERE price = 0.00").message == "1 row(s) deleted."
    assert session.sql("SELECT name FROM products").rows == [("Gadget",)]
    run(session, "UPDATE products SET price = 1, price = 2", "UPDATE products SET name = NULL")
    assert session.sql("SELECT * FROM products").rows == [(2, None, 2.0)]


def test_a_changed_primary_key_keeps_its_row(session):
    run(session, "CREATE TABLE t (id INT PRIMARY KEY, v TEXT)", "INSERT INTO t VALUES (1, 'a')", "INSERT INTO t VALUES (2, 'b')", "UPDATE t SET id = 9 WHERE id = 1")
    assert session.sql("SELECT * FROM t").rows == [(9, "a"), (2, "b")]
    assert session.sql("INSERT INTO t VALUES (1, 'x')").message == "Duplicate PRIMARY KEY value: 1"
    run(session, "INSERT INTO t VALUES (9, 'y')")
    assert session.sql("SELECT id, v FROM t ORDER BY id").rows == [(2, "b"), (9, "a"), (9, "y")]


def test_key_order_and_rounding(session):
    run(session, "CREATE TABLE n (id INT PRIMARY KEY)", *[f"INSERT INTO n VALUES ({k})" for k in (-5, -1, 0, 5, 9999999999, 10000000000)])
    assert [r[0] for r in session.sql("SELECT * FROM n").rows] == [-1, -5, 0, 5, 10000000000, 9999999999]
    run(session, "CREATE TABLE f (id FLOAT PRIMARY KEY)", "INSERT INTO f VALUES (1.001)")
    assert session.sql("INSERT INTO f VALUES (1.004)").message == "Duplicate PRIMARY KEY value: 1.00"
    run(session, "CREATE TABLE t (id TEXT PRIMARY KEY)", *[f"INSERT INTO t VALUES ('{k}')" for k in ("", "A", "z", "~", "~a", "é")])
    assert [r[0] for r in session.sql("SELECT * FROM t").rows] == ["", "A", "z", "~", "~a", "é"]


def test_nulls(session):
    run(session, "CREATE TABLE t (id INT PRIMARY KEY, v TEXT)", "INSERT INTO t VALUES (1, 'a')", "INSERT INTO t (id) VALUES (2)")
    ids = lambda where: [r[0] for r in session.sql(f"SELECT id FROM t WHERE {where}").rows]
    assert (ids("v != 'a'"), ids("v = NULL"), ids("v != NULL"), ids("v < 'z'")) == ([2], [], [1, 2], [1])
    assert session.sql("SELECT v, id FROM t ORDER BY v").rows == [(None, 2), ("a", 1)] and session.sql("SELECT v, id FROM t ORDER BY v DESC").rows == [("a", 1), (None, 2)]


def test_introspection_and_reopening(spark, folder, employees):
    run(employees, "CREATE TABLE b (k TEXT PRIMARY KEY)", "CREATE TABLE Z (k BOOLEAN PRIMARY KEY)")
    assert employees.sql("SHOW TABLES").rows == [("Z",), ("b",), ("employees",)] and employees.sql("SHOW TABLES").message == "3 table(s)."
    assert employees.sql("DESCRIBE employees").rows == [("id", "INT", "YES", "YES"), ("name", "TEXT", "YES", "NO"), ("salary", "FLOAT", "NO", "NO"), ("active", "BOOL", "NO", "NO")]
    run(employees, "DROP TABLE b")
    again = Session(spark, f"{folder}/db")
    assert again.sql("SHOW TABLES").rows == [("Z",), ("employees",)]
    assert again.sql("SELECT name FROM employees WHERE active = FALSE").rows == [("Charlie",)]
    run(again, "CREATE TABLE b (k TEXT PRIMARY KEY)")
    assert again.sql("SELECT * FROM b").rows == []


def test_row_numbers_for_statement_values(session):
    run(session, "CREATE TABLE t (id INT PRIMARY KEY, v TEXT)")
    for _ in range(2):
        assert session.insert_auto(S.Insert("t", ("v",), (Value(TEXT, "x"),))).ok
    run(session, "INSERT INTO t VALUES (7, 'y')")
    assert session.insert_auto(S.Insert("t", ("id", "v"), (Value(INT, None), Value(TEXT, "x")))).ok
    assert [r[0] for r in session.sql("SELECT id FROM t").rows] == [1, 2, 3, 7]


def test_many_rows_at_once(spark, employees):
    rows = spark.createDataFrame([(i, f"n{i}", float(i)) for i in range(10, 40)], "id long, name string, salary double")
    assert employees.insert_rows("employees", rows).message == "30 row(s) inserted."
    assert employees.sql("SELECT * FROM employees").message == "33 row(s) returned."
    assert employees.insert_rows("employees", rows.limit(1)).message.startswith("Duplicate PRIMARY KEY")
    assert employees.insert_rows("employees", spark.createDataFrame([(50, "a"), (50, "b")], "id long, name string")).message.startswith("Duplicate")
    assert employees.insert_rows("employees", spark.createDataFrame([(60,)], "id long")).message == "Column 'name' cannot be NULL"
    assert employees.sql("UPDATE employees SET salary = 1 WHERE id >= 10").message == "30 row(s) updated."


def test_external_tables(spark, session):
    session.register("orders", f"{SF}/orders.parquet", "o_orderkey")
    session.register("lineitem", f"{SF}/lineitem.parquet")
    before = spark.read.parquet(f"{SF}/orders.parquet").count()
    n = int(session.sql("DELETE FROM orders WHERE o_orderstatus = 'F'").message.split()[0])
    assert session.table("orders").count() == before - n
    run(session, "UPDATE orders SET o_orderpriority = 'X' WHERE o_orderkey < 10")
    assert session.sql("SELECT o_orderkey FROM orders WHERE o_orderdate = 1").message.startswith("Execution error")
    assert "read-only" in session.sql("DELETE FROM lineitem").message
    plan = session.select("SELECT o_orderkey FROM orders WHERE o_totalprice > 300000")._jdf.queryExecution().toString()
    assert "GreaterThan(o_totalprice,300000.0)" in plan  # the base's scan filters, also under changes


def test_top_k_plan_and_pruned_scan(session):
    session.register("orders", f"{SF}/orders.parquet", "o_orderkey")
    plan = session.select("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000 ORDER BY o_totalprice DESC LIMIT 10")._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


def test_lenient(spark, folder):
    s = Session(spark, f"{folder}/l", lenient=True)
    run(s, "CREATE TABLE t (id INT PRIMARY KEY)", "INSERT INTO t VALUES (1), (2)")
    assert s.sql("SELECT * FROM t GROUP BY id").rows == [(1,)]


def test_rendering(employees):
    result = employees.sql("SELECT id, salary, active FROM employees WHERE id = 1")
    assert json.loads(result.to_json()) == {"ok": True, "message": "1 row(s) returned.", "columns": ["id", "salary", "active"], "rows": [["1", "75000.50", "TRUE"]]}
    assert result.table().splitlines()[1:4:2] == ["| id | salary   | active |", "| 1  | 75000.50 | TRUE   |"]


def test_servers(spark, folder, employees):
    with Server(KVStore(spark, f"{folder}/kv"), employees, port=0).start() as server, Client(port=server.server_address[1]) as c:
        for k, v in (("scan_1", "AAA"), ("scan_2", "BBB"), ("scan_3", "CCC"), ("scan_4", "DDD")):
            c.put(k, v)
        assert c.scan("scan_2", "scan_3") == [("scan_2", "BBB"), ("scan_3", "CCC")]
        c.delete("scan_2")
        assert c.get("scan_2") is None and c.get("scan_1") == "AAA"
        assert c.execute_sql("SELECT name, salary FROM employees WHERE id = 2") == {"ok": True, "message": "1 row(s) returned.", "columns": ["name", "salary"], "rows": [["Bob", "82000.00"]]}
        assert not c.execute_sql("nonsense")["ok"]
        server.shutdown()
    http = http_server(employees)
    Thread(target=http.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{http.server_address[1]}"
    ask = lambda path, body=None: json.loads(urllib.request.urlopen(urllib.request.Request(url + path, body), timeout=60).read())
    assert ask("/api/health")["ok"] and ask("/api/sql", b'{"sql": "SHOW TABLES"}')["rows"] == [["employees"]]
    for path, body, code in (("/api/sql", b"{}", 400), ("/nope", None, 404)):
        with pytest.raises(urllib.error.HTTPError) as e:
            ask(path, body)
        assert e.value.code == code
    http.shutdown()

import math
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from keystrata.functions import values as V
from keystrata.plans import statements as S
from keystrata.plans.lexer import ParseError, tokenize
from keystrata.plans.parser import parse
from keystrata.plans.predicates import fold
from tests.model import matches

I, X, T, B = V.INT, V.FLOAT, V.TEXT, V.BOOL


def kinds_of(sql):
    return [(t.kind, t.text) for t in tokenize(sql)[:-1]]


def test_tokens():
    assert kinds_of("select A_1 <> -3 'it''s' \"x\"\"y\"") == [("SELECT", "select"), ("identifier", "A_1"), ("symbol", "!="), ("integer", "-3"), ("string", "it's"), ("string", 'x"y')]
    assert kinds_of("1e5 5. 1.2.3") == [("integer", "1"), ("identifier", "e5"), ("number", "5."), ("number", "1.2"), ("symbol", "."), ("integer", "3")]
    assert kinds_of("'open") == [("string", "open")] and kinds_of("''") == [("string", "")]
    for bad in ("a + 1", "a -- b", "é", "a ! b", "a / b", "[x]"):
        with pytest.raises(ParseError):
            tokenize(bad)


@given(st.text())
def test_string_literals_round_trip(s):
    assert kinds_of("'" + s.replace("'", "''") + "'") == [("string", s)]


def test_statements():
    made = parse("CREATE TABLE t (id INT PRIMARY KEY, name VARCHAR(20) NOT NULL score REAL, PRIMARY KEY (name))")
    assert made == S.CreateTable("t", (S.Column("id", I, True, True), S.Column("name", T, True, True), S.Column("score", X)), "name")
    assert parse("insert into t (a b,) values (1, 2.5 'x' NULL, TRUE)") == S.Insert("t", ("a", "b"), (V.Value(I, 1), V.Value(X, 2.5), V.Value(T, "x"), V.Value(T, None), V.Value(B, True)))
    assert parse("SELECT a, a FROM t WHERE a = 1 OR b <> 'x' AND c >= -2.5 ORDER BY a DESC LIMIT 3;") == S.Select(
        "t", ("a", "a"), (S.Condition("a", "=", V.Value(I, 1)), S.Condition("b", "!=", V.Value(T, "x"), "OR"), S.Condition("c", ">=", V.Value(X, -2.5), "AND")), "a", True, 3
    )
    assert parse("UPDATE t SET a = 1, b = 'x'") == S.Update("t", (("a", V.Value(I, 1)), ("b", V.Value(T, "x"))))
    assert parse("DELETE FROM t WHERE a < 0").where[0].op == "<"
    assert parse("drop table if exists t") == S.DropTable("t", True)
    assert parse("SHOW TABLES") == S.ShowTables() and parse("describe t") == S.Describe("t")


@pytest.mark.parametrize(("text", "n"), [("2.7", 2), ("'3'", 3), ("-1", None), ("0", 0)])
def test_limits(text, n):
    assert parse(f"SELECT * FROM t LIMIT {text}").limit == n


@pytest.mark.parametrize(
    "bad",
    [
        "", "FOOBAR baz", "SELECT", "SELECT * t", "SELECT COUNT(*) FROM t", "SELECT a b FROM t", "SELECT a, FROM t", "SELECT text FROM t", "SELECT * FROM t LIMIT abc", "SELECT * FROM t WHERE a", "SELECT * FROM t WHERE a IN 1",
        "SELECT * FROM t WHERE (a = 1)", "SELECT * FROM t WHERE a = b", "CREATE TABLE t (a FLOAT(3))", "CREATE TABLE t (a DATE)", "CREATE TABLE IF NOT EXISTS t (a INT)", "CREATE TABLE t (a INT, PRIMARY KEY (a, b))",
        "INSERT INTO t VALUES (1", "UPDATE t SET a = 1 b = 2", "UPDATE t SET a > 1", "INSERT INTO t VALUES (99999999999999999999)",
    ],
)
def test_what_does_not_parse(bad):
    with pytest.raises(ParseError):
        parse(bad)


@pytest.mark.parametrize("tail", ["GROUP", "JOIN b", "OFFSET 3", "; SELECT * FROM u", ", b", "LIMIT 1 ORDER BY a"])
def test_what_follows_a_statement(tail):
    text = f"SELECT * FROM t {tail}"
    with pytest.raises(ParseError):
        parse(text)
    assert parse(text, lenient=True).table == "t"


def test_prefix_numbers():
    assert [V.parse_integer(s) for s in ("12abc", " \t-7", "+3", "abc", "", "9" * 30, "-9223372036854775808")] == [12, -7, 3, None, None, None, -(1 << 63)]
    assert [V.parse_float(s) for s in ("1.5x", "-.5", "1e3z", "0x1p3", "inf", "abc", "1e999", "5.")] == [1.5, -0.5, 1000.0, 8.0, math.inf, None, None, 5.0]
    assert math.isnan(V.parse_float("nan"))


def test_coercion_matrix():
    L = V.Value
    table = {
        I: [(L(X, 1.9), 1), (L(X, -1.9), -1), (L(T, "12abc"), 12), (L(T, "x"), 0), (L(B, True), 0), (L(T, None), None)],
        X: [(L(I, 2), 2.0), (L(T, "2.5x"), 2.5), (L(T, "x"), 0.0), (L(B, True), 0.0)],
        T: [(L(I, 5), "5"), (L(X, 5.0), "5.00"), (L(B, False), "FALSE"), (L(T, "a"), "a")],
        B: [(L(I, 1), False), (L(T, "TRUE"), False), (L(X, 1.0), False), (L(B, True), True)],
    }
    for kind, cases in table.items():
        for literal, expected in cases:
            assert V.comparand(literal, kind) == expected
    assert V.convert(L(B, True), I) is None and V.convert(L(I, 1), B) is None and V.convert(L(T, "q"), X) is None


def test_key_text_and_rendering():
    assert sorted([-5, -1, 0, 5, 9999999999, 10000000000], key=lambda n: V.key_text(I, n)) == [-1, -5, 0, 5, 10000000000, 9999999999]
    assert V.key_text(X, 1.001) == V.key_text(X, 1.004) and V.key_text(B, True) == "TRUE" and V.key_text(T, "~a") == "~a"
    assert [V.render(X, x) for x in (2.675, 1.005, math.inf, math.nan, -0.0)] == ["2.67", "1.00", "inf", "nan", "-0.00"] and V.render(T, None) == "NULL"


KINDS = {"i": I, "f": X, "t": T, "b": B}


def table(spark):
    rng, rows = random.Random(4), []
    cells = {"i": [None, -5, 0, 3, 12, 1 << 40], "f": [None, math.nan, math.inf, -math.inf, -0.0, 0.0, 1.5, 12.0], "t": [None, "", "12", "abc", "é", "~", "5.00", "TRUE"], "b": [None, True, False]}
    for n in range(150):
        rows.append((n, *(rng.choice(cells[c]) for c in "iftb")))
    return rows, spark.createDataFrame(rows, "n long, i long, f double, t string, b boolean").cache()


def test_predicates_equal_the_model(spark):
    rows, df = table(spark)
    rng = random.Random(9)
    literals = [V.Value(I, 0), V.Value(I, 12), V.Value(I, -5), V.Value(X, 1.5), V.Value(X, -1.9), V.Value(T, "12abc"), V.Value(T, "abc"), V.Value(T, "nan"), V.Value(T, ""), V.Value(T, "é"), V.Value(B, True), V.Value(B, False), V.Value(T, None)]
    chains = []
    for _ in range(160):
        chains.append(tuple(S.Condition(rng.choice(["i", "f", "t", "b", "i", "f", "t", "b", "nope"]), rng.choice(["=", "!=", "<", ">", "<=", ">="]), rng.choice(literals), None if not k else rng.choice(["AND", "OR"])) for k in range(rng.randrange(1, 5))))
    found = df.select("n", *[fold(c, KINDS).alias(f"c{k}") for k, c in enumerate(chains)]).collect()
    named = {r["n"]: r for r in found}
    for row in rows:
        cells = dict(zip(["n", *"iftb"], row, strict=True))
        for k, c in enumerate(chains):
            assert bool(named[row[0]][f"c{k}"]) == matches(cells, c, KINDS), (cells, c)


def test_left_fold_over_all_truth_values(spark):
    rows = [(a, b, c) for a in (True, False) for b in (True, False) for c in (True, False)]
    df = spark.createDataFrame(rows, "a boolean, b boolean, c boolean")
    where = parse("SELECT * FROM t WHERE a = TRUE OR b = TRUE AND c = TRUE").where
    assert sorted(tuple(r) for r in df.where(fold(where, dict.fromkeys("abc", B))).collect()) == sorted(r for r in rows if (r[0] or r[1]) and r[2])

"""Statements in, results out."""

from __future__ import annotations

import json
import struct
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.functions.columns import key_text as key_column
from keystrata.functions.values import INT, TEXT, Value, convert, key_text, kind_of, render
from keystrata.operators.merge import DELETE, PUT
from keystrata.plans import messages as M
from keystrata.plans import statements as S
from keystrata.plans.lexer import ParseError
from keystrata.plans.parser import parse
from keystrata.plans.predicates import UnsupportedColumn, fold
from keystrata.plans.select import PlanError, plan_select
from keystrata.sources.catalog import Catalog, Table

OK, INVALID_ARGUMENT = "OK", "INVALID_ARGUMENT"
#: Changed rows up to this number go through the memtable and its log; more become a segment at once.
SMALL_CHANGE = 1000


class StatementError(ValueError):
    pass


def _first_line(e: Exception) -> str:
    return (str(e).strip() or type(e).__name__).splitlines()[0]


@dataclass
class Result:
    """A statement's outcome. ``df`` is lazy; ``rows`` and the message of a SELECT run it once."""

    status: str = OK
    text: str | None = None
    df: DataFrame | None = None
    _rows: list[tuple] | None = field(default=None, repr=False)

    @property
    def ok(self) -> bool:
        return self.status == OK

    @property
    def columns(self) -> list[str]:
        return [] if self.df is None else self.df.columns

    @property
    def rows(self) -> list[tuple]:
        if self._rows is None:
            self._rows = [] if self.df is None else [tuple(r) for r in self.df.collect()]
        return self._rows

    @property
    def message(self) -> str:
        return M.RETURNED.format(len(self.rows)) if self.text is None else self.text

    def rendered(self) -> list[list[str]]:
        """All cells as text."""
        kinds = [] if self.df is None else [kind_of(f.dataType) for f in self.df.schema.fields]
        return [[render(k or TEXT, v) for k, v in zip(kinds, row, strict=True)] for row in self.rows]

    def table(self) -> str:
        """The result as the prompt shows it."""
        if self.df is None:
            return self.message
        cells = [self.columns, *self.rendered()]
        widths = [max(len(r[i]) for r in cells) for i in range(len(self.columns))]
        line = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
        show = ["| " + " | ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)) + " |" for r in cells]
        return "\n".join([line, show[0], line, *show[1:], line, self.message])

    def to_json(self) -> str:
        return json.dumps({"ok": self.ok, "message": self.message, "columns": self.columns, "rows": self.rendered()})

    def to_wire(self) -> bytes:
        """Message, columns and rows as counted strings, little-endian."""
        text = lambda s: struct.pack("<I", len(b := s.encode())) + b
        rows = self.rendered()
        parts = [text(self.message), struct.pack("<I", len(self.columns)), *map(text, self.columns), struct.pack("<I", len(rows))]
        return b"".join(parts + [text(c) for r in rows for c in r])


class Session:
    """Runs the dialect over a catalog folder.

    ``lenient`` ignores what follows a complete statement. Identifiers keep their case; the Spark session's
    ``spark.sql.caseSensitive`` is left alone, so a table with two columns that differ in case alone is refused unless it is set.
    """

    def __init__(self, spark: SparkSession, root: str, lenient: bool = False):
        self.spark, self.lenient, self.catalog = spark, lenient, Catalog(spark, root)

    def sql(self, text: str) -> Result:
        """Never raises: the result says what is wrong. The rows of a SELECT are fetched when they are asked for."""
        try:
            statement = parse(text, self.lenient)
        except ParseError as e:
            return Result(INVALID_ARGUMENT, f"Parse error: SQL parse error: {e}")
        except Exception as e:  # nothing that a text can hold may end a server
            return Result(INVALID_ARGUMENT, f"Parse error: {_first_line(e)}")
        return self.execute(statement)

    def execute(self, statement: S.Statement) -> Result:
        run = {S.CreateTable: self._create, S.DropTable: self._drop, S.Insert: self._insert, S.Select: self._select, S.Update: self._update, S.Delete: self._delete, S.ShowTables: self._show, S.Describe: self._describe}
        try:
            return run[type(statement)](statement)
        except (StatementError, PlanError) as e:
            return Result(INVALID_ARGUMENT, str(e))
        except UnsupportedColumn as e:
            return Result(INVALID_ARGUMENT, f"Execution error: {e}")
        except Exception as e:  # whatever fails below: storage, Spark
            return Result(INVALID_ARGUMENT, f"Execution error: {_first_line(e)}")

    def select(self, text: str) -> DataFrame:
        """A SELECT as a DataFrame, in no order unless the text gives one; raises for a bad statement."""
        statement = parse(text, self.lenient)
        if not isinstance(statement, S.Select):
            raise StatementError("not a SELECT")
        t = self._table(statement.table)
        return plan_select(statement, t.frame(), t.kinds, ordered=False)

    def table(self, name: str) -> DataFrame:
        """The live rows, in no order."""
        t = self._table(name)
        return t.frame().select([F.col(f"`{c}`") for c in t.kinds])

    def register(self, name: str, path: str, primary_key: str | None = None) -> None:
        self.catalog.register(name, path, primary_key)

    def _table(self, name: str) -> Table:
        t = self.catalog.get(name)
        if t is None:
            raise StatementError(M.NO_TABLE.format(name))
        return t

    def _writable(self, name: str) -> Table:
        t = self._table(name)
        if t.store is None:
            raise StatementError(f"Table '{name}' has no PRIMARY KEY and is read-only")
        return t

    # definition

    def _create(self, s: S.CreateTable) -> Result:
        if not s.name:
            raise StatementError(M.NO_NAME)
        if not s.columns:
            raise StatementError(M.NO_COLUMNS)
        if not s.primary_key:
            raise StatementError(M.NO_KEY)
        if self.catalog.get(s.name) is not None:
            raise StatementError(M.TABLE_EXISTS.format(s.name))
        if len({c.name for c in s.columns}) < len(s.columns):
            raise StatementError("column names must differ")
        if self.spark.conf.get("spark.sql.caseSensitive") != "true" and len({c.name.lower() for c in s.columns}) < len(s.columns):
            raise StatementError("columns whose names differ in case alone need spark.sql.caseSensitive")
        self.catalog.create(s.name, list(s.columns), s.primary_key)
        return Result(text=M.CREATED.format(s.name))

    def _drop(self, s: S.DropTable) -> Result:
        if self.catalog.get(s.name) is None:
            if s.if_exists:
                return Result(text=M.NOTHING_DROPPED)
            raise StatementError(M.NO_TABLE.format(s.name))
        self.catalog.drop(s.name)
        return Result(text=M.DROPPED.format(s.name))

    def _show(self, s: S.ShowTables) -> Result:
        names = self.catalog.names()
        return Result(text=M.TABLES.format(len(names)), df=self.spark.createDataFrame([(n,) for n in names], "table_name string").orderBy("table_name"), _rows=[(n,) for n in names])

    def _describe(self, s: S.Describe) -> Result:
        t, say = self._table(s.table), {True: "YES", False: "NO"}
        rows = [(c.name, c.kind, say[c.not_null], say[c.primary_key]) for c in t.columns]
        return Result(text=M.COLUMNS.format(len(rows)), df=self.spark.createDataFrame(rows, "column_name string, type string, not_null string, primary_key string"), _rows=rows)

    # rows

    def _select(self, s: S.Select) -> Result:
        t = self._table(s.table)
        return Result(df=plan_select(s, t.frame(), t.kinds))

    def _coerced(self, t: Table, name: str, v: Value):
        kind = t.kinds[name]
        c = None if kind is None else convert(v, kind)
        if c is None:
            raise StatementError(f"Column '{name}' cannot hold {render(v.kind, v.value)}")
        return c.value

    def _insert(self, s: S.Insert, auto_key: bool = False) -> Result:
        """``auto_key`` gives a row without a key the table's next row number; text never reaches it."""
        t = self._writable(s.table)
        names = list(s.columns) or list(t.kinds)
        if len(names) != len(s.values):
            raise StatementError(M.COUNTS_DIFFER.format(len(names), len(s.values)))
        row: dict[str, object] = dict.fromkeys(t.kinds)
        for name, v in zip(names, s.values, strict=True):
            if name not in t.kinds:
                raise StatementError(M.NO_COLUMN_IN.format(name, s.table))
            row[name] = self._coerced(t, name, v)
        key = t.primary_key
        if auto_key and key in row and row[key] is None and t.kinds[key] == INT:
            row[key] = self.catalog.next_row_id(s.table)
        for c in t.columns:
            if c.not_null and row[c.name] is None:
                raise StatementError(M.NULL_CELL.format(c.name))
        if row.get(key) is None:
            raise StatementError(M.NULL_KEY.format(key))
        text = key_text(t.kinds[key], row[key])
        if t.store.get(text) is not None:
            raise StatementError(M.SAME_KEY.format(render(t.kinds[key], row[key])))
        t.store.apply([(PUT, text, tuple(row.values()))])
        return Result(text=M.INSERTED)

    def insert_auto(self, s: S.Insert) -> Result:
        """INSERT as a statement value, with row numbers for missing integer keys."""
        try:
            return self._insert(s, auto_key=True)
        except StatementError as e:
            return Result(INVALID_ARGUMENT, str(e))

    def insert_rows(self, name: str, rows: DataFrame) -> Result:
        """Many rows at once, all or none; columns by name, missing ones NULL."""
        try:
            t = self._writable(name)
            unknown = [c for c in rows.columns if c not in t.kinds]
            if unknown:
                raise StatementError(M.NO_COLUMN_IN.format(unknown[0], name))
            types = {f.name: f.dataType for f in t.store.payload.fields}
            full = rows.select([(F.col(f"`{c}`") if c in rows.columns else F.lit(None)).cast(types[c]).alias(c) for c in t.kinds])
            for c in t.columns:
                if c.not_null and not full.where(F.col(f"`{c.name}`").isNull()).isEmpty():
                    raise StatementError(M.NULL_CELL.format(c.name))
            keyed = full.withColumn("_key", key_column(t.kinds[t.primary_key], F.col(f"`{t.primary_key}`")))
            twice = keyed.groupBy("_key").count().where("count > 1").select("_key").limit(1)
            there = keyed.join(t.frame().select("_key"), "_key", "left_semi").select("_key").limit(1)
            if (hit := twice.union(there).head()) is not None:
                raise StatementError(M.SAME_KEY.format(hit[0]))
            return Result(text=f"{t.store.append(keyed.withColumn('_op', F.lit(PUT)))} row(s) inserted.")
        except StatementError as e:
            return Result(INVALID_ARGUMENT, str(e))

    def _change(self, t: Table, changed: DataFrame, op: str) -> int:
        """Writes new versions of ``changed`` (_key and the columns), small changes through the log; how many."""
        columns = [F.col("_key"), *[F.col(f"`{c}`") for c in t.kinds]]
        rows, n, aside = t.store.staged(changed.select(columns))  # the scan and the filter run once
        if n <= SMALL_CHANGE and None not in t.kinds.values():
            t.store.apply([(op, r[0], tuple(r)[1:] if op == PUT else None) for r in rows.collect()])
        else:
            t.store.append(rows.withColumn("_op", F.lit(op)))
        t.store.files.delete(aside)
        return n

    def _update(self, s: S.Update) -> Result:
        t = self._writable(s.table)
        matched = t.frame().where(fold(s.where, t.kinds)) if s.where else t.frame()
        values = {}
        for name, v in s.assignments:
            if name not in t.kinds:
                if matched.isEmpty():
                    return Result(text=M.UPDATED.format(0))
                raise StatementError(M.NO_COLUMN.format(name))
            values[name] = F.lit(self._coerced(t, name, v)).cast(t.store.payload[name].dataType)
        # rows keep their key, also where the primary key's column is set
        changed = matched.select("_key", *[(values[c] if c in values else F.col(f"`{c}`")).alias(c) for c in t.kinds])
        return Result(text=M.UPDATED.format(self._change(t, changed, PUT)))

    def _delete(self, s: S.Delete) -> Result:
        t = self._writable(s.table)
        matched = t.frame().where(fold(s.where, t.kinds)) if s.where else t.frame()
        return Result(text=M.DELETED.format(self._change(t, matched, DELETE)))



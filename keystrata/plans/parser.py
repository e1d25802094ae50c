"""Recursive descent over the tokens.

Strict by default: what follows a complete statement is an error. ``lenient`` ignores it, as it
ignores a second VALUES tuple, OFFSET, or a join.
"""

from __future__ import annotations

from keystrata.functions.values import BOOL, FLOAT, INT, SPELLINGS, TEXT, Value, parse_integer
from keystrata.plans import statements as S
from keystrata.plans.lexer import END, INTEGER, NUMBER, STRING, SYMBOL, WORD, ParseError, Token, tokenize

OPERATORS = ("=", "!=", "<", ">", "<=", ">=")


class _Parser:
    def __init__(self, sql: str):
        self.tokens, self.at = tokenize(sql), 0

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def take(self) -> Token:
        token = self.now
        self.at += token.kind != END
        return token

    def found(self, kind: str, text: str | None = None) -> bool:
        if self.now.kind == kind and text in (None, self.now.text):
            self.take()
            return True
        return False

    def need(self, kind: str, text: str | None = None) -> Token:
        token = self.now
        if not self.found(kind, text):
            raise ParseError(f"expected {text or kind}, got '{token.text}' at position {token.at}")
        return token

    def symbol(self, text: str) -> bool:
        return self.found(SYMBOL, text)

    def name(self) -> str:
        return self.need(WORD).text

    # statements

    def statement(self) -> S.Statement:
        kinds = {"CREATE": self.create, "DROP": self.drop, "INSERT": self.insert, "SELECT": self.select, "UPDATE": self.update, "DELETE": self.delete, "SHOW": self.show, "DESCRIBE": self.describe}
        token = self.take()
        if token.kind not in kinds:
            raise ParseError(f"unexpected token '{token.text}'")
        return kinds[token.kind]()

    def create(self) -> S.CreateTable:
        self.need("TABLE")
        name, columns, key = self.name(), [], None
        self.need(SYMBOL, "(")
        while not self.symbol(")"):
            if self.found("PRIMARY"):
                self.need("KEY")
                self.need(SYMBOL, "(")
                key = self.name()
                self.need(SYMBOL, ")")
            else:
                column = self.column()
                columns.append(column)
                key = column.name if column.primary_key else key
            self.symbol(",")  # commas may be left out
        columns = [S.Column(c.name, c.kind, True, True) if c.name == key else c for c in columns]
        return S.CreateTable(name, tuple(columns), key)

    def column(self) -> S.Column:
        name, spelled = self.name(), self.take()
        kind = SPELLINGS.get(spelled.kind)
        if kind is None:
            raise ParseError(f"expected column type, got '{spelled.text}'")
        if kind == TEXT and self.symbol("("):  # a length, without effect
            self.need(INTEGER)
            self.need(SYMBOL, ")")
        not_null = key = False
        while True:
            if self.found("NOT"):
                self.need("NULL")
                not_null = True
            elif self.found("PRIMARY"):
                self.need("KEY")
                key = not_null = True
            else:
                return S.Column(name, kind, not_null, key)

    def drop(self) -> S.DropTable:
        self.need("TABLE")
        there = self.found("IF")
        if there:
            self.need("EXISTS")
        return S.DropTable(self.name(), there)

    def insert(self) -> S.Insert:
        self.need("INTO")
        table, columns = self.name(), []
        if self.symbol("("):
            while not self.symbol(")"):
                columns.append(self.name())
                self.symbol(",")
        self.need("VALUES")
        self.need(SYMBOL, "(")
        values = []
        while not self.symbol(")"):
            values.append(self.value())
            self.symbol(",")
        return S.Insert(table, tuple(columns), tuple(values))

    def select(self) -> S.Select:
        columns = None
        if not self.symbol("*"):
            columns = [self.name()]
            while self.symbol(","):
                columns.append(self.name())
        self.need("FROM")
        table, where = self.name(), self.where()
        order, down, limit = None, False, None
        if self.found("ORDER"):
            self.need("BY")
            order = self.name()
            down = self.found("DESC")
            if not down:
                self.found("ASC")
        if self.found("LIMIT"):
            token = self.take()
            limit = parse_integer(token.text)
            if limit is None or not -(1 << 31) <= limit < 1 << 31:
                raise ParseError(f"LIMIT takes a number, got '{token.text}'")
            limit = None if limit < 0 else limit
        return S.Select(table, None if columns is None else tuple(columns), where, order, down, limit)

    def update(self) -> S.Update:
        table = self.name()
        self.need("SET")
        assignments = [self.assignment()]
        while self.symbol(","):
            assignments.append(self.assignment())
        return S.Update(table, tuple(assignments), self.where())

    def assignment(self) -> tuple[str, Value]:
        name = self.name()
        self.need(SYMBOL, "=")
        return name, self.value()

    def delete(self) -> S.Delete:
        self.need("FROM")
        return S.Delete(self.name(), self.where())

    def show(self) -> S.ShowTables:
        self.need("TABLES")
        return S.ShowTables()

    def describe(self) -> S.Describe:
        return S.Describe(self.name())

    # parts

    def where(self) -> tuple[S.Condition, ...]:
        if not self.found("WHERE"):
            return ()
        conditions = [self.condition(None)]
        while self.now.kind in ("AND", "OR"):
            conditions.append(self.condition(self.take().kind))
        return tuple(conditions)

    def condition(self, link: str | None) -> S.Condition:
        column, token = self.name(), self.take()
        if token.kind != SYMBOL or token.text not in OPERATORS:
            raise ParseError(f"expected comparison operator, got '{token.text}'")
        return S.Condition(column, token.text, self.value(), link)

    def value(self) -> Value:
        token = self.take()
        if token.kind == INTEGER:
            n = parse_integer(token.text)
            if n is None:
                raise ParseError(f"integer out of range: '{token.text}'")
            return Value(INT, n)
        if token.kind == NUMBER:
            return Value(FLOAT, float(token.text))
        if token.kind == STRING:
            return Value(TEXT, token.text)
        if token.kind in ("TRUE", "FALSE"):
            return Value(BOOL, token.kind == "TRUE")
        if token.kind == "NULL":
            return Value(TEXT, None)
        raise ParseError(f"expected value, got '{token.text}'")


def parse(sql: str, lenient: bool = False) -> S.Statement:
    parser = _Parser(sql)
    statement = parser.statement()
    if not lenient:
        parser.symbol(";")
        if parser.now.kind != END:
            raise ParseError(f"unexpected '{parser.now.text}' after the statement, at position {parser.now.at}")
    return statement

"""Tokens of the dialect. Keywords have no case, identifiers do; ``"x"`` is a string like ``'x'``."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: The reserved words.
KEYWORDS = frozenset(
    "CREATE TABLE DROP INSERT INTO VALUES SELECT FROM WHERE UPDATE SET DELETE AND OR NOT NULL PRIMARY KEY INT INTEGER FLOAT REAL DOUBLE TEXT STRING VARCHAR BOOL BOOLEAN TRUE FALSE IF EXISTS ORDER BY ASC DESC LIMIT SHOW TABLES DESCRIBE".split()
)
WORD, INTEGER, NUMBER, STRING, SYMBOL, END = "identifier", "integer", "number", "string", "symbol", "end of input"

_TOKEN = re.compile(
    r"""(?P<space>[ \t\n\v\f\r]+)
      | (?P<word>[A-Za-z_][A-Za-z0-9_]*)
      | (?P<num>-?[0-9]+(?:\.[0-9]*)?|-(?=\.?[0-9])\.[0-9]*)
      | (?P<single>'(?:[^']|'')*(?:'|\Z))
      | (?P<double>"(?:[^"]|"")*(?:"|\Z))
      | (?P<sym><=|>=|<>|!=|[=<>(),;*.])""",
    re.VERBOSE,
)


class ParseError(ValueError):
    pass


@dataclass(frozen=True)
class Token:
    """``kind`` is a keyword in upper case or one of the classes above."""

    kind: str
    text: str
    at: int


def tokenize(sql: str) -> list[Token]:
    """All tokens and a final END; an unterminated string runs to the end of the text."""
    tokens, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise ParseError(f"unexpected character '{sql[at]}' at position {at}")
        text = m[0]
        if m.lastgroup == "word":
            upper = text.upper()
            tokens.append(Token(upper if upper in KEYWORDS else WORD, text, at))
        elif m.lastgroup == "num":
            tokens.append(Token(NUMBER if "." in text else INTEGER, text, at))
        elif m.lastgroup in ("single", "double"):
            quote, body = text[0], text[1:]
            body = body.replace(quote * 2, "\0") if "\0" not in body else body
            closed = body.endswith(quote)
            body = body[:-1] if closed else body
            tokens.append(Token(STRING, body.replace("\0", quote) if "\0" not in text else body.replace(quote * 2, quote), at))
        elif m.lastgroup == "sym":
            tokens.append(Token(SYMBOL, "!=" if text == "<>" else text, at))
        at = m.end()
    return [*tokens, Token(END, "", len(sql))]

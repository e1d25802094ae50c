"""The four types: spelling, rendering, literal coercion and key text. Works on Python values, on the driver."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import types as T

INT, FLOAT, TEXT, BOOL = "INT", "FLOAT", "TEXT", "BOOL"

#: The accepted spellings of each type.
SPELLINGS = {"INT": INT, "INTEGER": INT, "FLOAT": FLOAT, "REAL": FLOAT, "DOUBLE": FLOAT, "TEXT": TEXT, "STRING": TEXT, "VARCHAR": TEXT, "BOOL": BOOL, "BOOLEAN": BOOL}
SPARK = {INT: T.LongType(), FLOAT: T.DoubleType(), TEXT: T.StringType(), BOOL: T.BooleanType()}

_INTEGER = re.compile(r"[ \t\n\v\f\r]*([+-]?\d+)")
_FLOAT = re.compile(r"[ \t\n\v\f\r]*([+-]?(?:0[xX](?:[0-9a-fA-F]+(?:\.[0-9a-fA-F]*)?|\.[0-9a-fA-F]+)(?:[pP][+-]?\d+)?|(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?|inf(?:inity)?|nan))", re.IGNORECASE)


@dataclass(frozen=True)
class Value:
    """A typed literal; ``value`` None is NULL."""

    kind: str
    value: int | float | str | bool | None


def kind_of(spark_type: T.DataType) -> str | None:
    """The dialect's type for a Spark type; None for types outside the four."""
    if isinstance(spark_type, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return INT
    if isinstance(spark_type, (T.DoubleType, T.FloatType)):
        return FLOAT
    if isinstance(spark_type, (T.StringType, T.VarcharType, T.CharType)):
        return TEXT
    return BOOL if isinstance(spark_type, T.BooleanType) else None


def render(kind: str, value) -> str:
    """Text of a value: NULL, decimal, two decimals, itself, TRUE or FALSE."""
    if value is None:
        return "NULL"
    if kind == BOOL:
        return "TRUE" if value else "FALSE"
    if kind == FLOAT:
        return f"{value:.2f}"
    return str(value)


def parse_integer(text: str) -> int | None:
    """The leading integer of a text as C reads it; None if there is none or it overflows 64 bits."""
    if not (m := _INTEGER.match(text)):
        return None
    n = int(m[1])
    return n if -(1 << 63) <= n < 1 << 63 else None


def parse_float(text: str) -> float | None:
    """The leading number of a text as C reads it, hexadecimal, ``inf`` and ``nan`` included; None if there is none or it overflows."""
    if not (m := _FLOAT.match(text)):
        return None
    word = m[1]
    if "x" in word.lower():
        try:
            return float.fromhex(word)
        except OverflowError:
            return None
    x = float(word)
    return None if math.isinf(x) and "inf" not in word.lower() else x


def convert(v: Value, kind: str) -> Value | None:
    """``v`` as ``kind``; None where no conversion exists."""
    if v.value is None or v.kind == kind:
        return Value(kind, v.value)
    if kind == TEXT:
        return Value(TEXT, render(v.kind, v.value))
    if kind == FLOAT and v.kind == INT:
        return Value(FLOAT, float(v.value))
    if kind == INT and v.kind == FLOAT:
        n = int(v.value) if math.isfinite(v.value) else -(1 << 63)
        return Value(INT, n if -(1 << 63) <= n < 1 << 63 else -(1 << 63))
    if kind == INT and v.kind == TEXT and (n := parse_integer(v.value)) is not None:
        return Value(INT, n)
    if kind == FLOAT and v.kind == TEXT and (x := parse_float(v.value)) is not None:
        return Value(FLOAT, x)
    return None


def comparand(v: Value, kind: str):
    """What a comparison with a cell of ``kind`` reads: the converted literal, or that type's zero where it does not convert."""
    zero = {INT: 0, FLOAT: 0.0, TEXT: "", BOOL: False}
    return zero[kind] if (c := convert(v, kind)) is None else c.value


def key_text(kind: str, value) -> str:
    """Primary-key text: integers as ``%010d``, the rest rendered; rows order by it bytewise."""
    return f"{value:010d}" if kind == INT else render(kind, value)

"""The byte form of a row: a count, then type, null flag, length and value of each cell, little-endian."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

from keystrata.functions.values import BOOL, FLOAT, INT, TEXT, Value

#: Codes of the types, layouts of a cell's head and of the values of fixed length.
TYPES = {INT: 1, FLOAT: 2, TEXT: 3, BOOL: 4}
HEAD = "<BBI"
FIXED = {INT: "<q", FLOAT: "<d", BOOL: "<B"}
_NAMES = {v: k for k, v in TYPES.items()}


def encode_row(values: list[Value]) -> bytes:
    parts = [struct.pack("<I", len(values))]
    for v in values:
        data = b"" if v.value is None else v.value.encode() if v.kind == TEXT else struct.pack(FIXED[v.kind], v.value)
        parts += [struct.pack(HEAD, TYPES[v.kind], v.value is None, len(data)), data]
    return b"".join(parts)


def decode_row(data: bytes) -> list[Value]:
    """The cells; ValueError where the bytes are cut short or a type is unknown."""
    try:
        (n,), at, out = struct.unpack_from("<I", data), 4, []
        for _ in range(n):
            code, null, size = struct.unpack_from(HEAD, data, at)
            at += struct.calcsize(HEAD)
            kind, raw = _NAMES[code], data[at : at + size]
            if len(raw) < size:
                raise ValueError("a row is cut short")
            value = None if null else raw.decode() if kind == TEXT else struct.unpack(FIXED[kind], raw)[0]
            out.append(Value(kind, bool(value) if kind == BOOL and value is not None else value))
            at += size
        return out
    except (struct.error, KeyError) as e:
        raise ValueError(f"no row: {e}") from e


def _little(c: Column, size: int) -> Column:
    """The ``size`` lowest bytes of an integer column, lowest first."""
    h = F.lpad(F.hex(c), 16, "0")
    return F.unhex(F.concat(*[F.substring(h, 15 - 2 * i, 2) for i in range(size)]))


def row_bytes(cells: list[tuple[str, Column]]) -> Column:
    """``encode_row`` of (type, column) cells without FLOAT, as a plan; FLOAT bits have no built-in function."""
    parts = [_little(F.lit(len(cells)), 4)]
    for kind, c in cells:
        if kind == FLOAT:
            raise ValueError("FLOAT cells are encoded by encode_row")
        data = {INT: lambda c: _little(c.cast("long"), 8), BOOL: lambda c: F.when(c, F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00"))), TEXT: lambda c: c.cast("binary")}[kind](c)
        code = F.unhex(F.lit(f"{TYPES[kind]:02x}"))
        whole = F.concat(code, F.unhex(F.lit("00")), _little(F.octet_length(data), 4), data)
        parts.append(F.coalesce(whole, F.concat(code, F.unhex(F.lit("0100000000")))))
    return F.concat(*parts)

"""The binary log: records of checksum, operation, lengths, key and value."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from keystrata.operators.log import MAX_KEY, MAX_VALUE

#: Codes of the operations, layout of a record's head.
CODES = {"PUT": 1, "DELETE": 2}
HEAD = "<IBII"
_NAMES = {v: k for k, v in CODES.items()}


def encode(op: str, key: bytes, value: bytes = b"") -> bytes:
    body = struct.pack("<BII", CODES[op], len(key), len(value)) + key + value
    return struct.pack("<I", zlib.crc32(body)) + body


def decode(data: bytes) -> Iterator[tuple[str, bytes, bytes]]:
    """The records before the first that is cut short, too long or damaged."""
    at, head = 0, struct.calcsize(HEAD)
    while at + head <= len(data):
        crc, code, k, v = struct.unpack_from(HEAD, data, at)
        end = at + head + k + v
        if k > MAX_KEY or v > MAX_VALUE or end > len(data) or zlib.crc32(data[at + 4 : end]) != crc or code not in _NAMES:
            return
        yield _NAMES[code], data[at + head : at + head + k], data[at + head + k : end]
        at = end


def hex_dump(data: bytes, width: int = 16) -> str:
    """Offset, bytes in hex and printable characters, ``width`` bytes a line."""
    lines = []
    for at in range(0, len(data), width):
        part = data[at : at + width]
        lines.append(f"{at:08x}  {' '.join(f'{b:02x}' for b in part):<{3 * width}} {''.join(chr(b) if 32 <= b < 127 else '.' for b in part)}")
    return "\n".join(lines)

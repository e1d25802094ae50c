"""Scalar kernels as Spark columns: key text, rendering and the two 32-bit string hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keystrata.functions.values import BOOL, FLOAT, INT

#: Offset basis and prime of 32-bit FNV-1a; multiplier, also the seed, of the mixing hash.
FNV_BASIS, FNV_PRIME, MIX = 2166136261, 16777619, 0x5BD1E995
_LOW = (1 << 32) - 1


def key_text(kind: str, c: Column) -> Column:
    """``values.key_text`` of a column; NULL stays NULL."""
    if kind == INT:
        return F.when(c.isNotNull(), F.format_string("%010d", c.cast("long")))
    return F.when(c.isNotNull(), render(kind, c))


def _hundredths(part: Column) -> Column:
    """100 * part rounded to a whole number, halves to even, for 0 <= part < 1: the product is taken with its rounding error, so nothing is lost."""

    def rounded(v: Column) -> Column:
        p, whole = v["p"], F.floor(v["p"])
        beyond = (p - whole - 0.5) + v["e"]  # both parts are exact, so the sum's sign is right
        up = F.when(beyond > 0, 1).when(beyond < 0, 0).otherwise(F.pmod(whole, F.lit(2)))
        return whole + up

    def product(x: Column) -> Column:
        high = let(x * 134217729.0, lambda t: t - (t - x))  # the upper half of the digits
        return let(high, lambda h: F.struct((x * 100.0).alias("p"), ((h * 100.0 - x * 100.0) + (x - h) * 100.0).alias("e")))

    return let(let(part, product), rounded)


def _two_decimals(c: Column) -> Column:
    """A finite double's text with two decimals as C prints it: of its exact binary value, halves to even; beyond 2**124 with its shortest digits and zeros."""
    size = F.abs(c)
    sign = F.when((c < 0) | (c.cast("string") == "-0.0"), "-").otherwise("")
    small = let(size, lambda x: let(F.struct(x.cast("long").alias("i"), _hundredths(x - x.cast("long")).alias("n")), lambda v: F.concat((v["i"] + F.floor(v["n"] / 100)).cast("string"), F.lit("."), F.lpad((v["n"] % 100).cast("string"), 2, "0"))))
    # a double from 2**53 on is whole: two halves of 62 bits each are exact
    step = float(1 << 62)
    large = let(size, lambda x: F.concat(((F.floor(x / step).cast("decimal(19,0)") * F.lit(1 << 62).cast("decimal(19,0)")) + (x - F.floor(x / step) * step).cast("long").cast("decimal(19,0)")).cast("decimal(38,0)").cast("string"), F.lit(".00")))
    return F.concat(sign, F.when(size < step, small).when(size < float(1 << 124), large).otherwise(F.format_string("%.2f", size)))


def render(kind: str, c: Column) -> Column:
    """``values.render`` of a column."""
    if kind == FLOAT:
        text = F.when(F.isnan(c), "nan").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf").otherwise(_two_decimals(c.cast("double")))
    elif kind == BOOL:
        text = F.when(c, "TRUE").otherwise("FALSE")
    else:
        text = c.cast("string")
    return F.when(c.isNull(), "NULL").otherwise(text)


def _bytes(c: Column) -> Column:
    """The UTF-8 bytes of a string as an array of 0 to 255."""
    hexed = F.hex(c.cast("binary"))
    return F.transform(F.sequence(F.lit(1), F.octet_length(c)), lambda i: F.conv(F.substring(hexed, i * 2 - 1, F.lit(2)), 16, 10).cast("long"))


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def _over_bytes(c: Column, start: int, step) -> Column:
    folded = F.aggregate(_bytes(c), F.lit(start).cast("long"), step)
    return F.when(c.isNull(), None).when(F.octet_length(c) == 0, F.lit(start).cast("long")).otherwise(folded)


def _times(a: Column, by: int) -> Column:
    """a * by modulo 2**32 for 32-bit values, without leaving 64 bits: the upper half of ``a`` contributes its low bits only."""
    high, low = F.shiftright(a, 16), a.bitwiseAND(0xFFFF)
    return (F.shiftleft((high * by).bitwiseAND(0xFFFF), 16) + low * by).bitwiseAND(_LOW)


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a of a string's UTF-8 bytes, as a long."""
    return _over_bytes(c, FNV_BASIS, lambda h, b: _times(h.bitwiseXOR(b), FNV_PRIME))


def mix32(c: Column) -> Column:
    """The second hash of the Bloom filter, as a long."""

    def step(h: Column, b: Column) -> Column:
        k = let(_times(b, MIX), lambda k: _times(k.bitwiseXOR(F.shiftright(k, 24)), MIX))
        return _times(h, MIX).bitwiseXOR(k)

    h = let(_over_bytes(c, MIX, step), lambda h: h.bitwiseXOR(F.shiftright(h, 13)))
    return let(let(h, lambda h: _times(h, MIX)), lambda h: h.bitwiseXOR(F.shiftright(h, 15)))

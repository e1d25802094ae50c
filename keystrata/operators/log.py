"""Replay of a checksummed mutation log as a dataflow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.operators.merge import merged

#: Recovery stops at a longer key or value.
MAX_KEY, MAX_VALUE = 10 << 20, 100 << 20


def payload(op: Column, key: Column, value: Column) -> Column:
    """The checksummed bytes of a record: operation (PUT 1, DELETE 2), key and value lengths in little-endian, key, value."""
    code = F.when(op == "DELETE", F.unhex(F.lit("02"))).otherwise(F.unhex(F.lit("01")))
    text = F.coalesce(value, F.lit(""))

    def little(n: Column) -> Column:
        h = F.lpad(F.hex(n), 8, "0")
        return F.unhex(F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)]))

    return F.concat(code, little(F.octet_length(key)), little(F.octet_length(text)), key.cast("binary"), text.cast("binary"))


def checksum(op: Column, key: Column, value: Column) -> Column:
    """CRC-32 of ``payload``, as a long."""
    return F.crc32(payload(op, key, value))


def valid_prefix(log: DataFrame, stored: str = "crc") -> DataFrame:
    """The records (seq, op, k, v, stored checksum) before the first that is bad: too long, or of another checksum."""
    bad = (F.octet_length("k") > MAX_KEY) | (F.coalesce(F.octet_length("v"), F.lit(0)) > MAX_VALUE) | ~F.col(stored).eqNullSafe(checksum(F.col("op"), F.col("k"), F.col("v")))
    first = log.where(bad).agg(F.min("seq")).first()[0]  # one number, so that the filter reaches the scan
    return log if first is None else log.where(F.col("seq") < first)


def replay(log: DataFrame, stored: str = "crc") -> DataFrame:
    """k, v after the valid prefix is applied in order."""
    return merged(valid_prefix(log, stored).select("k", "seq", "op", "v")).select("k", "v")


def flipped(log: DataFrame, seq: int) -> DataFrame:
    """``log`` in which the first byte of one record's key is inverted, its checksum left: what a damaged disk does to it."""
    first = F.conv(F.hex(F.substring(F.col("k").cast("binary"), 1, 1)), 16, 10).cast("int")
    other = F.unhex(F.lpad(F.hex(first.bitwiseXOR(0xFF)), 2, "0"))
    broken = F.concat(other, F.substring(F.col("k").cast("binary"), F.lit(2), F.octet_length("k"))).cast("string")
    return log.withColumn("k", F.when(F.col("seq") == seq, broken).otherwise(F.col("k")))

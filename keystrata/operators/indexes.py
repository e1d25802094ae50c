"""Segment statistics, sparse index and Bloom membership."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keystrata.functions.columns import FNV_BASIS, FNV_PRIME, MIX, fnv1a, let, mix32

#: Every how many keys the sparse index has an entry; bits for each key, least bits and hashes of the filter.
SPARSE_INTERVAL, BITS_PER_KEY, LEAST_BITS, HASHES = 16, 10, 64, 7
#: Bytes of a filter that a plan holds as a value.
LITERAL = 1 << 20


def segment_stats(rows: DataFrame, segment: str, key: str = "k") -> DataFrame:
    """segment, min_key, max_key, entry_count."""
    return rows.groupBy(segment).agg(F.min(key).alias("min_key"), F.max(key).alias("max_key"), F.count("*").alias("entry_count"))


def sparse_index(rows: DataFrame, key: str = "k", interval: int = SPARSE_INTERVAL) -> DataFrame:
    """key, ordinal of every ``interval``-th row in key order, from 0.

    A range sort and a prefix sum over its partitions number the rows, so no task holds them all.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.select(key).repartitionByRange(n, key).sortWithinPartitions(key)
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = sorted_.select(key, F.spark_partition_id().alias("_part"), at.alias("_at"))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    shifts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    ordinal = (F.col("_at") + F.col("_shift")).alias("ordinal")
    return placed.join(F.broadcast(shifts), "_part").select(key, ordinal).where(F.col("ordinal") % interval == 0)


def positions(key: Column, bits: int, hashes: int = HASHES) -> Column:
    """The filter's bit positions of a string column: (h1 + i * h2 modulo 2**32) modulo bits."""
    both = F.struct(fnv1a(key).alias("a"), mix32(key).alias("b"))
    return let(both, lambda h: F.array(*[(h["a"] + h["b"] * i).bitwiseAND((1 << 32) - 1) % bits for i in range(hashes)]))


def hashes_of(data: bytes) -> tuple[int, int]:
    """``fnv1a`` and ``mix32`` of a byte string, on the driver."""
    a, b, low = FNV_BASIS, MIX, 0xFFFFFFFF
    for byte in data:
        a = (a ^ byte) * FNV_PRIME & low
        word = byte * MIX & low
        b = (b * MIX & low) ^ ((word ^ word >> 24) * MIX & low)
    b = (b ^ b >> 13) * MIX & low
    return a, b ^ b >> 15


class BloomFilter:
    """Bits over string keys: never a false negative; about 0.8 % false positives at its planned size."""

    def __init__(self, entries: int):
        self.bits = max(LEAST_BITS, entries * BITS_PER_KEY)
        self.words = np.zeros(-(-self.bits // 64), np.uint64)

    @classmethod
    def build(cls, rows: DataFrame, key: str = "k", entries: int | None = None) -> BloomFilter:
        """A filter of the keys of ``rows``, sized for ``entries`` or their number. Words of 64 bits combine before their shuffle."""
        made = cls(rows.count() if entries is None else entries)
        at = rows.where(F.col(key).isNotNull()).select(F.explode(positions(F.col(key), made.bits)).alias("at"))
        words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
        for r in words.toLocalIterator():
            made.words[r["word"]] = np.int64(r["bits"]).view(np.uint64)
        return made

    def probe(self, rows: DataFrame, key: str = "k", out: str = "maybe") -> DataFrame:
        """``rows`` with a boolean column: whether the key may be in the filter; a null key is not.

        A filter of up to ``LITERAL`` bytes is part of the expression, so the rows are neither joined nor sorted. The words
        of a larger one travel as a table that meets the keys' positions.
        """
        if self.words.nbytes <= LITERAL:
            data = F.lit(self.words.astype("<u8").tobytes())
            found = let(positions(F.col(key), self.bits), lambda at: F.forall(at, lambda p: self._bit(data, p)))
            return rows.withColumn(out, F.coalesce(found, F.lit(False)))
        spark = rows.sparkSession
        used = np.flatnonzero(self.words)
        table = spark.createDataFrame(pd.DataFrame({"_word": used, "_bits": self.words[used].view(np.int64)}), "_word long, _bits long")
        keys = rows.select(F.col(key).alias("_key")).where("_key is not null").distinct()
        asked = keys.select("_key", F.explode(F.array_distinct(positions(F.col("_key"), self.bits))).alias("_bit"))
        met = asked.withColumn("_word", F.shiftright("_bit", 6)).join(table, "_word", "left")
        hit = F.expr("shiftrightunsigned(coalesce(_bits, 0L), cast(_bit % 64 as int)) & 1") == 1
        sure = met.groupBy("_key").agg(F.bool_and(hit).alias(out))
        return rows.join(sure, F.col(key) == F.col("_key"), "left").drop("_key").withColumn(out, F.coalesce(out, F.lit(False)))

    @staticmethod
    def _bit(data: Column, at: Column) -> Column:
        byte = F.conv(F.hex(F.substring(data, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        mask = F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (at % 8).cast("int") + 1)
        return byte.bitwiseAND(mask) > 0

    def contains(self, key: str) -> bool:
        """Whether one key may be in the filter, on the driver."""
        h1, h2 = hashes_of(key.encode())
        spots = ((h1 + i * h2 & 0xFFFFFFFF) % self.bits for i in range(HASHES))
        return all(int(self.words[p >> 6]) >> (p & 63) & 1 for p in spots)

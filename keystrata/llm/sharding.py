"""Sharding by jump consistent hashing.

The shard of a key follows from the key and the number of shards alone; there is no ring table, and one
more shard takes about 1/(n+1) of the rows, all of them into itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from keystrata.llm.shared import session_partitions, stored

#: Multiplier of the generator, and the scale of the jump.
JUMP_MULTIPLIER = 2862933555777941757
JUMP_SCALE = float(1 << 31)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard, 0 to shards - 1, of each unsigned 64-bit key."""
    state, at, ahead = keys.astype(np.uint64), np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
    live = np.arange(len(keys))
    while len(live):
        at[live] = ahead[live]
        state[live] = state[live] * np.uint64(JUMP_MULTIPLIER) + np.uint64(1)
        ahead[live] = ((at[live] + 1) * (JUMP_SCALE / ((state[live] >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        live = live[ahead[live] < shards]
    return at


def shard_of(key: F.Column, shards: int) -> F.Column:
    """The shard of a long column; null counts as key 0."""

    def run(keys: pa.Array) -> pa.Array:
        return pa.array(jump_hash(keys.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), shards).astype(np.int32))

    return F.arrow_udf(run, "int")(F.coalesce(key.cast("long"), F.lit(0).cast("long")))


def place(rows: DataFrame, key: str, shards: int, grow: int = 1) -> DataFrame:
    """``rows`` with shard, slot (0, 1, 2, ... within each shard, in the key's order) and grown_shard (with ``grow`` more shards); columns of these names are replaced.

    Integer keys are hashed as they are, others by their xxHash64; a null key counts as 0. Repeated keys
    share a shard and get slots of their own. Slots come from a range sort by (shard, key) and a prefix sum
    over the runs of a shard in each sorted partition: there are at most as many runs as partitions and
    shards together, so no shard is ever gathered in one task.
    """
    whole = isinstance(rows.schema[key].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    hashed = F.col(key) if whole else F.when(F.col(key).isNotNull(), F.xxhash64(key))
    named = rows.withColumns({"shard": shard_of(hashed, shards), "grown_shard": shard_of(hashed, shards + grow), "__ks_tie": F.monotonically_increasing_id()})
    order = ["shard", key, "__ks_tie"]
    sorted_ = named.repartitionByRange(session_partitions(rows.sparkSession), *order).sortWithinPartitions(*order).drop("__ks_tie")
    kept = stored(sorted_.withColumns({"__ks_part": F.spark_partition_id(), "__ks_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "shards")
    runs = kept.groupBy("shard", "__ks_part").agg(F.min("__ks_at").alias("__ks_first"), F.count("*").alias("__ks_n"))
    before = Window.partitionBy("shard").orderBy("__ks_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("shard", "__ks_part", (F.coalesce(F.sum("__ks_n").over(before), F.lit(0)) - F.col("__ks_first")).alias("__ks_shift"))
    # at most partitions + shards rows
    return kept.join(F.broadcast(runs), ["shard", "__ks_part"]).withColumn("slot", F.col("__ks_at") + F.col("__ks_shift")).drop("__ks_part", "__ks_at", "__ks_shift")


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 8 shards; size is the text's UTF-8 bytes and 1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    placed = place(rows, "doc_id", 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")

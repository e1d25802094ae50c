"""Latest version wins: the merge behind scans and compaction.

Versioned rows have a key, a sequence number, an operation (PUT or DELETE) and payload columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PUT, DELETE = "PUT", "DELETE"


def latest(versions: DataFrame, key: str = "k", seq: str = "seq", ties: bool = True) -> DataFrame:
    """The last version of each key, deleted keys included. A null key is a key like any other.

    The largest number of each key is a hash aggregation that combines before its shuffle; the versions that have it are
    then a join, which sends the numbers around where they are few and which Spark can split where a key is hot.
    Payloads are in no aggregation buffer. ``ties``: of versions of a key with equal numbers the one that compares largest is
    taken, at the cost of a further aggregation; false where (key, number) is unique, as in a store.
    """
    last = versions.groupBy(F.col(key).alias("_last_key")).agg(F.max(seq).alias("_last_seq"))
    won = versions.join(last, F.col(key).eqNullSafe(F.col("_last_key")) & F.col(seq).eqNullSafe(F.col("_last_seq")), "left_semi")
    if not ties:
        return won
    payload = [c for c in versions.columns if c not in (key, seq)]
    packed = won.select(key, seq, F.struct(*[F.col(f"`{c}`") for c in payload]).alias("_v")).groupBy(key, seq).agg(F.max("_v").alias("_v"))
    return packed.select(*[F.col(f"`{c}`") if c in (key, seq) else F.col("_v")[c].alias(c) for c in versions.columns])


def merged(versions: DataFrame, key: str = "k", seq: str = "seq", op: str = "op", ties: bool = True) -> DataFrame:
    """The live rows: latest versions without deleted keys."""
    return latest(versions, key, seq, ties).where(F.col(op) == PUT)


def merge_on_read(base: DataFrame, delta: DataFrame, key: str = "k", seq: str = "seq", op: str = "op", ties: bool = True) -> DataFrame:
    """``base`` (one live row a key, payload columns and key) under ``delta`` (versions, all newer).

    Predicates on payload columns reach the base's scan, as they can't through an aggregation. The join
    sends the delta's keys around only while Spark finds them small; a large delta shuffles.
    """
    newest = latest(delta, key, seq, ties)
    columns = base.columns
    return base.join(newest.select(key), key, "left_anti").select(columns).unionByName(newest.where(F.col(op) == PUT).select(columns))


def compaction_report(versions: DataFrame, key: str = "k", seq: str = "seq", op: str = "op") -> DataFrame:
    """One row: keys_processed, duplicates_overwritten (older versions of live keys), tombstones_purged (all versions of deleted keys)."""
    each = versions.groupBy(key).agg(F.count("*").alias("n"), F.max_by(op, seq).alias("last"))
    live = F.col("last") == PUT
    zero = F.lit(0).cast("long")
    return each.agg(
        F.count("*").alias("keys_processed"),
        F.coalesce(F.sum(F.when(live, F.col("n") - 1).otherwise(0)), zero).alias("duplicates_overwritten"),
        F.coalesce(F.sum(F.when(live, 0).otherwise(F.col("n"))), zero).alias("tombstones_purged"),
    )


def key_actions(versions: DataFrame, key: str = "k", seq: str = "seq", op: str = "op") -> DataFrame:
    """key, action: keep (one live version), overwrite (a live one over others) or tombstone_purge."""
    each = versions.groupBy(key).agg(F.count("*").alias("n"), F.max_by(op, seq).alias("last"))
    return each.select(key, F.when(F.col("last") != PUT, "tombstone_purge").when(F.col("n") > 1, "overwrite").otherwise("keep").alias("action"))


def byte_size(rows: DataFrame, key: str = "k", value: str = "v") -> DataFrame:
    """One row, size_bytes: bytes of keys and values; a deletion counts its key alone."""
    size = F.sum(F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0))).cast("long")
    return rows.agg(F.coalesce(size, F.lit(0).cast("long")).alias("size_bytes"))


def range_scan(rows: DataFrame, first: str, last: str, key: str = "k") -> DataFrame:
    """Rows with first <= key <= last in key order; none if first > last."""
    return rows.where(F.col(key).between(first, last)).orderBy(key)

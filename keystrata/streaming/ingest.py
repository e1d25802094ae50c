"""A Structured Streaming source of mutations folded into a key-value store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keystrata.kv import KVStore
from keystrata.operators.merge import latest


def ingest(mutations: DataFrame, store: KVStore, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes a stream of (seq, op, k, v) into ``store``, a segment for each micro-batch.

    The largest seq of a key wins, whichever batch brings it: a late record loses to what is there. Records without a seq are left out.
    A batch that is retried, also after a restart, is written once; a record that comes twice counts once. Keys that the
    store holds otherwise have numbers of the store, which go on from the largest seq seen.
    """

    def fold(batch: DataFrame, number: int) -> None:
        known = batch.where("seq is not null").select("k", "seq", "op", "v")
        store.store.append(latest(known).select(F.col("k").alias("_key"), F.col("seq").cast("long").alias("_seq"), F.col("op").alias("_op"), "v"), (checkpoint, number))

    writer = mutations.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

"""Connected components by alternating large-star and small-star steps; every round is a written table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.shared import discard, session_partitions, stored

#: Edges that a task contracts at a time, and edges of a task of a round, about.
LOCAL_EDGES, TASK_EDGES = 1 << 20, 1 << 18


def forest(u: pa.Array, v: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Edges from every node but the smallest of each component of (u, v) to that smallest one."""
    both = pa.concat_arrays([u, v]).dictionary_encode()
    order = pc.sort_indices(both.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    ends = rank[both.indices.to_numpy()]
    a, b, root = ends[: len(u)], ends[len(u) :], np.arange(len(order))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != (up := root[root])).any():
            root = up
    low = np.flatnonzero(root != np.arange(len(root)))
    return both.dictionary.take(pa.array(order[low])), both.dictionary.take(pa.array(order[root[low]]))


def contracted(edges: DataFrame) -> DataFrame:
    """Fewer edges (u > v) that connect what ``edges`` (u, v, no nulls) connects: each task replaces its own by stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def made() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            u, v = (rows.column(c).combine_chunks() for c in ("u", "v"))
            return pa.RecordBatch.from_arrays([*forest(u, v)], ["u", "v"])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= LOCAL_EDGES:
                yield made()
                held, n = [], 0
        if n:
            yield made()

    return edges.select("u", "v").mapInArrow(run, edges.select("u", "v").schema)


def _star(both: DataFrame, large: bool, parts: int) -> DataFrame:
    """``both`` has each edge in both directions. Neighbours above (large) or not above (small) a node move to the smallest node seen from it.

    The minima are aggregated before their shuffle and written, so that they join two tables: Spark can then split
    the partitions of a node with very many neighbours, and no group meets in one task.
    """
    least = stored(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")).coalesce(parts), "minima")
    near = both.join(least, "u")
    if large:
        moved = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = near.where("v < u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.where("m < u").select("u", F.col("m").alias("v")))
    out = stored(contracted(moved.where("u <> v").coalesce(parts)).distinct().coalesce(parts), "edges")
    discard(least)
    return out


def _settled(edges: DataFrame, parts: int) -> bool:
    """Whether ``edges`` (u > v, distinct) are stars: every upper end has one edge and is the lower end of none."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("low")).union(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("low")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("low").alias("low")).where("up > 1 or (up > 0 and low > 0)").coalesce(parts).isEmpty()


def components(edges: DataFrame, contract: bool = True) -> DataFrame:
    """node, root for every node that has an edge in ``edges`` (u, v: any orderable ids, loops and repeats allowed); root is the smallest node of its component.

    No edges: an empty result. Null ends are left out. ``contract`` false: each task's edges are few already. The number of tasks
    follows the number of edges, ``TASK_EDGES`` in each, so that a small graph is settled in a step and a large one in rounds.
    """
    spark = edges.sparkSession
    ends = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    first = stored((contracted(ends) if contract else ends).distinct(), "edges")
    parts = max(1, min(session_partitions(spark), -(-first.count() // TASK_EDGES)))
    now = stored(contracted(first.coalesce(parts)).distinct().coalesce(parts), "edges")
    discard(first)
    while not _settled(now, parts):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, True, parts)
        down = _star(large, False, parts)  # every edge leads down, so small-star needs no reversed copy
        discard(now, large)
        now = down
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

"""What the operators share: scratch storage, texts as byte buffers, flat files that Spark writes and reads."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one vectorised step works on.
SLICE_BYTES = 4 << 20


#: Folders that this process has named.
_MADE: list[str] = []


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder's path below ``spark.checkpoint.dir``, which every executor shares; a local master may do without and gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="keystrata-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", root)
    _MADE.append(f"{root.rstrip('/')}/keystrata/{what}-{uuid.uuid4().hex}")
    return _MADE[-1]


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """``name`` has ``value`` in the session meanwhile."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


#: Spark's own removal of a query's shuffle files when the query ends.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: lineage ends here and survives lost executors. Its shuffle files go at once."""
    path = scratch(df.sparkSession, what)
    with setting(df.sparkSession, SWEEP, "true"):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _name(folder: str) -> str:
    """A scratch folder's last part, which no other folder has."""
    return folder.rstrip("/").rpartition("/")[2]


def _read_by(df: DataFrame) -> set[str]:
    return {_name(f.rpartition("/")[0]) for f in df.inputFiles()}


def _delete(spark: SparkSession, names: set[str]) -> None:
    """Deletes those of the named folders that ``scratch`` has named, and nothing else."""
    for folder in [f for f in _MADE if _name(f) in names]:
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        _MADE.remove(folder)


def discard(*tables: DataFrame) -> None:
    """Deletes the folders of ``stored`` tables that no plan reads any more; other tables stay."""
    for df in tables:
        _delete(df.sparkSession, _read_by(df))


@contextmanager
def swept(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes what ``scratch`` names meanwhile, but the folders that the yielded list's tables read then: for when a result is written and the rest is no longer needed."""
    before, keep = set(_MADE), []
    yield keep
    held = set().union(*map(_read_by, keep))
    _delete(spark, {_name(f) for f in _MADE if f not in before} - held)


class Sieve:
    """Bits of at most 8 MB over longs that are hashes: ``maybe`` is true for all that went in, and for few others while there is room.

    However many go in, the driver and the tasks hold no more than these bits; with too many, more rows pass and the join behind the sieve is larger.
    """

    MOST_BITS = 26

    def __init__(self, rows: DataFrame, column: str):
        n = rows.count()
        self.places = 1 << min(self.MOST_BITS, max(10, (16 * n).bit_length()))
        x, low = F.col(column), self.places - 1
        at = rows.where(x.isNotNull()).select(F.explode(F.array(x.bitwiseAND(low), F.shiftright(x, 32).bitwiseAND(low))).alias("at"))
        words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
        self.words = np.zeros(self.places >> 6, np.uint64)
        self.words[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)

    def maybe(self, column: F.Column) -> F.Column:
        words, low = self.words, np.uint64(self.places - 1)

        def run(x: pa.Array) -> pa.Array:
            v, hit = x.to_numpy(zero_copy_only=False).view(np.uint64), True
            for at in (v & low, v >> np.uint64(32) & low):
                hit = hit & (words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
            return pa.array(hit)

        return F.arrow_udf(run, "boolean")(column)


def folder(spark: SparkSession, path: str) -> None:
    """Makes the folder ``path`` where it is missing, on whatever file system Spark reaches."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(place)


def session_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, and the n + 1 offsets of its values; a null has no bytes. No copy is made."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES, rows: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of ``batch`` in runs of about ``most`` bytes of ``column`` and at most ``rows`` rows; a longer value is a run of its own."""
    _, at = buffers(batch.column(column))
    start, n = 0, len(at) - 1
    while start < n:
        end = min(start + rows, max(start + 1, int(np.searchsorted(at, at[start] + most, "right")) - 1))
        yield batch.slice(start, end - start)
        start = end


def write_flat(df: DataFrame, column: str, path: str, end: str, most: int = 0) -> None:
    """Writes the binary ``column`` as plain files: every value's bytes followed by ``end``, in the rows' order; a file a partition, or for each ``most`` rows of it.

    Spark's text sink puts the bytes of a string out unchanged, whatever they are, so this reaches any
    store that Spark reaches.
    """
    df.select(F.col(column).cast("string").alias("value")).write.option("lineSep", end).option("maxRecordsPerFile", most).text(path)


def read_flat(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content: one row a file."""
    return spark.read.format("binaryFile").load(path)


def arrow_strings(values: list) -> pa.Array:
    return pa.array(values, pa.string())


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker, for what is costly to load."""
    import sys
    import types

    return sys.modules.setdefault("_keystrata_worker", types.ModuleType("_keystrata_worker")).__dict__


def give_back() -> None:
    """Returns freed memory to the system: an idle Python worker keeps its allocators' pages, and an executor has several workers."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidied(run):
    """``run`` (of Arrow batches, for mapInArrow), which gives its memory back when it ends."""

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return through


def ragged(starts: np.ndarray, sizes: np.ndarray, kind: type = np.int64) -> np.ndarray:
    """The indices start, start + 1, ... of each run, one run after the other, as integers of ``kind``."""
    total = np.cumsum(sizes)
    return np.arange(int(total[-1]) if len(total) else 0, dtype=kind) + np.repeat((starts - (total - sizes)).astype(kind), sizes)


def pack(a: np.ndarray) -> bytes:
    """The bytes of ``a``, all lowest ones first, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes())


def unpack(b: bytes, kind: str) -> np.ndarray:
    """What ``pack`` was given, of the numpy type ``kind``."""
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()

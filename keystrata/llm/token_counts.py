"""Token counts of flat token files by a separator scan.

A flat file is nothing but little-endian unsigned ids of 2 or 4 bytes; an end-of-document id closes each document.
Files are read in blocks of any size: Spark splits a file at line feeds as it would a text, and a block's bytes
are its lines with the line feeds put back. A block does not know how many bytes stand before it, so it searches for
the end id at each alignment in vectorised comparisons; a prefix scan over the blocks' lengths then tells which
alignment holds, ids that lie across two blocks are put together from the blocks' edges, and prefix scans over
blocks and files stitch the documents (the largest end before a block; ids and documents before a file).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keystrata.llm.bpe import encoder
from keystrata.llm.shared import buffers, folder, scratch, setting, slices, stored, tidied
from keystrata.llm.token_files import with_end

#: Text bytes encoded at a time.
SLICE_BYTES = 8 << 20
#: Partition columns of what ``write_flat_tokens`` writes.
IDS, NAMES = "kind=ids", "kind=names"


def write_flat_tokens(docs: DataFrame, path: str, tokenizer: str, end: int, key: str = "doc_id", text: str = "text") -> None:
    """Writes the ids of every text (null: empty) and ``end`` after each as 2-byte integers: a flat file a partition in ``path``/kind=ids.

    The documents stay in the partition and the order that ``docs`` has, so nothing is shuffled. The same tasks write their
    keys (longs, null allowed, repeats too) to files of the same numbers in ``path``/kind=names. Ids and ``end`` are below 65536;
    special tokens' strings are ordinary text, and ``end`` as an id of a text raises ValueError. No rows: two empty folders.
    """
    if not 0 <= end < 1 << 16:
        raise ValueError("ids take two bytes")
    mark = struct.pack("<H", end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(kind: str, data: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary()), pa.array([kind])], ["data", "kind"])

        keys, valid = [], []
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                ids, sizes = encoder(tokenizer, special=False).encode(*buffers(part.column("text")))
                if len(ids) and (ids.max() >= 1 << 16 or (ids == end).any()):
                    raise ValueError(f"a text holds the end id {end} or an id of over two bytes")
                # the sink ends every row with the end id
                yield row("ids", with_end(ids, sizes, end).astype("<u2").tobytes()[:-2])
                column = part.column("key")
                keys.append(column.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
                valid.append(column.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8))
        if keys:
            yield row("names", np.concatenate(keys).tobytes() + np.concatenate(valid).tobytes())

    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    made = rows.mapInArrow(tidied(run), "data binary, kind string").select(F.col("data").cast("string").alias("value"), "kind")
    with setting(spark, "spark.sql.maxConcurrentOutputFileWriters", "4"):  # both files of a task are open at once, so its rows need no sort
        made.write.partitionBy("kind").option("encoding", "ISO-8859-1").option("lineSep", mark.decode("latin-1")).text(path)
    for name in (IDS, NAMES):
        folder(spark, f"{path}/{name}")


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """file (the number in its name), place, key of every document that ``write_flat_tokens`` wrote below ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, content in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
                data = memoryview(content.as_buffer())
                n = (len(data) - 2) // 9
                keys, valid = np.frombuffer(data, "<i8", n), np.frombuffer(data, np.uint8, n, 8 * n).astype(bool)
                yield pa.RecordBatch.from_arrays([pa.array([number] * n, pa.int64()), pa.array(np.arange(n)), pa.array(keys, mask=~valid)], ["file", "place", "key"])

    files = spark.read.format("binaryFile").load(f"{path}/{NAMES}").select(_number(F.col("path")).alias("file"), "content")
    return files.mapInArrow(run, "file long, place long, key long")


def _number(path: F.Column) -> F.Column:
    return F.regexp_extract(path, r"part-(\d+)[^/]*$", 1).cast("long")


def in_natural_order(path: F.Column) -> F.Column:
    """A path to sort by, in which runs of digits compare as numbers (of up to 20 digits)."""
    return F.regexp_replace(F.regexp_replace(path, r"(\d+)", "00000000000000000000$1"), r"\d*(\d{20})", "$1")


def _scan(batches: Iterator[pa.RecordBatch], end: int, width: int) -> Iterator[pa.RecordBatch]:
    """One row a block of (file, block, value) lines: its length, its first and last width - 1 bytes, and for each alignment where end ids begin."""

    class Block:
        def __init__(self, file: int, block: int):
            self.of, self.n, self.head, self.tail = (file, block), 0, b"", b""
            self.ends: list[list[np.ndarray]] = [[] for _ in range(width)]

        def add(self, raw: bytes) -> None:
            data, base = self.tail + raw, self.n - len(self.tail)  # fewer bytes than an id has: none is found twice
            for shift, ends in enumerate(self.ends):
                skip = (shift - base) % width
                if len(data) >= skip + width:
                    ids = np.frombuffer(data, f"<u{width}", (len(data) - skip) // width, skip)
                    ends.append(np.flatnonzero(ids == end) * width + (base + skip))
            self.n += len(raw)
            self.head, self.tail = (self.head + raw)[: width - 1], data[-(width - 1) :]

        def row(self) -> pa.RecordBatch:
            ends = [np.concatenate(e) if e else np.zeros(0, np.int64) for e in self.ends]
            values = ([self.of[0]], [self.of[1]], [self.n], [self.head], [self.tail], [ends])
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, _BLOCK, strict=True)], schema=_BLOCK)

    now = None
    for batch in batches:
        file, block = (batch.column(c).to_numpy() for c in ("file", "block"))
        edges = np.flatnonzero(np.concatenate(([True], (block[1:] != block[:-1]) | (file[1:] != file[:-1])))).tolist() if len(block) else []
        for a, b in zip(edges, [*edges[1:], len(block)], strict=True):
            of = (int(file[a]), int(block[a]))
            if now is None or of != now.of:
                if now is not None:
                    yield now.row()
                now = Block(*of)
            raw, at = buffers(batch.column("value").slice(a, b - a))
            lines = np.full(len(raw) + b - a, 10, np.uint8)
            lines[np.arange(len(raw)) + np.repeat(np.arange(b - a), np.diff(at))] = raw
            now.add(lines.tobytes())
    if now is not None:
        yield now.row()


_BLOCK = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("n_bytes", pa.int64()), ("head", pa.binary()), ("tail", pa.binary()), ("ends", pa.list_(pa.list_(pa.int64())))])
#: Fixed value: the bytes that Spark's line reader leaves out where a file begins with them.
BYTE_ORDER_MARK = b"\xef\xbb\xbf"


def scan_separators(spark: SparkSession, path: str, end: int, width: int = 2) -> DataFrame:
    """path, ordinal, place, start, at, n_tokens, closed of every document in the flat files of folder ``path``.

    Files count in the natural order of their paths (numbers as numbers). ``ordinal`` and ``start`` count all documents and ids
    before, ``place`` and ``at`` those of the same file; end ids are ids, but ``n_tokens`` leaves the document's own out.
    Ids after a file's last end id are a document that is not ``closed``. A file may have any size; blocks are what Spark splits it into.
    An empty file has no document, an empty folder no row. A length that ``width`` (2 or 4) does not divide raises an error.
    """
    mark = end.to_bytes(width, "little")
    lines = spark.read.schema("value string").option("lineSep", "\n").text(path)
    lines = lines.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    blocks = stored(lines.mapInArrow(lambda batches: _scan(batches, end, width), "file long, block long, n_bytes long, head binary, tail binary, ends array<array<long>>"), "separators")
    files = spark.read.format("binaryFile").load(path).select("path", F.xxhash64("_metadata.file_path").alias("file"), F.col("length").alias("size"))

    # a file whose blocks are short of bytes began with a byte order mark: it becomes a block ahead of the others
    short = blocks.groupBy("file").agg(F.sum("n_bytes").alias("read")).join(files, "file").where("read <= size - 2")
    longs = lambda values: F.array(*map(F.lit, values)).cast("array<long>")
    held = [[shift] if shift + width <= 3 and BYTE_ORDER_MARK[shift : shift + width] == mark else [] for shift in range(width)]
    led = short.select("file", F.lit(-1).cast("long").alias("block"), F.lit(3).cast("long").alias("n_bytes"), F.lit(BYTE_ORDER_MARK[: width - 1]).alias("head"), F.lit(BYTE_ORDER_MARK[1 - width :]).alias("tail"), F.array(*map(longs, held)).alias("ends"))
    blocks = blocks.unionByName(led)

    # where each block begins, and the bytes ahead of it that end the id which it leaves unfinished
    by_file = Window.partitionBy("file").orderBy("block")
    before = by_file.rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.concat(*[F.coalesce(F.lead(F.hex("head"), k).over(by_file), F.lit("")) for k in range(1, width)])
    edges = blocks.select("file", "block", "n_bytes", F.hex("tail").alias("tail"), F.coalesce(F.sum("n_bytes").over(before), F.lit(0)).alias("offset"), ahead.alias("ahead"))
    edges = edges.withColumn("over", F.pmod(F.col("offset") + F.col("n_bytes"), F.lit(width)).cast("int"))
    parted = (F.col("over") > 0) & (F.col("n_bytes") >= F.col("over")) & (F.expr(f"concat(right(tail, 2 * over), left(ahead, 2 * ({width} - over)))") == mark.hex().upper())
    edges = edges.select("file", "block", "offset", F.when(parted, F.array((F.col("offset") + F.col("n_bytes") - F.col("over")) / width)).otherwise(F.array()).cast("array<long>").alias("parted"))
    aligned = F.element_at("ends", F.pmod(-F.col("offset"), F.lit(width)).cast("int") + 1)
    stops = F.concat(F.transform(aligned, lambda p: ((p + F.col("offset")) / width).cast("long")), "parted")
    blocks = stored(blocks.join(edges, ["file", "block"]).select("file", "block", stops.alias("stops")), "stops")

    # the last end before each block, the documents before it in its file, and the ids and documents of the files before
    seen = blocks.select("file", "block", F.size("stops").alias("n"), F.array_max("stops").alias("last"))
    seen = seen.select("file", "block", F.coalesce(F.max("last").over(before), F.lit(-1)).alias("prior"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("docs"))
    whole = F.when(F.col("size") % width == 0, (F.col("size") / width).cast("long")).otherwise(F.raise_error(F.concat(F.lit(f"{width} does not divide the length of "), "path")))
    totals = blocks.groupBy("file").agg(F.sum(F.size("stops")).alias("docs"), F.max(F.array_max("stops")).alias("last"))
    files = files.join(totals, "file", "left").select("file", "path", whole.alias("n_ids"), F.coalesce("docs", F.lit(0)).alias("n_docs"), F.coalesce("last", F.lit(-1)).alias("last"))
    files = files.withColumn("open", F.col("last") + 1 < F.col("n_ids"))
    earlier = Window.orderBy(in_natural_order(F.col("path")), "path").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = stored(files.withColumns({"ids_before": F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)), "docs_before": F.coalesce(F.sum(F.col("n_docs") + F.col("open").cast("int")).over(earlier), F.lit(0))}), "files")
    runs = F.transform("stops", lambda stop, i: F.struct((F.col("docs") + i).alias("place"), (F.when(i == 0, F.col("prior")).otherwise(F.element_at("stops", F.greatest(i, F.lit(1)))) + 1).alias("at"), stop.alias("stop")))
    closed = blocks.join(seen, ["file", "block"]).select("file", F.explode(runs).alias("d")).select("file", "d.*", F.lit(True).alias("closed"))
    left = files.where("open").select("file", F.col("n_docs").alias("place"), (F.col("last") + 1).alias("at"), F.col("n_ids").alias("stop"), F.lit(False).alias("closed"))
    return closed.unionByName(left).join(files, "file").select(
        "path", (F.col("docs_before") + F.col("place")).alias("ordinal"), "place", (F.col("ids_before") + F.col("at")).alias("start"), "at", (F.col("stop") - F.col("at")).alias("n_tokens"), "closed",
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens of every document, counted in flat files of all documents' ids, and where the document lies: file and the ids before it there."""
    import public_tokenizers

    docs, end = spark.read.parquet(f"{sf_dir}/documents.parquet"), 50256
    path = scratch(spark, "flat-tokens")
    write_flat_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"), end)
    found = scan_separators(spark, f"{path}/{IDS}", end).select(_number(F.col("path")).alias("file"), "place", "at", "n_tokens")
    return found.join(read_names(spark, path), ["file", "place"]).select(F.col("key").alias("doc_id"), "n_tokens", "file", F.col("at").alias("start"))

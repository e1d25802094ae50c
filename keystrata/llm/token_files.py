"""Token-id files: adaptive context-mixing range coding in independent, checksummed blocks.

A file is a row of segments, a segment holds whole documents: a directory (keys, lengths), then blocks
of BLOCK ids. Every block starts from a fresh model, so all blocks of a segment are coded in lock-step,
an id of each at a time. The model of a block predicts an id by the last successor of the two ids before
(order 2), of the id before (order 1) and by an id that recurs whatever is before (order 0). An outcome says which
prediction holds or else in which size class the id lies; its frequencies mix, by adding counts, the outcomes seen so far
and those seen at the confidences that the order-1 and order-2 predictions have now.

The counts of the eight outcomes are 16-bit lanes of two little-endian 64-bit integers and sum to less than 2**15, so one multiplication
sums them up and one subtraction compares all sums with a value. The coder passes on words of 32 bits and carries into those passed on before.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keystrata.llm.bpe import encoder
from keystrata.llm.shared import buffers, read_flat, scratch, slices, stored, tidied, write_flat

MAGIC, HEADER = b"KST2", "<4sIIIQ"  # magic, documents, block size, blocks, ids
#: Ids of a block; blocks coded in step at most, and steps whose ids are turned from rows of blocks to rows of steps at once.
BLOCK, IN_STEP, TILE = 1024, 8192, 16
#: Text bytes of a segment and of a file, about.
SEGMENT_BYTES, FILE_BYTES = 16 << 20, 16 << 20
_SLOTS, _OUT, _STEP, _FADE = 512, 8, np.uint16(24), 256
#: Smallest id of each size class after the three predictions, and the bits of an id's place in it; the last class is for ids from _LARGE on.
_BASE = np.array([0, 0, 0, 0, 512, 2560, 10752, 0], np.uint32)
_BITS = np.array([0, 0, 0, 9, 11, 13, 16, 32], np.uint64)
_LARGE = 10752 + 65536
_CLASS = np.append(np.searchsorted(_BASE[4:7], np.arange(_LARGE, dtype=np.uint32), "right") + 3, 7).astype(np.uint8)
#: What a slot that predicts nothing holds; larger ids are never predicted.
_NONE = np.uint32((1 << 30) - 1)
#: What a multiplication by sums each lane and those below up; the lanes' highest bits.
_SUMS, _HIGH = np.uint64(0x0001000100010001), np.uint64(0x8000800080008000)
_WORD, _HALF, _BOT = np.uint64(32), np.uint64(16), np.uint64(1 << 32)


class _Model:
    """The predictions and outcome counts of each of n blocks. A slot packs the predicted id and, in two bits, the confidence in it."""

    def __init__(self, n: int):
        self.n, self.lane = n, np.arange(n) * _OUT
        self.row16 = np.arange(n, dtype=np.uint32) * np.uint32(16)
        self.rows = (np.arange(2 * n, dtype=np.uint32) * np.uint32(_SLOTS)).reshape(2, n)
        self.slots = np.full(2 * n * _SLOTS, _NONE << np.uint32(2), np.uint32)  # those of order 1, then those of order 2
        self.slot0 = np.full(n, _NONE << np.uint32(2), np.uint32)
        self.f0, self.f12 = np.full((n, 2), _SUMS, np.uint64), np.zeros((n * 16, 2), np.uint64)
        self.lanes0, self.lanes12 = self.f0.view(np.uint16).ravel(), self.f12.view(np.uint16).ravel()
        self.last, self.before, self.steps = np.zeros(n, np.uint32), np.zeros(n, np.uint32), 0

    def look(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Frequencies of the outcomes in lanes (block, 2), their sums up to each, and the totals."""
        at, spread = np.empty((2, self.n), np.uint32), self.last * np.uint32(40503)  # the low bits alone matter
        np.right_shift(spread, np.uint32(4), out=at[0])
        spread += self.before * np.uint32(30011)
        np.right_shift(spread, np.uint32(3), out=at[1])
        at &= np.uint32(_SLOTS - 1)
        at += self.rows
        self.at = at.astype(np.intp)
        self.slot = np.empty((3, self.n), np.uint32)
        self.slot[0] = self.slot0
        self.slots.take(self.at, out=self.slot[1:], mode="clip")
        self.guess, self.conf = self.slot >> np.uint32(2), self.slot & np.uint32(3)
        self.k = (self.row16 + (self.conf[1] | self.conf[2] << np.uint32(2))).astype(np.intp)
        f = self.f12.take(self.k, axis=0)
        f += self.f0
        cum = f * _SUMS
        cum[:, 1] += (cum[:, 0] >> np.uint64(48)) * _SUMS
        return f, cum, cum[:, 1] >> np.uint64(48)

    def update(self, ids: np.ndarray, right: np.ndarray, out: np.ndarray, at: np.ndarray) -> None:
        """Takes in ids, which predictions are right and the outcomes, which are lanes ``at``, after a ``look``."""
        np.add.at(self.lanes0, at, _STEP)
        np.add.at(self.lanes12, self.k * _OUT + out, _STEP)
        kept = np.minimum(ids, _NONE) << np.uint32(2)
        # confidence rises by 1 with a hit, to 3, and falls by 2 with a miss; what is below 2 gives way
        new = np.where(right, self.conf < np.uint32(3), np.uint32(0xFFFFFFFE))
        new += self.slot
        new = np.where(right | (self.conf > np.uint32(1)), new, kept)
        self.slot0, self.slots[self.at] = new[0], new[1:]  # orders 0, 1 and 2 lie one after the other
        self.before, self.last = self.last, ids
        self.steps += 1
        if self.steps % _FADE == 0:
            self.lanes0 -= self.lanes0 >> 1
            self.lanes12 >>= 1


def _part(f: np.ndarray, cum: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the outcomes in lanes ``at`` begin, and their frequencies."""
    freq = f.view(np.uint16).ravel().take(at).astype(np.uint64)
    return cum.view(np.uint16).ravel().take(at) - freq, freq


class _Writer:
    """Words of n blocks, ``most`` of each at most."""

    def __init__(self, n: int, most: int):
        self.low, self.width = np.zeros(n, np.uint64), np.full(n, 0xFFFFFFFFFFFFFFFF, np.uint64)
        self.n, self.words, self.at = n, np.zeros(most * n, "<u4"), np.arange(n)  # the blocks' first words, their second ones, ...

    def put(self, cum: np.ndarray, freq: np.ndarray, total: np.ndarray, place: np.ndarray, bits: np.ndarray) -> None:
        """Codes the part [cum, cum + freq) of total (below 2**15) and ``bits`` (0 to 16) even bits in it; (0, 1, 1) without bits changes nothing.
        ``cum`` and ``place`` are used up."""
        self.width //= total
        cum *= self.width
        self.width *= freq
        self.width >>= bits
        place *= self.width
        cum += place
        self.low += cum
        over = np.flatnonzero(self.low < cum)
        if len(over):
            at = self.at[over] - self.n
            while len(at):  # a word that overflows carries into the one before; the first never does
                self.words[at] += np.uint32(1)
                at = at[self.words[at] == 0] - self.n
        due = np.flatnonzero(self.width < _BOT)
        self._pass_on(due)
        self.width[due] <<= _WORD

    def _pass_on(self, due: np.ndarray | slice) -> None:
        low, at = self.low[due], self.at[due]
        self.words[at] = low >> _WORD
        self.at[due] = at + self.n
        self.low[due] = low << _WORD

    def end(self) -> list[bytes]:
        for _ in range(2):
            self._pass_on(slice(None))
        sizes = self.at // self.n
        most = int(sizes.max())
        raw = memoryview(np.ascontiguousarray(self.words[: most * self.n].reshape(most, self.n).T).ravel()).cast("B")
        return [bytes(raw[4 * i * most : 4 * (i * most + size)]) for i, size in enumerate(sizes.tolist())]


class _Reader:
    def __init__(self, coded: list[bytes]):
        n, most = len(coded), max(map(len, coded)) // 4 + 2
        words = np.zeros((n, most), "<u4")
        for row, b in zip(words, coded, strict=True):
            row[: len(b) // 4] = np.frombuffer(b, "<u4", len(b) // 4)
        self.n, self.words = n, np.ascontiguousarray(words.T).ravel()
        self.at = np.arange(n) + 2 * n
        self.width = np.full(n, 0xFFFFFFFFFFFFFFFF, np.uint64)
        self.off = self.words[:n].astype(np.uint64) << _WORD | self.words[n : 2 * n]  # from the part's begin

    def value(self, total: np.ndarray) -> np.ndarray:
        self.width //= total
        return np.minimum(self.off // self.width, total - np.uint64(1))

    def take(self, cum: np.ndarray, freq: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """The even bits in the part [cum, cum + freq) of ``value``'s total."""
        self.off -= cum * self.width
        self.width *= freq
        self.width >>= bits
        place = np.minimum(self.off // self.width, (np.uint64(1) << bits) - np.uint64(1))
        self.off -= place * self.width
        due = np.flatnonzero(self.width < _BOT)
        at = self.at[due]
        self.off[due] = self.off[due] << _WORD | self.words.take(at, mode="clip")  # damaged bytes may ask for more
        self.at[due] = at + self.n
        self.width[due] <<= _WORD
        return place


def _halves(wide: np.ndarray) -> tuple[np.ndarray, ...]:
    """What codes 16 even bits where ``wide`` and nothing elsewhere, without the bits' values."""
    one = np.ones(len(wide), np.uint64)
    return np.zeros(len(wide), np.uint64), one, one, wide * _HALF


def _rows(n: int, block: int) -> np.ndarray:
    """Room for n blocks of ids, in rows that do not all begin at the same place of a page."""
    return np.zeros((n, -(-block // TILE) * TILE + TILE), np.uint32)


def _encode(ids: np.ndarray, block: int) -> list[bytes]:
    n, steps = -(-len(ids) // block), min(block, len(ids))
    whole, large = len(ids) // block, int(ids.max()) >= _LARGE
    grid = _rows(n, block)
    grid[:whole, :block] = ids[: whole * block].reshape(whole, block)
    grid[whole:, : len(ids) - whole * block] = ids[whole * block :]
    model, writer = _Model(n), _Writer(n, steps * (3 if large else 1) + 4)
    for t in range(steps):
        if t % TILE == 0:
            tile = np.ascontiguousarray(grid[:, t : t + TILE].T)
            outs = _CLASS.take(np.minimum(tile, np.uint32(_LARGE)))
            places = tile - _BASE.take(outs)
        x, out, (f, cum, total) = tile[t % TILE], outs[t % TILE], model.look()
        right = model.guess == x
        for order in range(3):
            np.copyto(out, 2 - order, where=right[order])
        at = model.lane + out
        low, freq = _part(f, cum, at)
        bits, place = _BITS.take(out), places[t % TILE] * (out > 2).astype(np.uint64)
        if large and (wide := bits > _HALF).any():
            writer.put(low, freq, total, place * ~wide, bits * ~wide)
            for half in (place >> _HALF, place & np.uint64(0xFFFF)):
                none, one, all_, sixteen = _halves(wide)
                writer.put(none, one, all_, half * wide, sixteen)
        else:
            writer.put(low, freq, total, place, bits)
        model.update(x, right, out, at)
    return writer.end()


def encode_blocks(ids: np.ndarray, block: int = BLOCK) -> list[bytes]:
    """Each run of ``block`` ids coded on its own. Only the last can be short: it is filled up with the id 0 to the others' length."""
    step = IN_STEP * block
    return [b for at in range(0, len(ids), step) for b in _encode(ids[at : at + step], block)]


def _decode(coded: list[bytes], total_ids: int, block: int) -> np.ndarray:
    n, steps = len(coded), min(block, total_ids)
    grid, tile = _rows(n, block), np.zeros((TILE, n), np.uint32)
    model, reader = _Model(n), _Reader(coded)
    for t in range(steps):
        f, cum, total = model.look()
        value = reader.value(total)
        value *= _SUMS
        value |= _HIGH
        passed = value[:, None] - cum
        passed &= _HIGH
        out = np.bitwise_count(passed[:, 0] | passed[:, 1] >> np.uint64(1)).astype(np.intp)
        at = model.lane + out
        low, freq = _part(f, cum, at)
        bits = _BITS.take(out)
        wide = bits > _HALF
        if wide.any():
            place = reader.take(low, freq, bits * ~wide)
            for _ in range(2):
                none, one, all_, sixteen = _halves(wide)
                reader.value(all_)
                half = reader.take(none, one, sixteen)
                place = np.where(wide, place << _HALF | half, place)
        else:
            place = reader.take(low, freq, bits)
        x = tile[t % TILE]
        np.add(place.astype(np.uint32), _BASE.take(out), out=x)
        for order in range(3):
            np.copyto(x, model.guess[order], where=out == 2 - order)
        model.update(x.copy(), model.guess == x, out, at)
        if t % TILE == TILE - 1 or t == steps - 1:
            grid[:, t - t % TILE : t - t % TILE + TILE] = tile.T
    return np.ascontiguousarray(grid[:, :block]).ravel()[:total_ids]


def decode_blocks(coded: list[bytes], total_ids: int, block: int = BLOCK) -> np.ndarray:
    """What ``encode_blocks`` was given."""
    made = [_decode(coded[i : i + IN_STEP], min(total_ids - i * block, IN_STEP * block), block) for i in range(0, len(coded), IN_STEP)]
    return np.concatenate(made) if made else np.zeros(0, np.uint32)


def pack_segment(keys: np.ndarray, valid: np.ndarray, sizes: np.ndarray, ids: np.ndarray, block: int = BLOCK) -> bytes:
    coded = encode_blocks(ids, block)
    directory = b"".join((keys.astype("<i8").tobytes(), valid.astype(np.uint8).tobytes(), sizes.astype("<u8").tobytes()))
    raw = ids.astype("<u4")
    table = np.array([(len(c), zlib.crc32(raw[i * block : (i + 1) * block].tobytes())) for i, c in enumerate(coded)], "<u4").reshape(-1, 2)
    body = directory + table.tobytes()
    return struct.pack(HEADER, MAGIC, len(keys), block, len(coded), len(ids)) + struct.pack("<I", zlib.crc32(body)) + body + b"".join(coded)


def unpack_segment(data: memoryview, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """keys, valid, sizes, ids of the segment at ``at`` and where it ends; ValueError names what fails its checksum."""
    magic, docs, block, blocks, n = struct.unpack_from(HEADER, data, at)
    start = at + struct.calcsize(HEADER) + 4
    end = start + docs * 17 + blocks * 8
    if magic != MAGIC or zlib.crc32(data[start:end]) != struct.unpack_from("<I", data, start - 4)[0]:
        raise ValueError(f"no sound segment at byte {at}")
    keys = np.frombuffer(data, "<i8", docs, start)
    valid = np.frombuffer(data, np.uint8, docs, start + 8 * docs).astype(bool)
    sizes = np.frombuffer(data, "<u8", docs, start + 9 * docs).astype(np.int64)
    table = np.frombuffer(data, "<u4", 2 * blocks, start + 17 * docs).reshape(-1, 2)
    coded = []
    for length in table[:, 0].tolist():
        coded.append(bytes(data[end : end + length]))
        end += length
    ids = decode_blocks(coded, n, block)
    raw = ids.astype("<u4")
    for i, crc in enumerate(table[:, 1].tolist()):
        if zlib.crc32(raw[i * block : (i + 1) * block].tobytes()) != crc:
            raise ValueError(f"block {i} of the segment at byte {at} fails its checksum")
    return keys, valid, sizes, ids, end


def in_order(docs: DataFrame, key: str, text: str, file_bytes: int) -> DataFrame:
    """key, text sorted by key over partitions of about ``file_bytes`` of text: nulls first, equal keys by their texts' hash."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = ["key", F.xxhash64("text")]
    return rows.repartitionByRange(max(1, -(-total // file_bytes)), *order).sortWithinPartitions(*order)


def with_end(ids: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    """``ids`` with ``end`` after each document's."""
    out, own = np.empty(len(ids) + len(sizes), np.uint32), np.ones(len(ids) + len(sizes), bool)
    own[np.cumsum(sizes + 1) - 1] = False
    out[own], out[~own] = ids, end
    return out


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int, key: str = "doc_id", text: str = "text") -> None:
    """Encodes every text (null: empty), appends ``end`` and writes segments in ascending key order. The key is a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SEGMENT_BYTES):
                ids, sizes = encoder(tokenizer).encode(*buffers(part.column("text")))
                keys = part.column("key")
                segment = pack_segment(keys.fill_null(0).to_numpy(zero_copy_only=False), keys.is_valid().to_numpy(zero_copy_only=False), sizes + 1, with_end(ids, sizes, end))
                yield pa.RecordBatch.from_arrays([pa.array([segment], pa.binary())], ["segment"])

    rows = in_order(docs.withColumn(key, F.col(key).cast("long")), key, text, FILE_BYTES)
    write_flat(rows.mapInArrow(tidied(run), "segment binary"), "segment", path, "\n")


def read_tokens(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """key, start, n_tokens, ids_crc32 (and the ids as little-endian unsigned 32-bit integers) of every document in the files of ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
                data, at, base = memoryview(content.as_buffer()), 0, 0
                while at < len(data):
                    keys, valid, sizes, tokens, at = unpack_segment(data, at)
                    at += 1  # the line end
                    stop = np.cumsum(sizes)
                    raw = memoryview(tokens.astype("<u4").tobytes())
                    each = [raw[4 * (b - n) : 4 * b] for b, n in zip(stop.tolist(), sizes.tolist(), strict=True)]
                    columns = [pa.array([name] * len(keys), pa.int32()), pa.array(keys, mask=~valid), pa.array(base + stop - sizes), pa.array(sizes), pa.array([zlib.crc32(x) for x in each], pa.int64())]
                    if ids:
                        columns.append(pa.array([bytes(x) for x in each], pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, ["file", "key", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])
                    base += int(sizes.sum())

    files = read_flat(spark, path).select(F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("file"), "content")
    rows = stored(files.mapInArrow(tidied(run), "file int, key long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids), "tokens")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    shift = rows.groupBy("file").agg(F.sum("n_tokens").alias("n")).select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    return rows.join(shift, "file").withColumn("start", F.col("start") + F.col("shift")).drop("file", "shift")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids written in the file format and read back; 2 ends a document."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = scratch(spark, "token-files")
    write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"), 2)
    return read_tokens(spark, path).select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")

"""SentencePiece segmentations drawn by forward filtering and backward sampling over the piece lattice.

No piece crosses from a non-space to a space, so the lattice of a text falls into those of its chunks (a run
of spaces and what follows), and a long chunk, as scripts without spaces have them, into its parts between places that no piece crosses. Forward filtering of a distinct chunk gives, for each position, the weight of all
segmentations up to it, and so the chance of each piece that may end there. Backward sampling draws pieces
from the end, for all parts of a batch at once. A draw is a hash of (seed, row key, part's number, step), and chances are
added up for each place alone: the same row gets the same segmentation whatever else its batch holds.

A piece's weight is its rank's share under Zipf's law to the power ``theta``, as the model's scores are merge
ranks. A character that is no piece is spelled in byte pieces, so decoding gives every text back. As the library does, a
space is put before a text that is not empty, and decoding takes it away.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm.shared import buffers, ragged, slices, worker_cache

THETA, SEED = 1.0, 0
#: Rank at which byte pieces weigh; text bytes whose distinct chunks are filtered together; bytes from which a chunk is parted.
BYTE_RANK, SLICE_BYTES, LONG = 1_000_000, 5 << 18, 64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Strings:
    """Hashes of all strings that begin in a buffer, of growing length: each call takes in the next byte."""

    def __init__(self, raw: np.ndarray, at: np.ndarray):
        self.raw, self.at, self.size, self.state = raw, at, 0, np.zeros(len(at), np.uint64)

    def grow(self, keep: np.ndarray) -> np.ndarray:
        """Drops what ``keep`` doesn't name, takes in a byte more of the rest, and gives their hashes."""
        self.at = self.at[keep]
        self.state = (self.state[keep] + self.raw[self.at + self.size] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        self.state ^= self.state >> np.uint64(29)
        self.size += 1
        return self.state


class Lattices:
    """The pieces of a model with byte fallback, and samples from the lattices of texts."""

    def __init__(self, path: str, theta: float = THETA):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.byte, pieces = np.zeros(256, np.int64), {}
        text = [b""] * model.get_piece_size()
        for i in range(len(text)):
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[3:5], 16)
                self.byte[value], text[i] = i, bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                string = model.id_to_piece(i).replace("▁", " ")
                if " " in string.lstrip(" "):
                    raise ValueError(f"piece {i} crosses a space")
                text[i] = string.encode()
                pieces[text[i]] = i
        self.sizes = np.array([len(t) for t in text], np.int64)
        self.text, self.begins = np.frombuffer(b"".join(text), np.uint8), np.cumsum(self.sizes) - self.sizes
        self.weight = np.array([(2.0 - model.get_score(i)) ** -theta for i in range(len(text))])
        self.byte_weight = float(BYTE_RANK) ** -theta
        self.most = max(map(len, pieces))
        # every beginning of a piece by its hash: the piece that it is, or -1
        strings = sorted({p[:k] for p in pieces for k in range(1, len(p) + 1)})
        raw, sizes = np.frombuffer(b"".join(strings), np.uint8), np.array([len(x) for x in strings])
        hashes, grown, left = np.zeros(len(strings), np.uint64), _Strings(raw, np.cumsum(sizes) - sizes), np.arange(len(strings))
        for size in range(1, self.most + 1):
            keep = sizes[left] >= size
            left = left[keep]
            hashes[left] = grown.grow(np.flatnonzero(keep))
        order = np.argsort(hashes)
        self.hashes, self.of_hash = hashes[order], np.array([pieces.get(x, -1) for x in strings], np.int64)[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.hashes >> np.uint64(44)] = True

    def edges(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(begin, end, piece, weight) of all pieces in the chunks between the offsets, as byte places; piece -1 spells a character that is no piece in bytes."""
        lead = np.flatnonzero((raw & 0xC0) != 0x80)
        stop = np.append(lead[1:], len(raw))
        room = np.repeat(off[1:], np.diff(off))[lead] - lead
        grown, left, found = _Strings(raw, lead), np.arange(len(lead)), []
        alone = np.zeros(len(lead), bool)
        for size in range(1, self.most + 1):
            keep = np.flatnonzero(room[left] >= size)
            left = left[keep]
            if not len(left):
                break
            h = grown.grow(keep)
            near = np.flatnonzero(self.maybe[h >> np.uint64(44)])
            at = np.minimum(np.searchsorted(self.hashes, h[near]), len(self.hashes) - 1)
            hit = self.hashes[at] == h[near]
            near, piece = near[hit], self.of_hash[at[hit]]
            whole = piece >= 0
            mine = left[near[whole]]
            found.append((lead[mine], np.full(len(mine), size), piece[whole], self.weight[piece[whole]]))
            alone[mine[stop[mine] - lead[mine] == size]] = True
            left, grown.at, grown.state = left[near], grown.at[near], grown.state[near]
        spelled = np.flatnonzero(~alone)
        size = stop[spelled] - lead[spelled]
        found.append((lead[spelled], size, np.full(len(spelled), -1), self.byte_weight**size))
        begin, size, piece, weight = (np.concatenate(c) for c in zip(*found, strict=True))
        return begin, begin + size, piece, weight

    def filter(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
        """Edges in the order of the places where they end, with the sum of their and the earlier ones' chances given that place, the first edge of each place and after the last, and the parts' offsets."""
        begin, end, piece, weight = self.edges(raw, off)
        order = np.lexsort((begin, end))
        begin, end, piece, weight = begin[order], end[order], piece[order], weight[order]
        # a place inside no edge cuts a long chunk: the lattice's halves do not depend on each other
        inside = np.cumsum(np.bincount(begin + 1, minlength=len(raw) + 2) - np.bincount(end, minlength=len(raw) + 2))[: len(raw)]
        large = np.repeat(np.diff(off) >= LONG, np.diff(off))
        cut = (inside == 0) & large
        cut[off[:-1][np.diff(off) > 0]] = True
        off = np.append(np.flatnonzero(cut), len(raw))
        home = np.repeat(off[:-1], np.diff(off))[begin]
        deep = end - home
        # alpha of a place inside a chunk is at its number; a chunk's start is 1 and has no number of its own
        alpha, chance = np.zeros(len(raw) + 1), np.zeros(len(begin))
        starts = begin == home
        by = np.argsort(deep, kind="stable")
        edges = np.searchsorted(deep[by], np.arange(1, (int(deep.max()) if len(deep) else 0) + 2))
        for j in range(len(edges) - 1):
            e = by[edges[j] : edges[j + 1]]
            if not len(e):
                continue
            part, to = np.where(starts[e], 1.0 if j < self.most else 0.0, alpha[begin[e]]) * weight[e], end[e]
            first = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
            total = np.add.reduceat(part, first)
            chance[e] = part / np.repeat(total, np.diff(np.append(first, len(e))))
            alpha[to[first]] = total
            low = np.flatnonzero(total < 1e-120)
            if len(low) and j >= self.most:  # only ratios of the last few places matter
                for k in range(self.most):
                    alpha[to[first[low]] - k] *= 1e110
        first = np.concatenate(([0], np.cumsum(np.bincount(end, minlength=len(raw) + 1))))
        many = np.diff(first)
        places, k = np.flatnonzero(many > 1), 1
        while len(places):
            e = first[places] + k
            chance[e] += chance[e - 1]
            k += 1
            places = places[many[places] > k]
        return begin, end, piece, chance, first, off

    def sample(self, raw: np.ndarray, at: np.ndarray, keys: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of all texts one after the other, and the number of each; ``keys`` are unsigned 64-bit."""
        sizes = np.diff(at)
        full = sizes > 0
        # a space before each text that is not empty
        moved = np.cumsum(full)
        padded = np.full(len(raw) + int(full.sum()), 32, np.uint8)
        padded[np.arange(len(raw)) + np.repeat(moved, sizes)] = raw
        at = np.concatenate(([0], np.cumsum(sizes + full)))
        if not len(padded):
            return np.zeros(0, np.uint32), np.zeros(len(sizes), np.int64)
        space = padded == 32
        start = space.copy()
        start[1:] &= ~space[:-1]
        start[at[:-1][full]] = True
        begin = np.flatnonzero(start)
        offsets = np.append(begin, len(padded)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(padded)]).dictionary_encode()
        text, off = buffers(coded.dictionary)
        from_, to, piece, reached, first, part = self.filter(text, off)
        rounds = int(np.diff(first).max()).bit_length()

        # every occurrence of a chunk stands for its parts
        index, low = coded.indices.to_numpy(), np.searchsorted(part, off)
        many = np.diff(low)[index]
        which = ragged(low[:-1][index], many)
        owner = np.repeat(np.searchsorted(at, begin, "right") - 1, many)
        of_text = np.bincount(owner, minlength=len(sizes))
        nth = np.arange(len(which)) - np.repeat(np.cumsum(of_text) - of_text, of_text)
        state = _mix(_mix(keys[owner] + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) + nth.astype(np.uint64))
        place, home, live = part[which + 1], part[which], np.arange(len(which))
        drawn_for, drawn = [], []
        while len(live):
            u = ((_mix(state[live] + np.uint64((len(drawn) + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
            here = place[live]
            edge, last = first[here], first[here + 1] - 1  # the last one's sum may be rounded down
            for _ in range(rounds):
                middle = (edge + last) >> 1
                past = reached[middle] < u
                edge, last = np.where(past & (edge < last), middle + 1, edge), np.where(past, last, middle)
            edge = np.minimum(edge, last)
            drawn_for.append(live)
            drawn.append(edge)
            place[live] = from_[edge]
            live = live[from_[edge] > home[live]]
        chunk, edge = np.concatenate(drawn_for), np.concatenate(drawn)
        order = np.argsort(chunk[::-1], kind="stable")  # back to front
        edge, chunk = edge[::-1][order], chunk[::-1][order]
        spelled = piece[edge] < 0
        width = np.where(spelled, to[edge] - from_[edge], 1)
        out = np.repeat(piece[edge], width)
        out[np.repeat(spelled, width)] = self.byte[text[ragged(from_[edge[spelled]], width[spelled])]]
        return out.astype(np.uint32), np.bincount(owner[chunk], width, len(sizes)).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the texts and their n + 1 offsets, without the space put before each."""
        size = self.sizes[ids]
        raw = self.text[ragged(self.begins[ids], size)]
        stop = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(counts)))]
        keep = np.ones(len(raw), bool)
        keep[stop[:-1][np.diff(stop) > 0]] = False
        return raw[keep], np.concatenate(([0], np.cumsum(keep)))[stop]


def lattices(path: str, theta: float = THETA) -> Lattices:
    """This worker's lattices for the model at ``path``."""
    cache = worker_cache()
    if ("pieces", path, theta) not in cache:
        cache["pieces", path, theta] = Lattices(path, theta)
    return cache["pieces", path, theta]


def encode(key: F.Column, text: F.Column, model: str, theta: float = THETA, seed: int = SEED) -> F.Column:
    """array<int>: the pieces drawn for a row; none for a null or empty text. Equal keys and texts draw equally; a null key is 0."""

    def run(keys: pa.Array, texts: pa.Array) -> pa.Array:
        batch, parts = pa.RecordBatch.from_arrays([keys, texts], ["key", "text"]), []
        for part in slices(batch, "text", SLICE_BYTES):
            ids, n = lattices(model, theta).sample(*buffers(part.column("text")), part.column("key").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), seed)
            parts.append(pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(n))).astype(np.int32), pa.array(ids.astype(np.int32))))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return F.arrow_udf(run, "array<int>")(F.coalesce(F.xxhash64(key), F.lit(0).cast("long")), text)


def decode(pieces: F.Column, model: str) -> F.Column:
    """The text of an array<int> of pieces; null gives an empty text."""

    def run(lists: pa.Array) -> pa.Array:
        lists = lists.fill_null([])
        ids, n = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
        raw, at = lattices(model).decode(ids, n)
        return pa.StringArray.from_buffers(len(n), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw)))

    return F.arrow_udf(run, "string")(pieces)


def digests(key: F.Column, text: F.Column, model: str, theta: float = THETA, seed: int = SEED) -> F.Column:
    """struct(n_pieces, pieces_crc32, decoded_sha256, lossless) of a row, encoded and decoded in one pass without leaving the worker."""

    def run(keys: pa.Array, texts: pa.Array) -> pa.Array:
        batch, rows = pa.RecordBatch.from_arrays([keys, texts], ["key", "text"]), []
        for part in slices(batch, "text", SLICE_BYTES):
            raw, at = buffers(part.column("text"))
            model_ = lattices(model, theta)
            ids, n = model_.sample(raw, at, part.column("key").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), seed)
            back, to = model_.decode(ids, n)
            coded, stop = memoryview(ids.astype("<u4").tobytes()), np.cumsum(n).tolist()
            back, raw = back.tobytes(), raw.tobytes()
            for i, (b, k) in enumerate(zip(stop, n.tolist(), strict=True)):
                text_ = back[to[i] : to[i + 1]]
                rows.append((k, zlib.crc32(coded[4 * (b - k) : 4 * b]), hashlib.sha256(text_).hexdigest(), text_ == raw[at[i] : at[i + 1]]))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_())
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["n_pieces", "pieces_crc32", "decoded_sha256", "lossless"])

    return F.arrow_udf(run, "n_pieces long, pieces_crc32 long, decoded_sha256 string, lossless boolean")(F.coalesce(F.xxhash64(key), F.lit(0).cast("long")), text)


def round_trip(key: F.Column, text: F.Column, model: str, theta: float = THETA, seed: int = SEED) -> F.Column:
    """struct(pieces, text): what ``encode`` and, of that, ``decode`` give, drawn once; a null text stays null."""

    def run(keys: pa.Array, texts: pa.Array) -> pa.Array:
        batch, parts = pa.RecordBatch.from_arrays([keys, texts], ["key", "text"]), []
        for part in slices(batch, "text", SLICE_BYTES):
            model_ = lattices(model, theta)
            ids, n = model_.sample(*buffers(part.column("text")), part.column("key").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), seed)
            raw, at = model_.decode(ids, n)
            lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(n))).astype(np.int32), pa.array(ids.astype(np.int32)))
            valid = None if not part.column("text").null_count else pa.py_buffer(np.packbits(part.column("text").is_valid().to_numpy(zero_copy_only=False), bitorder="little"))
            back = pa.StringArray.from_buffers(len(n), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw)), valid, part.column("text").null_count)
            parts.append(pa.StructArray.from_arrays([lists, back], ["pieces", "text"]))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("pieces", pa.list_(pa.int32())), ("text", pa.string())]))

    return F.arrow_udf(run, "pieces array<int>, text string")(F.coalesce(F.xxhash64(key), F.lit(0).cast("long")), text)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pieces, n_pieces, decoded, lossless: a sampled segmentation of every document and the text decoded from it.

    A null text has no pieces and decodes to null. Rows with one doc_id and text draw alike; a null doc_id draws as 0.
    """
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    coded = docs.withColumn("d", round_trip(F.col("doc_id"), F.col("text"), public_tokenizers.path("piece_bpe_32k.model")))
    return coded.select("doc_id", F.col("d.pieces").alias("pieces"), F.size("d.pieces").cast("long").alias("n_pieces"), F.col("d.text").alias("decoded"), F.col("d.text").eqNullSafe(F.col("text")).alias("lossless"))


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: ``pieces`` drawn for each document, their number ``n_pieces``, and the text decoded from them.

    Columns of these two names that the documents have already are replaced.
    """
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    coded = docs.withColumn("__ks_coded", round_trip(F.col("doc_id"), F.col("text"), model))
    return coded.withColumns({"pieces": F.col("__ks_coded.pieces"), "text": F.col("__ks_coded.text"), "n_pieces": F.size("__ks_coded.pieces")}).drop("__ks_coded")

"""SimHash near-duplicates found through Golay-code fuzzy hashing.

A document's fingerprint is a 64-bit SimHash of its word shingles. To find all pairs of fingerprints
within ``MAX_BITS`` = 4 differing bits, a fingerprint is cut into three segments of 22, 21 and 21 bits.
Of at most 4 errors the worst segment has at least its share, so some two segments hold at most 2
(pigeonhole). Each segment, padded with zeros to 23 bits, lies within 3 errors of exactly one word of
the perfect binary Golay code; that word's 12-bit index is its key, and flipping any one bit of the
segment leads to at most a few further indices. For each of the three segment pairs a fingerprint files
itself under (index, index) for its own value and for every value at one error from it: about 29 keys.
Two values at up to 2 errors have a value at one error from both, so they share a key; the join loses
no pair. Equal keys are verified by counting differing bits.

Such a key has 24 bits. Where a key has many fingerprints, each files itself anew under finer ones: of two at most 4 errors apart
the third segment has at most 2, so they share one of its indices (12 bits more), or at least 3, so that one of the key's own
two segments is the same in both (9 bits more). What is still large is cut into blocks that meet in pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.components import components
from keystrata.llm.shared import buffers, session_partitions, slices, stored, tidied

MAX_BITS = 4
#: Generator polynomial of the cyclic [23, 12] Golay code; widths of the segments of a fingerprint.
GOLAY = 0b110001110101
WIDTHS = (22, 21, 21)
#: Fingerprints from which a key is refined; fingerprints under one key that one step compares: refined keys with more are cut into blocks that meet in pairs.
REFINE, BLOCK = 4096, 20_000

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _normal(raw: np.ndarray, at: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased words joined by single spaces, where each begins and ends there, and the number of words of each text."""
    n = len(at) - 1
    solid = ~_WHITE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last[:-1] &= ~solid[1:] | edge[1:-1]
    word = np.cumsum(first)
    counts = np.diff(np.concatenate(([0], word))[at]) if len(raw) else np.zeros(n, np.int64)
    kept = np.flatnonzero(solid)
    to = np.arange(len(kept)) + word[kept] - 1
    out = np.full(len(kept) + (int(word[-1]) if len(word) else 0), 32, np.uint8)
    out[to] = _LOWER[raw[kept]]
    place = np.zeros(len(raw), np.int64)
    place[kept] = to
    return out.tobytes(), place[np.flatnonzero(first)], place[np.flatnonzero(last)] + 1, counts


def shingles(raw: np.ndarray, at: np.ndarray, shingle: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The 64-bit hashes of the word shingles of all texts, repeats among them, the text of each, and their number in each text; fewer words make one shingle."""
    text, begin, end, counts = _normal(raw, at)
    n, base = len(counts), np.concatenate(([0], np.cumsum(counts)))
    each = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(n), each)
    first = base[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
    final = np.minimum(first + shingle, base[owner + 1]) - 1
    digest = xxhash.xxh64_intdigest
    return np.array([digest(text[a:b], seed) for a, b in zip(begin[first].tolist(), end[final].tolist(), strict=True)], np.uint64), owner, each


def fingerprints(raw: np.ndarray, at: np.ndarray, shingle: int = 4, seed: int = 42) -> np.ndarray:
    """The unsigned 64-bit SimHash of each text: bit b is set if over half the shingle hashes have it; no words: zero."""
    h, owner, each = shingles(raw, at, shingle, seed)
    n = len(each)
    octets = h.astype("<u8").view(np.uint8).reshape(-1, 8)
    bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
    ones = np.zeros((n, 64), np.int64)
    for j in range(8):
        tally = np.bincount(owner * 256 + octets[:, j], minlength=n * 256).reshape(n, 256)
        ones[:, 8 * j : 8 * j + 8] = tally @ bits
    out = np.zeros(n, np.uint64)
    for b in range(64):
        out |= (2 * ones[:, b] > each).astype(np.uint64) << np.uint64(b)
    return out


def simhash(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """key, fp (the fingerprint as a signed long): one row for each row, null and wordless texts having 0. Only these two columns are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20, 1024):
                fp = fingerprints(*buffers(part.column("text")), shingle, seed)
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(fp.view(np.int64))], ["key", "fp"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(tidied(run), f"key {rows.schema['key'].dataType.simpleString()}, fp long").withColumnRenamed("key", key)


def golay_indices() -> np.ndarray:
    """For each 23-bit word, the 12-bit index of the code word within 3 errors of it."""

    def remainder(x: int) -> int:
        for b in range(22, 10, -1):
            if x >> b & 1:
                x ^= GOLAY << (b - 11)
        return x

    unit = [remainder(1 << b) for b in range(23)]
    errors = np.zeros(1 << 11, np.uint32)
    for weight in (1, 2, 3):
        for places in combinations(range(23), weight):
            s = 0
            for b in places:
                s ^= unit[b]
            errors[s] = sum(1 << b for b in places)
    syndrome = np.zeros(1 << 23, np.uint16)
    for b in range(23):
        syndrome[1 << b : 2 << b] = syndrome[: 1 << b] ^ unit[b]
    return ((np.arange(1 << 23, dtype=np.uint32) ^ errors[syndrome]) >> 11).astype(np.uint16)


def fuzzy_keys(fp: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every key of every fingerprint, without repeats."""
    segments, shift = [], 0
    for width in WIDTHS:
        segments.append((fp >> np.uint64(shift)).astype(np.uint32) & np.uint32((1 << width) - 1))
        shift += width
    own = [table[s].astype(np.uint32) for s in segments]
    near = [table[s[:, None] ^ (np.uint32(1) << np.arange(w, dtype=np.uint32))].astype(np.uint32) for s, w in zip(segments, WIDTHS, strict=True)]
    keys = []
    for tag, (s, t) in enumerate(combinations(range(3), 2)):
        top = np.uint32(tag << 24)
        keys += [(top | own[s] << np.uint32(12) | own[t])[:, None], top | near[s] << np.uint32(12) | own[t][:, None], top | (own[s] << np.uint32(12))[:, None] | near[t]]
    every = np.sort(np.concatenate(keys, axis=1), axis=1)
    new = np.ones(every.shape, bool)
    new[:, 1:] = every[:, 1:] != every[:, :-1]
    row, at = np.nonzero(new)
    return row, every[row, at].astype(np.int64)


def finer_keys(key: np.ndarray, fp: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of finer keys: two fingerprints under one key of ``fuzzy_keys`` within MAX_BITS share one. Keys are hashes."""
    shifts = np.cumsum([0, *WIDTHS[:-1]])
    segment = lambda i, x: (x >> np.uint64(shifts[i])).astype(np.uint32) & np.uint32((1 << WIDTHS[i]) - 1)
    rows, keys = [], []
    for tag, pair in enumerate(combinations(range(3), 2)):
        of = np.flatnonzero(key >> 24 == tag)
        x, third = fp[of], 3 - sum(pair)
        c = segment(third, x)
        near = table[c[:, None] ^ (np.uint32(1) << np.arange(WIDTHS[third], dtype=np.uint32))]
        index = np.sort(np.concatenate([table[c][:, None], near], axis=1), axis=1).astype(np.uint64)
        new = np.ones(index.shape, bool)
        new[:, 1:] = index[:, 1:] != index[:, :-1]
        r, at = np.nonzero(new)
        for kind, value, row in ((1, index[r, at], r), (2, segment(pair[0], x).astype(np.uint64), np.arange(len(x))), (3, segment(pair[1], x).astype(np.uint64), np.arange(len(x)))):
            h = (key[of[row]].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (value << np.uint64(2) | np.uint64(kind)) * np.uint64(0xC2B2AE3D27D4EB4F)
            rows.append(of[row])
            keys.append((h ^ (h >> np.uint64(29))) * np.uint64(0x165667B19E3779F9))
    return np.concatenate(rows), np.concatenate(keys).view(np.int64)


def _forest(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges within MAX_BITS that connect whatever can be connected in ``fp``, fewer than there are fingerprints."""
    rest, ends = fp[1:], ([], [])
    todo = [fp[0]]
    while len(rest):
        if not todo:
            todo, rest = [rest[0]], rest[1:]
            continue
        x = todo.pop()
        close = np.bitwise_count(rest ^ x) <= MAX_BITS
        if close.any():
            found = rest[close]
            ends[0].append(np.full(len(found), x))
            ends[1].append(found)
            todo.extend(found)
            rest = rest[~close]
    return (np.concatenate(ends[0]), np.concatenate(ends[1])) if ends[0] else (fp[:0], fp[:0])


def _linked(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges among the fingerprints of each key; ``key`` is sorted. Small groups compare at growing distances, large ones grow trees."""
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.append(starts, len(key)))
    small = np.repeat(sizes <= 16, sizes)
    a, b = [], []
    for gap in range(1, 16):
        same = np.flatnonzero((key[gap:] == key[:-gap]) & small[gap:]) if len(key) > gap else np.zeros(0, int)
        if not len(same):
            break
        hit = same[np.bitwise_count(fp[same] ^ fp[same + gap]) <= MAX_BITS]
        a.append(fp[hit])
        b.append(fp[hit + gap])
    for s in np.flatnonzero(sizes > 16):
        x, y = _forest(fp[starts[s] : starts[s] + sizes[s]])
        a.append(x)
        b.append(y)
    a, b = np.concatenate(a) if a else fp[:0], np.concatenate(b) if b else fp[:0]
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def links(distinct: DataFrame) -> DataFrame:
    """u, v: edges between the distinct fingerprints of column fp that differ in 1 to MAX_BITS bits, enough to connect all that such pairs connect."""
    spark = distinct.sparkSession

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = golay_indices()
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            for at in range(0, len(fp), 2048):
                part = fp[at : at + 2048]
                row, key = fuzzy_keys(part.view(np.uint64), table)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row])], ["key", "fp"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            a, b = _linked(key, fp.view(np.uint64))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["u", "v"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            key, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp"))
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1]))  # the last group may go on in the next batch
            if cut or (held and held[0][0][0] != key[-1]):
                held.append((key[:cut], fp[:cut]))
                k, f = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
                held = []
                if len(k):
                    yield edges(k, f)
            held.append((key[cut:], fp[cut:]))
        if held:
            yield edges(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = golay_indices()
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 16):
                key, fp = (batch.column(c).slice(at, 1 << 16).to_numpy(zero_copy_only=False) for c in ("key", "fp"))
                row, finer = finer_keys(key, fp.view(np.uint64), table)
                yield pa.RecordBatch.from_arrays([pa.array(finer), pa.array(fp[row])], ["key", "fp"])

    def large(rows: DataFrame, most: int) -> DataFrame:
        return stored(rows.groupBy("key").count().where(F.col("count") > most), "large")

    filed = stored(distinct.repartition(session_partitions(spark), "fp").mapInArrow(tidied(file), "key long, fp long"), "golay")
    many = large(filed, min(REFINE, BLOCK))
    grouped = filed
    if not many.isEmpty():
        plain = filed.join(many.select("key"), "key", "left_anti")
        fine = stored(filed.join(many.select("key"), "key", "left_semi").mapInArrow(tidied(refine), "key long, fp long"), "finer")
        big = large(fine, BLOCK).select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
        cut = fine.join(big, "key", "left").withColumn("own", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")))
        # block i meets block j in the group (i, j): each pair of blocks once, a block's own pairs in any of them
        met = cut.where("own is not null").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        met = met.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp")
        grouped = plain.union(cut.where("own is null").select("key", "fp")).union(met)
    grouped = grouped.repartition("key").sortWithinPartitions("key")
    return grouped.mapInArrow(tidied(verify), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fp, component_id for every row: fingerprints at MAX_BITS or fewer differing bits link; component_id is the smallest key in it.

    Null and wordless texts have fingerprint 0 and link like any other; equal rows stay; a null key keeps
    its row but never names a component unless it is alone. An empty table gives an empty result.
    """
    prints = stored(simhash(docs, key, text), "prints")
    classes = prints.groupBy("fp").agg(F.min(key).alias("least"))
    roots = components(links(classes.select("fp")))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "names")  # written, so that Spark can split the join's large partitions
    named = stored(rooted.join(names, "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select(key, "fp", "component_id")


def hex16(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component of similar texts the document with the smallest doc_id stays (of equal rows all; of null ids one, where no other is in the component).

    The contract's 4 bits of 64 are op1's alone: this stage links by the similarity of shingles.
    """
    from keystrata.llm.similar import one_of_each, similar

    return one_of_each(docs, similar(docs))

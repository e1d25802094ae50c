"""Removal of byte strings that an earlier document holds, by distributed doubling of ranked positions.

A text of n bytes has n suffixes; prefix doubling gives each a rank by its first h bytes and ranks pairs
(rank at p, rank at p + h) at growing h until a rank is unique or h passes the threshold. Doing that for
every position moves some 24 bytes a position and round. Here the first round ranks only sampled
positions that cannot miss a match: of the W = SPAN - SEED + 1 seeds in each stretch of SPAN bytes the one with the
least code (equal stretches choose alike). Rounds:

1. (seed code, code of the context, which is all stretches that chose this position, SPAN to SPAN + W - 1 bytes)
   pairs are sorted. A seed that one document alone holds is unique and leaves. In the rest, where a context recurs,
   all its stretches recur, so every holder but those with the smallest doc_id is settled at once; only one
   holder of each context that shares its seed with other contexts goes on, and only with stretches on that side of the seed where
   the next SIDE = 17 bytes recur, too: a stretch holds those on its left or those on its right (16 bits of their code rule out most).
2. Their stretches, now every position, are ranked by (code of the first half, code of the second half
   at offset SPAN / 2): one doubling to SPAN. Of equal pairs all but the smallest doc_id's are settled.

Codes are 64-bit hashes; a decision always rests on at least 80 bits (a bucket's number counts among them).
Pairs travel packed, a block of arrays a row, one bucket in a task; within a batch equal pairs are settled
before the shuffle, so a passage that a third of all documents hold costs a bucket one entry a batch. A seed that
a batch holds in very many contexts is not paired at all: its stretches go to round 2 at once, where each has a code of its own.
The seed itself is sent to its bucket, which passes the stretches that other batches found for it on to round 2, too, so all of them meet there.

A row is known by its key, and where keys repeat or are null also by the 64-bit hash of its text, so such rows are told apart and spread.

``doubled_spans`` is the plain method, prefix doubling at every position; it gives the same rows and moves far more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from keystrata.llm.shared import buffers, pack, ragged, session_partitions, stored, tidied, unpack, worker_cache

SPAN, SEED, SIDE = 50, 16, 17
#: Text bytes of a bucket and a document block, of a batch that settles equal pairs by itself, and of a vectorised step.
BUCKET_BYTES, BATCH_BYTES, STEP_BYTES = 8 << 20, 16 << 20, 1 << 19
#: Contexts of a seed in a batch above which its stretches are ranked without pairing.
COMMON = 64
#: Order key of a null doc_id: larger than any other, so its text never counts as earlier.
LAST = np.iinfo(np.int64).max

_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _K2
    x = (x ^ (x >> np.uint64(29))) * _K3
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0 .. base**n and the inverses, modulo 2**64."""
    base, inverse = int(_K1), pow(int(_K1), -1, 1 << 64)
    up, down = np.empty(n + 1, np.uint64), np.empty(n + 1, np.uint64)
    for out, b in ((up, base), (down, inverse)):
        out[0] = 1
        size = 1
        while size <= n:
            m = min(size, n + 1 - size)
            out[size : size + m] = out[:m] * np.uint64(pow(b, size, 1 << 64))
            size += m
    return up, down


def _sides(codes: Codes, chosen: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """16 bits each of the codes of the SIDE bytes before a seed and after it; 0 where no stretch holds them."""
    out = np.zeros(len(chosen), "<u4")
    for has, begin, shift in ((chosen - first > SIDE, chosen - SIDE, 16), (chosen - last <= SIDE, chosen + SEED, 0)):
        at = begin[has]
        out[has] |= np.maximum(codes.of(at, at + SIDE) >> np.uint64(48), np.uint64(1)).astype(np.uint32) << np.uint32(shift)
    return out


class Codes:
    """Codes of substrings of a buffer: sums of mixed 8-byte pieces times powers, so any substring of 8 or more bytes costs two look-ups."""

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        x = np.zeros(n + 8, np.uint64)
        x[:n] = raw
        for shift in (1, 2, 4):
            x[:-shift] |= x[shift:] << np.uint64(8 * shift)
        self.eight = x[:n]
        cache = worker_cache()
        if len(cache.get("powers", ((),))[0]) < n + 2:
            cache["powers"] = _powers(max(n + 1, STEP_BYTES + (STEP_BYTES >> 2)))
        up, self.down = cache["powers"]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_mix(self.eight * _K1 + _K3) * up[:n], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end - 7] - self.sums[begin]) * self.down[begin] + (end - begin).astype(np.uint64))

    def seeds(self) -> np.ndarray:
        """The code of the SEED = 16 bytes at each position but the last 15."""
        x = self.eight[: max(len(self.eight) - SEED + 1, 0)]
        return _mix(x * _K1 ^ _mix(self.eight[SEED - 8 : SEED - 8 + len(x)] + _K2))


def choices(seeds: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chosen, first, last): the position with the least seed code, and the first and last start of the SPAN-byte stretches that choose it, over all stretches within a document."""
    width = SPAN - SEED + 1
    none = np.zeros(0, np.int64)
    if len(seeds) < width:
        return none, none, none
    x = (seeds & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(seeds), dtype=np.uint64)  # ties: the leftmost
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    if size < width:
        gap = width - size
        x = np.minimum(x[:-gap], x[gap:])
    chosen = (x & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = ragged(at[:-1], np.maximum(np.diff(at) - SPAN + 1, 0))
    chosen = chosen[starts]
    if not len(starts):
        return none, none, none
    new = np.flatnonzero(np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1))))
    return chosen[new], starts[new], starts[np.append(new[1:], len(starts)) - 1]


def _blob(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, more: np.ndarray, *codes: np.ndarray) -> bytes:
    """Entries packed: document (order key and tag of its text), start, stretches beyond the first, and codes."""
    order = np.lexsort((start, tag, doc))
    doc, tag = doc[order], tag[order]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]))) if len(doc) else np.zeros(0, bool)
    place = (np.cumsum(new) - 1).astype("<u4")
    parts = [pack(doc[new].astype("<i8")), pack(tag[new].astype("<u8")), pack(place), pack(start[order].astype("<u4")), pack(more[order].astype("<u1"))]
    parts += [c[order].tobytes() for c in codes]
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def _unblob(blobs: list[bytes], kinds: tuple[str, ...]) -> list[np.ndarray]:
    """doc, tag, start, more and codes of all entries of ``blobs``."""
    columns: list[list[np.ndarray]] = [[] for _ in range(4 + len(kinds))]
    for b in blobs:
        parts, at = [], 0
        while at < len(b):
            n = int.from_bytes(b[at : at + 4], "little")
            parts.append(b[at + 4 : at + 4 + n])
            at += 4 + n
        place = unpack(parts[2], "<u4")
        values = [unpack(parts[0], "<i8")[place], unpack(parts[1], "<u8")[place], unpack(parts[3], "<u4").astype(np.int64), unpack(parts[4], "<u1").astype(np.int64)]
        values += [np.frombuffer(p, k) for p, k in zip(parts[5:], kinds, strict=True)]
        for c, v in zip(columns, values, strict=True):
            c.append(v)
    empty = [np.zeros(0, k) for k in ("<i8", "<u8", np.int64, np.int64, *kinds)]
    return [np.concatenate(c) if c else e for c, e in zip(columns, empty, strict=True)]


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Whether each sorted row begins a group of equal keys."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _least(new: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The smallest doc of each row's group."""
    first = np.flatnonzero(new)
    return np.repeat(np.minimum.reduceat(doc, first), np.diff(np.append(first, len(doc)))) if len(first) else doc


def _recurs(seed: np.ndarray, side: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether another doc has the same seed and side; a side of 0 is none."""
    order = np.lexsort((side, seed))
    first = np.flatnonzero(_groups(seed[order], side[order]))
    out = np.zeros(len(doc), bool)
    if len(first):
        held = doc[order]
        out[order] = np.repeat(np.maximum.reduceat(held, first) > np.minimum.reduceat(held, first), np.diff(np.append(first, len(doc))))
    return out & (side > 0)


_BUCKET = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])
_SCHEMA = "bucket int, kind int, blob binary"
#: Kinds of blobs: pairs to be ranked; settled stretches; stretches to be ranked in the next round; seeds of which a batch did not pair its stretches.
PAIRS, SETTLED, OPEN, UNPAIRED = 0, 1, 2, 3


def _by_bucket(bucket: np.ndarray, kind: int, doc, tag, start, more, *codes) -> Iterator[tuple[int, int, bytes]]:
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(_groups(bucket[order]))
    for a, b in zip(edges, np.append(edges[1:], len(order)), strict=True):
        rows = order[a:b]
        yield int(bucket[rows[0]]), kind, _blob(doc[rows], tag[rows], start[rows], more[rows], *(c[rows] for c in codes))


def _rows(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], f.type) for i, f in enumerate(_BUCKET)], schema=_BUCKET)


def _home(doc: np.ndarray, tag: np.ndarray, blocks: int) -> np.ndarray:
    """The document block of a row."""
    return (_mix(doc.astype(np.int64).view(np.uint64) ^ _mix(tag)) % np.uint64(blocks)).astype(np.int32)


def _steps(at: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs a to b of documents with about ``most`` bytes; a longer document is a run of its own."""
    a, n = 0, len(at) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(at, at[a] + most, "right")) - 1)
        yield a, b
        a = b


def _documents(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """raw, offsets, order key and tag of each document."""
    raw, at = buffers(batch.column("text"))
    doc = batch.column("key")
    doc = doc.combine_chunks() if isinstance(doc, pa.ChunkedArray) else doc
    return raw, at, doc.to_numpy(zero_copy_only=False), batch.column("tag").to_numpy().view(np.uint64)


def shared_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", kept: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``docs``: key, n_bytes, n_removed, n_spans, kept_sha256, the kept text under the name ``kept``, and the columns ``carry``, whose names differ from those.

    A byte goes if a string of SPAN bytes over it also starts in a row with a smaller key; strings are judged
    on the input and never cross texts. A null text is empty; a null key is larger than any other; rows
    with equal keys do not count as earlier for each other; equal rows get equal results. The
    kept text holds a character whole if any byte of it stays.
    """
    carried = [f"carry_{i}" for i in range(len(carry))]
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("key"), F.coalesce(text, F.lit("")).alias("text"), *[F.col(f"`{c}`").alias(n) for c, n in zip(carry, carried, strict=True)])
    repeated = rows.where("id is not null").groupBy("id").count().where("count > 1").limit(1).count()
    rows = rows.withColumn("tag", F.when(F.col("id").isNull() | F.lit(bool(repeated)), F.xxhash64("text")).otherwise(F.lit(0).cast("long")))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BUCKET_BYTES))

    def rank_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ranked(parts: list[tuple]) -> pa.RecordBatch:
            seed, context, who, what, start, more, ahead, sides = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.lexsort((who, context, seed))
            seed, context, who, what, start, more, ahead, sides = (c[order] for c in (seed, context, who, what, start, more, ahead, sides))
            settled = who > _least(_groups(seed, context), who)
            found = list(_by_bucket(_home(who[settled], what[settled], blocks), SETTLED, who[settled], what[settled], start[settled], more[settled]))
            left = ~settled
            edges = np.flatnonzero(_groups(seed))
            many = np.add.reduceat(_groups(seed, context).astype(np.int64), edges) > COMMON
            common = left & np.repeat(many, np.diff(np.append(edges, len(seed))))
            found += _by_bucket(_home(who[common], what[common], blocks), OPEN, who[common], what[common], start[common], more[common])
            left &= ~common
            bucket = ((seed >> np.uint64(32)) % np.uint64(blocks)).astype(np.int32)
            one = edges[many]
            found += _by_bucket(bucket[one], UNPAIRED, who[one], what[one], start[one], more[one], seed[one].astype("<u4"))
            narrow = np.ascontiguousarray(context[left]).view(np.uint8).reshape(-1, 8)[:, :6].copy().view("V6").ravel()
            found += _by_bucket(bucket[left], PAIRS, who[left], what[left], start[left], more[left], seed[left].astype("<u4"), narrow, ahead[left], sides[left])
            return _rows(found)

        for batch in batches:
            raw, at, doc, tag = _documents(batch)
            parts, held = [], 0
            for a, b in _steps(at, STEP_BYTES):
                here, text = at[a : b + 1] - at[a], raw[at[a] : at[b]]
                codes = Codes(text)
                seeds = codes.seeds()
                chosen, first, last = choices(seeds, here)
                if len(chosen):
                    owner = np.searchsorted(here, first, "right") - 1
                    context = _mix(codes.of(first, last + SPAN) + (chosen - first).astype(np.uint64) * _K1) >> np.uint64(16)
                    parts.append((seeds[chosen], context, doc[a + owner], tag[a + owner], (first - here[owner]).astype(np.uint32), (last - first).astype(np.uint8), (chosen - first).astype(np.uint8), _sides(codes, chosen, first, last)))
                held += len(text)
                if held >= BATCH_BYTES and parts:
                    yield ranked(parts)
                    parts, held = [], 0
            if parts:
                yield ranked(parts)

    def passed(table: pa.Table) -> tuple[list[bytes], list[tuple[int, int, bytes]]]:
        """The blobs of pairs of a bucket, and the other rows, which only pass."""
        rows = list(zip(table.column("bucket").to_pylist(), table.column("kind").to_pylist(), table.column("blob").to_pylist(), strict=True))
        return [r[2] for r in rows if r[1] == PAIRS], [r for r in rows if r[1] != PAIRS]

    def settle_seeds(table: pa.Table) -> pa.Table:
        blobs, found = passed(table)
        unpaired = _unblob([r[2] for r in found if r[1] == UNPAIRED], ("<u4",))[-1]
        found = [r for r in found if r[1] != UNPAIRED]
        doc, tag, start, more, seed, narrow, ahead, sides = _unblob(blobs, ("<u4", "V6", "u1", "<u4"))
        if len(doc):
            wide = np.zeros((len(narrow), 8), np.uint8)
            wide[:, :6] = narrow.view(np.uint8).reshape(-1, 6)
            context = wide.view("<u8").ravel()
            order = np.lexsort((doc, context, seed))
            doc, tag, start, more, seed, context, ahead, sides = (x[order] for x in (doc, tag, start, more, seed, context, ahead, sides))
            by_seed, by_context = _groups(seed), _groups(seed, context)
            edges = np.flatnonzero(by_seed)
            size = np.diff(np.append(edges, len(doc)))
            shared = np.repeat((np.maximum.reduceat(doc, edges) > np.minimum.reduceat(doc, edges)), size)
            mixed = np.repeat(np.add.reduceat(by_context.astype(np.int64), edges) > 1, size)
            settled = shared & (doc > _least(by_context, doc))
            found += _by_bucket(_home(doc[settled], tag[settled], blocks), SETTLED, doc[settled], tag[settled], start[settled], more[settled])
            whole = np.isin(seed, unpaired) & ~settled  # their partners are in round 2
            found += _by_bucket(_home(doc[whole], tag[whole], blocks), OPEN, doc[whole], tag[whole], start[whole], more[whole])
            rest = np.flatnonzero(shared & mixed & ~settled & ~whole)
            doc, tag, start, more, seed, sides = doc[rest], tag[rest], start[rest], more[rest], seed[rest], sides[rest]
            middle = start + ahead[rest] - SIDE  # stretches from here on hold the bytes after the seed, those before it the ones ahead of it
            for side, low, high in ((sides >> 16, start, np.minimum(start + more, middle - 1)), (sides & 0xFFFF, np.maximum(start, middle), start + more)):
                open_ = np.flatnonzero((_recurs(seed, side, doc)) & (low <= high))
                found += _by_bucket(_home(doc[open_], tag[open_], blocks), OPEN, doc[open_], tag[open_], low[open_], high[open_] - low[open_])
        return pa.Table.from_batches([_rows(found)], _BUCKET)

    def stretches(table: pa.Table, notes: pa.Table, kind: int):
        """The block's table, buffer, documents, and (owner, start, more) of the noted stretches of ``kind``, owners ascending."""
        table = table.combine_chunks()
        raw, at, doc, tag = _documents(table)
        chosen = [b for b, k in zip(notes.column("blob").to_pylist(), notes.column("kind").to_pylist(), strict=True) if k == kind]
        d, t, start, more = _unblob(chosen, ())
        name = lambda a, b: a.astype(np.int64).view(np.uint64) * _K1 + b * _K2
        mine, noted = name(doc, tag), name(d, t)
        by = np.argsort(mine, kind="stable")
        low, high = np.searchsorted(mine[by], noted, "left"), np.searchsorted(mine[by], noted, "right")
        owner = by[ragged(low, high - low)]
        start, more = np.repeat(start, high - low), np.repeat(more, high - low)
        fits = start + more + SPAN <= (at[1:] - at[:-1])[owner]
        owner, start, more = owner[fits], start[fits], more[fits]
        order = np.argsort(owner, kind="stable")
        return table, raw, at, doc, tag, owner[order], start[order], more[order]

    def rank_halves(table: pa.Table, notes: pa.Table) -> pa.Table:
        found: list[tuple[int, int, bytes]] = []
        if table.num_rows and notes.num_rows:
            _, raw, at, doc, tag, owner, start, more = stretches(table, notes, OPEN)
            half, parts = SPAN // 2, []
            for a, b in _steps(at, STEP_BYTES):
                x, y = np.searchsorted(owner, (a, b))
                if x < y:
                    codes = Codes(raw[at[a] : at[b]])
                    s = ragged(start[x:y], more[x:y] + 1)
                    whose = np.repeat(owner[x:y], more[x:y] + 1)
                    here = at[whose] - at[a] + s
                    parts.append((codes.of(here, here + half), codes.of(here + half, here + SPAN), whose.astype(np.int32), s.astype(np.uint32)))
            if parts:
                front, back, owner, s = (np.concatenate(c) for c in zip(*parts, strict=True))
                who = doc[owner]
                order = np.lexsort((who, back, front))
                front, back, s, owner, who = front[order], back[order], s[order], owner[order], who[order]
                what, none = tag[owner], np.zeros(len(s), np.uint8)
                settled = who > _least(_groups(front, back), who)
                found += _by_bucket(_home(who[settled], what[settled], blocks), SETTLED, who[settled], what[settled], s[settled], none[settled])
                left = ~settled
                bucket = ((front >> np.uint64(32)) % np.uint64(blocks)).astype(np.int32)
                found += _by_bucket(bucket[left], PAIRS, who[left], what[left], s[left], none[left], front[left].astype("<u8"), back[left].astype("<u4"))
        return pa.Table.from_batches([_rows(found)], _BUCKET)

    def settle_halves(table: pa.Table) -> pa.Table:
        blobs, found = passed(table)
        doc, tag, start, more, front, back = _unblob(blobs, ("<u8", "<u4"))
        if len(doc):
            order = np.lexsort((doc, back, front))
            doc, tag, start, more, front, back = (x[order] for x in (doc, tag, start, more, front, back))
            settled = doc > _least(_groups(front, back), doc)
            found += _by_bucket(_home(doc[settled], tag[settled], blocks), SETTLED, doc[settled], tag[settled], start[settled], more[settled])
        return pa.Table.from_batches([_rows(found)], _BUCKET)

    def cut(table: pa.Table, notes: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.Table.from_arrays([pa.array([], f.type) for f in out_schema] + [table.column(c) for c in carried], [*out_schema.names, *carried])
        table, raw, at, _, _, owner, start, more = stretches(table, notes, SETTLED)
        columns: list[list] = [[] for _ in out_schema][1:]
        for a, b in _steps(at, STEP_BYTES):
            x, y = np.searchsorted(owner, (a, b))
            here, text = at[a : b + 1] - at[a], raw[at[a] : at[b]]
            begin = here[owner[x:y] - a] + start[x:y]
            size = len(text) + 1
            gone = np.cumsum(np.bincount(begin, minlength=size) - np.bincount(begin + more[x:y] + SPAN, minlength=size))[:-1] > 0
            edge = gone.copy()
            edge[1:] &= ~gone[:-1]
            full = here[:-1][np.diff(here) > 0]
            edge[full] = gone[full]
            many, spans = (np.diff(np.concatenate(([0], np.cumsum(f)))[here]) for f in (gone, edge))
            left, stay = text[~gone].tobytes(), np.concatenate(([0], np.cumsum(np.diff(here) - many))).tolist()
            made = [np.diff(here), many, spans, [hashlib.sha256(left[i:j]).hexdigest() for i, j in zip(stay[:-1], stay[1:], strict=True)]]
            if kept:
                lead = np.flatnonzero((text & 0xC0) != 0x80)
                if len(lead):
                    gone = np.repeat(np.logical_and.reduceat(gone, lead), np.diff(np.append(lead, len(text))))
                left, stay = text[~gone].tobytes(), np.concatenate(([0], np.cumsum(~gone)))[here]
                made += [[left[i:j].decode() for i, j in zip(stay[:-1].tolist(), stay[1:].tolist(), strict=True)]]
            for column, values in zip(columns, made, strict=True):
                column.extend(values)
        made = [pa.array(c, f.type) for c, f in zip(columns, list(out_schema)[1:], strict=True)]
        return pa.Table.from_arrays([table.column("id"), *made, *(table.column(c) for c in carried)], [*out_schema.names, *carried])

    out_schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())] + ([("kept", pa.string())] if kept else []))
    homed = rows.withColumn("bucket", F.arrow_udf(lambda k, t: pa.array(_home(k.to_numpy(zero_copy_only=False), t.to_numpy(zero_copy_only=False).view(np.uint64), blocks)), "int")("key", "tag"))
    seeds = rows.select("key", "tag", "text").mapInArrow(tidied(rank_seeds), _SCHEMA)
    first = stored(seeds.groupBy("bucket").applyInArrow(settle_seeds, _SCHEMA), "seeds")
    open_ = first.where(F.col("kind") == OPEN)
    halves = homed.select("bucket", "key", "tag", "text").groupBy("bucket").cogroup(open_.groupBy("bucket")).applyInArrow(rank_halves, _SCHEMA)
    second = stored(halves.groupBy("bucket").applyInArrow(settle_halves, _SCHEMA), "halves")
    notes = first.union(second).where(F.col("kind") == SETTLED)
    schema = T.StructType.fromDDL("id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * bool(kept))
    for c in carried:
        schema = schema.add(c, homed.schema[c].dataType)
    found = homed.groupBy("bucket").cogroup(notes.groupBy("bucket")).applyInArrow(cut, schema)
    names = {"id": key, "kept": kept or "kept", **dict(zip(carried, carry, strict=True))}
    return found.select([F.col(c).alias(names.get(c, c)) for c in found.columns])


def doubled_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """key, n_bytes, n_removed, n_spans of ``shared_spans`` by prefix doubling at every position, as DataFrames throughout.

    Every position starts with its byte as rank. A round sorts the pairs (rank at p, rank at p + h) over the cluster and numbers the
    different ones: ranks of 2h bytes. Positions whose pair is alone leave, as no longer string from there can recur. When the ranked
    length h passes span / 2, a last round pairs p with p + span - h. A position moves some 40 bytes a round.
    Rows with equal keys do not count as earlier for each other, null keys are larger than any other.
    """
    rows = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), F.encode(F.coalesce(text, F.lit("")), "UTF-8").alias("b")), "rows")
    order = F.coalesce("id", F.lit(LAST)).alias("order")
    byte = F.conv(F.substring(F.hex("b"), F.col("p") * 2 + 1, F.lit(2)), 16, 10).cast("long")
    sizes = rows.select("row", "id", F.octet_length("b").cast("long").alias("n_bytes"))
    now = stored(rows.where(F.octet_length("b") >= span).withColumn("p", F.explode(F.sequence(F.lit(0), F.octet_length("b") - 1))).select("row", order, "p", byte.alias("rank")), "ranks")
    h = 1
    while h < span:
        step = h if 2 * h <= span else span - h
        other = now.select("row", (F.col("p") - step).alias("p"), F.col("rank").alias("next"))
        pairs = now.select("row", "order", "p", "rank").join(other, ["row", "p"])
        # the rank of a pair is the number of the rows before its first one in sorted order: a range sort and a sum over partitions
        n = session_partitions(docs.sparkSession)
        ranked = pairs.groupBy("rank", "next").agg(F.count("*").alias("n"), F.min("order").alias("low"), F.max("order").alias("high")).where("n > 1")
        sorted_ = stored(ranked.repartitionByRange(n, "rank", "next").sortWithinPartitions("rank", "next").withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "sorted")
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
        shift = sorted_.groupBy("part").agg(F.count("*").alias("rows")).select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("shift"))
        numbers = sorted_.join(shift, "part").select("rank", "next", "low", (F.col("at") + F.col("shift")).alias("new"))
        now = stored(pairs.join(numbers, ["rank", "next"]).select("row", "order", "p", F.col("new").alias("rank"), "low"), "ranks")
        h += step
    gone = now.where(F.col("order") > F.col("low")).select("row", F.col("p").cast("long").alias("p"))
    prior = F.lag("p").over(Window.partitionBy("row").orderBy("p"))
    each = gone.select("row", F.when(prior.isNull() | (F.col("p") > prior + span), span).otherwise(F.col("p") - prior).alias("bytes"), (prior.isNull() | (F.col("p") > prior + span)).cast("long").alias("first"))
    found = each.groupBy("row").agg(F.sum("bytes").alias("removed"), F.sum("first").alias("spans"))
    zero = F.lit(0).cast("long")
    return sizes.join(found, "row", "left").select(F.col("id").alias(key), "n_bytes", F.coalesce("removed", zero).alias("n_removed"), F.coalesce("spans", zero).alias("n_spans"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all documents keep after strings of 50 bytes of earlier documents are removed."""
    return shared_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def drop_shared(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts lose their shared strings (whole characters), n_chars follows; a document of which nothing is left goes."""
    carry = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    marks = {f"__ks_{i}": F.col(f"`{c}`") for i, c in enumerate(carry)}  # names of their own: columns may be called as the result's are
    named = docs.select("doc_id", "text", *[c.alias(n) for n, c in marks.items()], F.col("text").isNull().alias("__ks_null"))
    found = shared_spans(named, kept="__ks_text", carry=(*marks, "__ks_null"))
    changed = F.col("n_removed") > 0
    columns = {"doc_id": F.col("doc_id"), "text": F.when(~F.col("__ks_null"), F.col("__ks_text"))} | {c: F.col(n) for n, c in zip(marks, carry, strict=True)}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(changed, F.char_length("__ks_text").cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return found.where(~(changed & (F.col("__ks_text") == ""))).select([columns[c].alias(c) for c in docs.columns])

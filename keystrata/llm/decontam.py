"""Benchmark decontamination over a distributed positional inverted index.

The corpus is cut into segments of some megabytes of text. Each segment stores the sorted hashes of its
words and, for each word, the sorted list of its positions; documents lie a gap apart on the segment's
axis, so no phrase crosses two of them. A phrase is searched in every segment from its rarest word there:
that word's positions, less its offset in the phrase, are the candidates, and the lists of the other words,
less theirs, are intersected with them in order of length. Segments are independent: nothing is shuffled,
no word's list is ever gathered from the whole corpus, and a lost segment is rebuilt from its own rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keystrata.llm.shared import buffers, pack, scratch, slices, stored, tidied, unpack

WINDOW = 10
#: Text bytes of a segment; benchmark text bytes that one pass sends to the executors (about 30 MB there, and 200 MB on the driver).
SEGMENT_BYTES, PASS_BYTES = 12 << 20, 2 << 20
#: Positions between two documents of a segment, more than any phrase or proximity window spans.
GAP = 1024

_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of every word ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lowering A-Z, and the number of words of each text."""
    n = len(at) - 1
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    low = np.concatenate((_LOWER[raw], np.zeros(8, np.uint8)))
    inside = _WORD[low[: len(raw)]]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    size = stop - start
    h = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    eight = np.lib.stride_tricks.sliding_window_view(low, 8)
    live = np.arange(len(start))
    for k in range(int(-(-size.max() // 8)) if len(size) else 0):
        live = live[size[live] > 8 * k]
        here = start[live] + 8 * k
        piece = np.ascontiguousarray(eight[here]).view("<u8").ravel()
        left = np.minimum(size[live] - 8 * k, 8).astype(np.uint64)
        piece &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left)
        x = (h[live] ^ piece) * np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        h[live] = x ^ (x >> np.uint64(29))
    return h, np.diff(np.searchsorted(start, at))


def build_index(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the index of ``docs`` to ``path``: a row a segment with its name, keys, n_words, and terms, freqs, postings packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SEGMENT_BYTES):
                h, n = words(*buffers(part.column("text")))
                base = np.concatenate(([0], np.cumsum(n)[:-1])) + GAP * np.arange(len(n))
                at = (np.arange(len(h)) + np.repeat(base - np.concatenate(([0], np.cumsum(n)[:-1])), n)).astype(np.uint32)
                order = np.argsort(h, kind="stable")
                h, at = h[order], at[order]
                first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
                freq = np.diff(np.append(first, len(h))).astype(np.uint32)
                step = at.copy()
                step[1:] -= at[:-1]
                step[first] = at[first]
                blobs = [pa.array([pack(a)], pa.binary()) for a in (h[first], freq, step)]
                keys = part.column("key")
                lists = [pa.ListArray.from_arrays([0, len(keys)], keys), pa.ListArray.from_arrays([0, len(n)], pa.array(n))]
                yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), *lists, *blobs], ["segment", "keys", "n_words", "terms", "freqs", "postings"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    rows.mapInArrow(tidied(run), f"segment string, keys array<{kind}>, n_words array<bigint>, terms binary, freqs binary, postings binary").write.parquet(path)
    return docs.sparkSession.read.parquet(path)


@dataclass
class Segment:
    terms: np.ndarray
    bounds: np.ndarray
    postings: np.ndarray

    @classmethod
    def load(cls, terms: bytes, freqs: bytes, steps: bytes) -> Segment:
        freq, at = unpack(freqs, "<u4").astype(np.int64), unpack(steps, "<u4").astype(np.int64)
        bounds = np.concatenate(([0], np.cumsum(freq)))
        if len(at):
            total = np.cumsum(at)
            at = total - np.repeat(total[bounds[:-1]] - at[bounds[:-1]], freq)
        return cls(unpack(terms, "<u8"), bounds, at)

    def find(self, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each word, and how often it occurs, 0 for absent words."""
        if not len(self.terms):
            return np.zeros(len(vocabulary), np.int64), np.zeros(len(vocabulary), np.int64)
        at = np.minimum(np.searchsorted(self.terms, vocabulary), len(self.terms) - 1)
        return at, np.where(self.terms[at] == vocabulary, self.bounds[at + 1] - self.bounds[at], 0)

    def phrase(self, places: np.ndarray, freq: np.ndarray) -> np.ndarray:
        """Positions where the words at ``places`` follow each other, intersecting from the rarest on."""
        order = np.argsort(freq, kind="stable")
        start = self.postings[self.bounds[places[order[0]]] : self.bounds[places[order[0]] + 1]] - order[0]
        for k in order[1:]:
            if not len(start):
                break
            have = self.postings[self.bounds[places[k]] : self.bounds[places[k] + 1]]
            at = np.minimum(np.searchsorted(have, start + k), len(have) - 1)
            start = start[have[at] == start + k]
        return start

    def near(self, places: np.ndarray, freq: np.ndarray, span: int) -> np.ndarray:
        """(start, end) of every shortest stretch of at most ``span`` positions that holds all the words at ``places``, in any order."""
        places, first = np.unique(places, return_index=True)
        freq = freq[first]
        lists = [self.postings[self.bounds[p] : self.bounds[p + 1]] for p in places]
        rare = lists[int(np.argmin(freq))]
        close = [x[np.unique(np.clip(np.searchsorted(x, (rare[:, None] + np.array([-span, span])).ravel()), 0, len(x) - 1))] if len(x) < 2 else x for x in lists]
        events = np.unique(np.concatenate(close))
        last = np.full(len(events), np.iinfo(np.int64).max)
        for x in close:
            at = np.searchsorted(x, events, "right") - 1
            last = np.minimum(last, np.where(at >= 0, x[np.maximum(at, 0)], -(1 << 40)))
        ok = events - last < span
        got = np.stack([last[ok], events[ok] + 1], axis=1)
        # of stretches with the same start the one that ends first
        return got[np.unique(got[:, 0], return_index=True)[1]] if len(got) else got


@dataclass
class Queries:
    """Distinct phrases of a block of items, and the items of each."""

    vocabulary: np.ndarray
    phrases: dict[int, np.ndarray]  # by length: (phrases, length) places in the vocabulary
    items: dict[int, list[list[str]]]


def queries_of(items: list[tuple[object, str | None]], window: int = WINDOW) -> Queries:
    column = pa.array([t for _, t in items], pa.string())
    h, n = words(*buffers(column))
    by: dict[tuple, list[str]] = {}
    base = 0
    for (item, _), k in zip(items, n.tolist(), strict=True):
        w = h[base : base + k].tolist()
        base += k
        for i in range(max(k - window, 0) + 1 if k else 0):
            ids = by.setdefault(tuple(w[i : i + window]), [])
            if item is not None and (not ids or ids[-1] != str(item)):
                ids.append(str(item))
    vocabulary = np.unique(h)
    lengths = sorted({len(p) for p in by})
    phrases = {k: np.searchsorted(vocabulary, np.array([p for p in by if len(p) == k], np.uint64)) for k in lengths}
    return Queries(vocabulary, phrases, {k: [by[p] for p in by if len(p) == k] for k in lengths})


def _passes(items: DataFrame) -> Iterator[list[tuple[object, str | None]]]:
    """The rows (item, text) in blocks of at most about PASS_BYTES."""
    block, held = [], 0
    for r in items.toLocalIterator():
        block.append((r[0], r[1]))
        held += len(r[1] or "")
        if held >= PASS_BYTES:
            yield block
            block, held = [], 0
    yield block


def search(index: DataFrame, items: DataFrame, slop: int | None = None, window: int = WINDOW) -> DataFrame:
    """key, n_words, spans (start, end, items) for every indexed document: what the items' phrases match in it.

    ``items`` has two columns, id and text; its windows of ``window`` words are the phrases, or the whole item
    if it is shorter; an item without words has none. ``slop``: None matches exact phrases, a number matches
    stretches at most that much longer than the phrase that hold all its words in any order. Spans are in
    word positions of the document. Repeated documents and items give repeated rows and ids once; a null item id
    hits without being named; a null key is an ordinary key.
    """
    kind = index.schema["keys"].dataType.elementType
    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("items", T.ArrayType(T.StringType()))]))
    schema = T.StructType([T.StructField("segment", T.StringType()), T.StructField("place", T.LongType()), T.StructField("key", kind), T.StructField("n_words", T.LongType()), T.StructField("spans", spans)])
    arrow_spans = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("items", pa.list_(pa.string()))])

    def searching(q: Queries):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    keys, n = batch.column("keys")[i].values, batch.column("n_words")[i].values.to_numpy()
                    segment = Segment.load(*(batch.column(c)[i].as_py() for c in ("terms", "freqs", "postings")))
                    place, freq = segment.find(q.vocabulary)
                    found: list[tuple[int, int, list[str]]] = []
                    for k, phrases in q.phrases.items():
                        for p in np.flatnonzero(freq[phrases].min(axis=1) > 0):
                            at, f = place[phrases[p]], freq[phrases[p]]
                            if slop is None:
                                found += [(s, s + k, q.items[k][p]) for s in segment.phrase(at, f).tolist()]
                            else:
                                found += [(s, e, q.items[k][p]) for s, e in segment.near(at, f, k + slop).tolist()]
                    base = np.concatenate(([0], np.cumsum(n)[:-1])) + GAP * np.arange(len(n))
                    out: dict[int, list[dict]] = {}
                    for s, e, ids in found:
                        d = int(np.searchsorted(base, s, "right")) - 1
                        out.setdefault(d, []).append({"start": s - int(base[d]), "end": e - int(base[d]), "items": ids})
                    name = pa.array([batch.column("segment")[i].as_py()] * len(n), pa.string())
                    yield pa.RecordBatch.from_arrays([name, pa.array(np.arange(len(n))), keys, pa.array(n), pa.array([out.get(d, []) for d in range(len(n))], pa.list_(arrow_spans))], ["segment", "place", "key", "n_words", "spans"])

        return run

    passes = _passes(items)
    block, following = next(passes), next(passes, None)
    found = index.mapInArrow(tidied(searching(queries_of(block, window))), schema)
    if following is None:
        return found.select("key", "n_words", "spans")
    # each pass's hits are a table before the next pass begins; they meet by segment and place
    hits = [stored(found.where(F.size("spans") > 0).select("segment", "place", "spans"), "hits")]
    while following is not None:
        found = index.mapInArrow(tidied(searching(queries_of(following, window))), schema)
        hits.append(stored(found.where(F.size("spans") > 0).select("segment", "place", "spans"), "hits"))
        following = next(passes, None)
    every = reduce(DataFrame.union, hits).groupBy("segment", "place").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    rows = index.select("segment", F.posexplode(F.arrays_zip("keys", "n_words")).alias("place", "d")).select("segment", F.col("place").cast("long").alias("place"), F.col("d.keys").alias("key"), "d.n_words")
    return rows.join(every, ["segment", "place"], "left").select("key", "n_words", F.coalesce("spans", F.array().cast(spans)).alias("spans"))


def covered(spans: F.Column) -> F.Column:
    """Number of positions that lie in any span."""
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(s["end"] - F.greatest(s["start"], acc["to"]), F.lit(0).cast("long"))).alias("n"),
        F.greatest(acc["to"], s["end"]).alias("to"),
    )
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    return F.aggregate(ordered, start, step)["n"]


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """key, n_words, n_hit, n_items, items_sha256, contaminated and the matching item ids for every row of ``docs``."""
    index = build_index(docs, scratch(docs.sparkSession, "index"), key, text)
    found = search(index, items.select(item, item_text))
    named = found.withColumn("items", F.array_sort(F.array_distinct(F.flatten(F.col("spans.items")))))
    return named.select(
        F.col("key").alias(key), "n_words", covered(F.col("spans")).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "items",
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the benchmark's windows of 10 words hit in every document."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, items).drop("items")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents in which any benchmark window occurs go; of rows with one doc_id, all go if any is hit. A row whose doc_id is null goes only with its own kind."""
    hit = contamination(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated").select(F.col("doc_id").alias("__ks_hit")).distinct()
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["__ks_hit"]), "left_anti")

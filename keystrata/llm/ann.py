"""Approximate nearest neighbours by additive quantisation.

A vector is the sum of one word of each of M full-dimensional codebooks plus a small residual. Codebooks
are trained one after the other on what the earlier ones leave over; encoding keeps the ``BEAM`` best
partial sums at each step. A query scores a block of codes by adding up table entries, its inner products
with the codebooks' words (or, with stored norms, by cosine). It then computes exactly those whose score, with ``SIGMAS`` standard
deviations of the error that their residual can make, reaches the best results so far: few where the codes are good, up
to all where they are not. The index stays where it lies; queries go to it in passes of a bounded size,
and a task keeps the best results of a pass over all its blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keystrata.llm.shared import stored, tidied

CODEBOOKS, CODEWORDS, BEAM, ROUNDS = 12, 256, 4, 6
#: Vectors that the codebooks are fitted to, at most about.
FIT_ROWS = 8192
#: Vectors of a block of codes; codes of a block that a query scores exactly at least; standard deviations that a score may be off.
BLOCK, RERANK, SIGMAS = 4096, 32, 4.5
#: Bytes of query vectors that one pass sends to every task.
PASS_BYTES = 32 << 20


@dataclass
class Quantiser:
    books: np.ndarray  # (M, words, dim) float32

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes (n, M) by beam search, and the squared norms of what they decode to."""
        n, m, words = len(x), *self.books.shape[:2]
        if not n or not m:
            return np.zeros((n, m), np.uint8), np.zeros(n, np.float32)
        rest, codes = x[:, None, :].astype(np.float32), np.zeros((n, 1, 0), np.uint8)
        for book in self.books:
            width = rest.shape[1]
            gain = (rest.reshape(-1, x.shape[1]) @ book.T).reshape(n, width, -1)
            cost = (rest**2).sum(axis=2, keepdims=True) - 2 * gain + (book**2).sum(axis=1)
            flat = cost.reshape(n, -1)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            best = np.take_along_axis(best, np.argsort(np.take_along_axis(flat, best, 1), axis=1, kind="stable"), 1)
            parent, word = best // len(book), best % len(book)
            rest = np.take_along_axis(rest, parent[:, :, None], 1) - book[word]
            codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), word[:, :, None].astype(np.uint8)], axis=2)
        return codes[:, 0], ((x - rest[:, 0]) ** 2).sum(axis=1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(codes), self.books.shape[2]), np.float32)
        for book, word in zip(self.books, codes.T, strict=True):
            out += book[word]
        return out

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(M, queries, words) inner products."""
        return np.einsum("mwd,qd->mqw", self.books, q.astype(np.float32), optimize=True)


def train(x: np.ndarray, books: int = CODEBOOKS, words: int = CODEWORDS, rounds: int = ROUNDS, seed: int = 7) -> Quantiser:
    """Residual k-means over the rows of ``x``; fewer rows than words give fewer words."""
    rng, rest, out = np.random.default_rng(seed), x.astype(np.float32).copy(), []
    for _ in range(books if len(x) else 0):
        c = rest[rng.permutation(len(rest))[:words]].copy()
        for _ in range(rounds):
            own = np.argmin((c**2).sum(axis=1) - 2 * rest @ c.T, axis=1)
            sums, sizes = np.zeros_like(c), np.bincount(own, minlength=len(c))
            np.add.at(sums, own, rest)
            c = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], c)
        own = np.argmin((c**2).sum(axis=1) - 2 * rest @ c.T, axis=1)
        out.append(c)
        rest -= c[own]
    return Quantiser(np.stack(out) if out else np.zeros((0, 0, x.shape[1] if x.ndim == 2 else 0), np.float32))


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """key, v (array<double>): the rows whose vector is not null, empty or zero, has no null or non-finite component, and has the commonest length."""
    v = F.col(vector).cast("array<double>")
    good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))) & F.exists(v, lambda c: c != 0)
    rows = vectors.where(F.col(vector).isNotNull() & good).select(F.col(key).alias("key"), v.alias("v"))
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (length["n"] if length else 0))


def _parts(n: int, block: int) -> int:
    """Partitions of the index of n rows, of about four blocks each."""
    return max(1, -(-n // (4 * block)))


def build(rows: DataFrame, fit_rows: int = FIT_ROWS, block: int = BLOCK) -> tuple[DataFrame, Quantiser]:
    """The index of ``usable`` rows: a row a block with ids, codes, norms and vectors packed. Codebooks are fitted on ``fit_rows`` rows at most, those with the least hashes of key and vector."""
    n = rows.count()
    chance = F.xxhash64("key", "v", F.lit("fit"))
    sample = rows.where(F.pmod(chance, F.lit(1 << 20)) < int((1 << 20) * min(1.0, 2 * fit_rows / max(n, 1))) + 1)
    x = np.array([r["v"] for r in sample.orderBy(chance, "key").limit(fit_rows).select("v").collect()], np.float64)
    quantiser = train(x if len(x) else np.zeros((0, 0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def packed(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            ids = np.concatenate([p.column("key").to_numpy(zero_copy_only=False) for p in parts])
            v = np.concatenate([p.column("v").flatten().to_numpy(zero_copy_only=False) for p in parts]).reshape(len(ids), -1)
            codes, norms = quantiser.encode(v)
            norms = np.stack([norms, ((v - quantiser.decode(codes)) ** 2).sum(axis=1)], axis=1)  # of what the codes decode to, and of what they leave over
            return pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int32()), *(pa.array([a.tobytes()], pa.binary()) for a in (ids.astype("<i8"), codes, norms.astype("<f4"), v.astype("<f8")))], ["n", "ids", "codes", "norms", "vectors"])

        for batch in batches:
            for at in range(0, batch.num_rows, block):
                held.append(batch.slice(at, block))
                if sum(p.num_rows for p in held) >= block:
                    yield packed(held)
                    held = []
        if held:
            yield packed(held)

    spread = rows.repartition(_parts(n, block), F.xxhash64("key", "v"))
    return stored(spread.mapInArrow(run, "n int, ids binary, codes binary, norms binary, vectors binary"), "codes"), quantiser


def copies(ids: np.ndarray, v: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, int]:
    """A row of each different vector of ``v``; of each the rows with its smallest ids, as many as ``top`` results can hold, filled up with -1; the rows that one id has at most."""
    if not len(ids):
        return np.zeros(0, np.int64), np.zeros((0, 1), np.int64), 1
    row = np.ascontiguousarray(v + 0.0).view(np.dtype((np.void, v.shape[1] * v.itemsize))).ravel()  # -0 is 0
    _, first, of = np.unique(row, return_index=True, return_inverse=True)
    spare = int(np.unique(ids, return_counts=True)[1].max())  # a query's own id is no result
    order = np.lexsort((ids, of.ravel()))
    sizes = np.bincount(of.ravel())
    rank = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    members = np.full((len(first), min(int(sizes.max()), top + spare)), -1, np.int64)
    ok = rank < members.shape[1]
    members[of.ravel()[order[ok]], rank[ok]] = order[ok]
    return first, members, spare


def highest(scores: np.ndarray, keep: int) -> np.ndarray:
    """The places of the ``keep`` highest of each row, and of further ones so that no row lacks one equal to its last."""
    n = scores.shape[1]
    if keep >= n:
        return np.broadcast_to(np.arange(n), scores.shape)
    last = np.partition(scores, n - keep, axis=1)[:, n - keep]
    wide = int((scores >= last[:, None]).sum(axis=1).max())
    return np.argpartition(scores, n - wide, axis=1)[:, n - wide :] if wide < n else np.broadcast_to(np.arange(n), scores.shape)


def _exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of q (queries, d) and v (queries, k, d), added up in the order of the components."""
    out = np.zeros(v.shape[:2])
    for d in range(q.shape[1]):
        out += q[:, d, None] * v[:, :, d]
    return out


class _Best:
    """The best ``top`` results of each query so far; free places have the score -inf."""

    def __init__(self, qid: np.ndarray, q: np.ndarray, top: int, measure: str):
        self.qid, self.q, self.top, self.measure = qid, q, top, measure
        self.norm = np.linalg.norm(q, axis=1)
        self.ids, self.scores = np.zeros((len(qid), top), np.int64), np.full((len(qid), top), -np.inf)

    def block(self, quantiser: Quantiser, ids: np.ndarray, v: np.ndarray, codes: np.ndarray, norms: np.ndarray, rerank: int) -> None:
        """Takes in a block of the index."""
        kind, members, spare = copies(ids, v, self.top)
        v, codes, decoded, left = v[kind], codes[kind], norms[kind, 0], norms[kind, 1]
        length, n = np.linalg.norm(v, axis=1), len(kind)
        width = self.top + spare
        tables = quantiser.tables(self.q)
        for a in range(0, len(self.qid), 128):
            at = slice(a, min(a + 128, len(self.qid)))
            q, size = self.q[at], self.norm[at, None]
            approx = np.zeros((len(q), n), np.float32)
            for m in range(codes.shape[1]):
                approx += np.take(tables[m, at], codes[:, m], axis=1)
            off = (SIGMAS * np.sqrt(left / max(q.shape[1], 1))).astype(np.float32) * size.astype(np.float32)
            if self.measure == "cosine":
                by = (np.sqrt(np.maximum(decoded, 1e-20)) * size).astype(np.float32)
                approx, off = approx / by, off / by
            # a few exact scores first: they say what the others have to reach
            seed = highest(approx, min(max(rerank, width), n))
            self._score(at, q, size, v, length, seed, ids, members, width)
            reach = self.scores[at, -1]
            open_ = approx + off >= reach[:, None]
            np.put_along_axis(open_, seed, False, axis=1)
            many = open_.sum(axis=1)
            # queries with like many left go together; where most are left, all are scored
            for some in np.array_split(np.argsort(many, kind="stable"), 8):
                wide = int(many[some].max()) if len(some) else 0
                if wide:
                    held = np.where(open_[some], approx[some], -np.inf)
                    best = np.argpartition(held, n - wide, axis=1)[:, n - wide :] if wide < n else np.broadcast_to(np.arange(n), held.shape)
                    self._score(a + some, q[some], size[some], v, length, best, ids, members, width)

    def _score(self, at, q: np.ndarray, size: np.ndarray, v: np.ndarray, length: np.ndarray, best: np.ndarray, ids: np.ndarray, members: np.ndarray, width: int) -> None:
        """Scores the vectors ``best`` of each query exactly; ``at`` are the queries' places."""
        where = np.arange(at.start, at.stop) if isinstance(at, slice) else at
        step = max(1, (4 << 20) // max(best.shape[1] * v.shape[1], 1))
        for z in range(0, len(best), step):
            rows, place = best[z : z + step], where[z : z + step]
            near = np.einsum("qd,qkd->qk", q[z : z + step], v[rows]) if rows.shape[1] < len(v) // 2 else np.take_along_axis(q[z : z + step] @ v.T, rows, 1)
            if self.measure == "cosine":
                near /= size[z : z + step] * length[rows]
            first = highest(near, min(width + 8, near.shape[1]))
            rows = np.take_along_axis(rows, first, 1)
            exact = _exact(q[z : z + step], v[rows])
            if self.measure == "cosine":
                exact /= size[z : z + step] * length[rows]
            held = members[rows]
            scores = np.where(held < 0, -np.inf, exact[:, :, None]).reshape(len(rows), -1)
            self._merge(place, ids[np.maximum(held, 0)].reshape(len(rows), -1), scores)

    def _merge(self, place: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        scores[ids == self.qid[place, None]] = -np.inf
        ids, scores = np.concatenate([self.ids[place], ids], axis=1), np.concatenate([self.scores[place], scores], axis=1)
        order = np.lexsort((ids, -scores), axis=1)[:, : self.top]
        self.ids[place], self.scores[place] = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)

    def rows(self) -> pa.RecordBatch:
        ok = np.isfinite(self.scores).ravel()
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.qid, self.top)[ok]), pa.array(self.ids.ravel()[ok]), pa.array(self.scores.ravel()[ok])], ["query_id", "vec_id", "score"])


def _passes(queries: DataFrame, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """ids and vectors of ``queries`` in runs of about ``most`` bytes; the driver holds one at a time."""
    ids, rows, held = [], [], 0
    for r in queries.toLocalIterator():
        ids.append(r["key"])
        rows.append(np.array(r["v"], np.float64))
        held += rows[-1].nbytes
        if held >= most:
            yield np.array(ids, np.int64), np.stack(rows)
            ids, rows, held = [], [], 0
    if ids:
        yield np.array(ids, np.int64), np.stack(rows)


def search(index: DataFrame, quantiser: Quantiser, queries: DataFrame, top: int, rerank: int = RERANK, measure: str = "ip") -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` nearest found of each row (key, v; keys differ) of ``queries``, rows of its own id apart; ties go to the smaller id.

    ``measure``: ``ip`` (inner product) or ``cosine``. Each query scores ``rerank`` different vectors of each block exactly, all that tie with
    the last of them, and every other that may still reach its results. Copies of a vector count once and bring their
    smallest ids. Repeated ids in the index are results of their own. Each pass of queries is a table before the next begins.
    """
    spark, found = index.sparkSession, []

    def matching(qid: np.ndarray, q: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = _Best(qid, q, top, measure)
            for batch in batches:
                for i in range(batch.num_rows):
                    get = lambda c, kind, i=i, batch=batch: np.frombuffer(batch.column(c)[i].as_buffer(), kind)
                    ids = get("ids", "<i8")
                    best.block(quantiser, ids, get("vectors", "<f8").reshape(len(ids), -1), get("codes", np.uint8).reshape(len(ids), -1), get("norms", "<f4").reshape(len(ids), -1), rerank)
            yield best.rows()

        return tidied(run)

    packed = index.select("ids", "codes", "norms", "vectors")
    for qid, q in _passes(queries.select("key", "v"), PASS_BYTES):
        found.append(stored(packed.mapInArrow(matching(qid, q), "query_id long, vec_id long, score double"), "nearest"))
    near = reduce(DataFrame.union, found) if found else spark.createDataFrame([], "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest by inner product of every embedding whose vec_id 20 divides, among all others.

    A null vec_id takes no part. Rows that share a vec_id are candidates each; of those that 20 divides one is the query, the
    one whose vector compares smallest, and none of the others is its result. Vectors of another than the commonest length take no part.
    """
    rows = stored(usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding").where("key is not null"), "vectors")
    index, quantiser = build(rows)
    return search(index, quantiser, rows.where("key % 20 = 0").groupBy("key").agg(F.min("v").alias("v")), 20)

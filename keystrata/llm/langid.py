"""Language identification by nearest centroid.

A text's vector holds hashed character n-gram (1 to 3 UTF-8 bytes, A-Z lowered, other ASCII characters
as spaces) frequencies, log-scaled, weighted by inverse document frequency and normalised. Each language
has several centroids from spherical k-means over its labelled texts; a text gets the language of the
centroid with the largest cosine and is rejected where its cosine with every centroid is below what held-in
texts of that centroid's language reach. Short texts reach less than long ones, so each length has a floor of its own, taken from
runs of words of texts that the centroids were not fitted to.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keystrata.llm.shared import buffers, slices, stored

DIM = 4096
#: Labelled rows of a language that the fit takes on average at most; centroids of a language; rounds of k-means.
FIT_ROWS, CENTROIDS, ROUNDS = 600, 4, 12
#: A text is rejected below this share of the cosine that all but a share of QUANTILE of the held-in texts of its length reach.
REJECT, QUANTILE = 0.9, 0.01
#: Folds of the validation, lengths (powers of two of letters' bytes) with a floor each, texts of a language up to which every fold is validated, runs that a floor rests on at least.
FOLDS, LENGTHS, FEW, RUNS = 4, 12, 200, 20

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def counts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(texts, DIM) n-gram counts; n-grams of spaces alone do not count."""
    n = len(at) - 1
    out = np.zeros(n * DIM, np.float32)
    if len(raw):
        folded = _FOLD[raw].astype(np.uint32)
        owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(at))
        code, solid = np.zeros(len(raw), np.uint32), np.zeros(len(raw), bool)
        for size in (1, 2, 3):
            m = len(raw) - size + 1
            if m <= 0:
                break
            code = code[:m] * np.uint32(256) + folded[size - 1 :]
            solid = solid[:m] | (folded[size - 1 :] != 32)
            use = solid & (owner[:m] == owner[size - 1 :])
            slot = ((code + np.uint32(size << 24)) * np.uint32(2654435761)) >> np.uint32(20)
            out += np.bincount((owner[:m] * DIM + slot)[use], minlength=n * DIM)
    return out.reshape(n, DIM)


@dataclass
class Model:
    langs: list[str]  # of each centroid
    idf: np.ndarray
    centroids: np.ndarray
    floor: np.ndarray  # (centroids, LENGTHS) the cosine below which a text of that length is rejected


def _weighted(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(tf) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _clusters(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from a farthest-first start: the centroids that have rows."""
    seeds = [int(np.argmax(x @ x.mean(axis=0)))]
    near = x @ x[seeds[0]]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[seeds[-1]])
    c = x[seeds]
    for _ in range(ROUNDS):
        own = np.argmax(x @ c.T, axis=1)
        used = np.unique(own)
        c = np.stack([x[own == j].mean(axis=0) for j in used])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c[np.unique(np.argmax(x @ c.T, axis=1))]


def lettered(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each text has a letter."""
    letter = np.concatenate(([0], np.cumsum(_FOLD[raw] - 97 < 26)))
    has = letter[at[1:]] > letter[at[:-1]]
    for i in np.flatnonzero(~has & (np.diff(at) > 0)):
        has[i] = any(c.isalpha() for c in raw[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace"))
    return has


def lengths(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The length class of each text: the power of two in the bytes of its letters, LENGTHS - 1 at most."""
    solid = np.diff(np.concatenate(([0], np.cumsum(_FOLD[raw] != 32)))[at])
    return np.minimum(np.frexp(np.maximum(solid, 1).astype(np.float64))[1] - 1, LENGTHS - 1)


def _runs(text: bytes) -> list[bytes]:
    """Runs of whole words of ``text``, one of about each length, from places that its checksum chooses; the text itself."""
    words, out = text.split(), [text]
    for k in range(LENGTHS - 1):
        i, run, size = zlib.crc32(text, k) % max(len(words), 1), [], 0
        while i < len(words) and size < 1.5 * 2**k:
            run.append(words[i])
            size += len(words[i])
            i += 1
        out.append(b" ".join(run))
    return out


def _floors(cos: np.ndarray, length: np.ndarray) -> np.ndarray:
    """REJECT times the low quantile of the cosines of each length; a length with few runs takes the next shorter one's, or where none is shorter is open."""
    out, last = np.zeros(LENGTHS, np.float32), 0.0
    for k in range(LENGTHS):
        here = cos[length == k]
        if len(here) >= RUNS:
            last = REJECT * float(np.quantile(here, QUANTILE))
        out[k] = last
    return out


def fit(labelled: DataFrame, per_lang: int = FIT_ROWS) -> Model:
    """A model of the columns key, text, lang (no nulls in lang).

    Of each language about ``per_lang`` rows are taken, by a hash of the key, and never more than twice as many, so the
    driver holds at most a fixed number of sparse vectors for each language, whatever the table's size and however often a key
    repeats. Texts without a letter are left out. The floors are those of a fold of the texts against centroids of the others; of a
    language of few texts, every fold's. No rows: an empty model. Of centroids at one cosine the first counts, in the
    order of the languages' names.
    """
    # written first, so that Spark knows how few rows it has
    sizes = stored(labelled.groupBy("lang").count().withColumnRenamed("count", "of_lang"), "languages")
    chance = F.pmod(F.xxhash64("key", F.lit("fit")), F.lit(1 << 20))
    rate = F.least(F.lit(1 << 20), (F.lit(float((1 << 20) * per_lang)) / F.col("of_lang")).cast("int") + 1)
    sample = labelled.join(sizes, "lang").where((chance < rate) & F.col("text").isNotNull())
    turn = F.row_number().over(Window.partitionBy("lang").orderBy(chance, "key", F.xxhash64("text")))
    sample = sample.withColumn("turn", turn).where(F.col("turn") <= 2 * per_lang).select("key", "text", "lang", (F.col("of_lang") <= FEW).alias("few"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 19, 128):
                raw, at = buffers(part.column("text"))
                has = np.flatnonzero(lettered(raw, at)).tolist()
                texts = [raw[at[i] : at[i + 1]].tobytes() for i in has]
                folds = [zlib.crc32(t) % FOLDS for t in texts]
                few = part.column("few").to_pylist()
                # (row, fold, the bytes, whether it is fitted)
                made = [(i, f, t, True) for i, f, t in zip(has, folds, texts, strict=True)]
                made += [(i, f, r, False) for i, f, t in zip(has, folds, texts, strict=True) if f == 0 or few[i] for r in _runs(t)]
                for start in range(0, len(made), 128):
                    some = made[start : start + 128]
                    raw, at = buffers(pa.array([m[2] for m in some], pa.binary()))
                    ok, tf, length = lettered(raw, at), counts(raw, at), lengths(raw, at)
                    keep = np.flatnonzero(ok).tolist()
                    places = [np.flatnonzero(tf[j]) for j in keep]
                    row = pa.array([some[j][0] for j in keep], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("key").take(row), part.column("lang").take(row), pa.array([some[j][1] for j in keep], pa.int32()), pa.array([some[j][3] for j in keep], pa.bool_()), pa.array(length[keep].astype(np.int32)),
                            pa.array([a.astype("<u2").tobytes() for a in places], pa.binary()), pa.array([tf[j][a].astype("<f4").tobytes() for j, a in zip(keep, places, strict=True)], pa.binary()),
                        ],
                        ["key", "lang", "fold", "fitted", "length", "at", "tf"],
                    )

    def vectors(rows: list) -> np.ndarray:
        tf = np.zeros((len(rows), DIM), np.float32)
        for i, r in enumerate(rows):
            tf[i, np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["tf"], "<f4")
        return tf

    kind = labelled.schema["key"].dataType.simpleString()
    got = sample.mapInArrow(run, f"key {kind}, lang string, fold int, fitted boolean, length int, at binary, tf binary").collect()
    rows = sorted((r for r in got if r["fitted"]), key=lambda r: (r["lang"], r["key"] is None, r["key"] or 0, bytes(r["at"]), bytes(r["tf"])))
    tf = vectors(rows)
    idf = (np.log((1 + len(rows)) / (1 + (tf > 0).sum(axis=0))) + 1).astype(np.float32)
    x, langs, centroids, floors = _weighted(tf, idf), [], [], []
    of, fold = np.array([r["lang"] for r in rows], object), np.array([r["fold"] for r in rows], np.int64)
    for lang in sorted(set(of)):
        c = _clusters(x[of == lang], CENTROIDS)
        cos, length = [np.zeros(0, np.float32)], [np.zeros(0, np.int64)]
        for f in range(FOLDS):
            held = [r for r in got if not r["fitted"] and r["lang"] == lang and r["fold"] == f]
            others = x[(of == lang) & (fold != f)]
            if held and len(others):
                seen = _clusters(others, CENTROIDS)
                for start in range(0, len(held), 1024):
                    cos.append((_weighted(vectors(held[start : start + 1024]), idf) @ seen.T).max(axis=1))
                length.append(np.array([r["length"] for r in held]))
        langs += [lang] * len(c)
        centroids.append(c)
        floors.append(np.tile(_floors(np.concatenate(cos), np.concatenate(length)), (len(c), 1)))
    return Model(langs, idf, np.concatenate(centroids) if centroids else np.zeros((0, DIM), np.float32), np.concatenate(floors) if floors else np.zeros((0, LENGTHS), np.float32))


def identify(text: F.Column, model: Model) -> F.Column:
    """struct(lang, score, rejected) of a text: ``und``, 0 and true where it is null or has no letter, or the model is empty."""

    def run(column: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([column], ["t"])
        langs, scores, rejected = [], [], []
        for part in slices(batch, "t", 1 << 19, 128):
            raw, at = buffers(part.column("t"))
            n = len(at) - 1
            has = lettered(raw, at)
            if len(model.langs):
                cos = _weighted(counts(raw, at), model.idf) @ model.centroids.T
                best = np.argmax(cos, axis=1)
                top = cos[np.arange(n), best]
                langs += [model.langs[b] if h else "und" for b, h in zip(best, has, strict=True)]
                scores.append(np.where(has, np.clip(top, 0, 1), 0))
                rejected.append(~has | (cos < model.floor[:, lengths(raw, at)].T).all(axis=1))
            else:
                langs += ["und"] * n
                scores.append(np.zeros(n))
                rejected.append(np.ones(n, bool))
        flat = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(flat(scores, np.float64)), pa.array(flat(rejected, bool))], ["lang", "score", "rejected"])

    return F.arrow_udf(run, "lang string, score double, rejected boolean")(text)


def held_out(key: F.Column) -> F.Column:
    """Whether crc32 of the key as text leaves 1 when divided by 3; a null key is not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def trained_on(docs: DataFrame) -> Model:
    labelled = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    return fit(labelled.select(F.col("doc_id").alias("key"), "text", "lang"))


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the labelled ones that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), identify(F.col("text"), trained_on(docs)).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.rejected").alias("rejected"))


def drop_rejected(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier rejects go, those without a letter among them."""
    named = docs.withColumn("__ks_lang", identify(F.col("text"), trained_on(docs)))
    return named.where(~F.col("__ks_lang.rejected")).drop("__ks_lang")

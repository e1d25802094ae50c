"""WARC archives, read and written, and their external index merge.

Archives are written by Spark's text sink: a record's bytes are the row, the empty line that ends a record
is the line separator; records of like size share files, so a file's bytes are bounded. Reading parses whole files by their
length fields. The index (URL key, timestamp, id) is made as capture runs, one sorted run for each partition of records,
cut at sampled key bounds; each range of keys is then merged from its run pieces with a loser tree, and the ranges follow each other.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm.shared import scratch, stored, tidied, write_flat

#: Payloads of at least so many bytes are stored once.
DEDUP_BYTES = 1000
#: Records of a file at most, by the bytes of their payloads at most: 256 MB a file; larger payloads have files of their own.
FILES = ((128 << 10, 2000), (8 << 20, 32), (1 << 31, 1))
#: Index entries of a range, about; ranges at most, then they grow; keys sampled for each bound, about.
RANGE_ENTRIES, RANGES, SAMPLE = 50_000, 20_000, 16
#: Version line and media types of the records.
VERSION, RESPONSE_TYPE = "WARC/1.1", "application/http; msgtype=response"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ENTRY = "page_id bigint, url string, captured string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def records(pages: DataFrame) -> DataFrame:
    """page_id, url, captured, payload (binary), payload_bytes, payload_digest, refers_to of the rows (page_id, url, html).

    Of equal payloads of DEDUP_BYTES or more the row with the largest page_id is kept (if several rows have
    it, each is), the others refer to it; null ids count as smallest and are never referred to. A null html
    is an empty payload, a null url an empty one. Capture times follow the page_id, a second each.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), body.alias("payload"), F.octet_length(body).cast("long").alias("payload_bytes"), F.sha1(body).alias("payload_digest"))
    rows = rows.withColumn("captured", F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.coalesce("page_id", F.lit(0)) % 1_000_000_000), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    small = pages.select(F.octet_length(body).alias("n"), F.sha1(body).alias("payload_digest"), "page_id").where(F.col("n") >= DEDUP_BYTES)
    kept = small.groupBy("payload_digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("copies")).where("copies > 1").select("payload_digest", "kept")
    # written first: Spark then knows its size, and moves no payload where it is small
    joined = rows.join(stored(kept, "kept"), "payload_digest", "left")
    return joined.withColumn("refers_to", F.when(~F.coalesce(F.col("page_id") == F.col("kept"), F.lit(False)), F.col("kept"))).drop("kept")


def _urn(page_id: F.Column) -> F.Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def write_warc(rows: DataFrame, path: str) -> None:
    """Writes what ``records`` gives as WARC files. A revisit record holds the HTTP header alone; its named fields keep the payload's digest and length."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n")).cast("binary")
    again = F.col("refers_to").isNotNull()
    block = F.when(again, http).otherwise(F.concat(http, F.col("payload")))
    url = F.regexp_replace("url", r"[\r\n]", "")
    head = F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: "), F.when(again, "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: "), _urn(F.col("page_id")), F.lit("\r\nWARC-Date: "), F.col("captured"),
        F.lit("\r\nWARC-Target-URI: "), url, F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"), F.lit("\r\nWARC-Payload-Length: "), F.col("payload_bytes").cast("string"),
        F.when(again, F.concat(F.lit(f"\r\nWARC-Profile: {REVISIT_PROFILE}\r\nWARC-Refers-To: "), _urn(F.col("refers_to")))).otherwise(""),
        F.lit(f"\r\nContent-Type: {RESPONSE_TYPE}\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"),
    ).cast("binary")
    tier = sum(((F.col("payload_bytes") > size).cast("int") for size, _ in FILES[:-1]), F.lit(0))
    for k in sorted(r[0] for r in rows.select(tier.alias("tier")).distinct().collect()) or [0]:
        write_flat(rows.where(tier == k).select(F.concat(head, block).alias("record")), "record", f"{path}/size-{k}", "\r\n\r\n", FILES[k][1])


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(named fields in lower case, content block) of each record; a damaged record raises ValueError."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "surrogateescape").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start, n = end + 4, int(fields["content-length"])
        if data[start + n : start + n + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut short")
        yield fields, data[start : start + n]
        at = start + n + 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """ENTRY's columns of every record below ``path``, the payloads' digests and lengths of responses computed anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        number = lambda urn: int(x) if (x := urn[len("<urn:page:") : -1]) else None
        for batch in batches:
            for content in batch.column("content"):
                out: list[list] = [[] for _ in range(7)]
                for fields, block in parse_warc(content.as_buffer().to_pybytes()):
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    digest, size = fields["warc-payload-digest"].removeprefix("sha1:"), int(fields["warc-payload-length"])
                    if fields["warc-type"] == "response" and (digest, size) != (found := (hashlib.sha1(payload).hexdigest(), len(payload))):
                        raise ValueError(f"payload of {fields['warc-record-id']}: {found}, its record says {(digest, size)}")
                    refers = fields.get("warc-refers-to")
                    for column, x in zip(out, (number(fields["warc-record-id"]), fields["warc-target-uri"], fields["warc-date"], size, digest, fields["warc-type"], number(refers) if refers else None), strict=True):
                        column.append(x)
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], [x.split()[0] for x in ENTRY.split(", ")])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(tidied(run), ENTRY)


def url_key(url: str) -> str:
    """Sort-friendly key of a URL: host labels reversed, no scheme, user, ``www``, default port or fragment, lower case."""
    rest = url.strip().lower().partition("#")[0]
    scheme, sep, tail = rest.partition("://")
    if not sep:
        return rest
    host, slash, path = tail.partition("/")
    if "?" in host:
        host, _, query = host.partition("?")
        slash, path = "/", f"?{query}"
    host = host.rpartition("@")[2].removesuffix(":80" if scheme == "http" else ":443").removeprefix("www.")
    name, colon, port = host.partition(":")
    return ",".join(reversed(name.split("."))) + colon + port + ")/" + path


class LoserTree:
    """Merges sorted iterators: an inner node holds the loser of its match, so a new head replays one path to the root."""

    def __init__(self, runs: list[Iterator]):
        self.runs, self.n = runs, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.losers = [-1] * max(self.n, 1)
        for leaf in range(self.n):
            self._replay(leaf)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _replay(self, leaf: int) -> None:
        """Plays ``leaf`` up; while the tree is built, the first to reach a node waits there."""
        winner, node = leaf, (leaf + self.n) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:
                self.losers[node] = winner
                return
            if self._before(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator:
        while self.n and self.heads[top := self.losers[0]] is not None:
            yield self.heads[top]
            self.heads[top] = next(self.runs[top], None)
            self._replay(top)


def merge_index(entries: DataFrame) -> DataFrame:
    """``entries`` (ENTRY) with url_key and index_pos, the place from 0 in the order of (url_key, captured, page_id), nulls first.

    Key bounds come from a sample of SAMPLE keys a range and of RANGES ranges at most, and include time and id, so captures of one
    URL spread over several ranges. Each partition of the entries is a run, sorted by Spark; a range is merged from its
    pieces of the runs. Equal entries keep the order of their runs. No rows: no rows.
    """
    spark = entries.sparkSession
    n = entries.count()
    id_ = F.coalesce("page_id", F.lit(-(1 << 63)))
    key = F.struct(F.col("url_key"), "captured", id_.alias("id"))

    def keyed(urls: pa.Array) -> pa.Array:
        return pa.array([None if u is None else url_key(u) for u in urls.to_pylist()], pa.string())

    entries = stored(entries.withColumn("url_key", F.coalesce(F.arrow_udf(keyed, "string")("url"), F.lit(""))), "captures")
    ranges = max(1, min(RANGES, -(-n // RANGE_ENTRIES)))
    share = int((1 << 20) * min(1.0, SAMPLE * ranges / max(n, 1))) + 1
    chosen = entries.where(F.pmod(F.xxhash64("page_id", "url", "captured", F.lit("bounds")), F.lit(1 << 20)) < share).select(key.alias("k"))
    found = sorted(tuple(r["k"]) for r in chosen.limit(4 * SAMPLE * ranges).collect()) if ranges > 1 else []
    bounds = [found[len(found) * i // ranges] for i in range(1, ranges)] if found else []
    columns = entries.columns

    def keys_of(table) -> list[tuple]:
        ids = table.column("page_id").fill_null(-(1 << 63))
        return list(zip(table.column("url_key").to_pylist(), table.column("captured").to_pylist(), ids.to_pylist(), strict=True))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            low = pa.array([bisect_right(bounds, k) for k in keys_of(batch)], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, low, pa.array(np.arange(at, at + batch.num_rows))], [*batch.schema.names, "range", "at"])
            at += batch.num_rows

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by([("run", "ascending"), ("at", "ascending")]).combine_chunks()  # the runs' pieces, one after the other
        run, keys = table.column("run").to_numpy(), keys_of(table)
        edges = [*np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1]))).tolist(), len(run)]
        tree = LoserTree([((keys[i], i) for i in range(a, b)) for a, b in zip(edges, edges[1:], strict=False)])
        start = table.column("start")[0].as_py()
        merged = table.select(columns).take(pa.array([i for _, i in tree], pa.int64()))
        return merged.append_column("index_pos", pa.array(np.arange(start, start + len(run))))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in entries.schema.fields)
    runs = entries.sortWithinPartitions("url_key", "captured", id_)
    pieces = stored(runs.mapInArrow(cut, f"{schema}, range int, at long").withColumn("run", F.spark_partition_id()), "runs")
    sizes = dict(pieces.groupBy("range").count().collect())  # a number for each range
    starts, total = {}, 0
    for r in sorted(sizes):
        starts[r], total = total, total + sizes[r]
    placed = pieces.join(spark.createDataFrame(list(starts.items()) or [(0, 0)], "range int, start long"), "range")
    return placed.groupBy("range").applyInArrow(merge, f"{schema}, index_pos bigint")


def archive(pages: DataFrame, path: str) -> DataFrame:
    """Writes ``pages`` to WARC files under ``path``, reads them back and gives their merged index."""
    spark = pages.sparkSession
    write_warc(records(pages), path)
    return merge_index(stored(read_warc(spark, path), "entries"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written to WARC files, read back and indexed."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    found = archive(pages, scratch(spark, "warc"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "index_pos")

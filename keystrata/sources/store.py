"""A versioned keyed store: a memtable and its log on the driver, immutable Parquet segments below.

Folder layout: ``manifest.json.<n>`` (the list of segments; the largest number counts), ``seg-<n>`` (sorted Parquet with
columns _key, _seq, _op and the payload), ``wal/<n>.log`` (the log of the memtable), ``quarantine/``.
A reader holds the segments of the manifest it read; a merge writes a new segment and a new manifest, never over a file in use.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keystrata.operators.merge import DELETE, PUT, latest, merge_on_read
from keystrata.sources import wal
from keystrata.sources.files import Files

#: Bytes of keys and values that fill the memtable; segments that set off a merge.
FLUSH_BYTES, MERGE_SEGMENTS = 4 << 20, 4


class Store:
    """Rows of ``payload`` columns under a string key. ``base``: an external DataFrame with _key and the payload, older than all that the store holds."""

    def __init__(self, spark: SparkSession, root: str, payload: T.StructType, base: DataFrame | None = None, flush_bytes: int = FLUSH_BYTES, merge_segments: int = MERGE_SEGMENTS):
        self.spark, self.files, self.payload, self.base = spark, Files(spark, root), payload, base
        self.flush_bytes, self.merge_segments = flush_bytes, merge_segments
        self.schema = T.StructType([T.StructField("_key", T.StringType()), T.StructField("_seq", T.LongType()), T.StructField("_op", T.StringType()), *payload.fields])
        self.memtable: dict[str, tuple[int, str, tuple | None, int]] = {}
        self.quarantined: list[str] = []
        self.memory_bytes = 0
        state = json.loads(self.files.published("manifest.json") or '{"segments": [], "seq": 0, "flushed": 0, "batches": {}, "ties": false}')
        self.segments: list[dict] = state["segments"]
        self.seq: int = state["seq"]
        self.batches: dict[str, int] = state["batches"]
        self.ties: bool = state["ties"]
        self._logged: int = state["flushed"]
        self._check_segments()
        self._recover()

    # opening

    def _check_segments(self) -> None:
        """A segment whose files do not end as Parquet files must is put aside and named in ``quarantined``."""
        sound = []
        for s in self.segments:
            parts = [n for n in self.files.list(s["name"]) if n.endswith(".parquet")]
            if (parts or s.get("empty")) and all(self._sealed(f"{s['name']}/{n}") for n in parts):
                sound.append(s)
            else:
                if self.files.exists(s["name"]):
                    self.files.move(s["name"], f"quarantine/{s['name']}")
                self.quarantined.append(s["name"])
        if len(sound) < len(self.segments):
            self.segments = sound
            self._publish(self._logged)

    def _sealed(self, name: str) -> bool:
        path = self.files._path(name)
        size = self.files.fs.getFileStatus(path).getLen()
        if size < 12:
            return False
        stream = self.files.fs.open(path)
        try:
            stream.seek(size - 4)
            return bytes(stream.read() & 0xFF for _ in range(4)) == b"PAR1"
        finally:
            stream.close()

    def _recover(self) -> None:
        """Replays the log files that no segment holds yet, in order, up to the first that is damaged; that and later ones are put aside."""
        sound, flushed = True, self._logged
        for name in self.files.list("wal"):
            number = int(name.partition(".")[0])
            if number <= flushed:
                continue
            data = self.files.read(f"wal/{name}")
            records = list(wal.decode(data))
            sound = sound and bool(records) and sum(13 + len(k) + len(v) for _, k, v in records) == len(data)
            if sound:
                for op, key, value in records:
                    self._hold(key.decode(), op, tuple(json.loads(value)) if op == PUT else None, len(value))
            else:
                self.files.move(f"wal/{name}", f"quarantine/{name}")
                self.quarantined.append(name)
            self._logged = number

    # writing

    def _hold(self, key: str, op: str, row: tuple | None, size: int) -> None:
        self.seq += 1
        self.memory_bytes += size - self.memtable[key][3] if key in self.memtable else len(key.encode()) + size
        self.memtable[key] = (self.seq, op, row, size)

    def apply(self, changes: Iterable[tuple[str, str, tuple | None]]) -> None:
        """Logs and holds a group of (op, key, row) changes: one log file, so a crash leaves all or none. Then flushes if full."""
        group = [(op, key, row, json.dumps(row) if op == PUT else "") for op, key, row in changes]
        if not group:
            return
        self._logged += 1
        self.files.write(f"wal/{self._logged:012d}.log", b"".join(wal.encode(op, key.encode(), text.encode()) for op, key, _, text in group))
        put = False
        for op, key, row, text in group:
            self._hold(key, op, row, len(text.encode()))
            put |= op == PUT
        if self.memory_bytes >= self.flush_bytes:
            self.flush()
            if put and len(self.segments) >= self.merge_segments:
                self.compact()

    def append(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Writes ``rows`` (_key, _op and payload; keys differ) as a new segment; their number.

        Without a column _seq they are newer than all else; with one, each takes its place among the versions of its key by it.
        ``batch`` names a writer and its running number: a number that is not above the last one is written already and left out.
        """
        if batch is not None and self.batches.get(batch[0], -1) >= batch[1]:
            return 0
        self.flush()
        if batch is not None:
            self.batches = self.batches | {batch[0]: batch[1]}
        if "_seq" in rows.columns:
            self.ties = True  # a record may come twice
            n = self._write(rows)
        else:
            self.seq += 1
            n = self._write(rows.withColumn("_seq", F.lit(self.seq).cast("long")))
        if n and len(self.segments) >= self.merge_segments:
            self.compact()
        return n

    def staged(self, rows: DataFrame) -> tuple[DataFrame, int, str]:
        """``rows`` written aside once, their number, and the folder's name: what follows reads them from there."""
        name = f"aside-{uuid.uuid4().hex}"
        rows.write.parquet(self.files.full(name))
        written = self.spark.read.schema(rows.schema).parquet(self.files.full(name))
        return written, written.count(), name

    def flush(self) -> None:
        """The memtable becomes a segment, deletions included; its log goes."""
        if not self.memtable:
            return
        rows = [(k, seq, op, *(row or (None,) * len(self.payload))) for k, (seq, op, row, _) in sorted(self.memtable.items())]
        self._write(self.spark.createDataFrame(rows, self.schema))
        self.memtable.clear()
        self.memory_bytes = 0
        for name in self.files.list("wal"):
            self.files.delete(f"wal/{name}")

    def _name(self) -> str:
        taken = [int(n[4:]) for n in self.files.list() if n.startswith("seg-")]
        return f"seg-{max(taken, default=0) + 1:08d}"

    def _write(self, rows: DataFrame, replace: bool = False) -> int:
        name = self._name()
        columns = [F.col(f"`{f.name}`") for f in self.schema.fields]
        sorted_ = rows.select(columns).repartitionByRange("_key").sortWithinPartitions("_key")
        writer = sorted_.write.option("parquet.bloom.filter.enabled#_key", "true")
        writer.parquet(self.files.full(name))
        n, low, high, last = self._read(name).agg(F.count("*"), F.min("_key"), F.max("_key"), F.max("_seq")).first()
        self.seq = max(self.seq, last or 0)
        if n or replace:
            self.segments = ([] if replace else self.segments) + ([{"name": name, "rows": n, "low": low, "high": high}] if n else [])
            self._publish(self._logged)
        if not n:
            self.files.delete(name)
        return n

    def _publish(self, flushed: int) -> None:
        self.files.publish("manifest.json", json.dumps({"segments": self.segments, "seq": self.seq, "flushed": flushed, "batches": self.batches, "ties": self.ties}).encode())

    def compact(self) -> None:
        """All segments become one: the latest versions, without deletions where no external base lies below."""
        if not self.segments:
            return
        won = latest(self._segments(), "_key", "_seq", ties=self.ties)
        self._write(won if self.base is not None else won.where(F.col("_op") == PUT), replace=True)

    def vacuum(self) -> list[str]:
        """Deletes segment folders that the manifest no longer names, and what a crash left aside."""
        named = {s["name"] for s in self.segments}
        old = [n for n in self.files.list() if n.startswith(("seg-", "aside-")) and n not in named]
        for n in old:
            self.files.delete(n)
        return old

    # reading

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.files.full(name))

    def _segments(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[self.files.full(s["name"]) for s in self.segments])

    def versions(self) -> DataFrame | None:
        """All versions the store holds above its base; None if there are none."""
        parts = [self._segments()] if self.segments else []
        if self.memtable:
            rows = [(k, seq, op, *(row or (None,) * len(self.payload))) for k, (seq, op, row, _) in self.memtable.items()]
            parts.append(self.spark.createDataFrame(rows, self.schema))
        return None if not parts else parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def live(self) -> DataFrame:
        """_key and the payload of the live rows."""
        columns = ["_key", *self.payload.fieldNames()]
        quoted = [F.col(f"`{c}`") for c in columns]
        versions = self.versions()
        if versions is None:
            return self.spark.createDataFrame([], self.schema).select(quoted) if self.base is None else self.base
        if self.base is not None:
            return merge_on_read(self.base, versions, "_key", "_seq", "_op", ties=self.ties)
        if not self.memtable and len(self.segments) == 1:  # a segment holds a key once
            return versions.where(F.col("_op") == PUT).select(quoted)
        return latest(versions, "_key", "_seq", ties=self.ties).where(F.col("_op") == PUT).select(quoted)

    def get(self, key: str) -> tuple | None:
        """The payload of a live key, or None."""
        if key in self.memtable:
            _, op, row, _ = self.memtable[key]
            return row if op == PUT else None
        if self.base is None and not any(s["low"] <= key <= s["high"] for s in self.segments):
            return None  # outside every segment's keys
        row = self.live().where(F.col("_key") == key).drop("_key").head()
        return None if row is None else tuple(row)

    def drop(self) -> None:
        self.files.delete("")


__all__ = ["DELETE", "FLUSH_BYTES", "MERGE_SEGMENTS", "PUT", "Store"]

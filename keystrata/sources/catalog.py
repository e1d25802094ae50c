"""The tables of a session: schemas in small files, rows in stores, external Parquet underneath where registered."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keystrata.functions import columns as C
from keystrata.functions.values import INT, SPARK, kind_of
from keystrata.plans.statements import Column
from keystrata.sources.files import Files
from keystrata.sources.store import Store


@dataclass
class Table:
    """``kinds`` maps every column to its type, None for types outside the dialect. ``store`` is None for a read-only table."""

    name: str
    columns: list[Column]
    primary_key: str | None
    kinds: dict[str, str | None]
    store: Store | None
    base: DataFrame | None = None

    def frame(self) -> DataFrame:
        """_key (where the table has a key) and the columns of the live rows."""
        return self.base if self.store is None else self.store.live()


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Files(spark, root)
        self.tables: dict[str, Table] = {}  # the opened ones; others open when they are named

    def _folder(self, name: str) -> str:
        return f"tables/{quote(name, safe='')}"

    def _open(self, name: str, schema: dict) -> Table:
        columns = [Column(**c) for c in schema["columns"]]
        key, path = schema["primary_key"], schema.get("path")
        folder = self.files.full(f"{self._folder(name)}/rows")
        if path is None:
            payload = T.StructType([T.StructField(c.name, SPARK[c.kind]) for c in columns])
            table = Table(name, columns, key, {c.name: c.kind for c in columns}, Store(self.spark, folder, payload))
        else:
            df = self.spark.read.parquet(path)
            kinds = {f.name: kind_of(f.dataType) for f in df.schema.fields}
            df = df.select([F.col(f"`{c}`").cast("long").alias(c) if k == INT else F.col(f"`{c}`") for c, k in kinds.items()])
            if key is None:
                table = Table(name, columns, None, kinds, None, df)
            else:
                base = df.select(C.key_text(kinds[key], F.col(f"`{key}`")).alias("_key"), *[F.col(f"`{c}`") for c in df.columns])
                table = Table(name, columns, key, kinds, Store(self.spark, folder, df.schema, base), base)
        self.tables[name] = table
        return table

    def get(self, name: str) -> Table | None:
        """A table by its exact name, from memory or from its schema file."""
        if name not in self.tables and (schema := self.files.published(f"{self._folder(name)}/schema.json")) is not None:
            self._open(name, json.loads(schema))
        return self.tables.get(name)

    def create(self, name: str, columns: list[Column], primary_key: str | None, path: str | None = None) -> Table:
        schema = {"columns": [asdict(c) for c in columns], "primary_key": primary_key, "path": path, "next_rowid": 1}
        self.files.publish(f"{self._folder(name)}/schema.json", json.dumps(schema).encode())
        return self._open(name, schema)

    def register(self, name: str, path: str, primary_key: str | None = None) -> Table:
        """An external Parquet table; with a key it takes changes, which go to a store of its own, without it is read-only."""
        fields = self.spark.read.parquet(path).schema.fields
        columns = [Column(f.name, kind_of(f.dataType) or f.dataType.simpleString().upper(), f.name == primary_key, f.name == primary_key) for f in fields]
        return self.create(name, columns, primary_key, path)

    def drop(self, name: str) -> None:
        self.tables.pop(name, None)
        self.files.delete(self._folder(name))

    def names(self) -> list[str]:
        """All tables, opened or not, in byte order."""
        there = {unquote(f) for f in self.files.list("tables") if self.files.published(f"tables/{f}/schema.json") is not None}
        return sorted(there, key=lambda n: n.encode())

    def next_row_id(self, name: str) -> int:
        """A number for a new row, from 1; explicit keys do not advance it."""
        place = f"{self._folder(name)}/schema.json"
        schema = json.loads(self.files.published(place))
        n = schema["next_rowid"]
        self.files.publish(place, json.dumps(schema | {"next_rowid": n + 1}).encode())
        return n

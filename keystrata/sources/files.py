"""Small files on whatever file system Spark reaches: manifests and log records."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession


class Files:
    """Reads, writes and lists small files through Hadoop's FileSystem."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.jvm, self.root = spark, spark._jvm, root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def full(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def list(self, name: str = "") -> list[str]:
        """Names in a folder, sorted; a missing folder is empty."""
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(name))) if self.exists(name) else []

    def read(self, name: str) -> bytes:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def _rename(self, name: str, to: str) -> None:
        """Puts a file in place in one step, over another if there is one."""
        if self.fs.rename(self._path(name), self._path(to)):
            return
        # file systems whose plain rename keeps what is there
        options = self.spark._sc._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        options[0] = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(to).toUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(self._path(name), self._path(to), options)

    def write(self, name: str, data: bytes) -> None:
        """The file appears whole or not at all: it is written aside and renamed; nothing is deleted before."""
        aside = f"{name}.tmp"
        stream = self.fs.create(self._path(aside), True)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()
        self._rename(aside, name)

    def _editions(self, name: str) -> list[int]:
        folder, _, base = name.rpartition("/")
        return sorted(int(m[1]) for n in self.list(folder) if (m := re.fullmatch(re.escape(base) + r"\.(\d{12})", n)))

    def publish(self, name: str, data: bytes) -> None:
        """A new edition of ``name``, under a number of its own; older ones go once it is in place, but for the last."""
        before = self._editions(name)
        self.write(f"{name}.{(before or [0])[-1] + 1:012d}", data)
        for n in before[:-1]:
            self.delete(f"{name}.{n:012d}")

    def published(self, name: str) -> bytes | None:
        """The last edition; None if there is none."""
        found = self._editions(name)
        return self.read(f"{name}.{found[-1]:012d}") if found else None

    def move(self, name: str, to: str) -> None:
        self.fs.mkdirs(self._path(to.rpartition("/")[0]))
        if not self.fs.rename(self._path(name), self._path(to)):
            raise OSError(f"{name} can't be moved to {to}")

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

"""Stored tables that are replaced as a whole: versions beside each other, and a pointer that moves last."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: The folder of pointers: one empty-bodied file for each published version, named by its number.
POINTERS, DATA = "_published", "versions"


class Conflict(RuntimeError):
    """Another writer published first."""


class Store:
    """A table in a folder. Readers see the version that was published last when they asked, whole, whatever is written meanwhile; a writer that dies
    leaves a version that nothing points to."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path = self._path(f"{self.folder}/{folder}")
        return [s.getPath().getName() for s in self._files.listStatus(path)] if self._files.exists(path) else []

    def versions(self) -> list[int]:
        """Numbers of the published versions, in order."""
        return sorted(int(n) for n in self._names(POINTERS) if n.isdigit())

    def _pointer(self, version: int) -> dict:
        stream = self._files.open(self._path(f"{self.folder}/{POINTERS}/{version:020}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame | None:
        """The table as of a version (None: the last one published); None where nothing was published yet. The frame stays at that version."""
        every = self.versions()
        if not every or version is not None and version not in every:
            return None
        at = self._pointer(every[-1] if version is None else version)
        return self.spark.read.schema(StructType.fromJson(json.loads(at["schema"]))).parquet(f"{self.folder}/{DATA}/{at['data']}")

    def write(self, rows: DataFrame, based_on: int | None = None) -> int:
        """Writes rows as the next version and publishes it; its number. The rows may be made from this store's own: they are written beside it.

        based_on: the version that rows were made from (None: the last one). If another one was published since, it is a Conflict, and nothing changes.
        The pointer is written under another name and renamed to its number: that name exists once, so of two writers one fails.
        """
        every = self.versions()
        base = (every[-1] if every else 0) if based_on is None else based_on
        data = uuid.uuid4().hex
        rows.write.parquet(f"{self.folder}/{DATA}/{data}")
        self._publish(base, data, rows.schema.json())
        return base + 1

    def _publish(self, base: int, data: str, schema: str) -> None:
        body = {"data": data, "schema": schema, "at": datetime.now(timezone.utc).isoformat()}
        every = self.versions()
        target = self._path(f"{self.folder}/{POINTERS}/{base + 1:020}")
        if every and every[-1] != base or self._files.exists(target):
            raise Conflict(f"version {every[-1]} was published meanwhile")
        draft = self._path(f"{self.folder}/{POINTERS}/_{uuid.uuid4().hex}")
        stream = self._files.create(draft, False)
        stream.write(json.dumps(body).encode())
        stream.close()
        if not self._files.rename(draft, target):
            self._files.delete(draft, False)
            raise Conflict(f"version {base + 1} was published meanwhile")

    def replace(self, make) -> int:
        """Publishes make(last version or None). With another writer between, it is made anew from what that one published."""
        while True:
            every = self.versions()
            base = every[-1] if every else 0
            try:
                return self.write(make(self.read(base) if every else None), base)
            except Conflict:
                continue

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes all but the last `keep` versions, and what nothing points to; the names of the deleted data folders. Not while a writer is at work: a
        version that it hasn't published yet is one that nothing points to."""
        every = self.versions()
        held = {self._pointer(v)["data"] for v in every[-keep:]}
        gone = [n for n in self._names(DATA) if n not in held]
        for v in every[:-keep]:
            self._files.delete(self._path(f"{self.folder}/{POINTERS}/{v:020}"), False)
        for n in self._names(POINTERS):
            if n.startswith("_"):
                self._files.delete(self._path(f"{self.folder}/{POINTERS}/{n}"), False)
        for n in gone:
            self._files.delete(self._path(f"{self.folder}/{DATA}/{n}"), True)
        return gone

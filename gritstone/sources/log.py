"""The event log as a data source: a sink that rotates its files and publishes them whole, and a source for streams.

`spark.dataSource.register(EventLog)`, then format("event_log") with the log's folder as `path`: any place that pyarrow reaches (file, hdfs, s3, gs).
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

import pyarrow as pa
import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: The names of the log's files; a file's bytes before the next one is begun; the longest line that is read.
PREFIX, SUFFIX, MOST_FILE, MOST_LINE = "events-", ".jsonl", 64 << 20, 1 << 20
SCHEMA = "value string, file_name string, file_modification_time timestamp, line_no bigint"
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else pyarrow.fs.FileSystem.from_uri(f"file://{path}")


def _listed(path: str) -> list[tuple[int, str, int]]:
    """Modification time (microseconds), name and size of the log's files, in that order."""
    files, folder = _open(path)
    found = files.get_file_info(pyarrow.fs.FileSelector(folder, allow_not_found=True))
    return sorted(
        ((f.mtime - EPOCH) // timedelta(microseconds=1), f.base_name, f.size or 0)
        for f in found if f.is_file and f.base_name.startswith(PREFIX) and f.base_name.endswith(SUFFIX)
    )


@dataclass
class Written(WriterCommitMessage):
    """Files that a task wrote under draft names, in order."""

    drafts: tuple[str, ...] = ()
    lines: int = 0


class _Writer:
    """Lines of a task go to drafts of about max_bytes each, which no reader looks at. The driver renames them when all tasks are done, so a task that
    is tried again leaves no line twice, and a write that fails leaves none."""

    def __init__(self, options: dict[str, str]):
        self.path, self.most = options["path"], int(options.get("max_bytes", MOST_FILE))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, folder = _open(self.path)
        files.create_dir(folder)
        drafts, out, size, lines = [], None, 0, 0
        for batch in iterator:
            for line in batch.column(0).to_pylist():
                if line is None:
                    continue
                if out is None or size >= self.most:
                    if out is not None:
                        out.close()
                    drafts.append(f"_draft-{uuid.uuid4().hex}")
                    out, size = files.open_output_stream(posixpath.join(folder, drafts[-1])), 0
                raw = line.rstrip("\r\n").encode() + b"\n"
                out.write(raw)
                size, lines = size + len(raw), lines + 1
        if out is not None:
            out.close()
        return Written(tuple(drafts), lines)

    def _publish(self, messages: list[WriterCommitMessage | None]) -> None:
        """events-YYYYmmdd-HHMMSS.jsonl, and -N for the further ones."""
        files, folder = _open(self.path)
        stamp, taken, n = datetime.now(timezone.utc).strftime("%Y%m%d-%H%M%S"), {name for _, name, _ in _listed(self.path)}, 0
        for message in messages:
            for draft in message.drafts if message else ():
                while (name := f"{PREFIX}{stamp}{f'-{n}' if n else ''}{SUFFIX}") in taken:
                    n += 1
                taken.add(name)
                files.move(posixpath.join(folder, draft), posixpath.join(folder, name))

    def _discard(self, messages: list[WriterCommitMessage | None]) -> None:
        files, folder = _open(self.path)
        for message in messages:
            for draft in message.drafts if message else ():
                files.delete_file(posixpath.join(folder, draft))


class BatchWriter(_Writer, DataSourceArrowWriter):
    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        self._publish(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._discard(messages)


class StreamWriter(_Writer, DataSourceStreamArrowWriter):
    """As BatchWriter, once for each batch: a batch that was published and is run again after a restart is known by its mark, and left out."""

    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        files, folder = _open(self.path)
        mark = posixpath.join(folder, f"_batch-{batchId}")
        if files.get_file_info(mark).type == pyarrow.fs.FileType.NotFound:
            self._publish(messages)
            files.open_output_stream(mark).close()
        else:
            self._discard(messages)

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        self._discard(messages)


@dataclass
class LogFile(InputPartition):
    modified: int
    name: str


class _Reader:
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def read(self, partition: LogFile) -> Iterator[pa.RecordBatch]:
        """Lines of one file, some thousand at a time. Lines of over a MiB are passed over, but counted."""
        files, folder = _open(self.path)
        at, values, places = 0, [], []

        def batch() -> pa.RecordBatch:
            n = len(values)
            columns = [pa.array(values, pa.string()), pa.array([partition.name] * n, pa.string()), pa.array([partition.modified] * n, pa.timestamp("us", "UTC")), pa.array(places, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["value", "file_name", "file_modification_time", "line_no"])

        with pa.PythonFile(files.open_input_stream(posixpath.join(folder, partition.name)), mode="r") as raw:
            rest = b""
            while chunk := raw.read(1 << 20):
                *whole, rest = (rest + chunk).split(b"\n")
                for line in whole:
                    at += 1
                    if len(line) <= MOST_LINE:
                        values.append(line.decode("utf-8", "replace"))
                        places.append(at)
                if values:
                    yield batch()
                    values, places = [], []
            if rest and len(rest) <= MOST_LINE:
                values, places = [rest.decode("utf-8", "replace")], [at + 1]
        if values:
            yield batch()


class BatchReader(_Reader, DataSourceReader):
    """since (ISO 8601, UTC) and slack_seconds: files last written more than the slack before are not even opened."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        since = options.get("since")
        self.least = -(1 << 62)
        if since:
            at = datetime.fromisoformat(since)
            at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
            self.least = (at - EPOCH) // timedelta(microseconds=1) - int(options.get("slack_seconds", 300)) * 1_000_000

    def partitions(self) -> list[LogFile]:
        return [LogFile(m, n) for m, n, _ in _listed(self.path) if m >= self.least]


class StreamReader(_Reader, DataSourceStreamReader):
    """Offsets: the newest modification time so far, and the names read whose time is within slack_seconds of it. A file that comes later than others
    that were written after it is read if its time is within that slack. Of new files the oldest come first, max_files and max_bytes at most in a
    batch (one at least); a run with the trigger availableNow is one batch."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.slack = int(options.get("slack_seconds", 300)) * 1_000_000
        self.files, self.bytes = int(options.get("max_files", 1000)), int(options.get("max_bytes_a_batch", 1 << 30))
        self.at: dict | None = None

    def initialOffset(self) -> dict:
        return {"newest": -1, "names": "[]"}

    def _fresh(self, offset: dict) -> list[tuple[int, str, int]]:
        seen = set(json.loads(offset["names"]))
        return [f for f in _listed(self.path) if f[1] not in seen and f[0] > int(offset["newest"]) - self.slack]

    def latestOffset(self) -> dict:
        at = self.at or self.initialOffset()
        names, newest, size = json.loads(at["names"]), int(at["newest"]), 0
        times = {n: m for m, n, _ in _listed(self.path)}
        for k, (modified, name, own) in enumerate(self._fresh(at)):
            if k and (k >= self.files or size + own > self.bytes):
                break
            names.append(name)
            newest, size = max(newest, modified), size + own
        names = sorted(n for n in names if times.get(n, newest) > newest - self.slack)
        self.at = {"newest": newest, "names": json.dumps(names)}
        return self.at

    def partitions(self, start: dict, end: dict) -> list[LogFile]:
        """Files that `end` has read and `start` has not."""
        self.at = end
        before, after = set(json.loads(start["names"])), set(json.loads(end["names"]))
        low, high = int(start["newest"]) - self.slack, int(end["newest"]) - self.slack
        return [LogFile(m, n) for m, n, _ in _listed(self.path) if n not in before and m > low and (n in after or m <= high)]

    def commit(self, end: dict) -> None:
        pass


class EventLog(DataSource):
    """Rows of the log: value (a line), file_name, file_modification_time and line_no; to be written: one text column of lines."""

    @classmethod
    def name(cls) -> str:
        return "event_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> BatchReader:
        return BatchReader(dict(self.options))

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> BatchWriter:
        return BatchWriter(dict(self.options))

    def streamWriter(self, schema: StructType, overwrite: bool) -> StreamWriter:
        return StreamWriter(dict(self.options))


def expired(path: str, now: datetime, hours: int = 168, most_bytes: int | None = None) -> list[str]:
    """Removes the log's files that were last written more than so many hours before `now`, and the oldest of the others while they hold more than
    most_bytes; the newest file always stays. The names of those removed."""
    files, folder = _open(path)
    every = _listed(path)
    at = now if now.tzinfo else now.replace(tzinfo=timezone.utc)
    least, size = (at - EPOCH) // timedelta(microseconds=1) - hours * 3_600_000_000, sum(f[2] for f in every)
    gone = []
    for modified, name, own in every[:-1]:
        if modified < least or most_bytes is not None and size > most_bytes:
            files.delete_file(posixpath.join(folder, name))
            gone.append(name)
            size -= own
    return gone

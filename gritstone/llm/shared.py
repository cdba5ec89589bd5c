"""Helpers the operators of this subpackage share: tables written to the cluster's shared folder, and hashing of whole Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step of numpy work looks at; longer single texts are taken alone.
SLICE_BYTES = 1 << 20

#: Ten white-space bytes end no word elsewhere: words are [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where that is unset: a temporary folder of our own if the session is local, so that all tasks share its
    disk, else a folder in the warehouse, which must not be the driver's own disk: that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        folder = f"file://{tempfile.mkdtemp(prefix='gritstone-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    elif not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_gritstone"
        if re.match("(file:|/)", folder):
            raise ValueError(f"executors don't share {folder}: set spark.checkpoint.dir to a folder of the cluster")
    return folder.rstrip("/")


#: Where the tables that save() wrote lie.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def save(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Writes df to the shared folder and reads it again: a lineage cut that outlives any executor. The table goes with drop(), or when the driver
    ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    atexit.register(_delete, spark, path)
    table = spark.read.parquet(path)
    _PATHS[table] = path
    return table


def handed_on(table: DataFrame, view: DataFrame) -> DataFrame:
    """view, which is all that reads a saved table from now on: drop(view) deletes the table."""
    _PATHS[view] = _PATHS.pop(table)
    return view


def drop(*tables: DataFrame | None) -> None:
    """Deletes tables that save() wrote and that nothing reads any more."""
    for table in tables:
        path = None if table is None else _PATHS.pop(table, None)
        if path:
            _delete(table.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE to 0..n-1 and its inverses, modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(max(n, SLICE_BYTES), base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, end to end, and len + 1 bounds; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    bounds = np.frombuffer(
        texts.buffers()[1], np.int64 if wide else np.int32, len(texts) + 1, texts.offset * (8 if wide else 4)
    ).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2] if len(texts) else None
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


def hash_words(texts: pa.Array, ends: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, A-Z lower-cased, end to end; and len + 1 bounds. ends: which bytes end a word."""
    raw, bounds = text_bytes(texts)
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    low = LOWER[raw]
    space = ends[low]
    first = np.empty(n, bool)  # no word crosses from a text to the next
    first[0] = True
    first[1:] = space[:-1]
    first[bounds[:-1][bounds[:-1] < n]] = True
    starts = np.flatnonzero(first & ~space)
    last = np.empty(n, bool)
    last[-1] = True
    last[:-1] = space[1:]
    ends_at = bounds[1:] - 1
    last[ends_at[ends_at >= 0]] = True
    stops = np.flatnonzero(last & ~space) + 1
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[low] * up[:n], out=total[1:])
    hashes = mix((total[stops] - total[starts]) * down[starts] + (stops - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, bounds)


def shingles(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word sequences of that size, in order of position; fewer words make one of the whole; and bounds."""
    counts = np.diff(bounds)
    made = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    out = np.concatenate([[0], np.cumsum(made)])
    at = np.arange(out[-1]) - np.repeat(out[:-1], made) + np.repeat(bounds[:-1], made)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    acc = np.zeros(len(at), np.uint64)
    step = np.uint64(0xA0761D6478BD642F)
    for k in range(size):
        acc = acc * step + padded[at + k]
    for d in np.flatnonzero((counts > 0) & (counts < size)):
        short = np.uint64(counts[d])
        with np.errstate(over="ignore"):
            for w in words[bounds[d] : bounds[d + 1]]:
                short = short * step + w
        acc[out[d]] = short
    return mix(acc), out


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows of about `most` bytes in that column (strings, binaries or lists), so that what is made of a run follows no
    batch size setting. Nulls stay null and count as empty."""
    for batch in batches:
        bounds = _bounds(batch.column(column))
        at = 0
        while at < len(batch):
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def _bounds(values: pa.Array) -> np.ndarray:
    """len + 1 bounds of the values' bytes."""
    kind = values.type
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        size = pc.list_value_length(values).fill_null(0).to_numpy(zero_copy_only=False) * (kind.value_type.bit_width // 8)
    else:
        size = pc.binary_length(values).fill_null(0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(size, dtype=np.int64)])


def signed(x: np.ndarray) -> pa.Array:
    """uint64 as Spark's bigint, bit by bit."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def bits_of(slots: DataFrame, log_bits: int) -> np.ndarray:
    """A bit set for each s of slots (0 to 2**log_bits - 1). Its size is fixed, so it may go to every task at any scale."""
    rows = slots.groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("b")).toArrow()  # at most 2**(log_bits - 6)
    bits = np.zeros(1 << (log_bits - 6), np.int64)
    bits[rows["w"].to_numpy()] = rows["b"].to_numpy()
    return bits.view(np.uint64)


def id_bits(ids: DataFrame, column: str, log_bits: int = 23) -> np.ndarray:
    """A one-hash Bloom filter of ids, for the map side of a join that stays exact. 1 MB at 23; where it fills up it merely lets more rows through."""
    return bits_of(ids.select(F.pmod(F.xxhash64(F.col(column).cast("bigint")), F.lit(1 << log_bits)).alias("s")), log_bits)


def with_slot(df: DataFrame, column: str, log_bits: int = 23) -> DataFrame:
    """Adds _slot, where id_bits() looks."""
    return df.withColumn("_slot", F.pmod(F.xxhash64(F.col(column).cast("bigint")), F.lit(1 << log_bits)))


def in_bits(bits: np.ndarray, slot: np.ndarray) -> np.ndarray:
    slot = slot.astype(np.uint64)
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1

"""Helpers shared by the operators: Arrow text buffers, vectorised hashing, shared storage."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Text bytes worked on at once inside a Python worker; one longer document is taken whole.
SLICE_BYTES = 1 << 20

_MIX1, _MIX2 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {"base": np.ones(1, U64), "inverse": np.ones(1, U64)}
#: Random odd weights of the 256 byte values, from a fixed seed.
BYTE_WEIGHT = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) | U64(1)

#: Maps the bytes of A-Z to a-z and leaves all other bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; where it is unset, a local one in local mode, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="receptory-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df once to the shared folder and read it back."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in frames:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.stored_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that are done; it does so only when the driver collects its garbage."""
    spark._jvm.System.gc()


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """Send Python workers at most so many rows at once while this lasts: rows of long texts or large sets then stay within a worker's memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores in front until df has no such column in any case."""
    taken = {x.lower() for x in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_column(name: str = "text"):
    """Null texts count as empty ones."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias("text")


def fold(column: str, parts: int):
    """crc32 of the column as text, modulo parts; null ids fall in fold 0 as the empty text does."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % parts


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about limit bytes of text, or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = text_offsets(batch.column(batch.schema.get_field_index(column)))[1:]
        first = 0
        while first < batch.num_rows:
            base = ends[first - 1] if first else ends[0] * 0
            last = max(first + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(first, last - first)
            first = last
    release()


def release() -> None:
    """Give freed memory back to the system, and large arrays as soon as they are freed from now on.

    A Python worker is kept for later tasks, and what it holds counts for the
    executor.  -3 is glibc's number of the size from which arrays get pages of
    their own; it grows by itself unless it is set.
    """
    pa.default_memory_pool().release_unused()
    library = ctypes.CDLL(None)
    if hasattr(library, "malloc_trim"):
        library.mallopt(-3, 1 << 18)
        library.malloc_trim(0)


def text_offsets(array: pa.Array) -> np.ndarray:
    """Offsets of a string array's rows, from 0."""
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    raw = np.frombuffer(array.buffers()[1], np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    return raw - raw[0]


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows, one after another, and the rows' offsets (no copy of the bytes)."""
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    raw = np.frombuffer(array.buffers()[1], np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = array.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[raw[0] : raw[-1]], raw - raw[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(33))
    x = x * _MIX1
    x ^= x >> U64(33)
    x *= _MIX2
    x ^= x >> U64(33)
    return x


def powers(kind: str, n: int) -> np.ndarray:
    """The first n powers of the hash base or of its inverse, modulo 2**64."""
    have = _powers[kind]
    if len(have) < n:
        have = np.full(max(n, 2 * len(have)), U64(_BASE if kind == "base" else _BASE_INVERSE), U64)
        have[0] = 1
        _powers[kind] = have = np.multiply.accumulate(have)
    return have[:n]


def prefix_hashes(weights: np.ndarray) -> np.ndarray:
    """Prefix sums of weight times power of the base; span_hashes takes them."""
    out = np.zeros(len(weights) + 1, U64)
    np.cumsum(weights * powers("base", len(weights)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end): equal spans are equal wherever they stand."""
    raw = (prefix[ends] - prefix[starts]) * powers("inverse", len(prefix))[starts]
    return mix(raw + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes, never over a row's border, and each row's number of words."""
    inside = is_word[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offsets[:-1] < offsets[1:]
    borders = offsets[:-1][full]
    first[borders] = inside[borders]
    tails = offsets[1:][full] - 1
    last[tails] = inside[tails]
    starts = np.flatnonzero(first)
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, np.flatnonzero(last) + 1, counts


def row_starts(counts: np.ndarray) -> np.ndarray:
    """Offsets from counts."""
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


#: Bytes that are no white space \x20 \x09-\x0D.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F]: digits, a-z and all bytes of characters beyond ASCII.
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[48:58] = ALPHANUMERIC[97:123] = ALPHANUMERIC[128:] = True


def spread(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each length n, one after another."""
    starts = row_starts(lengths)
    return np.arange(starts[-1]) - np.repeat(starts[:-1], lengths)


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """Collect at most limit rows; more is an error, never a silent cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows")
    return rows


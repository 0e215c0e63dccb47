"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python task holds in numpy form at once.
CHUNK_BYTES = 1 << 20
#: White space of the word definition used throughout: space, tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back, so that lost executors cost only a reread.

    The folder is the one the cluster names in spark.checkpoint.dir; only where none is set (tests), a temporary one is.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="seedloom-"))
    return df.checkpoint()


def id_residue(id_col: str, modulus: int) -> Column:
    """crc32(id as text) mod ``modulus``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def release_memory() -> None:
    """Gives back what a task has freed: Python workers live on, and would add it to what later stages need."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library keeps so much
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """From now on the session passes ``rows`` rows at once to Python: whole texts make large rows, and each task of an executor holds a batch twice."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices of the batches with about ``limit`` bytes of ``text`` each; a longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        start = 0
        while start < len(size):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    release_memory()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column laid end to end, and len + 1 offsets; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


_POWERS: dict[str, np.ndarray] = {}


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word in ``data``, and the row it belongs to; no word crosses rows."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    word = np.concatenate([[False], ~blank, [False]])
    edge = word[1:] != word[:-1]
    first = np.zeros(len(edge), bool)
    first[offsets[offsets < len(edge)]] = True
    inner = first[:-1] & word[1:-1] & word[:-2]  # a row that starts right after another's last word
    starts = np.flatnonzero((edge[:-1] & word[1:-1]) | inner)
    ends = np.flatnonzero((edge & word[:-1]) | np.concatenate([inner, [False]]))
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit polynomial hashes of the byte spans, mixed; equal spans hash alike wherever they stand."""
    ring = np.random.default_rng(seed)
    symbols = ring.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    base = int(ring.integers(0, 1 << 61)) * 8 + 5
    n = len(data) + 1
    for name, step in (("up", base), ("down", pow(base, -1, 1 << 64))):
        key = f"{seed}{name}"
        if key not in _POWERS or len(_POWERS[key]) < n:
            powers = np.full(max(n, CHUNK_BYTES + 4096), np.uint64(step))
            powers[0] = 1
            _POWERS[key] = np.multiply.accumulate(powers)
    total = np.zeros(n, np.uint64)
    np.cumsum(symbols[data] * _POWERS[f"{seed}up"][: n - 1], out=total[1:])
    return mix((total[ends] - total[starts]) * _POWERS[f"{seed}down"][starts] + (ends - starts).astype(np.uint64))


def fold_case(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z, all other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def small(df: DataFrame, limit: int = 100_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``limit`` rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def top_by_count(df: DataFrame, n: str, keys: list[str], limit: int) -> DataFrame:
    """The ``limit`` rows with the largest ``n``, ties by ``keys``. ``df`` should be checkpointed: it is read twice.

    A histogram over eighths of powers of two finds the counts that qualify, so little more than ``limit`` rows are sorted.
    """
    level = F.floor(F.log2(F.col(n)) * 8)
    histogram = sorted(df.groupBy(level.alias("level")).count().collect(), reverse=True)
    cut, above = None, 0
    for row in histogram:
        cut, above = row[0], above + row[1]
        if above >= limit:
            break
    rows = df if cut is None else df.filter(level >= cut)
    return rows.orderBy(F.desc(n), *keys).limit(limit)


def broadcast_value(spark: SparkSession, value):
    """A Spark broadcast of a value whose size the caller bounds."""
    return spark.sparkContext.broadcast(value)

"""Scratch tables, Arrow chunking and vectorised text kernels shared by the corpus operators.

Scratch data goes to the folder named by ``spark.checkpoint.dir`` (shared by all executors on a
cluster); only where that setting is absent and all runs in one process, as in tests, a temporary folder
is made.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word and strip rules: U+0020 and U+0009 to U+000D.
WS_CHARS = " \t\n\x0b\f\r"
WORD_RE = r"[^\x20\x09-\x0D]+"

_local_base: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and scratch tables."""
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _local_base:
            _local_base.append(tempfile.mkdtemp(prefix="strataloom-"))
        base = _local_base[0]
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/strataloom-{uuid.uuid4().hex}-{tag}"
    atexit.register(_drop_quietly, spark, path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _drop_quietly(spark: SparkSession, path: str) -> None:
    try:
        drop_path(spark, path)
    except Exception:  # the session ended before the interpreter did
        pass


def materialize(df: DataFrame, tag: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet scratch table and read it back: later steps don't recompute it,
    and it outlives any executor."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete scratch tables that nothing lazily reads any more."""
    for df in frames:
        drop_path(df.sparkSession, df._scratch)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text) -> F.Column:
    """Number of words of a text column; null counts as an empty text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def maybe_broadcast(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Broadcast a side whose counted rows stay within the limit; else leave the join to the optimiser."""
    return F.broadcast(df) if rows <= limit else df


# --------------------------------------------------------------------------- Arrow chunking


def text_chunks(batches: Iterator[pa.RecordBatch], column: int, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text each (one longer text travels alone),
    so that kernels need bounded memory."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            done = size[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(size, done + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def raw_text(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts on end, and their n + 1 offsets. Null is empty."""
    col = pc.fill_null(col, "")
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    bufs = col.buffers()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(bufs[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8)[off[0] : off[-1]] if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


# --------------------------------------------------------------------------- word kernels

_IS_WS = np.zeros(256, bool)
_IS_WS[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

BASE_A = 0x9E3779B97F4A7C15 | 1
BASE_B = 0xC2B2AE3D27D4EB4F | 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n).bit_length())
        up = np.full(size, base, np.uint64)
        up[0] = 1
        down = np.full(size, pow(base, -1, 1 << 64), np.uint64)
        down[0] = 1
        _powers[base] = have = (np.cumprod(up), np.cumprod(down))
    return have


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Spans are hashed over so many values at a time, or over one longer span.
SPAN_BLOCK = 1 << 19


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE_A) -> np.ndarray:
    """Hash of each span of ``values`` (bytes or 64-bit numbers): equal content, equal hash wherever it lies.
    Spans are in the order of their starts, and of their ends."""
    if len(values) > SPAN_BLOCK and len(starts) > 1:
        out, i = np.empty(len(starts), np.uint64), 0
        while i < len(starts):
            lo = int(starts[i])
            j = max(i + 1, int(np.searchsorted(starts, lo + SPAN_BLOCK)))
            hi = int(ends[j - 1])
            out[i:j] = _span_hash(values[lo:hi], starts[i:j] - lo, ends[i:j] - lo, base)
            i = j
        return out
    return _span_hash(values, starts, ends, base)


def _span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    up, down = _power_tables(base, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words, and for each text the index of its first word (n + 1 values)."""
    inside = ~_IS_WS[data]
    n = len(data)
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    cuts = offsets[:-1]
    before[cuts[cuts < n]] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    cuts = offsets[1:] - 1
    after[cuts[cuts >= 0]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def ragged_range(lengths: np.ndarray) -> np.ndarray:
    """0..l-1 for each length on end."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - lengths, lengths)

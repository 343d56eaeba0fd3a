"""Document fingerprints by content-defined chunking.

A gear hash rolls over the UTF-8 bytes; a chunk ends where masked bits of the hash are zero. The mask is
stricter before the normal chunk size than after it (normalised chunking), which keeps sizes near it. An
edit moves only the boundaries around it. The fingerprint is the set of chunk digests with their lengths,
and two fingerprints are alike by the share of length that their sets have in common.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, shuffle_width, span_hash, text_chunks

LEAST, NORMAL, MOST = 16, 48, 192
# The hash is read from 8 to 16 bits up, where it depends on the last 9 to 16 bytes, fewer than LEAST.
STRICT, LOOSE = np.uint32(0b01111110 << 8), np.uint32(0b00011110 << 8)
GEAR = (mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def boundaries(data: np.ndarray) -> list[int]:
    """Ends of the chunks of one text's bytes."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = GEAR[data]
    for k in (1, 2, 4, 8):  # sums of gear[byte] << distance over the last 16 bytes
        nxt = h.copy()
        nxt[k:] += h[:-k] << np.uint32(k)
        h = nxt
    loose = np.flatnonzero((h & LOOSE) == 0) + 1
    strict = loose[(h[loose - 1] & STRICT) == 0].tolist()
    loose = loose.tolist()
    out, at = [], 0
    while n - at > LEAST:
        i = bisect_left(strict, at + LEAST)
        if i < len(strict) and strict[i] < at + NORMAL:
            end = strict[i]
        else:
            j = bisect_left(loose, at + NORMAL)
            end = loose[j] if j < len(loose) and loose[j] <= at + MOST else at + MOST
        at = min(end, n)
        out.append(at)
    if at < n:
        out.append(n)
    return out


def chunk_set(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct chunk digests (64 bits) and their lengths in bytes."""
    ends = np.asarray(boundaries(data), np.int64)
    if not len(ends):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    digest, at = np.unique(span_hash(data, starts, ends), return_index=True)
    return digest, (ends - starts)[at]


def containment(a, b) -> float:
    """Length that both sets hold over the length of the smaller set; two empty sets are alike (1),
    an empty and another one are not (0)."""
    small = min(int(a[1].sum()), int(b[1].sum()))
    if not small:
        return 1.0 if int(a[1].sum()) == int(b[1].sum()) else 0.0
    both = np.isin(a[0], b[0], assume_unique=True)
    return float(a[1][both].sum()) / small


def fingerprint(chunks) -> str:
    """digest:length of each chunk, in order of digests."""
    return ",".join(f"{d:016x}:{n}" for d, n in zip(chunks[0].tolist(), chunks[1].tolist(), strict=True))


def _with_next(docs: DataFrame, parts: int) -> DataFrame:
    """Documents dealt by ranges of doc_id, sorted inside a part, each part closed by a copy of the first
    row of the next non-empty one (``tail``). The first document of all closes the last part."""
    spark = docs.sparkSession
    d = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    edges = d.where(F.col("doc_id").isNotNull()).approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.002) if parts > 1 else []
    edges = sorted({float(x) for x in edges})
    if edges:
        cut = Bucketizer(splits=[-float("inf"), *edges, float("inf")], inputCol="_x", outputCol="part", handleInvalid="keep")
        d = cut.transform(d.withColumn("_x", F.col("doc_id").cast("double"))).drop("_x")
    else:
        d = d.withColumn("part", F.lit(0))
    d = d.withColumn("part", F.coalesce(F.col("part").cast("int"), F.lit(len(edges) + 1)))  # a null doc_id comes last
    first = d.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", F.xxhash64("text").alias("h"))).alias("f"))
    heads = sorted(((r["part"], r["f"]) for r in first.collect()), key=lambda h: h[0])  # one small row for each part
    if not heads:
        return d.withColumn("tail", F.lit(False))
    close = [(heads[i - 1][0], h["doc_id"], h["h"]) for i, (_, h) in enumerate(heads)]
    close = spark.createDataFrame(close, "to int, d long, h long")
    same = d["doc_id"].eqNullSafe(close["d"]) & (F.xxhash64(d["text"]) == close["h"])
    tails = d.join(F.broadcast(close), same).select("doc_id", "text", F.col("to").alias("part")).dropDuplicates(["doc_id", "part"])
    return d.withColumn("tail", F.lit(False)).unionByName(tails.withColumn("tail", F.lit(True)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text), ascending doc_id: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or all) of
    the next document; after the last document comes the first. Null text is empty: fingerprint ''. Rows
    that share a doc_id follow one another by a hash of their text. A null doc_id comes last. Empty input:
    no rows; a single document is its own next. Other columns are ignored.
    """
    spark = docs.sparkSession
    parts = shuffle_width(spark)
    d = _with_next(docs, parts)
    d = d.repartitionById(parts + 1, "part").sortWithinPartitions("part", "tail", F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held_bytes = 0  # of the fingerprints in rows, which grow with their texts
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        held = None  # (doc_id, text, chunks, part) waiting for its next document
        for b in text_chunks(batches, 1):
            for doc, text, part, tail in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                chunks = chunk_set(np.frombuffer(text.encode(), np.uint8))
                if held is not None and held[3] == part:
                    quarter = len(held[1]) // 4
                    edited = (held[1][: len(held[1]) - quarter] + text[:quarter]).encode()
                    other = chunk_set(np.frombuffer(edited, np.uint8))
                    prints = fingerprint(held[2]), fingerprint(other)
                    rows.append((held[0], len(held[1]), hashlib.sha256(edited).hexdigest(), *prints, containment(held[2], other), containment(held[2], chunks)))
                    held_bytes += len(prints[0]) + len(prints[1])
                held = None if tail else (doc, text, chunks, part)
                if len(rows) >= 512 or held_bytes > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows, held_bytes = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return d.select("doc_id", "text", "part", "tail").mapInArrow(run, schema)

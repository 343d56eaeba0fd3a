"""Packing token streams: concatenate and cut.

Pass 1 encodes every document, keeps its running token offset inside its partition and stores the ids.
Pass 2 turns partition totals into global offsets by a prefix sum over partitions and cuts the stream
into fixed windows; each piece of a document in a window is one boundary record. Only the very last
window is short. Nothing is shuffled but one total per partition.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_chunks

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_encoders: dict[str, object] = {}


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE vocabularies: printable bytes stand for themselves, the
    others, in order, for the code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    for i, b in enumerate(sorted(set(range(256)) - set(plain))):
        out[chr(256 + i)] = b
    return out


def encoder(path: str):
    """A function from a text to the ids of a byte-level BPE vocabulary file; the strings of its added tokens
    give their ids, as the file's library has it by default. The file's ranks are run by the quickest engine
    at hand; tests hold its ids against the file's own library."""
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        added = {t["content"]: t["id"] for t in whole["added_tokens"]}
        to_byte = _byte_alphabet()
        ranks = {bytes(to_byte[c] for c in t): i for t, i in whole["model"]["vocab"].items() if t not in added}
        own = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
        _encoders[path] = lambda text: own.encode(text, allowed_special="all")
    return _encoders[path]


def encode_documents(docs: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    """Per row: doc_id, part, local (tokens of the partition before it), n_tokens, ids (packed little-endian
    unsigned 32-bit). Materialised: the order inside a partition is fixed once it is written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, local = encoder(vocabulary), TaskContext.get().partitionId(), 0
        for b in text_chunks(batches, 1):
            ids = [np.asarray([*enc(t or ""), end_id], "<u4") for t in b.column(1).to_pylist()]
            n = np.asarray([len(x) for x in ids], np.int64)
            begin = local + np.cumsum(n) - n
            local += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array(np.full(len(n), part, np.int32)), pa.array(begin), pa.array(n), pa.array([x.tobytes() for x in ids], pa.binary())],
                ["doc_id", "part", "local", "n_tokens", "ids"],
            )

    schema = "doc_id long, part int, local long, n_tokens long, ids binary"
    return materialize(docs.select("doc_id", "text").mapInArrow(run, schema), "token-ids")


def pack(docs: DataFrame, vocabulary: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """Boundary records of all ``docs`` (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset. Null or empty text: the end id alone. Repeated rows are packed each. Rows of very
    long texts span many windows. Empty input: no rows. Columns other than doc_id and text are ignored.
    """
    tokens = encode_documents(docs, vocabulary, end_id)
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = totals.select(F.col("part").alias("_p"), before.alias("base"))
    # one row of 12 bytes for each input partition, whatever the partitions hold
    placed = tokens.join(F.broadcast(bases), tokens["part"] == bases["_p"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, at, n, ids = (b.column(i).to_pylist() for i in range(4))
            rows = []
            for d, g, k, raw in zip(doc, at, n, ids, strict=True):
                done = 0
                while done < k:
                    seq, off = divmod(g + done, window)
                    take = min(k - done, window - off)
                    rows.append((d, done, take, zlib.crc32(raw[4 * done : 4 * (done + take)]), k, seq, off))
                    done += take
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return placed.select("doc_id", (F.col("base") + F.col("local")).alias("at"), "n_tokens", "ids").mapInArrow(cut, PIECES)

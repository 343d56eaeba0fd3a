"""Substring dedup by super-k-mer partitioning.

A window is ``k`` consecutive words. Its minimiser is the least hash among its runs of ``m`` words, and
consecutive windows of a document that share a minimiser travel as one packed string of words to the
bucket of that minimiser. Equal windows have equal minimisers, so each bucket can count its windows
exactly by sorting. Map tasks send each distinct packed string once per flush, with all places where it
starts, so a passage that very many documents share costs its bucket one string a flush.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix64, ragged_range, raw_text, shuffle_width, span_hash, text_chunks, words_of

LAST_ID = (1 << 63) - 1
SPANS = "id long, tag long, first int, last int"


def packed_runs(data: np.ndarray, offsets: np.ndarray, k: int, m: int):
    """Super-k-mers of the texts: (text index, first window's word in its text, windows, minimiser, packed bytes)."""
    starts, ends, first = words_of(data, offsets)
    n = len(starts)
    if n < k:
        return None
    hashes = span_hash(data, starts, ends)
    grams = hashes[: n - m + 1].copy()
    for j in range(1, m):
        grams = mix64(grams + hashes[j : n - m + 1 + j] * np.uint64(2 * j + 1))
    width, have, low = k - m + 1, 1, grams
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: len(grams) - width + 1], low[width - have : len(grams) - have + 1])
    counts = np.diff(first)
    text_of = np.repeat(np.arange(len(counts)), counts)[: n - k + 1]
    local = np.arange(n - k + 1) - first[text_of]
    valid = local + k <= counts[text_of]
    new = valid.copy()
    new[1:] &= ~(valid[:-1] & (low[1:] == low[:-1]) & (text_of[1:] == text_of[:-1]))
    at = np.flatnonzero(new)
    if not len(at):
        return None
    ok = np.flatnonzero(valid)
    run_end = np.append(np.searchsorted(ok, at[1:]), len(ok))
    windows = run_end - np.searchsorted(ok, at)
    length = ends - starts
    put = np.cumsum(length + 1) - (length + 1)
    packed = np.full(int(put[-1] + length[-1]), 32, np.uint8)
    step = ragged_range(length)
    packed[np.repeat(put, length) + step] = data[np.repeat(starts, length) + step]
    last = at + windows + k - 2
    a, b = put[at], put[last] + length[last]
    buf = packed.tobytes()
    return text_of[at], local[at], windows, low[at], [buf[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]


class _Flush:
    """Distinct packed strings of a map task, until written out by bucket."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.low: list[np.ndarray] = []
        self.where: list[tuple[np.ndarray, ...]] = []

    def add(self, ids: np.ndarray, tags: np.ndarray, runs) -> None:
        text, local, _, low, strings = runs
        index = self.index
        uid = np.asarray([index.setdefault(s, len(index)) for s in strings], np.int64)
        self.where.append((uid, ids[text], tags[text], local.astype(np.int32)))
        self.low.append(low)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.index:
            return
        uid, ids, tags, local = (np.concatenate(x) for x in zip(*self.where, strict=True))
        low = np.empty(len(self.index), np.uint64)
        low[uid] = np.concatenate(self.low)
        bucket = (mix64(low) % np.uint64(self.buckets)).astype(np.int64)
        by_bucket = np.argsort(bucket, kind="stable")
        rank = np.empty(len(bucket), np.int64)
        rank[by_bucket] = np.arange(len(bucket))
        order = np.argsort(rank[uid], kind="stable")
        ids, tags, local = ids[order], tags[order], local[order]
        per_string = np.bincount(rank[uid], minlength=len(bucket)).astype(np.uint32)
        done = np.concatenate([[0], np.cumsum(per_string)])
        strings = list(self.index)
        strings = [strings[i] for i in by_bucket.tolist()]
        names, cuts = np.unique(bucket[by_bucket], return_index=True)
        cuts = np.append(cuts, len(bucket))
        zip_ = zstandard.ZstdCompressor(level=5)
        out, held, size = [], [], 0
        for i in range(len(names)):
            a, b = int(cuts[i]), int(cuts[i + 1])
            x, y = int(done[a]), int(done[b])
            head = np.asarray([b - a, y - x], np.uint32).tobytes()
            body = b"".join((head, per_string[a:b].tobytes(), ids[x:y].tobytes(), tags[x:y].tobytes(), local[x:y].tobytes(), b"\n".join(strings[a:b])))
            out.append(zip_.compress(body))
            held.append(int(names[i]))
            size += len(out[-1])
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(out, pa.binary())], ["bucket", "payload"])
                out, held, size = [], [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(out, pa.binary())], ["bucket", "payload"])
        self.clear()


def repeated_windows(payloads: list[bytes], k: int):
    """Arrays (id, tag, first, last) of runs of windows in one bucket whose words also start earlier."""
    index: dict[bytes, int] = {}
    parts = []
    for raw in payloads:
        body = zstandard.ZstdDecompressor().decompress(raw)
        n, places = np.frombuffer(body, np.uint32, 2).tolist()
        at = 8
        per = np.frombuffer(body, np.uint32, n, at)
        at += 4 * n
        ids = np.frombuffer(body, np.int64, places, at)
        tags = np.frombuffer(body, np.int64, places, at + 8 * places)
        local = np.frombuffer(body, np.int32, places, at + 16 * places)
        uid = np.asarray([index.setdefault(s, len(index)) for s in body[at + 20 * places :].split(b"\n")], np.int64)
        parts.append((np.repeat(uid, per), ids, tags, local))
    uid, ids, tags, local = (np.concatenate(x) for x in zip(*parts, strict=True))
    strings = list(index)
    lengths = np.fromiter(map(len, strings), np.int64, len(strings)) + 1
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    buf = b"\n".join(strings) + b"\n"
    data = np.frombuffer(buf, np.uint8)
    starts, ends, first = words_of(data, offsets)
    windows = np.diff(first) - (k - 1)

    # of each packed string the earliest place; later places repeat all of its windows
    order = np.lexsort((local, ids, uid))
    uid, ids, tags, local = uid[order], ids[order], tags[order], local[order]
    head = np.ones(len(uid), bool)
    head[1:] = uid[1:] != uid[:-1]
    lead = np.flatnonzero(head)[uid]
    later = (ids != ids[lead]) | (local != local[lead])
    out = [(ids[later], tags[later], local[later], local[later] + windows[uid[later]].astype(np.int32) - 1)]
    # a repeated row of the earliest place is a place of its own, and as early
    twin = ~later & ~head
    own = np.flatnonzero(head)

    # windows of the distinct strings, each at its string's earliest place
    string_of = np.repeat(np.arange(len(strings)), windows)
    step = ragged_range(windows)
    begin = first[string_of] + step
    hashes = span_hash(span_hash(data, starts, ends), begin, begin + k)
    by_hash = np.argsort(hashes)
    same = hashes[by_hash][1:] == hashes[by_hash][:-1]
    mark = np.zeros(len(hashes), bool)
    mark[1:] = same
    mark[:-1] |= same
    some = by_hash[mark]
    if len(some):
        place = own[string_of[some]]
        doc, at = ids[place], local[place] + step[some].astype(np.int32)
        order = np.lexsort((at, doc))
        some, doc, at = some[order], doc[order], at[order]
        a, b = starts[begin[some]].tolist(), ends[begin[some] + k - 1].tolist()
        seen: dict[bytes, tuple[int, int]] = {}
        dl, al = doc.tolist(), at.tolist()
        hit = np.asarray([seen.setdefault(buf[x:y], (d, s)) != (d, s) for x, y, d, s in zip(a, b, dl, al, strict=True)], bool)
        some, at = some[hit], at[hit]
        for extra in (own, np.flatnonzero(twin)):
            if extra is own:
                place = own[string_of[some]]
                out.append((ids[place], tags[place], at, at))
            elif len(extra):
                bad = {}
                for s, j in zip(string_of[some].tolist(), step[some].tolist(), strict=True):
                    bad.setdefault(s, []).append(j)
                rows = [(ids[e], tags[e], local[e] + j) for e in extra.tolist() for j in bad.get(int(uid[e]), ())]
                if rows:
                    i, t, s = zip(*rows, strict=True)
                    s = np.asarray(s, np.int32)
                    out.append((np.asarray(i, np.int64), np.asarray(t, np.int64), s, s))
    ids, tags, lo, hi = (np.concatenate(x) for x in zip(*out, strict=True))
    if not len(ids):
        return None
    order = np.lexsort((lo, tags, ids))
    ids, tags, lo, hi = ids[order], tags[order], lo[order].astype(np.int64), hi[order].astype(np.int64)
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1]) | (lo[1:] > hi[:-1] + 1)
    at = np.flatnonzero(new)
    return ids[at], tags[at], lo[at].astype(np.int32), np.maximum.reduceat(hi, at).astype(np.int32)


def repeated_spans(docs: DataFrame, k: int = 20, m: int = 4, flush_bytes: int = 8 << 20) -> DataFrame:
    """Runs (id, tag, first, last) of windows, by the word where each starts, whose words also start
    earlier: in a smaller doc_id, or sooner in the same document. id is doc_id, or the largest long where
    that is null; tag tells apart different texts under one doc_id. Rows that repeat a doc_id are as early
    as each other."""
    spark = docs.sparkSession
    buckets = 8 * shuffle_width(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("id"), F.xxhash64(text).alias("tag"), text.alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flush, held = _Flush(buckets), 0
        for b in text_chunks(batches, 2):
            data, offsets = raw_text(b.column(2))
            if (runs := packed_runs(data, offsets, k, m)) is not None:
                flush.add(b.column(0).to_numpy(), b.column(1).to_numpy(), runs)
            held += len(data)
            if held >= flush_bytes:
                yield from flush.rows()
                held = 0
        yield from flush.rows()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(payloads):
            if (got := repeated_windows(payloads, k)) is not None:
                for i in range(0, len(got[0]), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 50_000]) for x in got], ["id", "tag", "first", "last"])

        now, held = None, []
        for b in batches:
            for bucket, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if bucket != now and held:
                    yield from found(held)
                    held = []
                now = bucket
                held.append(payload)
        if held:
            yield from found(held)

    packed = rows.mapInArrow(pack, "bucket int, payload binary")
    return packed.repartitionById(shuffle_width(spark), F.pmod("bucket", F.lit(shuffle_width(spark)))).sortWithinPartitions("bucket").mapInArrow(count, SPANS)


def remove_repeats(docs: DataFrame, k: int = 20, m: int = 4) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept (words left, joined by a space)
    and kept_sha256. A word goes if any window of ``k`` words that covers it also starts earlier.

    Null or blank text: no words, kept ''. Texts of under ``k`` words stay whole. Rows that repeat a doc_id
    and text are not earlier than each other and are treated alike. Empty input: no rows. Other columns are
    ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    spans = repeated_spans(docs, k, m).groupBy("id", "tag").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    d = docs.select("doc_id", text.alias("text"), F.coalesce("doc_id", F.lit(LAST_ID)).alias("_id"), F.xxhash64(text).alias("_tag"))
    d = d.join(spans, (d["_id"] == spans["id"]) & (d["_tag"] == spans["tag"]), "left").select("doc_id", "text", "spans.first", "spans.last")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches, 1):
            data, offsets = raw_text(b.column(1))
            starts, ends, first = words_of(data, offsets)
            change = np.zeros(len(starts) + k + 1, np.int64)
            for col, sign, shift in ((b.column(2), 1, 0), (b.column(3), -1, k)):
                flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                per = np.asarray([0 if x is None else x for x in pa.compute.list_value_length(col).to_pylist()], np.int64)
                np.add.at(change, flat + np.repeat(first[:-1], per) + shift, sign)
            gone = np.cumsum(change)[: len(starts)] > 0
            buf = data.tobytes()
            words = [buf[x:y] for x, y in zip(starts[~gone].tolist(), ends[~gone].tolist(), strict=True)]
            cum = np.concatenate([[0], np.cumsum(~gone)])[first]
            kept = [b" ".join(words[x:y]) for x, y in zip(cum[:-1].tolist(), cum[1:].tolist(), strict=True)]
            n = np.diff(first)
            cols = [b.column(0).cast(pa.int64()), pa.array(n), pa.array(n - np.diff(cum)), pa.array([x.decode() for x in kept], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])

    return d.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS i, ws FROM w WHERE len(ws) >= 20),
x AS (SELECT doc_id, i, row_number() OVER (PARTITION BY sha256(array_to_string(ws[i:i + 19], ' ')) ORDER BY doc_id, i) AS r FROM s),
g AS (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM x WHERE r > 1),
c AS (SELECT DISTINCT doc_id, p FROM g),
e AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
t AS (
  SELECT e.doc_id, count(c.p) AS n_removed, string_agg(e.word, ' ' ORDER BY e.p) FILTER (WHERE c.p IS NULL) AS kept
  FROM e LEFT JOIN c ON e.doc_id = c.doc_id AND e.p = c.p GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, coalesce(t.n_removed, 0) AS n_removed,
       sha256(coalesce(t.kept, '')) AS kept_sha256
FROM w LEFT JOIN t ON w.doc_id = t.doc_id
"""

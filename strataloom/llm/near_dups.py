"""Near-duplicate classes by ProbMinHash.

Word shingles, weighted by their counts, arrive as Poisson processes whose rate is their weight; each
arrival falls on one of the registers, which keep their earliest arrival. An element stops once its next
arrival is later than all registers, so most elements draw once. Two documents agree in a register with
the probability Jaccard similarity of their shingles. A text whose shingles repeat unevenly has a second
set of registers, of its shingles counted once, which agree as set Jaccard; for all others the two sets are
equal. Bands of registers of both sets propose pairs, in one space of keys, and pairs are verified on the
exact shingles of the whole texts.

Equal word sequences are one node from the start. A bucket first proposes only its members against one
pivot; then, where the verified links leave several components in one bucket, all pairs of members of
different components are compared by their registers. So no bucket is capped, no pair inside one
component is emitted, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BASE_A, BASE_B, discard, lower_ascii, materialize, mix64, ragged_range, raw_text, span_hash, text_chunks, words_of

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 4  # a pair at 0.8 shares no band in 3e-6 of cases
REGISTERS = BANDS * ROWS
#: Estimates this far below the threshold are refused unverified: nearly five standard deviations.
SLACK = 0.2
BLOCK, BLOCK_BYTES = 1500, 4 << 20


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS):
    """Distinct shingles of each text: (text index, shingle hash, count), sorted; and the word count and
    128-bit node key of each text. A text of fewer words than a shingle has is one shingle."""
    data = lower_ascii(data)
    starts, ends, first = words_of(data, offsets)
    hashes = span_hash(data, starts, ends)
    counts = np.diff(first)
    key = np.stack([span_hash(hashes, first[:-1], first[1:], BASE_A), span_hash(hashes, first[:-1], first[1:], BASE_B)], 1)
    per = np.where(counts > 0, np.maximum(counts - words + 1, 1), 0)
    text_of = np.repeat(np.arange(len(counts)), per)
    begin = first[text_of] + ragged_range(per)
    value = span_hash(hashes, begin, np.minimum(begin + words, first[text_of + 1]))
    order = np.argsort(value)
    order = order[np.argsort(text_of[order].astype(np.int32), kind="stable")]
    value, text_of = value[order], text_of[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (text_of[1:] != text_of[:-1])
    at = np.flatnonzero(new)
    return text_of[at], value[at], np.diff(np.append(at, len(value))), counts, key


def signatures(text_of: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash registers (n, registers) of 32 bits: for each, the element that arrived first.

    The i-th arrival of an element depends on its hash and i alone; arrivals are drawn in rounds of growing
    size for the elements that may still win a register."""
    best = np.full(n * registers, np.inf)
    owner = np.zeros(n * registers, np.uint32)
    live = np.arange(len(value))
    clock = np.zeros(len(value))
    drawn, burst = 0, 1
    while len(live):
        steps = np.arange(drawn + 1, drawn + burst + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        bits = mix64(value[live][:, None] + steps[None, :])
        gap = -np.log1p(-((bits >> np.uint64(11)).astype(np.float64) * 2.0**-53))
        when = clock[live][:, None] + np.cumsum(gap, 1) / weight[live][:, None]
        slot = text_of[live][:, None] * registers + (mix64(bits) % np.uint64(registers)).astype(np.int64)
        flat, t = slot.ravel(), when.ravel()
        np.minimum.at(best, flat, t)
        won = best[flat] == t
        owner[flat[won]] = np.broadcast_to((value[live] >> np.uint64(32)).astype(np.uint32)[:, None], slot.shape).ravel()[won]
        clock[live] = when[:, -1]
        limit = best.reshape(n, registers).max(1)
        live = live[when[:, -1] < limit[text_of[live]]]
        drawn += burst
        burst = min(burst * 2, 64)
    return owner.reshape(n, registers)


def both_sets(raw: list[bytes]) -> np.ndarray:
    """(n, 2, REGISTERS): the weighted and the plain registers; a text that has only one set has it twice."""
    return np.frombuffer(b"".join(r if len(r) == 8 * REGISTERS else r + r for r in raw), np.uint32).reshape(-1, 2, REGISTERS)


def both_keys(sig: np.ndarray) -> np.ndarray:
    """(n, 2, BANDS) keys of both sets of registers."""
    return np.stack([band_keys(sig[:, 0]), band_keys(sig[:, 1])], 1)


def _share(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether two texts' keys (.., 2, bands) meet in some band, by either set of each."""
    return ((x == y) | (x == y[..., ::-1, :])).any((-2, -1))


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(n, BANDS) 64-bit keys; a key tells its band apart."""
    v = sig.astype(np.uint64).reshape(len(sig), BANDS, ROWS)
    h = mix64(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))[None, :].repeat(len(sig), 0)
    for r in range(ROWS):
        h = mix64(h + v[:, :, r] * np.uint64(2 * r + 3))
    return h.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Likeness of two texts' (shingle hash, count): the greater of set Jaccard and probability Jaccard."""
    (va, wa), (vb, wb) = a, b
    if not len(va) or not len(vb):
        return 0.0
    ib = np.searchsorted(vb, va)
    ib[ib == len(vb)] = 0
    ia = np.flatnonzero(vb[ib] == va)
    if not len(ia):
        return 0.0
    ib = ib[ia]
    plain = len(ia) / (len(va) + len(vb) - len(ia))
    if plain >= SIMILARITY or (wa.max() == 1 and wb.max() == 1):
        return plain
    pa_, pb_ = wa / wa.sum(), wb / wb.sum()
    x, y = pa_[ia], pb_[ib]
    # sum over shared elements of 1 / sum_e max(pa_e / x, pb_e / y): sort all elements by pa / pb
    only_a, only_b = 1 - x.sum(), 1 - y.sum()
    order = np.argsort(x / y)
    xs, ys = x[order], y[order]
    below = np.concatenate([[0], np.cumsum(ys)])[:-1]  # elements of smaller ratio are bound by b's share
    above = xs[::-1].cumsum()[::-1]
    return max(plain, float(np.sum(1 / ((only_a + above) / xs + (only_b + below) / ys))))


def _nodes(docs: DataFrame) -> DataFrame:
    """Materialised rows (doc_id, t, node binary, sig binary): t is the text's hash; null node: no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches, 1):
            data, offsets = raw_text(b.column(1))
            text_of, value, weight, counts, key = shingles(data, offsets)
            sig = signatures(text_of, value, weight.astype(np.float64), b.num_rows)
            # equal counts give the registers of counts of one
            most, least = np.zeros(b.num_rows, np.int64), np.full(b.num_rows, 1 << 62)
            np.maximum.at(most, text_of, weight)
            np.minimum.at(least, text_of, weight)
            uneven = most > least
            own = uneven[text_of]
            plain = np.zeros((0, REGISTERS), np.uint32)
            if own.any():
                plain = signatures((np.cumsum(uneven) - 1)[text_of[own]], value[own], np.ones(int(own.sum())), int(uneven.sum()))
            more = [b""] * b.num_rows
            for k, x in zip(np.flatnonzero(uneven).tolist(), plain, strict=True):
                more[k] = x.tobytes()
            full = counts > 0
            node = pa.array([k.tobytes() if ok else None for k, ok in zip(key, full.tolist(), strict=True)], pa.binary())
            raw = pa.array([s.tobytes() + m if ok else None for s, m, ok in zip(sig, more, full.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(2), node, raw], ["doc_id", "t", "node", "sig"])

    return materialize(docs.select("doc_id", "text", F.xxhash64("text").alias("t")).mapInArrow(run, "doc_id long, t long, node binary, sig binary"), "nodes")


def _estimate(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose registers of one kind agree in at least SIMILARITY - SLACK."""
    s = sigs.select("node", "sig")
    p = pairs.join(s.withColumnsRenamed({"node": "a", "sig": "sa"}), "a").join(s.withColumnsRenamed({"node": "b", "sig": "sb"}), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (both_sets(batch.column(i).to_pylist()) for i in (2, 3))
                ok = pa.array((x == y).mean(2).max(1) >= SIMILARITY - SLACK)
                yield batch.select(["a", "b"]).filter(ok)

    return p.select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary")


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) whose exact similarity is at least SIMILARITY."""
    p = pairs.join(texts.withColumnsRenamed({"node": "a", "text": "ta"}), "a").join(texts.withColumnsRenamed({"node": "b", "text": "tb"}), "b")

    def sets(col: pa.Array):
        data, offsets = raw_text(col)
        text_of, value, weight, _, _ = shingles(data, offsets)
        cuts = np.searchsorted(text_of, np.arange(len(col) + 1))
        return [(value[x:y], weight[x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches, 2, 1 << 19):
            ok = [similarity(x, y) >= SIMILARITY for x, y in zip(sets(b.column(2)), sets(b.column(3)), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return p.select("a", "b", "ta", "tb").mapInArrow(run, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """Materialised (node, root) for the nodes of ``edges`` (a, b): root is the component's least node.
    Alternates large-star and small-star steps until the links no longer change, however many rounds that
    takes (about the square of the logarithm of their number); every round is written to the shared folder,
    so lineage stays short."""
    e = materialize(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi > lo").distinct(), "links")
    count = lambda d: d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    last = count(e)
    while last[0]:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select("lo", "hi"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = materialize(large.where("hi > lo").distinct(), "large-star")
        low = large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        j = large.join(low, large["hi"] == low["u"])
        small = j.select(F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("m").alias("lo"))
        nxt = materialize(small.where("hi > lo").distinct(), "small-star")
        discard(e, large)
        e, now = nxt, count(nxt)
        if now == last:
            break
        last = now
    roots = e.groupBy("hi").agg(F.min("lo").alias("root")).select(F.col("hi").alias("node"), "root")
    return roots.union(e.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def _open_members(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members (key, node, root) of the buckets that hold several components."""
    m = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = m.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("key")
    return m.join(mixed, "key").select("key", "node", "root")


def _across(opened: DataFrame, sigs: DataFrame, texts: DataFrame) -> DataFrame:
    """Verified links (a, b) between components that share a bucket.

    The members of a bucket's largest component, its bulk, need no comparison with each other; the rest do,
    and with the bulk. Both are dealt to blocks of about BLOCK members and BLOCK_BYTES of text, and a task
    compares two blocks. Each pair of members of different components is compared by registers first, in the
    first band that it shares; only registers travel for that. Then the texts of those members that have a partner
    in some pair of blocks, and of no others, go to that pair of blocks, where such pairs are compared by texts. Within
    a task a link joins its components, and pairs inside a component need no more comparison: a task returns fewer
    links than it has members."""
    sizes = texts.select("node", F.octet_length("text").alias("_size"))
    m = opened.join(sigs.select("node", "sig"), "node").join(sizes, "node")
    # how many members and bytes the components of each bucket have; one row for each of both
    load = F.greatest(F.col("n") / BLOCK, F.col("bytes") / BLOCK_BYTES)
    parts = m.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("_size").alias("bytes"))
    by = parts.groupBy(F.col("key").alias("_k")).agg(F.max(F.struct("n", "root", load.alias("load"))).alias("bulk"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    blocks = lambda x: F.greatest(F.ceil(x), F.lit(1)).cast("int")
    by = by.select("_k", F.col("bulk.root").alias("_bulk"), blocks(F.col("bulk.load")).alias("nb"), blocks(load).alias("nr"))
    m = m.join(by, m["key"] == by["_k"]).withColumn("big", F.col("root") == F.col("_bulk"))
    m = m.withColumn("mine", F.pmod(F.xxhash64("node"), F.when(F.col("big"), F.col("nb")).otherwise(F.col("nr"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda across, i, j: F.struct(F.lit(across).alias("across"), i.alias("i"), j.alias("j"))
    with_rest = F.transform(upto("nr"), lambda r: place(True, F.col("mine"), r))
    with_bulk = F.transform(upto("nb"), lambda b: place(True, b, F.col("mine")))
    in_rest = F.transform(upto("nr"), lambda r: place(False, F.least("mine", r), F.greatest("mine", r)))
    m = m.withColumn("at", F.explode(F.when(F.col("big"), with_rest).otherwise(F.concat(with_bulk, in_rest))))
    m = m.select("key", "at.across", "at.i", "at.j", "mine", "big", "node", "root", "sig")
    need = int(np.ceil(REGISTERS * (SIMILARITY - SLACK) - 1e-9))

    def partners(table: pa.Table):
        """(x, those that x is to be compared with by texts) for the members of the left block."""
        sig = both_sets(table["sig"].to_pylist())
        bands = both_keys(sig)
        band = int(np.flatnonzero((bands[0] == table["key"][0].as_py()).any(0))[0])
        mine, big = table["mine"].to_numpy(), table["big"].to_numpy()
        across, i, j = (table[c][0].as_py() for c in ("across", "i", "j"))
        comp = _numbered(table["root"])
        left, right = (np.flatnonzero(~big), np.flatnonzero(big)) if across else (np.flatnonzero(mine == i), np.flatnonzero(mine == j))
        for x in left.tolist():
            cand = right[(comp[right] != comp[x]) & ((right > x) | across | (i != j))]
            if not len(cand):
                continue
            cand = cand[(sig[cand] == sig[x]).sum(2).max(1) >= need]
            yield x, cand[~_share(bands[cand, :, :band], bands[x, :, :band])]

    def wanted(table: pa.Table) -> pa.Table:
        """The rows that have a partner."""
        some = np.zeros(table.num_rows, bool)
        for x, cand in partners(table):
            some[cand] = True
            some[x] |= len(cand) > 0
        return table.filter(pa.array(some))

    def run(table: pa.Table) -> pa.Table:
        node, comp = table["node"].to_pylist(), _numbered(table["root"])
        text_of, value, weight, _, _ = shingles(*raw_text(table["text"]))
        cuts = np.searchsorted(text_of, np.arange(len(node) + 1))
        a, b = [], []
        for x, cand in partners(table):
            own = slice(cuts[x], cuts[x + 1])
            for y in cand.tolist():
                other = slice(cuts[y], cuts[y + 1])
                if comp[y] != comp[x] and similarity((value[own], weight[own]), (value[other], weight[other])) >= SIMILARITY:
                    comp[comp == comp[y]] = comp[x]
                    a.append(node[x])
                    b.append(node[y])
        return pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    # the join left a bucket's rows in one partition, which would also do for the grouping by block
    at = ["key", "across", "i", "j"]
    close = materialize(m.repartition(*at).groupBy(*at).applyInArrow(wanted, m.schema), "close-members")
    return close.join(texts, "node").repartition(*at).groupBy(*at).applyInArrow(run, "a binary, b binary")


def _numbered(roots: pa.ChunkedArray) -> np.ndarray:
    """Components as numbers from 0."""
    return np.unique(np.asarray([r.hex() for r in roots.to_pylist()]), return_inverse=True)[1]


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, class_id (least doc_id among all rows linked to it,
    directly or through others, by 0.8 or more), is_first (this row is the class's one representative).

    Equal word sequences (A-Z lower-cased) are always one class, whatever their number. Rows without words,
    null or blank, are alone: class_id is their doc_id and is_first is true. Rows that repeat a doc_id and
    text are one class; is_first marks one of them. A null doc_id is larger than any other. Empty input: no
    rows. Other columns are ignored.
    """
    return _classes(docs).drop("t")


def _classes(docs: DataFrame) -> DataFrame:
    """``near_duplicates`` with the hash of each row's text, ``t``."""
    rows = _nodes(docs)
    sigs = rows.where(F.col("node").isNotNull()).groupBy("node").agg(F.first("sig").alias("sig"), F.min("doc_id").alias("doc_id"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                c = b.slice(at, 2000)
                k = both_keys(both_sets(c.column(1).to_pylist()))
                new = np.stack([np.ones_like(k[:, 0], bool), k[:, 1] != k[:, 0]], 1)
                yield pa.RecordBatch.from_arrays([pa.array(k[new]), c.column(0).take(pa.array(np.nonzero(new)[0]))], ["key", "node"])

    sigs = materialize(sigs, "signatures")
    bands = materialize(sigs.select("node", "sig").mapInArrow(keys, "key long, node binary"), "bands")
    shared = bands.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("top")).where("pivot != top").select("key", "pivot")
    members = materialize(bands.join(shared, "key"), "members")
    stars = members.where("node != pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    stars = materialize(stars, "stars")
    likely = materialize(_estimate(stars, sigs), "likely")

    def texts(need: DataFrame) -> DataFrame:
        need = need.join(sigs.select("node", "doc_id"), "node").withColumnsRenamed({"doc_id": "_d", "node": "_n"})
        d = docs.select("doc_id", "text")
        found = d.join(need, d["doc_id"].eqNullSafe(need["_d"])).select("_n", "text")

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # other texts may have the doc_id too
            for b in text_chunks(batches, 1):
                *_, key = shingles(*raw_text(b.column(1)))
                ok = [k.tobytes() == n for k, n in zip(key, b.column(0).to_pylist(), strict=True)]
                yield b.filter(pa.array(ok, pa.bool_())).rename_columns(["node", "text"])

        return materialize(found.mapInArrow(own, "node binary, text string").dropDuplicates(["node"]), "pair-texts")

    ends = likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct()
    links = materialize(_verify(likely, texts(ends)), "verified")
    roots = materialize(components(links), "roots")
    opened = materialize(_open_members(members, roots), "open-members")
    if opened.limit(1).count():
        need = opened.select("node").distinct()
        links = links.union(materialize(_across(opened, sigs, texts(need)), "links-across"))
        roots = materialize(components(links), "all-roots")

    # classes are named by their least doc_id; a class may hold very many rows, so it is only aggregated
    named = sigs.select("node", F.col("doc_id").alias("_least")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("_least").alias("class_id"))
    first = named.join(least, "root").select(F.col("node").alias("_n"), "class_id", "_least", "root")
    out = rows.select("doc_id", "t", "node").join(first, F.col("node") == F.col("_n"), "left")
    head = F.col("doc_id").eqNullSafe(F.col("class_id"))
    # of rows that share the least doc_id in one class, one stays: numbered among these rows alone
    w = Window.partitionBy("root", "doc_id").orderBy("node", "t")
    lone = out.where(F.col("_n").isNull()).select("doc_id", "t", F.col("doc_id").alias("class_id"), F.lit(True).alias("is_first"))
    named_rows = out.where(F.col("_n").isNotNull())
    rest = named_rows.where(~head).select("doc_id", "t", "class_id", F.lit(False).alias("is_first"))
    heads = named_rows.where(head).withColumn("_k", F.row_number().over(w)).select("doc_id", "t", "class_id", (F.col("_k") == 1).alias("is_first"))
    return lone.unionByName(rest).unionByName(heads)


def first_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that represent their class: exactly one of each, also where rows share a doc_id or
    have none. Rows without words all stay."""
    by = _classes(docs).groupBy(F.col("doc_id").alias("_d"), F.col("t").alias("_t"))
    n = by.agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col("is_first").cast("int")).alias("_keep")).where("_keep > 0")
    n = materialize(n, "firsts")
    same = docs["doc_id"].eqNullSafe(n["_d"]) & (F.xxhash64(docs["text"]) == n["_t"])
    d = docs.join(n, same)
    whole = d.where("_n = _keep").select(docs["*"])
    # of rows that repeat both doc_id and text, as many as represent classes
    again = d.where("_n > _keep").withColumn("_k", F.row_number().over(Window.partitionBy("_d", "_t").orderBy(F.lit(0)))).where("_k <= _keep")
    return whole.unionByName(again.select(*docs.columns))

"""Hard negatives by exact search over one-dimensional distance keys.

Rows become whole vectors, floor(256 * x) of each component, and get one more coordinate that gives all the same
length, so the higher an inner product with an anchor, the nearer the row. Every row has its nearest pivot and the
distance to it as key; rows are stored sorted by (pivot, distance) in blocks. Whatever is within a radius of an
anchor lies, for each pivot, in an interval of keys around the anchor's own distance to it. A search scans the
blocks that meet these intervals, in growing radius, each block once, until the distance of the last row it needs
is within the radius: nothing unseen can be nearer. Positives are the nearest rows of an anchor's label; for
negatives the annulus between the two score bounds of a positive is searched in the same way, from its inner
radius outwards. Anchors are searched in groups that are near each other. Scores are exact whole numbers.

The pivots come from a bounded sample of rows (``SAMPLE``) and decide the speed alone; all rows are indexed.

Rows with a null label, a null vector, or a null or non-finite component take no part. Shorter vectors count as
padded with zeros; a vector of no components scores 0 with all. A null vec_id is no anchor, keeps its label and
comes last among ties. Rows that share a vec_id are rows of their own: each anchor gets its result. Remaining ties
go by an arbitrary order of rows. Scores beyond the range of long are compared exactly and returned as its
bounds. Without anchors, positives or negatives in the range there are no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, maybe_broadcast, shuffle_width

#: Rows that the pivots are fitted to, at most: those of the lowest hashes.
SAMPLE = 4096
PIVOTS = 64
#: Rows of a block and of a group of anchors, at most.
BLOCK, GROUP = 2048, 256
#: Groups of anchors whose vectors are broadcast, at most; more are joined by shuffle.
BROADCAST_GROUPS = 256
#: Pairs of a block and a group for one task, about.
PAIRS_A_TASK = 64
POSITIVES, NEGATIVES = 5, 3

KEYED = "row long, vec_id long, label long, vector array<double>, pivot int, distance double"
BLOCKS = "block long, pivot int, low double, high double, row array<long>, vec_id array<long>, label array<long>, wide boolean, vectors binary"
BOUNDS = "block long, pivot int, near double, far double"
FOUND = "anchor long, high long, score long, vec_id long, row long"

#: Whole numbers in doubles are exact below this.
EXACT = 2.0**53


# --------------------------------------------------------------------------- rows


def taking_part(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, vector) of the rows that take part, labels as mined."""
    x = F.col("embedding")
    fine = F.col("label").isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")))
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return embeddings.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), moved.alias("label"), x.cast("array<double>").alias("vector"))


def _whole(lists: pa.Array, dims: int) -> np.ndarray:
    """Whole vectors, padded to ``dims``."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = np.diff(np.asarray(lists.offsets))
    out = np.zeros((len(lists), dims))
    with np.errstate(over="ignore"):
        out[np.arange(dims) < sizes[:, None]] = np.clip(np.floor(256 * np.asarray(lists.flatten(), float)), -1e300, 1e300)
    return out


def _distances(points: np.ndarray, last: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """From each point with its last coordinate to each pivot."""
    full = np.c_[points, last]
    square = (full * full).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * full @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def _last(points: np.ndarray, radius2: float) -> np.ndarray:
    return np.sqrt(np.maximum(radius2 - (points * points).sum(1), 0))


def fit_pivots(points: np.ndarray) -> np.ndarray:
    """Centres of a few rounds of k-means from points spread by their distance."""
    rng = np.random.default_rng(0)
    centres = points[:1]
    nearest = np.full(len(points), np.inf)
    while len(centres) < PIVOTS:
        nearest = np.minimum(nearest, ((points - centres[-1]) ** 2).sum(1))
        if not nearest.sum() > 0:
            break
        centres = np.r_[centres, points[rng.choice(len(points), p=nearest / nearest.sum())][None]]
    for _ in range(5):
        own = ((centres * centres).sum(1) - 2 * points @ centres.T).argmin(1)
        centres = np.stack([points[own == k].mean(0) if (own == k).any() else centres[k] for k in range(len(centres))])
    return centres


# --------------------------------------------------------------------------- blocks


def _pack(batches: Iterator[pa.RecordBatch], dims: int, most: int, by_pivot: bool) -> Iterator[pa.RecordBatch]:
    """Sorted keyed rows to blocks of at most ``most`` rows, of one pivot each if ``by_pivot``. A block is named
    after its first row."""

    def packed(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        v = _whole(t.column("vector"), dims)
        narrow = not len(v) or np.abs(v).max(initial=0) <= 32767
        key = t.column("distance").to_numpy()
        one = lambda x, kind: pa.array([x], kind)
        lists = [one(t.column(c).to_pylist(), pa.list_(pa.int64())) for c in ("row", "vec_id", "label")]
        values = [one(t.column("row")[0].as_py(), pa.int64()), one(t.column("pivot")[0].as_py(), pa.int32()), one(key.min(), pa.float64()), one(key.max(), pa.float64()), *lists]
        return pa.record_batch([*values, one(not narrow, pa.bool_()), one(v.astype("<i2" if narrow else "<f8").tobytes(), pa.binary())], names=[c.split()[0] for c in BLOCKS.split(", ")])

    held: list[pa.RecordBatch] = []
    size, pivot = 0, None
    for batch in batches:
        own = batch.column(batch.schema.get_field_index("pivot")).to_numpy()
        at = 0
        while at < len(own):
            if size and (size == most or by_pivot and own[at] != pivot):
                yield packed(held)
                held, size = [], 0
            pivot = own[at]
            stop = min(len(own), at + most - size)
            if by_pivot:
                stop = min(stop, int(np.searchsorted(own, pivot, "right")))
            held.append(batch.slice(at, stop - at))
            size += stop - at
            at = stop
    if size:
        yield packed(held)


class Index:
    """Blocks of all rows and groups of the anchors, as scratch tables."""

    def __init__(self, embeddings: DataFrame):
        self.rows = materialize(taking_part(embeddings).withColumn("row", F.monotonically_increasing_id()), "vector-rows")
        top = F.aggregate("vector", F.lit(0.0), lambda a, x: a + (F.abs(x) * 256 + 1) * (F.abs(x) * 256 + 1))
        self.dims, radius2 = self.rows.agg(F.max(F.size("vector")), F.max(top)).first()
        if self.dims is None:
            return
        self.dims, self.radius2 = max(self.dims, 1), min(radius2, 1e300)
        dims, radius2 = self.dims, self.radius2
        sample = self.rows.select("vector").orderBy(F.xxhash64("vector", "vec_id", "label")).limit(SAMPLE).toArrow()
        points = _whole(sample.column("vector"), dims)
        self.pivots = pivots = fit_pivots(np.c_[points, _last(points, radius2)])

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _whole(batch.column(3), dims)
                d = _distances(x, _last(x, radius2), pivots)
                own = d.argmin(1)
                yield pa.record_batch([*batch.columns, pa.array(own.astype(np.int32)), pa.array(d[np.arange(len(d)), own])], names=[c.split()[0] for c in KEYED.split(", ")])

        k = self.rows.select("row", "vec_id", "label", "vector").mapInArrow(keyed, KEYED)
        order = ("pivot", "distance", "row")
        ranged = lambda df: df.repartitionByRange(*order).sortWithinPartitions(*order)
        self.blocks = materialize(ranged(k).mapInArrow(lambda b: _pack(b, dims, BLOCK, True), BLOCKS), "vector-blocks")
        anchors = k.where(F.col("vec_id") % 50 == 0)
        self.groups = materialize(ranged(anchors).mapInArrow(lambda b: _pack(b, dims, GROUP, False), BLOCKS), "anchor-groups")
        self.n_blocks, self.n_groups = self.blocks.count(), self.groups.count()
        self.bounds = materialize(self.groups.select("block", "wide", "vectors").mapInArrow(lambda b: _spans(b, dims, pivots), BOUNDS), "anchor-bounds")
        self.slack = 1e-6 * (1 + radius2**0.5)

    def distance2(self, norm2, score):
        """Square of the distance of an anchor to a row of that score."""
        return norm2 + F.lit(self.radius2) - 2 * score.cast("double")

    def drop(self) -> None:
        discard(self.rows, *([self.blocks, self.groups, self.bounds] if self.dims else []))


def _vectors(wide: bool, raw: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(raw, "<f8" if wide else "<i2").reshape(-1, dims).astype(float)


def _spans(batches: Iterator[pa.RecordBatch], dims: int, pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The least and the greatest distance of a group's anchors to each pivot."""
    for batch in batches:
        for group, wide, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a = _vectors(wide, raw, dims)
            d = _distances(a, np.zeros(len(a)), pivots)
            n = len(pivots)
            yield pa.record_batch([pa.array([group] * n), pa.array(np.arange(n, dtype=np.int32)), pa.array(d.min(0)), pa.array(d.max(0))], names=["block", "pivot", "near", "far"])


# --------------------------------------------------------------------------- search


def _best(scores: np.ndarray, fits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest fitting scores in each row; ties go to the first column."""
    n = scores.shape[1]
    if scores.dtype != object and np.abs(scores).max(initial=0) * (n + 1) < EXACT:
        key = np.where(fits, scores * n - np.arange(n), -np.inf)
        at = np.argpartition(key, n - k, 1)[:, n - k :] if n > k else np.tile(np.arange(n), (len(key), 1))
        i, j = np.nonzero(np.take_along_axis(key, at, 1) > -np.inf)
        return i, at[i, j]
    pairs = [(i, j) for i in range(len(scores)) for j in sorted(np.flatnonzero(fits[i]), key=lambda j: (-scores[i, j], j))[:k]]
    return tuple(np.array(pairs, np.int64).reshape(-1, 2).T)


def _products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products: doubles where these hold them, else Python's whole numbers."""
    if a.shape[1] * np.abs(a).max(initial=0) * np.abs(x).max(initial=0) < EXACT:
        return a @ x.T
    whole = np.frompyfunc(int, 1, 1)
    return whole(a).dot(whole(x).T)


def _scan(batches: Iterator[pa.RecordBatch], dims: int, k: int, same: bool) -> Iterator[pa.RecordBatch]:
    """A block and a group with its targets in each row, to the block's best rows for each target."""
    low, high = -(1 << 63), (1 << 63) - 1
    for batch in batches:
        for b in range(batch.num_rows):
            r = {c: v[0] for c, v in batch.slice(b, 1).to_pydict().items()}
            x, ids, rows = _vectors(r["wide"], r["vectors"], dims), r["vec_id"], np.array(r["row"], np.int64)
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i], rows[i]))  # ties go by vec_id
            x, rows, labels = x[order], rows[order], np.array(r["label"], np.int64)[order]
            at = np.array([t["at"] for t in r["targets"]])
            used, inverse = np.unique(at, return_inverse=True)
            score = _products(_vectors(r["a_wide"], r["a_vectors"], dims)[used], x)[inverse]
            a_rows, a_labels = np.array(r["a_row"], np.int64)[at], np.array(r["a_label"], np.int64)[at]
            top, bottom, least = (np.array([t[c] for t in r["targets"]], score.dtype)[:, None] for c in ("high", "low", "least"))
            fits = (a_labels[:, None] == labels) if same else (a_labels[:, None] != labels) & (score <= top) & (score >= bottom)
            fits &= (score >= least) & (a_rows[:, None] != rows)
            i, j = _best(score, fits, k)
            if len(i):
                picked = [order[c] for c in j]
                values = score[i, j]
                values = [min(max(int(v), low), high) for v in values] if score.dtype == object else values.astype(np.int64)
                yield pa.record_batch([pa.array(a_rows[i]), pa.array([r["targets"][t]["high"] for t in i], pa.int64()), pa.array(values, pa.int64()), pa.array([ids[c] for c in picked], pa.int64()), pa.array(rows[j])], names=["anchor", "high", "score", "vec_id", "row"])


def search(index: Index, targets: DataFrame, k: int, same: bool) -> DataFrame:
    """The first k rows of each target, as a scratch table (anchor, high, score, vec_id, row, rank).

    ``targets``: (group, at, anchor, norm2, need, high, low, start, limit): the place of an anchor in its group, how
    many rows there are to find at most, the range of scores, the radius to begin with, and the radius beyond
    which no row counts. One anchor may have several targets, of different ``high``."""
    dims, slack = index.dims, index.slack
    rank = F.row_number().over(Window.partitionBy("anchor", "high").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row"))
    directory = index.blocks.select("block", "pivot", F.col("low").alias("b_low"), F.col("high").alias("b_high"))
    payload = index.blocks.select("block", "row", "vec_id", "label", "wide", "vectors")
    groups = index.groups.select(F.col("block").alias("group"), *[F.col(c).alias(f"a_{c}") for c in ("row", "label", "wide", "vectors")])
    spans = index.bounds.withColumnRenamed("block", "group")
    tasks = max(shuffle_width(targets.sparkSession), min(index.n_blocks * index.n_groups // PAIRS_A_TASK, 10 * index.n_blocks))
    least = F.lit(-(1 << 63)).cast("long")
    open_ = materialize(targets.select("*", F.col("start").alias("reach"), F.lit(-1.0).alias("done"), least.alias("least")), "search-targets")
    best = None
    while True:
        of_group = open_.groupBy("group").agg(F.collect_list(F.struct("at", "high", "low", "least")).alias("targets"), F.max("reach").alias("reach"), F.min("done").alias("done"), F.min("inner").alias("inner"))
        nearest = F.greatest(F.lit(0.0), F.col("near") - F.col("b_high"), F.col("b_low") - F.col("far")) - slack
        meets = (nearest <= F.col("reach")) & (nearest > F.col("done")) & (F.col("far") + F.col("b_high") + slack >= F.col("inner"))
        pairs = of_group.select("group", "reach", "done", "inner").join(spans, "group").join(directory, "pivot").where(meets).select("group", "block")
        work = pairs.repartition(tasks, "block").join(payload, "block").join(maybe_broadcast(of_group.select("group", "targets").join(groups, "group"), index.n_groups, BROADCAST_GROUPS), "group")
        found = work.drop("group", "block").mapInArrow(lambda batches: _scan(batches, dims, k, same), FOUND)
        if best is not None:
            found = best.drop("rank").unionByName(found)
        now = materialize(found.withColumn("rank", rank).where(F.col("rank") <= k), "search-best")
        # each target's last row so far, and whether nothing unseen can come before it
        last = now.groupBy("anchor", "high").agg(F.count("*").alias("have"), F.min("score").alias("worst"))
        reached = open_.groupBy("group").agg(F.max("reach").alias("reached"))
        t = open_.join(reached, "group").join(last, ["anchor", "high"], "left")
        full = F.col("have") >= F.col("need")
        wanted = F.least(F.col("limit"), F.when(full, F.sqrt(index.distance2(F.col("norm2"), F.col("worst"))) + slack).otherwise(F.greatest(2 * F.col("reached"), F.lit(index.radius2**0.5 / 8))))
        ready = (F.col("need") <= 0) | (F.col("reached") >= F.col("limit")) | (F.coalesce(full, F.lit(False)) & (wanted <= F.col("reached")))
        left = t.where(~ready).select(*[c for c in targets.columns], wanted.alias("reach"), F.col("reached").alias("done"), F.when(full, F.col("worst")).otherwise(least).alias("least"))
        after = materialize(left, "search-targets")
        discard(open_, *([best] if best is not None else []))
        open_, best = after, now
        if not open_.head(1):
            discard(open_)
            return best


def mine(embeddings: DataFrame) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    spark = embeddings.sparkSession
    index = Index(embeddings)
    if not index.dims or not index.n_groups:
        index.drop()
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    dims = index.dims

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each anchor's place in its group."""
        for batch in batches:
            for group, rows, ids, labels, wide, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a = _vectors(wide, raw, dims)
                kinds = (pa.array([group] * len(a)), pa.array(np.arange(len(a), dtype=np.int32)), pa.array(rows), pa.array(ids, pa.int64()), pa.array(labels), pa.array((a * a).sum(1)))
                yield pa.record_batch(list(kinds), names=["group", "at", "anchor", "anchor_id", "label", "norm2"])

    anchors = index.groups.select("block", "row", "vec_id", "label", "wide", "vectors").mapInArrow(placed, "group long, at int, anchor long, anchor_id long, label long, norm2 double")
    anchors = materialize(anchors, "anchors")
    whole = F.lit(2.1 * index.radius2**0.5 + 1)  # no two points are farther apart
    near = index.bounds.groupBy(F.col("block").alias("group")).agg((F.min("near") / 2).alias("start"))
    sizes = index.rows.groupBy("label").agg(F.count("*").alias("size"))
    nothing = F.lit(0).cast("long")
    first = anchors.join(near, "group").join(sizes, "label").select("group", "at", "anchor", "norm2", F.least(F.lit(POSITIVES), F.col("size") - 1).alias("need"), nothing.alias("high"), nothing.alias("low"), "start", whole.alias("limit"), F.lit(0.0).alias("inner"))
    positives = search(index, first, POSITIVES, same=True)
    p = positives.select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).where("positive_score >= 0")
    # 100 n <= 95 p and 100 n >= 50 p in whole numbers, without overflow
    p = p.withColumn("high", F.expr("(positive_score div 20) * 19 + (positive_score % 20) * 19 div 20")).withColumn("low", F.expr("positive_score div 2 + positive_score % 2"))
    radius = lambda c: F.sqrt(F.greatest(index.distance2(F.col("norm2"), F.col(c)), F.lit(0.0)))
    ranges = anchors.join(p.select("anchor", "high", "low").distinct(), "anchor")
    ranges = ranges.groupBy("group", "at", "anchor", "norm2", "high").agg(F.min("low").alias("low"))
    second = ranges.select("group", "at", "anchor", "norm2", F.lit(NEGATIVES).cast("long").alias("need"), "high", "low", (radius("high") * 1.02).alias("start"), (radius("low") + index.slack).alias("limit"), (radius("high") - index.slack).alias("inner"))
    negatives = search(index, second, NEGATIVES, same=False)
    n = negatives.select("anchor", "high", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"), "rank")
    # positives of nearly the same score can have one upper bound and two lower ones; each keeps its own
    out = p.join(anchors.select("anchor", "anchor_id"), "anchor").join(n, ["anchor", "high"]).where("negative_score >= low")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


ORACLE_SQL = """
WITH v AS (
    SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.r AS ar, a.vec_id AS anchor_id, b.r AS br, b.vec_id AS other_id, a.label = b.label AS same,
           CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
    FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 50 = 0
), p AS (
    SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, other_id) <= 5
), n AS (
    SELECT p.anchor_id, p.other_id AS positive_id, s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
           row_number() OVER (PARTITION BY p.ar, p.br ORDER BY s.score DESC, s.other_id) AS rank
    FROM p JOIN s ON s.ar = p.ar AND NOT s.same
    WHERE 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

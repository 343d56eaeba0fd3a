"""Mixing sources to target weights by capped water-filling.

Every source asks for its share (by weight) of the words of the whole corpus. A source may repeat its
words ``max_epochs`` times at most; what a clamped source cannot supply is shared out again among the
others by weight. The level at which that settles is found in closed form over the sources sorted by
cap / weight, so no loop runs. A source is then taken as whole repetitions of all its documents plus a
seeded fractional repetition: documents in the order of a seeded hash until the words are reached, the
last one in part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, maybe_broadcast, shared_dir, word_count

BUCKET_HEX = 3
#: A source row is under 200 bytes, so at most 2 MB are broadcast.
BROADCAST_SOURCES = 10_000


def default_weights(sources: DataFrame) -> DataFrame:
    """Weights 1, 2, 3, repeating, over the sources by code point, null last."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    return sources.withColumn("weight", ((rank - 1) % 3 + 1).cast("long"))


def water_fill(sources: DataFrame, max_epochs: int = 3) -> DataFrame:
    """``sources`` (one row each: source, source_size long, weight long) with ``target`` double:
    min(max_epochs * source_size, level * weight), where the targets add up to all sizes.

    The window runs over source rows, one per source, never over documents. A source of size 0 gets 0.
    """
    cap = F.col("source_size") * F.lit(max_epochs)
    order = [F.col("_ratio"), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = sources.withColumn("_ratio", cap.cast("double") / F.col("weight"))
    s = s.withColumn(
        "_level",
        (F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(before), F.lit(0))).cast("double")
        / F.sum("weight").over(rest),
    )
    # the first source whose ratio reaches the level that its predecessors' caps leave
    level = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_level"))).over(every)
    s = s.withColumn("_level", level["_level"])
    target = F.when(F.col("_level") <= F.col("_ratio"), F.least(F.col("_level") * F.col("weight"), cap.cast("double")))
    return s.withColumn("target", F.coalesce(target, cap.cast("double"))).drop("_ratio", "_level")


def mix(docs: DataFrame, max_epochs: int = 3, seed: str = "mix-1", cut_last: bool = True) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source): doc_id, source, size, source_size, target, taken.

    taken = whole * size + the part of the document inside the fractional repetition. ``cut_last`` false
    takes the last document of a fraction wholly where at least half of it is due, else not at all.

    Null or blank text: size 0, taken 0. A null source is a source of its own, last in the order. Rows that
    share doc_id and size are alike and ordered arbitrarily among themselves, which gives the same rows.
    Empty input: no rows. A hot source is dealt by seeded hash buckets: sums per bucket are found by
    partial aggregation, and only the one bucket per source in which the fraction ends is ordered row by row.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    sized = sized.withColumn("_key", key).withColumn("_bucket", F.conv(F.substring("_key", 1, BUCKET_HEX), 16, 10).cast("int"))
    per_bucket = materialize(sized.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum")), "mix-buckets")

    plan = water_fill(default_weights(per_bucket.groupBy("source").agg(F.sum("_sum").alias("source_size"))), max_epochs)
    due = F.least(F.floor("target"), F.col("source_size") * max_epochs)
    plan = plan.withColumn("_whole", F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0)))
    plan = plan.withColumn("_extra", due - F.col("_whole") * F.col("source_size"))
    ahead = F.coalesce(F.sum("_sum").over(Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = per_bucket.withColumn("_ahead", ahead)
    p = plan.select(F.col("source").alias("_s"), "_extra")
    ends = ends.join(p, ends["source"].eqNullSafe(p["_s"]))
    ends = ends.where((F.col("_ahead") < F.col("_extra")) & (F.col("_ahead") + F.col("_sum") >= F.col("_extra")))
    ends = ends.select(F.col("_s").alias("_s2"), F.col("_bucket").alias("_end"), "_ahead")
    plan = plan.join(ends, plan["source"].eqNullSafe(ends["_s2"]), "left").drop("_s2")
    plan = materialize(plan.withColumnRenamed("source", "_s").drop("weight"), "mix-plan")

    d = sized.join(maybe_broadcast(plan, plan.count(), BROADCAST_SOURCES), sized["source"].eqNullSafe(plan["_s"])).drop("_s")
    # no _end: nothing extra is due
    plain = d.where(F.col("_end").isNull() | (F.col("_bucket") != F.col("_end")))
    plain = plain.withColumn("_part", F.when(F.col("_bucket") < F.col("_end"), F.col("size")).otherwise(F.lit(0)))
    w = Window.partitionBy("source").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    last = d.where(F.col("_bucket") == F.col("_end"))
    left = F.col("_extra") - F.col("_ahead") - F.coalesce(F.sum("size").over(w), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), left))
    if not cut_last:
        part = F.when(part * 2 >= F.col("size"), F.col("size")).otherwise(F.lit(0))
    last = last.withColumn("_part", part)
    both = plain.unionByName(last)
    return both.select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("_whole") * F.col("size") + F.col("_part")).cast("long").alias("taken"),
    )


def mixed_documents(docs: DataFrame, max_epochs: int = 3, seed: str = "mix-1") -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, whole. Rows without words are taken never. Rows
    that share doc_id and size are taken equally often."""
    taken = mix(docs, max_epochs, seed, cut_last=False).where(F.col("taken") > 0)
    times = taken.groupBy(F.col("doc_id").alias("_d"), F.col("size").alias("_n")).agg(F.max(F.expr("taken div size")).cast("int").alias("_times"))
    d = docs.withColumn("_size", word_count(F.col("text")))
    d = d.join(times, d["doc_id"].eqNullSafe(times["_d"]) & (d["_size"] == times["_n"]))
    return d.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*docs.columns)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source),
r AS (SELECT *, CAST(3 * source_size AS DOUBLE) / weight AS ratio FROM s),
l AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
         / CAST(sum(weight) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lev
  FROM r),
f AS (SELECT lev FROM l WHERE lev <= ratio ORDER BY ratio, lev LIMIT 1),
t AS (
  SELECT l.source, l.source_size,
         CASE WHEN f.lev <= l.ratio THEN least(f.lev * l.weight, CAST(3 * l.source_size AS DOUBLE)) ELSE CAST(3 * l.source_size AS DOUBLE) END AS target
  FROM l, f),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS whole FROM t),
q AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.whole,
         least(CAST(floor(p.target) AS BIGINT), 3 * p.source_size) - p.whole * p.source_size
         - coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(0, least(size, left_over)) AS BIGINT) AS taken
FROM q
"""

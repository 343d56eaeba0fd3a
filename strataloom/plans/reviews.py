"""Reviews as logs of events: replaying a log gives the selection that the person at the screen saw last.

Events (image_id, seq, kind, and what the kind needs) are folded in the order of ``seq`` in each image; the last one
wins. Kinds: ``limits`` (the limits of the object filter, null is off), ``delete`` and ``restore`` (label), ``pin`` (label that is
taken first, in the order of pins), ``count`` (n and rule), ``accept`` and ``cancel``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import finite_or_zero
from ..operators.joins import knn_mean_distance
from ..operators.scratch import cut

LIMITS = ("min_area", "max_area", "min_elongation", "max_elongation", "min_confidence", "max_nn")


def _last(kind: str, value):
    """Of the last event of a kind; null without one."""
    return F.max_by(F.when(F.col("kind") == kind, value), F.when(F.col("kind") == kind, F.col("seq")))


def state(events: DataFrame) -> DataFrame:
    """(image_id, the limits, n, rule, accepted): where each image's review stands. It is accepted if that was the last
    thing that happened."""
    limits = F.struct(*[F.col(c) for c in LIMITS])
    s = events.groupBy("image_id").agg(_last("limits", limits).alias("l"), _last("count", F.struct("n", "rule")).alias("c"), (F.max_by("kind", "seq") == "accept").alias("accepted"))
    return s.select("image_id", *[F.col(f"l.{c}").alias(c) for c in LIMITS], "c.n", "c.rule", "accepted")


def marked(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The deleted labels (image_id, label), and the pinned ones with the place of their first pin."""
    by = events.where(F.col("kind").isin("delete", "restore")).groupBy("image_id", "label").agg(F.max_by("kind", "seq").alias("k"))
    pins = events.where("kind = 'pin'").groupBy("image_id", "label").agg(F.min("seq").alias("pin"))
    return by.where("k = 'delete'").select("image_id", "label"), pins


def replay(objects: DataFrame, events: DataFrame) -> DataFrame:
    """The objects (image_id, label, area, elongation, weighted, x, y, ...) that each image's review ends with, with
    ``nn``, the mean distance to the three nearest other survivors in the units of x and y. An image without events is
    not reviewed and keeps none of its objects. An error where a review was not accepted."""
    st = cut(state(events))
    if st.where("not accepted").head(1):
        raise RuntimeError("a review was closed without being accepted")
    deleted, pins = marked(events)
    between = lambda c, lo, hi: (F.col(lo).isNull() | (F.col(c) >= F.col(lo))) & (F.col(hi).isNull() | (F.col(c) <= F.col(hi)))
    m = F.col("weighted")
    sure = F.col("min_confidence").isNull() | F.coalesce(~F.isnan(m) & (F.abs(m) != float("inf")) & (m >= F.col("min_confidence")), F.lit(False))
    o = objects.join(st, "image_id").where(between("area", "min_area", "max_area") & between("elongation", "min_elongation", "max_elongation") & sure)
    o = cut(o.join(deleted, ["image_id", "label"], "left_anti"))
    nn = knn_mean_distance(o.select("image_id", F.col("label").alias("id"), "x", "y")).withColumnRenamed("id", "label")
    o = o.join(nn, ["image_id", "label"]).where(F.col("max_nn").isNull() | (F.col("nn") <= F.col("max_nn"))).join(pins, ["image_id", "label"], "left")
    best = F.when(F.col("rule") == "area", F.col("area").cast("double")).otherwise(finite_or_zero(m))
    place = F.row_number().over(Window.partitionBy("image_id").orderBy(F.col("pin").asc_nulls_last(), best.desc(), "label"))
    o = o.withColumn("_place", place).where(F.col("n").isNull() | (F.col("n") <= 0) | (F.col("_place") <= F.col("n")))
    return o.select(*objects.columns, "nn")

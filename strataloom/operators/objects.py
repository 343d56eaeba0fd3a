"""Measurements of labelled objects, their filters and selections."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import finite_or_zero
from .joins import images, knn_mean_distance
from .scratch import cut


@dataclass(frozen=True)
class Limits:
    """Limits of the object filter; None is off. Confidence is the size-weighted one (column ``weighted``), and
    neighbour distances are in stage units."""

    min_area: float = 100
    max_area: float | None = None
    min_elongation: float = 0.0
    max_elongation: float = 1.0
    min_confidence: float | None = None
    max_nn: float | None = None

    def __post_init__(self):
        if self.min_area < 0 or (self.max_area is not None and self.max_area < self.min_area):
            raise ValueError("area limits are out of order")
        if not 0 <= self.min_elongation <= self.max_elongation <= 1:
            raise ValueError("elongation limits must lie in [0, 1], in order")
        if self.max_nn is not None and self.max_nn <= 0:
            raise ValueError("the neighbour limit must be positive")
        if any(v is not None and v != v for v in (self.min_area, self.max_area, self.min_confidence, self.max_nn)):
            raise ValueError("limits must be numbers")


def measure(labels: DataFrame) -> DataFrame:
    """Objects of (image_id, y, x, label): area, centroid, box, axis_ratio and elongation. Moments are whole
    sums, divided once. A single pixel has ratio 0 and elongation 1."""
    s = lambda e: F.sum((e).cast("long")).cast("double")
    x, y = F.col("x").cast("long"), F.col("y").cast("long")
    g = labels.groupBy("image_id", "label").agg(
        F.count(F.lit(1)).alias("area"), s(x).alias("sx"), s(y).alias("sy"), s(x * x).alias("sxx"), s(y * y).alias("syy"), s(x * y).alias("sxy"),
        F.min("y").alias("min_y"), F.max("y").alias("max_y"), F.min("x").alias("min_x"), F.max("x").alias("max_x"),
    )
    n = F.col("area").cast("double")
    # covariance times n squared, exact in whole numbers
    a, b, c = n * F.col("sxx") - F.col("sx") * F.col("sx"), n * F.col("syy") - F.col("sy") * F.col("sy"), n * F.col("sxy") - F.col("sx") * F.col("sy")
    root = F.sqrt((a - b) * (a - b) + c * c * 4)
    l1, l2 = (a + b + root) / 2, F.greatest((a + b - root) / 2, F.lit(0.0))
    ratio = F.when(l1 <= 0, 0.0).otherwise(F.least(F.sqrt(l2 / F.when(l1 > 0, l1)), F.lit(1.0)))
    return g.select("image_id", "label", "area", (F.col("sy") / n).alias("centroid_y"), (F.col("sx") / n).alias("centroid_x"), "min_y", "max_y", "min_x", "max_x", ratio.alias("axis_ratio"), (1 - ratio).alias("elongation"))


def confidence(labels: DataFrame) -> DataFrame:
    """Mean, least, sum and mean * sqrt(n) of ``prob`` by object; NaN where there is no probability."""
    n, nan = F.count("prob"), F.lit(float("nan"))
    v = lambda e: F.when(n > 0, e).otherwise(nan)
    return labels.groupBy("image_id", "label").agg(
        v(F.avg("prob")).alias("mean"), v(F.min("prob")).alias("least"), F.coalesce(F.sum("prob"), F.lit(0.0)).alias("total"), v(F.avg("prob") * F.sqrt(n.cast("double"))).alias("weighted")
    )


def filter_objects(objects: DataFrame, limits: Limits, deleted: DataFrame | None = None, px_x: float = 1.0, px_y: float = 1.0) -> DataFrame:
    """Objects within the limits, without the deleted labels (by image, where that table tells images apart).
    Neighbour distances (column ``nn``) are those among the survivors of the other limits in the same image,
    in stage units of ``px_x`` by ``px_y`` a pixel."""
    keep = (F.col("area") >= limits.min_area) & F.col("elongation").between(limits.min_elongation, limits.max_elongation)
    if limits.max_area is not None:
        keep &= F.col("area") <= limits.max_area
    if limits.min_confidence is not None:
        m = F.col("weighted")
        keep &= m.isNotNull() & ~F.isnan(m) & (F.abs(m) != float("inf")) & (m >= limits.min_confidence)
    out = objects.where(keep)
    if deleted is not None:
        out = out.join(deleted, [*images(out, deleted), "label"], "left_anti")
    out = cut(out)  # the neighbour search reads the survivors several times
    image = images(out)
    nn = knn_mean_distance(out.select(*image, F.col("label").alias("id"), (F.col("centroid_x") * px_x).alias("x"), (F.col("centroid_y") * px_y).alias("y")))
    out = out.join(nn.withColumnRenamed("id", "label"), [*image, "label"])
    return out if limits.max_nn is None else out.where(F.col("nn") <= limits.max_nn)


def top(objects: DataFrame, n: int, by: str) -> DataFrame:
    """The first n of each image by area, or by finite size-weighted confidence, descending; ties in the order
    of labels."""
    if by not in ("none", "area", "confidence"):
        raise ValueError(f"unknown count rule {by!r}")
    if by == "none" or n <= 0:
        return objects
    key = F.col("area") if by == "area" else finite_or_zero(F.col("weighted"))
    if not images(objects):
        return objects.orderBy(key.desc(), "label").limit(n)
    w = Window.partitionBy("image_id").orderBy(key.desc(), "label")
    return objects.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def fill_selection(objects: DataFrame, cached: list[int], n: int) -> DataFrame:
    """n objects of each image: cached labels first, in their order, then the best by size-weighted confidence."""
    rank = objects.sparkSession.createDataFrame([(x, i) for i, x in enumerate(dict.fromkeys(cached))], "label long, _r int")
    j = objects.join(F.broadcast(rank), "label", "left")
    order = (F.col("_r").asc_nulls_last(), finite_or_zero(F.col("weighted")).desc(), "label")
    if not images(objects):
        return j.orderBy(*order).limit(n).drop("_r")
    return j.withColumn("_k", F.row_number().over(Window.partitionBy("image_id").orderBy(*order))).where(F.col("_k") <= n).drop("_r", "_k")


def paint(labels: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """Per-object values painted on their pixels; 0 where an object has none."""
    return labels.join(values.select("image_id", "label", column), ["image_id", "label"], "left").withColumn(column, F.coalesce(column, F.lit(0)))


def box_groups(members: DataFrame) -> DataFrame:
    """Groups of members (group_id, id, x, y, z): count, box, centre and median z."""
    return members.groupBy(*images(members), "group_id").agg(
        F.count(F.lit(1)).alias("members"), F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"), F.median("z").alias("z")
    )


def modal_z(pixels: DataFrame, keys: list[str], classes: tuple[int, ...] | None = None) -> DataFrame:
    """Most frequent ``argmax_z`` by key, the least on ties, over the pixels of the classes."""
    p = pixels if classes is None else pixels.where(F.col("cls").isin(*classes))
    c = p.where(F.col("argmax_z") >= 0).groupBy(*keys, "argmax_z").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("m"), "argmax_z"))["argmax_z"].alias("z"))


def sorted_groups(groups: DataFrame) -> DataFrame:
    """Groups numbered in their image by top edge, left edge and first member: one row for each group, never one
    for a member."""
    w = Window.partitionBy(*images(groups)).orderBy("min_y", "min_x", "group_id")
    return groups.withColumn("ordinal", F.row_number().over(w).cast("long"))

"""Connected components of pixel masks and of link tables, and single linkage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import images
from .scratch import cut


def component_roots(edges: DataFrame) -> DataFrame:
    """(id, label) of the nodes of ``edges`` (a, b): label is the least id that they reach. Alternates
    linking every neighbour, then every smaller neighbour, to the least one, until the links stay, however
    many rounds that takes. Each round works on links only, in the shuffle, and is checkpointed."""
    e = cut(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi > lo").distinct())
    state = lambda d: d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    last = state(e)
    while last[0]:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select("lo", "hi"))
        m = F.least(F.min("v"), F.first("u"))
        least = both.groupBy("u").agg(m.alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        j = large.join(low, F.col("hi") == F.col("u"))
        e = cut(j.select(F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("m").alias("lo")).where("hi > lo").distinct())
        now = state(e)
        if now == last:
            break
        last = now
    roots = e.groupBy(F.col("hi").alias("id")).agg(F.min("lo").alias("label"))
    return roots.union(e.select(F.col("lo").alias("id"), F.col("lo").alias("label")).distinct())


def label_components(mask: DataFrame, width: int, connectivity: int = 8) -> DataFrame:
    """``mask`` (image_id, y, x, ...) with ``label``: the least y * width + x of its component.

    Runs of pixels along x are found by a window over rows; touching runs of neighbouring rows are linked
    by an equi-join on the row and on cells of ``RUN_CELL`` columns, so a run meets those near it alone, and only
    runs are labelled by rounds. Images and rows share the work."""
    if connectivity not in (4, 8):
        raise ValueError("connectivity is 4 or 8")
    reach = 1 if connectivity == 8 else 0
    m = mask.withColumn("_k", F.col("x") - F.row_number().over(Window.partitionBy("image_id", "y").orderBy("x")))
    # the id of a run: image and first pixel; images are numbered by hash so that ids are longs
    runs = m.groupBy("image_id", "y", "_k").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    runs = cut(runs.withColumn("rid", F.struct("image_id", (F.col("y") * F.lit(width).cast("long") + F.col("x0")).alias("p"))))
    edges = touching_runs(runs, reach)
    roots = component_roots(edges)
    runs = runs.join(roots, runs["rid"] == roots["id"], "left").select("image_id", "y", "_k", F.coalesce("label.p", "rid.p").alias("label"))
    return m.join(runs, ["image_id", "y", "_k"]).drop("_k")


#: Columns of a cell in which runs of neighbouring rows meet.
RUN_CELL = 64


def touching_runs(runs: DataFrame, reach: int) -> DataFrame:
    """(a, b): ``rid`` of the runs (image_id, y, x0, x1, rid) that touch one of the next row, with ``reach`` 1 also at
    corners. Both are dealt to the cells that they meet; a pair counts in the first that both meet."""
    cell = lambda c: F.floor(c / RUN_CELL)
    cells = lambda r: F.explode(F.sequence(cell(F.col("x0") - r), cell(F.col("x1") + r)))
    upper = runs.select("image_id", (F.col("y") + 1).alias("y"), F.col("x0").alias("ax0"), F.col("x1").alias("ax1"), F.col("rid").alias("a"), cells(reach).alias("cell"))
    lower = runs.select("image_id", "y", "x0", "x1", F.col("rid").alias("b"), cells(0).alias("cell"))
    touch = (F.col("x0") <= F.col("ax1") + reach) & (F.col("x1") >= F.col("ax0") - reach)
    first = F.col("cell") == cell(F.greatest(F.col("ax0") - reach, F.col("x0")))
    return upper.join(lower, ["image_id", "y", "cell"]).where(touch & first).select("a", "b")


def single_linkage(points: DataFrame, pairs: DataFrame) -> DataFrame:
    """``points`` with ``group_id``: the least id of the points of its image that chains of ``pairs`` (a, b) reach."""
    image = images(points, pairs)
    node = lambda c: F.struct(*image, F.col(c).alias("id"))
    roots = component_roots(pairs.select(node("a").alias("a"), node("b").alias("b")))
    roots = roots.select("id.*", F.col("label.id").alias("group_id"))
    return points.join(roots, [*image, "id"], "left").withColumn("group_id", F.coalesce("group_id", "id"))

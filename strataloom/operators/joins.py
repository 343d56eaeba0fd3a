"""Range, box and nearest-neighbour joins, rewritten as equi-joins on grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import axis_gap
from .scratch import cut


def images(*frames: DataFrame) -> list[str]:
    """``["image_id"]`` where all tables tell their images apart, which is then part of every key."""
    return ["image_id"] if all("image_id" in f.columns for f in frames) else []


def _around() -> Column:
    return F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])


def proximity_pairs(points: DataFrame, width: float, height: float) -> DataFrame:
    """Pairs (a < b) of points (id, x, y) of one image with |dx| <= width and |dy| <= height. A point meets the
    9 cells around its own, so the join is hashed on cells."""
    image = images(points)
    cell = lambda c, size: F.floor(F.col(c) / size)
    p = points.select(*image, "id", "x", "y", cell("x", width).alias("cx"), cell("y", height).alias("cy"))
    q = p.select(*image, F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), "cx", "cy", F.explode(_around()).alias("o"))
    q = q.select(*image, "b", "bx", "by", (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"))
    j = p.join(q, [*image, "cx", "cy"]).where((F.col("id") < F.col("b")) & (F.abs(F.col("x") - F.col("bx")) <= width) & (F.abs(F.col("y") - F.col("by")) <= height))
    return j.select(*image, F.col("id").alias("a"), "b")


#: Slices of a cell's width in which the points of two cells that meet at a corner are compared.
SLICES = 256


def proximity_links(points: DataFrame, width: float, height: float) -> DataFrame:
    """Links (a, b) of points (id, x, y) of one image that join exactly the chains of ``proximity_pairs``, but at most one for
    each point and twelve for each cell, however dense the points are. Points without finite coordinates have none.

    Points of one cell are within reach of each other, and are linked with the least id there. Two cells in a row or
    column are linked if the gap between their points is small enough; cells that meet at a corner if one point of
    the first lies far enough to both sides of one of the other, found by running maxima over slices."""
    image = images(points)
    real = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    shrink = 1 - 1e-9  # so that rounding puts no two points out of reach into one cell
    xy = points.select(*image, "id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where(real("x") & real("y"))
    p = cut(xy.withColumns({"cx": F.floor(F.col("x") / (width * shrink)), "cy": F.floor(F.col("y") / (height * shrink))}))
    key = [*image, "cx", "cy"]
    cells = cut(p.groupBy(*key).agg(F.min("id").alias("rep"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")))
    stars = p.join(cells.select(*key, "rep"), key).where("id <> rep").select(*image, F.col("rep").alias("a"), F.col("id").alias("b"))
    ahead = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(3) for j in range(-2, 3) if i or j > 0])
    q = cells.select(*image, (F.struct(*["cx", "cy", "rep", "x0", "x1", "y0", "y1"])).alias("f"), F.explode(ahead).alias("o"))
    q = q.select(*image, "f", "o", (F.col("f.cx") + F.col("o.i")).alias("cx"), (F.col("f.cy") + F.col("o.j")).alias("cy"))
    j = q.join(cells, key)
    beside = (F.when(F.col("o.i") == 0, True).otherwise(F.col("x0") - F.col("f.x1") <= width)) & F.when(F.col("o.j") == 0, True).when(F.col("o.j") > 0, F.col("y0") - F.col("f.y1") <= height).otherwise(F.col("f.y0") - F.col("y1") <= height)
    near = cut(j.where(beside).select(*image, "f", "o", "cx", "cy", "rep"))
    straight = near.where("o.i = 0 or o.j = 0")
    # cells at a corner: their points, the second ones moved back by the reach, upside down where the second cell lies below
    corner = near.where("o.i <> 0 and o.j <> 0")
    pair = [*image, "fx", "fy", "cx", "cy"]
    corner = corner.select(*image, F.col("f.cx").alias("fx"), F.col("f.cy").alias("fy"), "cx", "cy", F.signum(F.col("o.j")).alias("s"), F.col("f.rep").alias("a"), F.col("rep").alias("b"))
    first = p.select(*image, F.col("cx").alias("fx"), F.col("cy").alias("fy"), "x", "y").join(corner.select(*pair, "s"), [*image, "fx", "fy"])
    first = first.groupBy(*pair, F.col("x").alias("t")).agg(F.max(F.col("y") * F.col("s")).alias("v"))
    second = p.select(*key, "x", "y").join(corner.select(*pair, "s"), key).groupBy(*pair, (F.col("x") - width).alias("t")).agg(F.min(F.col("y") * F.col("s") - height).alias("v"))
    both = first.withColumn("kind", F.lit(0)).unionByName(second.withColumn("kind", F.lit(1))).withColumn("slice", F.floor(F.col("t") / (width / SLICES)))
    mine = F.when(F.col("kind") == 0, F.col("v"))
    in_slice = Window.partitionBy(*pair, "slice").orderBy(F.desc("t"), "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = both.withColumn("m", F.max(mine).over(in_slice))
    hit = here.where("kind = 1 and v <= m").select(*pair)
    tops = both.groupBy(*pair, "slice").agg(F.max(mine).alias("m"), F.min(F.when(F.col("kind") == 1, F.col("v"))).alias("v"))
    beyond = Window.partitionBy(*pair).orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    hit = hit.unionByName(tops.withColumn("m", F.max("m").over(beyond)).where("v <= m").select(*pair)).distinct()
    crossed = corner.join(hit, pair, "left_semi").select(*image, "a", "b")
    return stars.unionByName(straight.select(*image, F.col("f.rep").alias("a"), F.col("rep").alias("b"))).unionByName(crossed)


def _in_cells(boxes: DataFrame, gap_x: float, gap_y: float, slack: float = 0.0) -> DataFrame:
    """Boxes dealt to the cells (_level, cx, cy) that they meet when grown by half the gaps. Cells come in sizes that double;
    a box has those of the first size that is no less than it (_own), where it meets four at most, and of the
    greater sizes that other boxes have. Two near boxes meet in the size of the greater one."""
    size = boxes.agg(F.avg(F.col("max_x") - F.col("min_x")), F.avg(F.col("max_y") - F.col("min_y"))).first()
    cw, ch = (max(1e-9, (s or 0) + g) for s, g in zip(size, (gap_x, gap_y), strict=True))
    ratio = F.greatest((F.col("max_x") - F.col("min_x") + gap_x) / cw, (F.col("max_y") - F.col("min_y") + gap_y) / ch, F.lit(1.0))
    b = boxes.withColumn("_own", F.ceil(F.log2(ratio)).cast("int"))
    levels = F.array(*[F.lit(r[0]) for r in b.select("_own").where("_own IS NOT NULL").distinct().orderBy("_own").collect()] or [F.lit(0)])  # no more than doublings of one number
    b = b.withColumn("_level", F.explode(F.filter(levels, lambda v: v >= F.col("_own"))))
    grown = lambda c, g, side: F.col(c) + side * g / 2 + (side * slack * (F.abs(c) + g) if slack else 0)
    cell = lambda c, g, s, side: F.floor(grown(c, g, side) / (F.lit(s) * F.pow(F.lit(2.0), F.col("_level"))))
    b = b.withColumns({"_x0": cell("min_x", gap_x, cw, -1), "_x1": cell("max_x", gap_x, cw, 1), "_y0": cell("min_y", gap_y, ch, -1), "_y1": cell("max_y", gap_y, ch, 1)})
    return b.withColumn("cx", F.explode(F.sequence("_x0", "_x1"))).withColumn("cy", F.explode(F.sequence("_y0", "_y1")))


def _near(a: str, b: str, gap_x: float, gap_y: float, dz: float | None) -> Column:
    """Whether the boxes of the tables ``a`` and ``b`` lie within the limits."""
    c = lambda t, n: F.col(f"{t}.{n}")
    ok = axis_gap(c(a, "min_x"), c(a, "max_x"), c(b, "min_x"), c(b, "max_x")) <= gap_x
    ok &= axis_gap(c(a, "min_y"), c(a, "max_y"), c(b, "min_y"), c(b, "max_y")) <= gap_y
    return ok if dz is None else ok & (F.abs(c(a, "z") - c(b, "z")) <= dz)


def box_gap_pairs(boxes: DataFrame, gap_x: float, gap_y: float, dz: float | None = None) -> DataFrame:
    """Pairs (a < b) of boxes (id, min_x, max_x, min_y, max_y, z) of one image whose gaps on both axes, and difference in
    z, stay within the limits, met in cells. A pair is tested in the first cell that both meet."""
    b = _in_cells(boxes, gap_x, gap_y)
    r, s = b.alias("r"), b.alias("s")
    c = lambda t, n: F.col(f"{t}.{n}")
    image = images(boxes)
    ok = F.lit(True)
    for name in (*image, "_level", "cx", "cy"):
        ok &= c("r", name) == c("s", name)
    ok &= (c("r", "id") < c("s", "id")) & (F.greatest(c("r", "_own"), c("s", "_own")) == c("r", "_level"))
    ok &= (F.greatest(c("r", "_x0"), c("s", "_x0")) == c("r", "cx")) & (F.greatest(c("r", "_y0"), c("s", "_y0")) == c("r", "cy"))
    ok &= _near("r", "s", gap_x, gap_y, dz)
    return r.join(s, ok).select(*[c("r", name) for name in image], c("r", "id").alias("a"), c("s", "id").alias("b"))


#: Boxes of a cell beyond which they are linked as one, without a look at their gaps.
CROWD = 32


def box_gap_links(boxes: DataFrame, gap_x: float, gap_y: float, dz: float, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) whose chains hold those of ``box_gap_pairs`` whole, in rows linear in the boxes: those pairs in cells of at
    most ``crowd`` boxes, and in others a link of each box with the least id, even if it lies just beyond the limits. So
    chains may come out longer where boxes are dense, never shorter. Boxes with a side or z that is not finite have none."""
    image, tall = images(boxes), max(dz, 1e-9)
    key = [*image, "_level", "cx", "cy", "cz"]
    b = boxes.select(*image, "id", *[F.col(c).cast("double").alias(c) for c in ("min_x", "max_x", "min_y", "max_y", "z")])
    for c in ("min_x", "max_x", "min_y", "max_y", "z"):
        b = b.where(F.abs(c) < float("inf"))  # NaN is greater
    reach = (F.abs("z") + dz) * 1e-9 + dz / 2
    deep = F.sequence(F.floor((F.col("z") - reach) / tall), F.floor((F.col("z") + reach) / tall)) if dz > 0 else F.array("z")
    b = cut(_in_cells(b, gap_x, gap_y, 1e-9).withColumn("cz", F.explode(deep)))
    cells = cut(b.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("_rep")).where("_n > 1"))
    few = b.join(cells.where(F.col("_n") <= crowd).select(*key), key, "left_semi")
    r, s = few.alias("r"), few.alias("s")
    meet = (F.col("r.id") < F.col("s.id")) & _near("r", "s", gap_x, gap_y, dz)
    for name in key:
        meet &= F.col(f"r.{name}") == F.col(f"s.{name}")
    pairs = r.join(s, meet).select(*[F.col(f"r.{name}") for name in image], F.col("r.id").alias("a"), F.col("s.id").alias("b"))
    stars = b.join(cells.where(F.col("_n") > crowd).select(*key, "_rep"), key).where("id <> _rep").select(*image, F.col("_rep").alias("a"), F.col("id").alias("b"))
    return pairs.unionByName(stars).distinct()


#: Times that the cells of the first round of nearest neighbours are divided by four, at most.
FINER = 12


def knn_mean_distance(points: DataFrame, k: int = 3, cell: float | None = None) -> DataFrame:
    """(id, nn): mean distance to the k nearest other points (id, x, y) of its image, or to all where there are
    fewer; infinite for a lone point, and for one without finite coordinates, which is no one's neighbour.

    Equal points are one place with a count. A round joins each cell of open places with the cells around it, as arrays
    of places. A place is settled once the k-th distance is within what those cells cover; the others go on with cells four
    times as large, until one cell holds an image."""
    image = images(points)
    real = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    xy = points.select(*image, "id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    places = xy.where(real("x") & real("y")).groupBy(*image, "x", "y").agg(F.count(F.lit(1)).alias("here"))
    sizes = places.groupBy(*image).agg(F.sum("here").alias("_n"), F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.min("y").alias("_y0"), F.max("y").alias("_y1"))
    lone = F.lit(float("inf"))
    total, most, dx, dy = sizes.agg(F.sum("_n"), F.max("_n"), F.max(F.col("_x1") - F.col("_x0")), F.max(F.col("_y1") - F.col("_y0"))).first()
    if not total or most < 2:
        return xy.select(*image, "id", lone.alias("nn"))
    start = cell or max((dx * dy / most * (k + 1)) ** 0.5, max(dx, dy) / most, 1e-9)
    want = F.least(F.lit(k), F.col("_n") - 1)
    n_of = sizes.select(*image, "_n")
    places = cut(places.join(n_of, image).where("_n > 1") if image else places.withColumn("_n", F.lit(most)))
    if cell is None:  # finer where places are dense: as many as share a place's cell, on average
        for _ in range(FINER):
            n = places.groupBy(*image, F.floor(F.col("x") / start), F.floor(F.col("y") / start)).count().agg(F.sum(F.col("count") * F.col("count").cast("double")) / F.sum("count")).first()[0]
            if n <= 8 * (k + 1) or start / 4 < 1e-9:
                break
            start /= 4
    cell = start
    open_, done = places, None
    key = [*image, "cx", "cy"]
    while True:
        by_cell = lambda t, n, name, s=cell: t.groupBy(*image, F.floor(F.col("x") / s).alias("cx"), F.floor(F.col("y") / s).alias("cy")).agg(F.collect_list(F.struct("x", "y", n)).alias(name))
        p, q = by_cell(places, "here", "points"), by_cell(open_, "_n", "asking")
        o = q.select(*key, F.explode(_around()).alias("o")).select(*image, F.col("cx").alias("qx"), F.col("cy").alias("qy"), (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"))
        near = o.join(p, key).groupBy(*image, F.col("qx").alias("cx"), F.col("qy").alias("cy")).agg(F.flatten(F.collect_list("points")).alias("near"))

        def nearest(a: Column) -> Column:
            # a place counts as often as it has points, up to k, but for the point itself
            own = lambda b: ((a["x"] == b["x"]) & (a["y"] == b["y"])).cast("int")
            d = lambda b: F.array_repeat(F.hypot(a["x"] - b["x"], a["y"] - b["y"]), F.least(b["here"] - own(b), F.lit(k)).cast("int"))
            return F.struct(a["x"].alias("x"), a["y"].alias("y"), F.slice(F.sort_array(F.flatten(F.transform("near", d))), 1, F.least(F.lit(k), a["_n"] - 1).cast("int")).alias("d"))

        # a cell's pairs never become rows
        got = q.join(near, key).select(*image, F.explode(F.transform("asking", nearest)).alias("r")).select(*image, "r.x", "r.y", "r.d").where(F.size("d") > 0)
        got = got.select(*image, "x", "y", F.size("d").cast("long").alias("n"), F.array_max("d").alias("far"), (F.aggregate("d", F.lit(0.0), lambda t, v: t + v) / F.size("d")).alias("nn"))
        got = cut(open_.join(got, [*image, "x", "y"], "left"))
        # a point sees all within one cell size of itself
        settled = (F.col("n") == want) & (F.col("far") <= cell)
        now = got.where(settled).select(*image, "x", "y", "nn")
        done = now if done is None else done.union(now)
        open_ = got.where(~F.coalesce(settled, F.lit(False))).select(*image, "x", "y", "here", "_n")
        if not open_.limit(1).count():
            break
        cell *= 4
    return xy.join(done, [*image, "x", "y"], "left").select(*image, "id", F.coalesce("nn", lone).alias("nn"))

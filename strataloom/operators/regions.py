"""Pixels in polygons and rectangles, tile coverage and region summaries."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Tile, tiles_for_span
from .joins import images

CELL = 16


def edges(vertices: DataFrame) -> DataFrame:
    """Edges (id, x1, y1, x2, y2) of rings given as (id, k, x, y), k from 0: each vertex with the one before
    it, the first with the last."""
    key = [*images(vertices), "id"]
    n = vertices.groupBy(*key).agg(F.max("k").alias("last"))
    v = vertices.join(n, key)
    prev = vertices.select(*key, F.col("k").alias("pk"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    v = v.withColumn("pk", F.when(F.col("k") == 0, F.col("last")).otherwise(F.col("k") - 1))
    return v.join(prev, [*key, "pk"]).select(*key, "x1", "y1", F.col("x").alias("x2"), F.col("y").alias("y2"))


def row_spans(vertices: DataFrame, variant: str = "incl") -> DataFrame:
    """(id, y, x0, x1): the runs of whole pixels that each polygon has in each row; ``incl`` and ``open`` may give
    overlapping runs, ``edge`` tells those that lie on an edge.

    An edge gives one crossing to each row that it passes; sorted, the crossings of a row enclose its runs. So
    the work goes with the rows of the outline, not with the pixels inside."""
    key = [*images(vertices), "id"]
    e = edges(vertices).withColumnsRenamed({"x1": "ax", "y1": "ay", "x2": "bx", "y2": "by"})
    ax, ay, bx, by, y = (F.col(c) for c in ("ax", "ay", "bx", "by", "y"))
    lo, hi = F.ceil(F.least(ay, by)), F.floor(F.greatest(ay, by))
    rows = e.where(lo <= hi).withColumn("y", F.explode(F.sequence(lo, hi)))
    at = (bx - ax) * (y - ay) / F.when(by != ay, by - ay) + ax
    crossing = rows.where((ay > y) != (by > y)).groupBy(*key, "y").agg(F.sort_array(F.collect_list(at)).alias("c"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("c") - 1, F.lit(2)), lambda i: F.struct(F.ceil(F.get("c", i)).alias("x0"), (F.ceil(F.get("c", i + 1)) - 1).alias("x1")))
    inside = crossing.select(*key, "y", F.explode(pairs).alias("s")).select(*key, "y", "s.x0", "s.x1").where("x0 <= x1").withColumn("edge", F.lit(False))
    if variant == "scan":
        return inside
    flat = rows.where(ay == by).select(*key, "y", F.ceil(F.least(ax, bx) - 1e-9).alias("x0"), F.floor(F.greatest(ax, bx) + 1e-9).alias("x1"))
    near = F.round(at)
    turn = (bx - ax) * (y - ay) - (by - ay) * (near - ax)
    dots = rows.where((ay != by) & (F.abs(turn) <= 1e-9) & near.between(F.least(ax, bx) - 1e-9, F.greatest(ax, bx) + 1e-9)).select(*key, "y", near.cast("long").alias("x0"), near.cast("long").alias("x1"))
    return inside.unionByName(flat.unionByName(dots).where("x0 <= x1").withColumn("edge", F.lit(True)))


def pixels_in_polygons(pixels: DataFrame, vertices: DataFrame, variant: str = "incl") -> DataFrame:
    """(id, y, x) of the pixels in each polygon of their image, in pixel coordinates: ``incl`` with, ``open``
    without those on an edge, ``scan`` by half-open scanlines. The polygons' runs of pixels by row are dealt
    to cells of a row and meet the pixels by cell."""
    if variant not in ("incl", "open", "scan"):
        raise ValueError(f"unknown variant {variant!r}")
    image = images(pixels, vertices)
    cell = lambda c: F.floor(F.col(c) / CELL)
    v = vertices if image else vertices.drop("image_id")
    spans = row_spans(v, variant).withColumn("cx", F.explode(F.sequence(cell("x0"), cell("x1"))))
    p = pixels.select(*image, F.col("y").cast("long").alias("y"), F.col("x").alias("x"), cell("x").alias("cx"), F.col("y").alias("_y"))
    j = p.join(spans, [*image, "y", "cx"]).where(F.col("x").between(F.col("x0"), F.col("x1")))
    g = j.groupBy(*image, "id", F.col("_y").alias("y"), "x").agg(F.bool_or("edge").alias("on"))
    return (g.where("not on") if variant == "open" else g).select(*image, "id", "y", "x")


def tile_lattice(boxes: DataFrame, tile: Tile) -> DataFrame:
    """Tiles (id, ordinal, center_x, center_y) that cover boxes (id, min_x, max_x, min_y, max_y): rows outer,
    columns inner, centred on the box."""
    key = [*images(boxes), "id"]
    b = boxes.select(*key, ((F.col("min_x") + F.col("max_x")) / 2).alias("mx"), ((F.col("min_y") + F.col("max_y")) / 2).alias("my"), tiles_for_span(F.col("max_x") - F.col("min_x"), tile.width, tile.step_x).alias("nx"), tiles_for_span(F.col("max_y") - F.col("min_y"), tile.height, tile.step_y).alias("ny"))
    b = b.withColumn("iy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ny") - 1))).withColumn("ix", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nx") - 1)))
    return b.select(*key, (F.col("iy") * F.col("nx") + F.col("ix") + 1).alias("ordinal"), (F.col("mx") + (F.col("ix") - (F.col("nx") - 1) / 2) * tile.step_x).alias("center_x"), (F.col("my") + (F.col("iy") - (F.col("ny") - 1) / 2) * tile.step_y).alias("center_y"))


def rectangles_over(boxes: DataFrame, tile: Tile) -> DataFrame:
    """Scan rectangles covering boxes: tile + (n - 1) * step on each axis, and their tile counts."""
    nx, ny = (tiles_for_span(F.col(f"max_{a}") - F.col(f"min_{a}"), t, s) for a, t, s in (("x", tile.width, tile.step_x), ("y", tile.height, tile.step_y)))
    return boxes.select(*images(boxes), "id", ((F.col("min_x") + F.col("max_x")) / 2).alias("center_x"), ((F.col("min_y") + F.col("max_y")) / 2).alias("center_y"), ((nx - 1) * tile.step_x + tile.width).alias("width"), ((ny - 1) * tile.step_y + tile.height).alias("height"), (nx * ny).alias("tiles"))


class Extent(NamedTuple):
    """Width and height of tiles, as columns where they differ."""

    width: float | Column
    height: float | Column


def tile_coverage(pixels: DataFrame, tiles: DataFrame, tile: Tile | Extent) -> DataFrame:
    """Pixels in tiles of their image: (id, ordinal, y, x) for tiles in pixel units whose window [floor(min), ceil(max)],
    both ends in, holds the pixel. Tiles are dealt to the cells they meet."""
    cell = lambda c: F.floor(c / CELL)
    image = images(pixels, tiles)
    t = tiles.select(*image, "id", "ordinal", F.floor(F.col("center_x") - tile.width / 2).alias("x0"), F.ceil(F.col("center_x") + tile.width / 2).alias("x1"), F.floor(F.col("center_y") - tile.height / 2).alias("y0"), F.ceil(F.col("center_y") + tile.height / 2).alias("y1"))
    t = t.withColumn("cx", F.explode(F.sequence(cell(F.col("x0")), cell(F.col("x1"))))).withColumn("cy", F.explode(F.sequence(cell(F.col("y0")), cell(F.col("y1")))))
    p = pixels.withColumns({"cx": cell(F.col("x")), "cy": cell(F.col("y"))})
    return p.join(t, [*image, "cx", "cy"]).where(F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))).drop("cx", "cy", "x0", "x1", "y0", "y1")


def tiles_touching(tiles: DataFrame, vertices: DataFrame, tile: Tile) -> DataFrame:
    """Tiles (id, ordinal, center_x, center_y) whose footprint touches their polygon: a corner inside it, a
    vertex inside the tile or crossing edges. A polygon that none touches gets one tile at its vertex mean.

    Edges are dealt to the cells of a tile's size that they pass, and each tile meets the edges of its own cells alone.
    Whether corners lie inside goes by the crossings of their height, counted in the order of x."""
    e = edges(vertices).withColumnsRenamed({"x1": "ax", "y1": "ay", "x2": "bx", "y2": "by"})
    hw, hh = tile.width / 2, tile.height / 2
    key = [*images(tiles, vertices), "id"]
    cx, cy, ax, ay, bx, by = (F.col(c) for c in ("center_x", "center_y", "ax", "ay", "bx", "by"))
    band = lambda y: F.floor(y / tile.height)
    by_band = e.select(*key, "ax", "ay", "bx", "by", F.explode(F.sequence(band(F.least(ay, by)), band(F.greatest(ay, by)))).alias("band"))

    corner = F.array(*[F.struct((cx + sx * hw).alias("x"), (cy + sy * hh).alias("y")) for sx, sy in ((-1, -1), (1, -1), (1, 1), (-1, 1))])
    corners = tiles.select(*key, "ordinal", F.explode(corner).alias("c")).select(*key, "ordinal", "c.x", "c.y")
    heights = corners.select(*key, "y").distinct().withColumn("band", band(F.col("y")))
    crossed = by_band.join(heights, [*key, "band"]).where((ay > F.col("y")) != (by > F.col("y")))
    crossed = crossed.select(*key, F.lit(None).cast(dict(tiles.dtypes)["ordinal"]).alias("ordinal"), ((bx - ax) * (F.col("y") - ay) / (by - ay) + ax).alias("x"), "y", F.lit(1).alias("_n"))
    right = Window.partitionBy(*key, "y").orderBy(F.desc("x"), "_n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = corners.withColumn("_n", F.lit(0)).unionByName(crossed).withColumn("_right", F.sum("_n").over(right))
    inside = counted.where("_n = 0 and _right % 2 = 1").select(*key, "ordinal").distinct()

    slack = 1e-6  # of a cell, so that rounding loses no contact; the test itself is exact
    column = lambda x: F.floor(x / tile.width)
    # the part of an edge that lies in its band
    at = lambda y: F.when(by == ay, ax).otherwise((bx - ax) * (F.greatest(F.least(y, F.greatest(ay, by)), F.least(ay, by)) - ay) / F.when(by != ay, by - ay) + ax)
    ends = [at(F.col("band") * tile.height), at((F.col("band") + 1) * tile.height), F.when(by == ay, bx)]
    span = [f(*[F.coalesce(x, ends[0]) for x in ends]) for f in (F.least, F.greatest)]
    placed = by_band.withColumn("column", F.explode(F.sequence(column(span[0] - slack * tile.width), column(span[1] + slack * tile.width))))
    grid = lambda c, half, size: F.explode(F.sequence(F.floor((c - half) / size - slack), F.floor((c + half) / size + slack)))
    met = tiles.select(*key, "ordinal", "center_x", "center_y", grid(cx, hw, tile.width).alias("column")).withColumn("band", grid(cy, hh, tile.height))
    within = (F.abs(ax - cx) <= hw + 1e-9) & (F.abs(ay - cy) <= hh + 1e-9)
    # an edge meets the tile if its box does and the corners lie on both sides of its line
    side = [(bx - ax) * (cy + sy * hh - ay) - (by - ay) * (cx + sx * hw - ax) for sx, sy in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
    meets = (F.least(ax, bx) <= cx + hw) & (F.greatest(ax, bx) >= cx - hw) & (F.least(ay, by) <= cy + hh) & (F.greatest(ay, by) >= cy - hh) & (F.least(*side) <= 0) & (F.greatest(*side) >= 0)
    touched = met.join(placed, [*key, "band", "column"]).where(within | meets).select(*key, "ordinal").distinct()

    hit = tiles.select(*key, "ordinal", "center_x", "center_y").join(inside.unionByName(touched).distinct(), [*key, "ordinal"], "left_semi")
    mean = vertices.groupBy(*key).agg(F.lit(1).cast("long").alias("ordinal"), F.avg("x").alias("center_x"), F.avg("y").alias("center_y"))
    return hit.unionByName(mean.join(hit.select(*key).distinct(), key, "left_anti"))


def z_histograms(region_pixels: DataFrame, n_planes: int, regions: DataFrame | None = None) -> DataFrame:
    """(id, z, n) for every region and plane, empty planes with 0, from (id, argmax_z). ``regions`` (id) adds those
    that have no pixel at all."""
    key = [*images(region_pixels, *([regions] if regions is not None else [])), "id"]
    n = region_pixels.where(F.col("argmax_z").between(0, n_planes - 1)).groupBy(*key, F.col("argmax_z").alias("z")).agg(F.count(F.lit(1)).alias("n"))
    every = (region_pixels if regions is None else regions).select(*key).distinct().withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(n_planes - 1))))
    return every.join(n, [*key, "z"], "left").select(*key, "z", F.coalesce("n", F.lit(0)).alias("n"))


def region_confidence(regions: DataFrame, inside: DataFrame, mask: DataFrame) -> DataFrame:
    """Regions with area_px (pixels inside), supported_px (of these, masked with a finite probability), their
    share, and mean, least, total and weighted probability: NaN, NaN, 0, NaN where nothing is supported.
    Regions and pixels are those of one image where all three tables tell images apart."""
    image = images(regions, inside, mask)
    key = [*image, "id"]
    m = mask.where(~F.isnan("prob") & (F.abs("prob") != float("inf"))).select(*image, "y", "x", "prob")
    g = inside.join(m, [*image, "y", "x"], "left").groupBy(*key).agg(F.count(F.lit(1)).alias("area_px"), F.count("prob").alias("supported_px"), F.avg("prob").alias("mean"), F.min("prob").alias("least"), F.sum("prob").alias("total"))
    nan = F.lit(float("nan"))
    out = regions.select(*key).join(g, key, "left")
    n = F.coalesce("supported_px", F.lit(0))
    area = F.coalesce("area_px", F.lit(0))
    return out.select(*key, area.alias("area_px"), n.alias("supported_px"), F.when(area > 0, n / area).otherwise(0.0).alias("share"), F.coalesce("mean", nan).alias("mean"), F.coalesce("least", nan).alias("least"), F.coalesce("total", F.lit(0.0)).alias("total"), F.when(n > 0, F.col("mean") * F.sqrt(n.cast("double"))).otherwise(nan).alias("weighted"))


def finite_polygons(vertices: DataFrame) -> DataFrame:
    """The rings (id, k, x, y) that can be scanned: three different vertices at least, all finite."""
    key = [*images(vertices), "id"]
    real = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    ok = vertices.groupBy(*key).agg(F.bool_and(real("x") & real("y")).alias("_ok"), F.count_distinct("x", "y").alias("_n"))
    return vertices.join(ok.where("_ok and _n >= 3").select(*key), key, "left_semi")

"""Previews of target tables: the tiles that each target takes, totals, and the extent of a drawing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Tile
from ..operators import regions
from ..operators.joins import images


def tiles(targets: DataFrame, tile: Tile) -> DataFrame:
    """(kind, ordinal, tile, center_x, center_y): one tile for a point, the lattice of a rectangle, and of a
    polygon's lattice the tiles that touch it, or one at its vertex mean. ``tile`` counts from 1 and keeps
    the lattice's numbers."""
    image = images(targets)
    named = lambda d, kind: d.select(*image, F.lit(kind).alias("kind"), F.col("id").alias("ordinal"), F.col("ordinal").alias("tile"), "center_x", "center_y")
    t = targets.withColumnRenamed("ordinal", "id")
    points = t.where("kind = 'point'").select(*image, "kind", F.col("id").alias("ordinal"), F.lit(1).cast("long").alias("tile"), F.col("x").alias("center_x"), F.col("y").alias("center_y"))
    sides = [(F.col(c) + k * F.col(n) / 2).alias(f"{m}_{c}") for c, n in (("x", "width"), ("y", "height")) for m, k in (("min", -1), ("max", 1))]
    rectangles = regions.tile_lattice(t.where("kind = 'rectangle'").select(*image, "id", *sides), tile)
    v = t.where("kind = 'polygon'").select(*image, "id", F.posexplode("vertices").alias("k", "v")).select(*image, "id", "k", "v.x", "v.y")
    box = v.groupBy(*image, "id").agg(*[f(c).alias(f"{m}_{c}") for c in ("x", "y") for m, f in (("min", F.min), ("max", F.max))])
    polygons = regions.tiles_touching(regions.tile_lattice(box, tile), v, tile)
    return points.unionByName(named(rectangles, "rectangle")).unionByName(named(polygons, "polygon"))


def totals(targets: DataFrame, tile: Tile) -> DataFrame:
    """Targets and tiles by kind of target; a kind without targets has no row."""
    n = tiles(targets, tile).groupBy("kind").agg(F.count_distinct(*images(targets), "ordinal").alias("targets"), F.count(F.lit(1)).alias("tiles"))
    return n.select("kind", "targets", "tiles")


def extent(preview: DataFrame, tile: Tile, margin: float = 0.75) -> DataFrame:
    """Box of all tile centres, widened by ``margin`` tiles: one row, nulls without tiles."""
    out = []
    for c, size in (("x", tile.width), ("y", tile.height)):
        out += [(F.min(f"center_{c}") - margin * size).alias(f"min_{c}"), (F.max(f"center_{c}") + margin * size).alias(f"max_{c}")]
    return preview.agg(*out)

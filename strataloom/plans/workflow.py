"""From images to plans: what a run needs is checked first, then each image is detected and planned."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Affine, Tile
from .compose import Planning, plan_targets
from .detectors import Context, Detector


def check(p: Planning, context: Context) -> None:
    """Refuses a run before its work: a mode that needs z takes the planes of the pixels and their positions."""
    if p.mode.needs_z and (context.argmax_z is None or context.z_positions is None):
        raise ValueError("this planning mode needs z planes and their positions")
    if min(context.height, context.width) <= 0 or min(context.px_x, context.px_y) <= 0:
        raise ValueError("images and pixels must have a size")


def z_scale(positions: DataFrame) -> tuple[float, float]:
    """(z of plane 0, step) of positions (z, z_um)."""
    rows = positions.agg(F.min("z").alias("a"), F.max("z").alias("b"), F.min_by("z_um", "z").alias("ua"), F.max_by("z_um", "z").alias("ub")).first()
    step = (rows["ub"] - rows["ua"]) / (rows["b"] - rows["a"]) if rows["b"] > rows["a"] else 0.0
    return rows["ua"] - rows["a"] * step, step


def run(pixels: DataFrame, detector: Detector, context: Context, tr: Affine, tile: Tile, p: Planning, z_um: float = 0.0) -> DataFrame:
    """The plan (image_id and target columns) of all images in ``pixels`` (image_id, y, x, v): detect, then plan. Modes
    without z put all targets at ``z_um``."""
    check(p, context)
    found = detector.detect(pixels, context)
    classes = found.planning_classes
    z0, step = (z_um, 0.0)
    if p.mode.needs_z:
        z0, step = z_scale(context.z_positions)
        classes = classes.join(context.argmax_z.select("image_id", "y", "x", "argmax_z"), ["image_id", "y", "x"], "left")
    else:
        classes = classes.withColumn("argmax_z", F.lit(-1))
    labels = found.labels.join(classes.select("image_id", "y", "x", "argmax_z", "cls"), ["image_id", "y", "x"])
    return plan_targets(labels, classes, tr, tile, p, z0, step)


def distinct_files(paths: DataFrame) -> DataFrame:
    """(ordinal, path) of a list of files without repetitions: the first place of each stays."""
    w = Window.partitionBy("path").orderBy("ordinal")
    return paths.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")

"""Streaming forms of the fold over planes and of histograms, as an extension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_projection(voxels: DataFrame) -> DataFrame:
    """Maximum and its least plane by pixel over a stream of voxels (image_id, z, y, x, v): update or
    complete mode; the state is one row for each pixel."""
    best = F.min(F.struct((-F.col("v")).alias("n"), "z", "v")).alias("b")
    return voxels.groupBy("image_id", "y", "x").agg(best).select("image_id", "y", "x", F.col("b.v").alias("v"), F.col("b.z").alias("argmax_z"))


def windowed_histogram(events: DataFrame, lo: float, hi: float, bins: int, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts of ``value`` by event-time window and bin, with a watermark for late rows."""
    b = F.least(F.floor((F.col("value") - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("int")
    ok = events.where(F.col("value").between(lo, hi)).withWatermark("ts", late)
    return ok.groupBy(F.window("ts", window).alias("w"), b.alias("bin")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "bin", "n")

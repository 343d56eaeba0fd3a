"""Masks, labels and probabilities as pixel tables for files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mask_rows(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """(image_id, y, x, v) of all ``pixels``: 255 where the ``mask`` has them, else 0."""
    on = mask.select("image_id", "y", "x", F.lit(255).alias("_v")).distinct()
    return pixels.select("image_id", "y", "x").join(on, ["image_id", "y", "x"], "left").select("image_id", "y", "x", F.coalesce("_v", F.lit(0)).cast("short").alias("v"))


def label_rows(labels: DataFrame) -> DataFrame:
    """(image_id, y, x, v): labels as whole numbers."""
    return labels.select("image_id", "y", "x", F.col("label").cast("long").alias("v"))


def probability_rows(classes: DataFrame) -> DataFrame:
    """(image_id, y, x, v): probabilities in single precision."""
    return classes.select("image_id", "y", "x", F.col("prob").cast("float").alias("v"))


def write_rows(rows: DataFrame | None, path: str) -> bool:
    """Writes a table as Parquet by image; nothing where there is none. Whether it was written."""
    if rows is None:
        return False
    rows.write.mode("overwrite").partitionBy("image_id").parquet(path)
    return True

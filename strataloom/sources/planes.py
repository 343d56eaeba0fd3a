"""Planes of image files: choice by scene, channel and time, and lookup of their metadata."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import raster
from .voxels import PlaneSource


def choose(voxels: DataFrame, scene: int | str = 0, channel: int = 0, time: int = 0) -> DataFrame:
    """Voxels of one channel and time of a scene, given by its number or name, without these columns. Tables that lack
    one of the columns have that one value alone."""
    want = {"scene_name" if isinstance(scene, str) else "scene": scene, "channel": channel, "time": time}
    for name, value in want.items():
        if name in voxels.columns:
            voxels = voxels.where(F.col(name) == value)
    return voxels.drop("scene", "scene_name", "channel", "time")


def lookup(planes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (image_id, c, z, t) with the metadata of each plane from ``planes`` (image_id, ordinal, c, z, t, ...), or
    else that of the image's first plane by ordinal; ``exact`` tells which. Images without planes give nulls."""
    key = ["image_id", "c", "z", "t"]
    rest = [n for n in planes.columns if n not in key]
    own = planes.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy("ordinal"))).where("_r = 1").select(*key, F.struct(*rest).alias("_own"))
    first = planes.groupBy("image_id").agg(F.min(F.struct("ordinal", *[n for n in rest if n != "ordinal"])).alias("_f"))
    first = first.select("image_id", F.struct(*[F.col(f"_f.{n}").alias(n) for n in rest]).alias("_first"))
    j = wanted.join(own, key, "left").join(first, "image_id", "left").withColumn("exact", F.col("_own").isNotNull())
    return j.withColumn("_m", F.coalesce("_own", "_first")).select(*wanted.columns, "exact", "_m.*")


def read_planes(spark: SparkSession, paths: list[str], scene: int | None = None, channel: int = 0, time: int = 0, z: int | None = None) -> DataFrame:
    """Voxels (image_id, z, y, x, v) of one channel and time of image files, zeros too; of all scenes and planes, or of one.
    Planes that are not asked for are not opened."""
    spark.dataSource.register(PlaneSource)
    want = {"scene": scene, "channel": channel, "time": time, "z": z}
    r = spark.read.format("planes").option("paths", ",".join(paths))
    for k, v in want.items():
        r = r if v is None else r.option(k, str(v))
    return r.load().select("image_id", "z", "y", "x", "v")


def read_overview(spark: SparkSession, paths: list[str], scene: int | None = None, channel: int = 0, z: int = 0, time: int = 0, projection: str | None = None) -> DataFrame:
    """One image (image_id, y, x, v, ...) for each file: a plane, or the max or mean projection of all planes."""
    if projection is None:
        return read_planes(spark, paths, scene, channel, time, z).drop("z")
    return raster.project(read_planes(spark, paths, scene, channel, time), projection)


def project_resampled(voxels: DataFrame, n_planes: int, shape_in: tuple[int, int], shape_out: tuple[int, int]) -> DataFrame:
    """Greatest value and its plane (image_id, y, x, v, argmax_z) after each plane was resampled by itself, from dense planes
    of one shape."""
    kind = dict(voxels.dtypes)["image_id"]
    plane = voxels.select((F.col("image_id").cast("long") * n_planes + F.col("z")).alias("image_id"), "y", "x", "v")
    r = raster.resample_bilinear(plane, shape_in, shape_out)
    back = r.select(F.floor(F.col("image_id") / n_planes).cast(kind).alias("image_id"), (F.col("image_id") % n_planes).cast("int").alias("z"), "y", "x", "v")
    return raster.project_max(back)


def cached(spark: SparkSession, folder: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table of a key from a cache folder, or else made, written there and read back. A table counts once the note beside
    it is written, after all its rows; what a failed run left is replaced."""
    rows, note = f"{folder}/rows/{key}", f"{folder}/whole/{key}"
    try:
        if spark.read.schema("key string").parquet(note).where(F.col("key") == key).head(1):
            return spark.read.parquet(rows)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    table = make()
    table.write.mode("overwrite").parquet(rows)
    spark.createDataFrame([(key,)], "key string").write.mode("overwrite").parquet(note)
    return spark.read.schema(table.schema).parquet(rows)

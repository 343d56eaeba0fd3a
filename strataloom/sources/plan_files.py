"""Plans as JSON and CSV files, and names of files. Plans are small; voxels and pixels never pass here."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.joins import images
from ..plans import tables


#: The fields of the targets in a plan file, and the columns that they hold.
POINT = {"x_um": "x", "y_um": "y", "z_um": "z", "name": "name"}
RECTANGLE = {"center_x_um": "x", "center_y_um": "y", "z_um": "z", "width_um": "width", "height_um": "height", "name": "name"}
POLYGON = {"vertices_xy_um": "vertices", "z_um": "z", "name": "name"}
LISTS = {"point": ("point_positions", POINT), "rectangle": ("rectangular_regions", RECTANGLE), "polygon": ("polygon_regions", POLYGON)}
DOUBLE = "double"
KIND_DDL = {"name": "string", "vertices": "array<array<double>>"}


def to_json(targets: DataFrame, source_image: str, planning_mode: str, overview: dict | None = None, selected: int | None = None) -> DataFrame:
    """One row ``value``: a plan file with its lists of targets, nulls kept, in the order of ordinals."""
    keep = {"ignoreNullFields": "false"}
    lists = []
    for kind, (name, fields) in LISTS.items():
        value = lambda c: F.transform("vertices", lambda v: F.array(v["x"], v["y"])) if c == "vertices" else F.col(c)
        one = F.struct(*[value(c).alias(f) for f, c in fields.items()])
        of_kind = F.collect_list(F.when(F.col("kind") == kind, F.struct(F.col("ordinal").alias("o"), one.alias("t"))))
        lists.append(F.concat(F.lit(f"{json.dumps(name)}: "), F.to_json(F.transform(F.sort_array(of_kind), lambda x: x["t"]), keep)))
    head = f'{{"source_image": {json.dumps(source_image)}, "planning_mode": {json.dumps(planning_mode)}, '
    tail = f', "overview_metadata": {json.dumps(overview)}, "selected_object_count": {json.dumps(selected)}}}'
    return targets.agg(F.concat(F.lit(head), F.concat_ws(", ", *lists), F.lit(tail)).alias("value"))


def from_json(texts: DataFrame) -> DataFrame:
    """Targets of plan files (column ``value``); lists that are missing or null count as empty. Ordinals are places
    in the lists, from 1. Other columns of ``texts``, such as the file's name, stay."""
    others = [c for c in texts.columns if c != "value"]
    ddl = ", ".join(f"{name} array<struct<{','.join(f'{f}:{KIND_DDL.get(c, DOUBLE)}' for f, c in fields.items())}>>" for name, fields in LISTS.values())
    parsed = texts.select(*others, F.from_json("value", ddl).alias("p"))
    out = None
    for kind, (name, fields) in LISTS.items():
        t = parsed.select(*others, F.posexplode(f"p.{name}").alias("_n", "t"))
        at = lambda f: F.transform(F.col(f"t.{f}"), lambda v: F.struct(F.get(v, 0).alias("x"), F.get(v, 1).alias("y")))
        t = t.select(*others, F.lit(kind).alias("kind"), (F.col("_n") + 1).cast("long").alias("ordinal"), *[(at(f) if c == "vertices" else F.col(f"t.{f}")).alias(c) for f, c in fields.items()])
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out.select(*others, *tables.COLUMNS)


def header(texts: DataFrame) -> DataFrame:
    """What plan files (column ``value``) say besides targets: source_image, planning_mode, selected_object_count,
    and overview_metadata as JSON text, null where it is missing."""
    h = F.from_json("value", "source_image string, planning_mode string, selected_object_count long").alias("h")
    return texts.select(h, F.get_json_object("value", "$.overview_metadata").alias("overview_metadata")).select("h.*", "overview_metadata")


def cache_number(v: float | None, missing: str = "native") -> str:
    """A number in a cache key: six digits, with p for the point and m for minus."""
    return missing if v is None else f"{v:.6g}".replace(".", "p").replace("-", "m")


def cache_key(stem: str, scene: int, channel: int, time: int, source_px: float | None, target_px: float | None) -> str:
    return f"{stem}_s{scene}_c{channel}_t{time}_srcpx_{cache_number(source_px, 'auto')}_px{cache_number(target_px)}"


def output_prefix(stem: str, taken: set[str]) -> str:
    """A file stem of letters (of any script), digits, - and _, numbered from 2 to 9999 where it is taken; an error where
    all of these are. ``operators.naming`` numbers whole tables of stems."""
    base = re.sub(r"[^\w-]", "_", stem) or "output"
    free = (name for name in (base, *(f"{base}_{n}" for n in range(2, 10_000))) if name not in taken)
    if (name := next(free, None)) is None:
        raise ValueError(f"no name is free for {stem!r}")
    return name


def csv_rows(targets: DataFrame, kind: str) -> DataFrame:
    """The columns that a CSV of points, rectangles or polygons has."""
    t = targets.where(F.col("kind") == kind)
    if kind == "point":
        return t.select("name", F.col("x").alias("x_um"), F.col("y").alias("y_um"), F.col("z").alias("z_um"))
    if kind == "rectangle":
        return t.select("name", F.col("x").alias("center_x_um"), F.col("y").alias("center_y_um"), F.col("z").alias("z_um"), F.col("width").alias("width_um"), F.col("height").alias("height_um"))
    at = lambda f, c: f(F.transform("vertices", lambda v: v[c]))
    return t.select("name", F.col("z").alias("z_um"), F.size("vertices").alias("vertex_count"), at(F.array_min, "x").alias("min_x_um"), at(F.array_max, "x").alias("max_x_um"), at(F.array_min, "y").alias("min_y_um"), at(F.array_max, "y").alias("max_y_um"))


def object_rows(objects: DataFrame, positions: DataFrame) -> DataFrame:
    """The columns that a CSV of objects has: measurements with confidence and neighbours, and the positions
    (label, name, x, y, z) of the same labels."""
    key = [*images(objects, positions), "label"]
    o = objects.join(positions.select(*key, "name", "x", "y", "z"), key)
    renamed = {"x": "x_um", "y": "y_um", "z": "z_um", "area": "area_px", "elongation": "elongation", "axis_ratio": "axis_ratio", "nn": "mean_3nn_distance_um", "centroid_x": "centroid_x_px", "centroid_y": "centroid_y_px", "mean": "mean_positive_probability", "least": "min_positive_probability", "total": "positive_probability_sum", "weighted": "size_weighted_confidence", "label": "source_label"}
    return o.select("name", *[F.col(c).alias(n) for c, n in renamed.items()])


def confidence_rows(regions: DataFrame, kind: str) -> DataFrame:
    """The columns that a CSV of region confidence has, from named regions with their confidence."""
    renamed = {"area_px": "roi_area_px", "supported_px": "detected_area_px", "share": "detected_fraction", "mean": "mean_positive_probability", "least": "min_positive_probability", "total": "positive_probability_sum", "weighted": "size_weighted_confidence"}
    return regions.select(F.lit(kind).alias("target_type"), "name", *[F.col(c).alias(n) for c, n in renamed.items()])


def z_rows(histograms: DataFrame, regions: DataFrame, planes: DataFrame, kind: str) -> DataFrame:
    """The columns that a CSV of region z has, one row for each region and plane: histograms (id, z, n) with
    regions (id, name) and planes (z, z_um). The selected plane is the modal one, the least on ties; null
    in a region without pixels."""
    best = histograms.groupBy("id").agg(F.sum("n").alias("pixel_count"), F.min(F.when(F.col("n") > 0, F.struct((-F.col("n")).alias("m"), "z")))["z"].alias("selected_z_index"))
    chosen = best.join(planes.select(F.col("z").alias("selected_z_index"), F.col("z_um").alias("selected_z_um")), "selected_z_index", "left")
    out = histograms.join(chosen, "id").join(regions.select("id", "name"), "id").join(planes.select("z", "z_um"), "z", "left")
    return out.select(F.lit(kind).alias("region_type"), F.col("id").alias("region_index"), F.col("name").alias("region_name"), "selected_z_index", "selected_z_um", "pixel_count", F.col("z").alias("z_index"), "z_um", F.col("n").alias("count"))


def read_points_csv(spark: SparkSession, path: str) -> DataFrame:
    """Points from a CSV with a header x_um, y_um, z_um, numbered from 1 in the order of the file."""
    c = spark.read.schema("x_um double, y_um double, z_um double").option("header", True).csv(path)
    c = c.withColumn("_at", F.monotonically_increasing_id())
    n = F.row_number().over(Window.orderBy("_at")).cast("long")  # a plan's points: as many as one acquisition visits
    return tables.union([c.select(F.lit("point").alias("kind"), n.alias("ordinal"), F.col("x_um").alias("x"), F.col("y_um").alias("y"), F.col("z_um").alias("z"))])

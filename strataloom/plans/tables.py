"""Target tables: points, rectangles and polygons of plans in one table, with ids and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "kind string, ordinal long, name string, x double, y double, z double, width double, height double, vertices array<struct<x:double,y:double>>"
COLUMNS = [c.split()[0] for c in SCHEMA.replace("array<struct<x:double,y:double>>", "v").split(", ")]
KINDS = ("point", "rectangle", "polygon")


def union(parts: list[DataFrame]) -> DataFrame:
    """One target table of tables that may lack columns."""
    empty = parts[0].sparkSession.createDataFrame([], SCHEMA)
    out = empty
    for p in parts:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.select(*COLUMNS)


def kind_rank() -> Column:
    return F.when(F.col("kind") == "point", 0).when(F.col("kind") == "rectangle", 1).otherwise(2)


#: What targets without a name are called, in a document and in combined plans.
IN_DOCUMENT = {"point": "Position", "rectangle": "Tile scan", "polygon": "Mosaic"}
IN_COMBINED = {"point": "position", "rectangle": "tilescan", "polygon": "mosaic"}


def default_name(number: Column, plain: dict[str, str]) -> Column:
    """Given names, or the kind and number where they are missing or blank."""
    plain = F.concat(F.element_at(F.create_map(*[F.lit(x) for kv in plain.items() for x in kv]), F.col("kind")), F.lit(" "))
    return F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.concat(plain, number.cast("string")))


def combine(plans: list[tuple[str, DataFrame]]) -> DataFrame:
    """All targets of several plans, in order, with ``plan`` (from 1), an ordinal in plan and kind, and names
    that tell their source."""
    parts = [p.withColumn("plan", F.lit(i)).withColumn("plan_id", F.lit(name)) for i, (name, p) in enumerate(plans, 1)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    n = F.row_number().over(Window.partitionBy("plan", "kind").orderBy("ordinal")).cast("long")
    out = out.withColumn("ordinal", n)
    return out.withColumn("name", F.concat(F.lit("Source "), F.col("plan").cast("string"), F.lit(" - "), default_name(F.col("ordinal"), IN_COMBINED)))


def plan_key(targets: DataFrame) -> list[str]:
    """What tells plans apart in a table: the image, where it has one."""
    return ["image_id"] if "image_id" in targets.columns else []


def with_target_ids(targets: DataFrame) -> DataFrame:
    """Ids 1..N over points, then rectangles, then polygons of each plan. A plan holds what one acquisition can visit,
    so one task numbers it."""
    image = plan_key(targets)
    n = F.row_number().over(Window.partitionBy(*image).orderBy(kind_rank(), "ordinal")).cast("long")
    k = F.row_number().over(Window.partitionBy(*image, "kind").orderBy("ordinal"))
    return targets.withColumn("target_id", n).withColumn("name", default_name(k, IN_DOCUMENT))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def validation(targets: DataFrame) -> DataFrame:
    """One row for each plan: number of targets; whether ids are 1..N, all coordinates finite, rectangles of positive size,
    and polygons of three vertices at least."""
    is_polygon = F.col("kind") == "polygon"
    ok = finite(F.col("z")) & F.when(is_polygon, F.forall("vertices", lambda v: finite(v["x"]) & finite(v["y"]))).otherwise(finite(F.col("x")) & finite(F.col("y")))
    sized = F.when(F.col("kind") == "rectangle", (F.col("width") > 0) & (F.col("height") > 0)).otherwise(True)
    return targets.groupBy(*plan_key(targets)).agg(
        F.count(F.lit(1)).alias("targets"), ((F.count_distinct("target_id") == F.count(F.lit(1))) & (F.min("target_id") == 1) & (F.max("target_id") == F.count(F.lit(1)))).alias("ids_complete"),
        F.bool_and(ok).alias("finite"), F.bool_and(sized).alias("sized"), F.bool_and(F.when(is_polygon, F.size("vertices") >= 3).otherwise(True)).alias("closed_enough"),
    )


def check(targets: DataFrame) -> DataFrame:
    """``targets``, or an error that names what is wrong."""
    rules = ("ids_complete", "finite", "sized", "closed_enough")
    row = validation(targets).agg(*[F.bool_and(k).alias(k) for k in rules]).first()
    bad = [k for k in rules if row[k] is False]
    if bad:
        raise ValueError(f"targets fail: {', '.join(bad)}")
    return targets

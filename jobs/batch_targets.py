"""Batch job: from z-stacks of many overview images to stage targets, each image with its own metadata.

    python -m jobs.batch_targets --stacks .../lineitem.parquet --images .../supplier.parquet --out DIR [--config jobs/batch_targets.json]

Every supplier is an overview image with a stage position, pixel size, anchor, axis directions and plane positions of
its own; its order lines are the voxels of its z-stack. Each image is projected, thresholded at a percentile of its
own, its connected objects are measured, and its plan is made in its own stage coordinates, with z from the modal
plane. Writes ``objects`` and ``targets``, partitioned by nation; the partitions of a run replace those before,
so a rerun gives the same result, and ``nations`` in the configuration reruns part of a batch."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import read_config, session
from strataloom.functions.geometry import ImageScales, Tile
from strataloom.operators import components, objects, raster
from strataloom.operators.scratch import cut
from strataloom.plans import compose

log = logging.getLogger("batch_targets")

#: Pixels of an image's side, percentile of its threshold, least object, kind of plan, and the nations to run (null: all).
DEFAULTS = {"size": 32, "percentile": 90, "min_area": 2, "output": "detection_points", "nations": None}
TILE = Tile(8, 8, 1.0, 1.0, 0.25)


def overviews(suppliers: DataFrame, size: int) -> DataFrame:
    """One row of metadata for each image; position, pixel size, anchor, directions and planes follow from its keys."""
    k = F.col("s_suppkey")
    return suppliers.select(
        k.alias("image_id"), F.col("s_nationkey").alias("nation"), (F.col("s_nationkey") * 1000).cast("double").alias("stage_x"), (k % 100 * 500).cast("double").alias("stage_y"),
        F.when(k % 2 == 0, 1.25).otherwise(0.625).alias("px_x"), F.when(k % 2 == 0, 1.25).otherwise(0.625).alias("px_y"), F.lit(size).alias("width"), F.lit(size).alias("height"),
        (k % 3 == 0).alias("centred"), (k % 5 == 0).alias("invert_x"), (k % 7 == 0).alias("invert_y"), (k % 10 + 100).cast("double").alias("z0"), F.when(k % 2 == 0, 5.0).otherwise(2.5).alias("z_step"),
    )


def voxels(lines: DataFrame, size: int) -> DataFrame:
    """(image_id, z, y, x, v) of all stacks; an absent voxel is padding. Lines are dealt by pixel once, for the sums and for
    the projection that follows; hardly two lines share a voxel, so sums before that would save nothing."""
    at = [F.col("l_suppkey").alias("image_id"), (F.col("l_linenumber") - 1).cast("int").alias("z"), (F.col("l_orderkey") % size).cast("int").alias("y"), (F.col("l_partkey") % size).cast("int").alias("x")]
    dealt = lines.select(*at, F.col("l_quantity").cast("long").alias("v")).repartition("image_id", "y", "x")
    return dealt.groupBy("image_id", "z", "y", "x").agg(F.sum("v").alias("v"))


def run(spark: SparkSession, stacks: str, images: str, out: str, config: dict | None = None) -> dict:
    """Reads, plans and writes; returns what was read and written."""
    c = DEFAULTS | (config or {})
    meta = overviews(spark.read.parquet(images), c["size"])
    if c["nations"] is not None:
        meta = meta.where(F.col("nation").isin(*c["nations"]))
    lines = spark.read.parquet(stacks).join(meta.select(F.col("image_id").alias("l_suppkey")), "l_suppkey", "left_semi")
    mip = cut(raster.project_max(voxels(lines, c["size"])))
    mask = raster.with_threshold(mip, percentile=c["percentile"])
    labels = cut(components.label_components(mask, c["size"], 8).withColumn("cls", F.lit(1)))
    nation = meta.select("image_id", "nation")
    plan = compose.plan_targets(labels, labels.select("image_id", "y", "x", "argmax_z", "cls"), ImageScales.from_overviews(meta), TILE, compose.Planning(c["output"], "none", "per_roi", "direct", min_area=c["min_area"]))
    found = {"objects": objects.measure(labels).where(F.col("area") >= c["min_area"]), "targets": plan}
    done = {"images read": meta.count(), "pixels read": mip.count()}
    for name, table in found.items():
        # one file a nation: its rows are few beside the voxels that they come from
        rows = table.join(nation, "image_id").repartition("nation")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("nation").parquet(f"{out}/{name}")
        written = spark.read.schema(rows.schema).parquet(f"{out}/{name}")
        if c["nations"] is not None:
            written = written.where(F.col("nation").isin(*c["nations"]))
        done[f"{name} written"] = written.count()
    log.info("%s -> %s: %s", stacks, out, done)
    return done


#: The targets by SQL: the same planes, threshold, objects and transform for each supplier.
ORACLE_SQL = """
WITH RECURSIVE stack AS (
    SELECT l_suppkey AS image_id, CAST(l_linenumber - 1 AS INT) AS z, CAST(l_orderkey % 32 AS INT) AS y, CAST(l_partkey % 32 AS INT) AS x, sum(CAST(l_quantity AS BIGINT)) AS v
    FROM lineitem SEMI JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL
), mip AS (
    SELECT image_id, y, x, max(v) AS v, arg_min(z, (-v, z)) AS argmax_z FROM stack GROUP BY ALL
), mask AS (
    SELECT image_id, y * 32 + x AS id, y, x, argmax_z FROM mip JOIN (SELECT image_id, quantile_cont(v, 0.9) AS t FROM mip GROUP BY ALL) USING (image_id) WHERE v >= t
), links AS (
    SELECT a.image_id, a.id AS a, b.id AS b FROM mask a JOIN mask b ON a.image_id = b.image_id AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1
), reach AS (
    SELECT image_id, id AS a, id AS b FROM mask UNION SELECT r.image_id, r.a, l.b FROM reach r JOIN links l ON r.image_id = l.image_id AND r.b = l.a
), labels AS (
    SELECT m.*, r.label FROM mask m JOIN (SELECT image_id, b, min(a) AS label FROM reach GROUP BY ALL) r ON m.image_id = r.image_id AND m.id = r.b
), objects AS (
    SELECT image_id, label, CAST(sum(x) AS DOUBLE) / count(*) AS cx, CAST(sum(y) AS DOUBLE) / count(*) AS cy FROM labels GROUP BY ALL HAVING count(*) >= 2
), planes AS (
    SELECT image_id, label, arg_min(argmax_z, (-n, argmax_z)) AS z FROM (SELECT image_id, label, argmax_z, count(*) AS n FROM labels GROUP BY ALL) GROUP BY ALL
), scales AS (
    SELECT s_suppkey AS image_id, s_nationkey AS nation, CASE WHEN s_suppkey % 2 = 0 THEN 1.25 ELSE 0.625 END::DOUBLE AS px, CASE WHEN s_suppkey % 3 = 0 THEN 15.5 ELSE 0 END::DOUBLE AS half,
           CASE WHEN s_suppkey % 5 = 0 THEN -px ELSE px END AS a, CASE WHEN s_suppkey % 7 = 0 THEN -px ELSE px END AS d, s_nationkey * 1000 - a * half AS tx, s_suppkey % 100 * 500 - d * half AS ty,
           s_suppkey % 10 + 100.0::DOUBLE AS z0, CASE WHEN s_suppkey % 2 = 0 THEN 5 ELSE 2.5 END::DOUBLE AS z_step
    FROM supplier
)
SELECT CAST(nation AS INT) AS nation, image_id, row_number() OVER (PARTITION BY image_id ORDER BY label) AS ordinal, 'Planned ' || row_number() OVER (PARTITION BY image_id ORDER BY label) AS name,
       cx * a + tx AS x, cy * d + ty AS y, z * z_step + z0 AS z
FROM objects JOIN planes USING (image_id, label) JOIN scales USING (image_id)
"""


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("stacks", "images", "out"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config", help="JSON file of settings")
    a = p.parse_args(argv)
    spark = session("batch_targets")
    try:
        run(spark, a.stacks, a.images, a.out, read_config(spark, a.config, DEFAULTS))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()

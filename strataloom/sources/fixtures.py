"""Rasters, points and shapes derived from the sample tables by fixed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stack(spark, sf_dir) -> DataFrame:
    """Sparse z-stack of 96 by 96 by 7 voxels; an absent voxel is padding."""
    li = table(spark, sf_dir, "lineitem")
    i = lambda e, n: e.cast("int").alias(n)
    return li.groupBy(i(F.col("l_linenumber") - 1, "z"), i(F.col("l_orderkey") % 96, "y"), i(F.col("l_partkey") % 96, "x")).agg(F.sum(F.col("l_quantity").cast("long")).alias("v")).select(F.lit(0).alias("image_id"), "z", "y", "x", "v")


def plane(spark, sf_dir) -> DataFrame:
    """Dense image, one row of 64 values for each embedding."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("y"), F.posexplode("embedding").alias("x", "e"))
    return e.select(F.lit(1).alias("image_id"), "y", "x", F.col("e").cast("double").alias("v"))


def rects(spark, sf_dir) -> DataFrame:
    k = F.col("r_regionkey")
    d = lambda e, n: e.cast("double").alias(n)
    return table(spark, sf_dir, "region").select(k.cast("int").alias("id"), F.col("r_name").alias("name"), d(1010 + 20 * k, "center_x"), d(2015 + 17 * k, "center_y"), F.lit(115.0).alias("z"), d(12 + 5 * k, "width"), d(25 - 3 * k, "height"))


#: The corners of an L, around its centre.
L_SHAPE = ((-7.5, -7.5), (7.5, -7.5), (7.5, 0.5), (0.5, 0.5), (0.5, 7.5), (-7.5, 7.5))


def shape_vertices(spark, sf_dir) -> DataFrame:
    k = F.col("n_nationkey")
    offsets = F.array(*[F.struct(F.lit(i).alias("k"), F.lit(x).alias("dx"), F.lit(y).alias("dy")) for i, (x, y) in enumerate(L_SHAPE)])
    d = table(spark, sf_dir, "nation").select(k.cast("int").alias("id"), F.explode(offsets).alias("o"))
    return d.select("id", "o.k", (10 + 19 * (F.col("id") % 5) + F.col("o.dx")).alias("x"), (10 + 19 * F.floor(F.col("id") / 5) + F.col("o.dy")).alias("y"))


def stage_points(spark, sf_dir) -> DataFrame:
    s = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(s.cast("long").alias("id"), (F.abs(F.round(F.col("s_acctbal") * 100).cast("long")) % 101).cast("double").alias("x"), ((s * s * 31 + s * 17) % 97).cast("double").alias("y"), (F.col("s_nationkey") * 2).cast("double").alias("z"))


def many_points(spark, sf_dir) -> DataFrame:
    s = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(s.cast("long").alias("id"), (F.abs(F.round(F.col("c_acctbal") * 100).cast("long")) % 10007).cast("double").alias("x"), ((s * s * 31 + s * 17) % 10009).cast("double").alias("y"), (F.col("c_nationkey") * 2).cast("double").alias("z"))


#: The same tables in SQL, as common table expressions.
SQL = {
    "stack": "stack AS (SELECT 0 AS image_id, CAST(l_linenumber - 1 AS INT) AS z, CAST(l_orderkey % 96 AS INT) AS y, CAST(l_partkey % 96 AS INT) AS x, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS v FROM lineitem GROUP BY ALL)",
    "mip": "mip AS (SELECT image_id, y, x, max(v) AS v, arg_min(z, (-v, z)) AS argmax_z FROM stack GROUP BY ALL)",
    "cls": "q AS (SELECT quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.95) AS p95, max(v) AS top FROM mip), cls AS (SELECT mip.*, CASE WHEN v >= p95 THEN 2 WHEN v >= p50 THEN 1 ELSE 0 END AS cls, v / CAST(top AS DOUBLE) AS prob FROM mip, q)",
    "mask": "mask AS (SELECT cls.*, y * 96 + x AS id FROM cls, (SELECT quantile_cont(v, 0.8) AS p80 FROM mip) WHERE v >= p80)",
    "plane": "plane AS (SELECT 1 AS image_id, CAST(vec_id AS INT) AS y, CAST(unnest(range(len(embedding))) AS INT) AS x, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)",
    "rects": "rects AS (SELECT CAST(r_regionkey AS INT) AS id, r_name AS name, CAST(1010 + 20 * r_regionkey AS DOUBLE) AS center_x, CAST(2015 + 17 * r_regionkey AS DOUBLE) AS center_y, 115.0::DOUBLE AS z, CAST(12 + 5 * r_regionkey AS DOUBLE) AS width, CAST(25 - 3 * r_regionkey AS DOUBLE) AS height FROM region)",
    "shapes": "shapes AS (SELECT CAST(n_nationkey AS INT) AS id, o.k AS k, CAST(10 + 19 * (n_nationkey % 5) AS DOUBLE) + o.dx AS x, CAST(10 + 19 * (n_nationkey // 5) AS DOUBLE) + o.dy AS y FROM nation, (VALUES (0, -7.5::DOUBLE, -7.5::DOUBLE), (1, 7.5, -7.5), (2, 7.5, 0.5), (3, 0.5, 0.5), (4, 0.5, 7.5), (5, -7.5, 7.5)) AS o(k, dx, dy))",
    "sp": "sp AS (SELECT CAST(s_suppkey AS BIGINT) AS id, CAST(abs(CAST(round(s_acctbal * 100) AS BIGINT)) % 101 AS DOUBLE) AS x, CAST((s_suppkey * s_suppkey * 31 + s_suppkey * 17) % 97 AS DOUBLE) AS y, CAST(s_nationkey * 2 AS DOUBLE) AS z FROM supplier)",
    "mp": "mp AS (SELECT CAST(c_custkey AS BIGINT) AS id, CAST(abs(CAST(round(c_acctbal * 100) AS BIGINT)) % 10007 AS DOUBLE) AS x, CAST((c_custkey * c_custkey * 31 + c_custkey * 17) % 10009 AS DOUBLE) AS y, CAST(c_nationkey * 2 AS DOUBLE) AS z FROM customer)",
    "edges": "edges AS (SELECT c.id, p.x AS ax, p.y AS ay, c.x AS bx, c.y AS by FROM shapes c JOIN shapes p ON p.id = c.id AND p.k = (c.k + 5) % 6)",
}


def labels_sql(connectivity: int) -> str:
    """Labels of the mask by transitive closure, for ``WITH RECURSIVE``."""
    near = "abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1" if connectivity == 8 else "abs(a.y - b.y) + abs(a.x - b.x) = 1"
    links = f"links AS (SELECT a.id AS a, b.id AS b FROM mask a JOIN mask b ON b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 WHERE {near})"
    return f"{links}, reach AS (SELECT id AS a, id AS b FROM mask UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a), labels AS (SELECT m.*, r.label FROM mask m JOIN (SELECT b, min(a) AS label FROM reach GROUP BY b) r ON m.id = r.b)"


def with_sql(*names: str) -> str:
    """WITH clause of the named tables."""
    return "WITH RECURSIVE " + ", ".join(SQL.get(n, n) for n in names) + " "

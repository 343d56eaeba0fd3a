"""The jobs as queries: each runs twice into one new folder and gives its output as it then stands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataloom.operators.scratch import new_folder

from . import batch_targets, name_register


def job1_batch_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_folder(spark, "job1")
    for _ in range(2):
        batch_targets.run(spark, f"{sf_dir}/lineitem.parquet", f"{sf_dir}/supplier.parquet", out)
    return spark.read.parquet(f"{out}/targets").select("nation", "image_id", "ordinal", "name", "x", "y", "z")


def job2_name_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_folder(spark, "job2")
    for _ in range(2):
        name_register.run(spark, f"{sf_dir}/documents.parquet", out, f"{out}/checkpoint")
    return name_register.register(spark, out).drop("batch")


QUERIES = {f.__name__: f for f in (job1_batch_targets, job2_name_register)}
ORACLE_SQL = {"job1_batch_targets": batch_targets.ORACLE_SQL, "job2_name_register": name_register.ORACLE_SQL}

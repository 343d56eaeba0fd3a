"""All queries of the library by name, each over a folder of Parquet tables, with their SQL counterparts."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

from .catalogue import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "flagship", "ship"]


def ship(spark: SparkSession, root: str) -> None:
    """Let Python workers import the library from ``root``: by path where they share this machine, else by
    a zip sent to the executors once."""
    sc = spark.sparkContext
    if sc.master.startswith("local"):
        path = sc.environment.get("PYTHONPATH", "").split(os.pathsep)
        if root not in path:
            sc.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, path)])
    elif sc.environment.get("STRATALOOM_SHIPPED") != sc.applicationId:
        target = os.path.join(tempfile.mkdtemp(), "strataloom.zip")
        with zipfile.ZipFile(target, "w") as z:
            for folder, _, names in os.walk(os.path.join(root, "strataloom")):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, root))
        sc.addPyFile(target)
        sc.environment["STRATALOOM_SHIPPED"] = sc.applicationId


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z-stack to stage points: projection, percentile threshold, 8-connected objects, area filter, centroids."""
    return QUERIES["detection_points"](spark, sf_dir)

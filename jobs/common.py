"""What the jobs share: the session of a command line, its configuration and its log."""

from __future__ import annotations

import json
import logging
import os
import sys

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def read_config(spark: SparkSession, path: str | None, defaults: dict) -> dict:
    """``defaults`` with the values of a JSON file, which may lie in any store that Spark reads. Unknown keys are refused."""
    given = json.loads(spark.read.option("wholetext", True).text(path).first()[0]) if path else {}
    if unknown := sorted(given.keys() - defaults.keys()):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return defaults | given


def session(name: str) -> SparkSession:
    """A session for a command line; master and the rest come from spark-submit or Spark's defaults."""
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s", stream=sys.stderr)
    sys.path.insert(0, ROOT)
    from strataloom import registry

    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    registry.ship(spark, ROOT)
    return spark

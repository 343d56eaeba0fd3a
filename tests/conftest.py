import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    """Comparable form of a value of either engine."""
    if v is None or (isinstance(v, float) and v != v):
        return "nan"
    if isinstance(v, (bool, str)):
        return str(v)
    return repr(float(v))


def same_rows(df, relation):
    assert sorted(df.columns) == sorted(relation.columns)
    at = [relation.columns.index(c) for c in sorted(df.columns)]
    ours = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    theirs = sorted(tuple(plain(r[i]) for i in at) for r in relation.fetchall())
    assert ours == theirs

import duckdb
import pytest
from conftest import SF, same_rows

from strataloom import registry
from strataloom.operators import raster


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    same_rows(registry.QUERIES[name](spark, SF), duck.sql(registry.ORACLE_SQL[name]))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_no_crossing_is_null_as_in_sql(spark):
    # at this size every pixel's maximum lies above the mean, so no bin can cross
    name, large = "threshold_crossing", SF.replace("sf0.001", "sf0.1")
    sql = registry.ORACLE_SQL[name].replace("FROM lineitem", f"FROM '{large}/lineitem.parquet'")
    same_rows(registry.QUERIES[name](spark, large), duckdb.connect().sql(sql))
    high = spark.createDataFrame([(92.5,), (97.5,)], "centre double")
    assert raster.posterior_crossing(high, 1.0, 900.0, 20.0, 300.0, 90.0, 20.0).first()[0] is None
    assert raster.posterior_crossing(high, 1.0, 900.0, 20.0, 300.0, 90.0, 20.0, 299.0).first()[0] == 1.0 + 0.1 * 299.0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

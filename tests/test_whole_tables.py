"""Registered queries take every row of their tables, not a subset by id."""

import os
import re

import pytest

from loamwork.plans import catalog, model_queries
from loamwork.plans.base import table

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def ids(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_models_take_all_lines(spark):
    lines = table(spark, SF, "lineitem")
    want = ids(lines, "l_orderkey", "l_linenumber")
    assert ids(model_queries._lines(spark, SF), "l_orderkey", "l_linenumber") == want
    for name in ("model_ridge", "model_cross_validated"):
        assert ids(QUERIES[name](spark, SF), "l_orderkey", "l_linenumber") == want, name


def test_no_query_takes_a_part_by_id():
    """The SQL, with which tests/test_oracle.py compares all rows, has no condition on an id but where unmatched rows or labels without a folder are the feature."""
    for name, sql in SQL.items():
        found = re.findall(r"WHERE \w*(?:key|_id)\b *(?:%[^=<]*[=<]|<) *\d+", sql)
        assert not found or name in ("source_tsv_pair", "source_labelled_paths"), (name, found)


def test_curves_are_of_all_profiles(spark):
    profiles = QUERIES["soil_harmonise_curve"](spark, SF).select("profile_id").distinct()
    assert ids(profiles, "profile_id") == ids(table(spark, SF, "lineitem").select("l_orderkey").distinct(), "l_orderkey")


def test_daily_arrays_are_of_all_users(spark):
    # the smallest tables have no user beyond 19
    users = spark.createDataFrame([(1, 3, "2024-01-05 01:00:00", 2.0), (2, 500, "2024-01-05 01:00:00", 4.0)], "event_id long, user_id long, ts string, value double")
    at = __import__("tempfile").mkdtemp()
    users.withColumn("ts", users.ts.cast("timestamp")).write.parquet(f"{at}/events.parquet")
    assert ids(QUERIES["json_daily_arrays"](spark, at), "user_id") == [(3,), (500,)]

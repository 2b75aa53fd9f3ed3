"""Sizes of tables that may be broadcast."""

from __future__ import annotations

from labelkit.operators.bounded import is_small, join_small
from labelkit.session import written


def test_sizes_that_are_known_need_no_job(spark):
    small = written(spark.range(50), "small")
    spark.sparkContext.setJobGroup("known-size", "")
    assert is_small(small, 10_000)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("known-size")
    spark.sparkContext.setJobGroup("other", "")
    assert not is_small(small, 49) and is_small(small, 50)


def test_rows_are_counted_where_spark_broadcasts_nothing_unasked(spark):
    own = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        some = written(spark.range(1000), "some")
        assert is_small(some, 1000) and not is_small(some, 999)
        assert join_small(spark.range(2000), some, "id", "left_anti", 999).count() == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", own)

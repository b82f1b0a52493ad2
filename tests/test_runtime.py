"""Helpers of the session: samples, skewed joins, tables of rounds."""

import os

import pytest
from pyspark.sql import functions as F

from chatloom.runtime import bounded_sample, discard, group_lowest, materialise, skew_join


def test_bounded_sample(spark):
    rows = spark.range(10000).withColumnRenamed("id", "seq")
    first = {r.seq for r in bounded_sample(rows, "seq", 1000).collect()}
    assert 850 < len(first) < 1150
    assert first == {r.seq for r in bounded_sample(rows.repartition(7), "seq", 1000).collect()}
    assert bounded_sample(rows, "seq", 10000).count() == 10000


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join(spark, how):
    rows = materialise(spark.range(6000).select("id", F.when(F.col("id") < 4000, 7).when(F.col("id") < 4010, None).otherwise(F.col("id") % 50).cast("bigint").alias("k")))
    table = spark.createDataFrame([(k, f"v{k}") for k in range(0, 40, 7)], "k bigint, v string")
    assert sorted(map(repr, skew_join(rows, table, "k", how).collect())) == sorted(map(repr, rows.join(table, "k", how).collect()))


def test_group_lowest_and_discard(spark):
    rows = materialise(spark.range(5000).select("id", F.when(F.col("id") < 3000, 0).otherwise(F.col("id") - F.col("id") % 2).alias("k")))
    got = group_lowest(rows, ["k"], "id", "low", "n").filter("k = 0 or k = 4000").collect()
    assert {(r.k, r.low, r.n) for r in got} == {(0, 0, 3000), (4000, 4000, 2)} and len(got) == 3002
    path = rows.written_to.replace("file://", "")
    assert os.path.exists(path)
    discard(rows)
    assert not os.path.exists(path)

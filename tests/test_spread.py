"""Learners read parts of bounded size, however the input lies in its files."""

from __future__ import annotations

from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from stratagrid.operators import ml as M


def test_large_parts_are_dealt_out(spark):
    one = spark.range(2_500_000).coalesce(1).withColumn("y", F.col("id") * 2.0)
    parts = M.spread(one).groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) >= 3 and max(r["count"] for r in parts) <= 1_000_000
    assert M.spread(one.limit(1000)).rdd.getNumPartitions() == 1


def test_fit_takes_its_own_columns(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("x"), (F.col("id") * 3.0 + 1).alias("y"), F.lit("text").alias("other"))
    model = M.fit(LinearRegression(labelCol="y"), M.assemble(df, ["x"]))
    assert abs(model.coefficients[0] - 3) < 1e-6

"""Test-table analogues of the library's inputs: band cubes, yearly series, zones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratagrid.session import table


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, period, red, nir, swir, blue): mean event value by kind, user as cell, five days as period.

    The values of a mean are added in the order of the table's rows, as a scan by the SQL adds them, so that its last bit does not depend on splits and shuffles.
    """
    kinds = {"view": "red", "click": "nir", "signup": "swir", "error": "blue"}
    period = F.floor((F.dayofmonth("ts") - 1) / 5).cast("int")
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin(list(kinds)))
    e = e.select(F.col("user_id").alias("cell"), period.alias("period"), "event_type", "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    whole = Window.partitionBy("cell", "period").orderBy("file", "row").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    means = [F.avg(F.when(F.col("event_type") == k, F.col("value"))).over(whole).alias(c) for k, c in kinds.items()]
    return e.select("cell", "period", *means).dropDuplicates(["cell", "period"])


BANDS = """bands AS (
  SELECT user_id AS cell, CAST(floor((day(ts) - 1) / 5.0) AS INT) AS period,
    avg(value) FILTER (event_type = 'view') AS red, avg(value) FILTER (event_type = 'click') AS nir,
    avg(value) FILTER (event_type = 'signup') AS swir, avg(value) FILTER (event_type = 'error') AS blue
  FROM events WHERE event_type IN ('view', 'click', 'signup', 'error') GROUP BY 1, 2)"""


def part_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, year, v): quantity shipped of each part by year."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_partkey").alias("cell"), F.year("l_shipdate").alias("year")).agg(F.sum("l_quantity").alias("v"))


PART_YEARS = """py AS (SELECT l_partkey AS cell, CAST(year(l_shipdate) AS INT) AS year, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"""


def customer_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, year, v): order value of each customer by year, on the dense grid of all years."""
    from stratagrid.operators.series import dense_grid

    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cell"), F.year("o_orderdate").alias("year"), "o_totalprice")
    got = o.groupBy("cell", "year").agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    return dense_grid(got, ["cell"], "year", o.select("year").distinct(), "v")


CUSTOMER_YEARS = """cy0 AS (SELECT o_custkey AS cell, CAST(year(o_orderdate) AS INT) AS year, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1, 2),
cy AS (SELECT c.cell, y.year, cy0.v FROM (SELECT DISTINCT cell FROM cy0) c CROSS JOIN (SELECT DISTINCT year FROM cy0) y LEFT JOIN cy0 ON cy0.cell = c.cell AND cy0.year = y.year)"""


def user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, day, v): mean event value of each user by day, days without events missing."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("cell"), F.dayofmonth("ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("v"))


USER_DAYS = """ud AS (SELECT user_id AS cell, CAST(day(ts) AS INT) AS day, round(avg(value), 6) AS v FROM events GROUP BY 1, 2)"""

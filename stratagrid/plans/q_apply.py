"""Queries of lookups, summaries, array and cell arithmetic, and of the user-function surface."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratagrid.functions import indices as I  # noqa: E741
from stratagrid.operators import apply as A
from stratagrid.operators import census as C
from stratagrid.operators import sampling as S
from stratagrid.plans.frames import BANDS, PART_YEARS, USER_DAYS, bands, part_years, user_days
from stratagrid.plans.registry import query
from stratagrid.session import table


@query("complete_series", f"WITH {PART_YEARS} SELECT cell, CAST(count(*) AS BIGINT) AS years, sum(v) AS total FROM py GROUP BY 1 HAVING count(DISTINCT year) = (SELECT count(DISTINCT year) FROM py)")
def complete_series(spark: SparkSession, sf: str) -> DataFrame:
    py = C.complete_series(part_years(spark, sf), ["cell"], "year", [r[0] for r in table(spark, sf, "lineitem").select(F.year("l_shipdate")).distinct().collect()])
    return py.groupBy("cell").agg(F.count("*").alias("years"), F.sum("v").alias("total"))


@query("lookup_first", "SELECT l_partkey AS tile, arg_min(l_suppkey, (l_shipdate, l_orderkey, l_suppkey)) AS path FROM lineitem GROUP BY 1")
def lookup_first(spark: SparkSession, sf: str) -> DataFrame:
    first = F.min_by("l_suppkey", F.struct("l_shipdate", "l_orderkey", "l_suppkey"))
    return table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("tile")).agg(first.alias("path"))


@query("mean_and_last", "SELECT o_custkey, round(avg(o_totalprice), 6) AS heads, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS geometry FROM orders GROUP BY 1")
def mean_and_last(spark: SparkSession, sf: str) -> DataFrame:
    last = F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey"))
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.round(F.avg("o_totalprice"), 6).alias("heads"), last.alias("geometry"))


@query("global_range", "SELECT CAST(min(year(o_orderdate)) AS INT) AS min_year, CAST(max(year(o_orderdate)) AS INT) AS max_year, (SELECT string_agg(p, ',' ORDER BY p) FROM (SELECT DISTINCT o_orderpriority AS p FROM orders)) AS levels FROM orders")
def global_range(spark: SparkSession, sf: str) -> DataFrame:
    levels = F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",")
    return table(spark, sf, "orders").agg(F.min(F.year("o_orderdate")).alias("min_year"), F.max(F.year("o_orderdate")).alias("max_year"), levels.alias("levels"))


_LAYERS = ("l_quantity", "l_discount", "l_tax")


@query("class_mean_std", "SELECT l_returnflag AS class, " + ", ".join(f"round(avg({c}), 6) AS {c}_mean, round(stddev_pop({c}), 6) AS {c}_std" for c in _LAYERS) + " FROM lineitem GROUP BY 1")
def class_mean_std(spark: SparkSession, sf: str) -> DataFrame:
    each = [F.round(f(c), 6).alias(f"{c}_{n}") for c in _LAYERS for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("class")).agg(*each)


@query("cell_mean_std", f"WITH {USER_DAYS} SELECT cell, round(avg(v), 10) AS mean, round(stddev_pop(v), 8) AS std FROM ud GROUP BY 1")
def cell_mean_std(spark: SparkSession, sf: str) -> DataFrame:
    return user_days(spark, sf).groupBy("cell").agg(F.round(F.avg("v"), 10).alias("mean"), F.round(F.stddev_pop("v"), 8).alias("std"))


@query("max_repeated", f"WITH {PART_YEARS} SELECT cell, year, v, max(v) OVER (PARTITION BY cell) AS top FROM py")
def max_repeated(spark: SparkSession, sf: str) -> DataFrame:
    return part_years(spark, sf).withColumn("top", F.max("v").over(Window.partitionBy("cell")))


@query("random_keys", "SELECT draw, arg_min(s_nationkey, md5('3:' || draw || ':' || s_nationkey)) AS key FROM (SELECT DISTINCT s_nationkey FROM supplier), range(1, 11) AS d(draw) GROUP BY 1")
def random_keys(spark: SparkSession, sf: str) -> DataFrame:
    return S.choose_keys(table(spark, sf, "supplier"), "s_nationkey", 10, seed=3)


@query("feature_union", "SELECT o_custkey AS name FROM orders WHERE o_totalprice > 250000 UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def feature_union(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    name = F.col("o_custkey").alias("name")
    return o.where("o_totalprice > 250000").select(name).union(o.where("o_orderstatus = 'P'").select(name)).distinct()


@query("day_of_year", "SELECT DISTINCT CAST(month(o_orderdate) AS INT) AS month, CAST(dayofyear(make_date(2000, month(o_orderdate), 15)) AS INT) AS doy FROM orders")
def day_of_year(spark: SparkSession, sf: str) -> DataFrame:
    months = table(spark, sf, "orders").select(F.month("o_orderdate").alias("month")).distinct()
    return months.select("month", F.dayofyear(F.make_date(F.lit(2000), "month", F.lit(15))).alias("doy"))


_GRID = "SELECT DISTINCT CAST(l_quantity AS BIGINT) AS row, l_partkey % 60 AS col FROM lineitem"


@query("cell_lat_lon", f"WITH g AS ({_GRID}) SELECT row, col, row * 60 + col AS cell_id, round(60 - (row + 0.5) * 0.25, 6)::DOUBLE AS lat, round(-20 + (col + 0.5) * 0.25, 6)::DOUBLE AS lon FROM g")
def cell_lat_lon(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "lineitem").select(F.col("l_quantity").cast("long").alias("row"), (F.col("l_partkey") % 60).alias("col")).distinct()
    lon, lat = I.cell_centre(F.col("row"), F.col("col"), -20.0, 60.0, 0.25)
    return g.select("row", "col", (F.col("row") * 60 + F.col("col")).alias("cell_id"), F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


@query("class_shares_100", f"WITH {BANDS}, u AS (UNPIVOT (SELECT cell, period, red - 40 AS red, nir - 40 AS nir, swir - 40 AS swir FROM bands) ON red, nir, swir INTO NAME class VALUE v), c AS (SELECT cell, period, class, greatest(v, 0) AS v FROM u) SELECT cell, period, class, round(round(v / nullif(sum(v) OVER (PARTITION BY cell, period), 0) * 100, 6)) AS share FROM c")
def class_shares_100(spark: SparkSession, sf: str) -> DataFrame:
    names = ["red", "nir", "swir"]
    b = bands(spark, sf).select("cell", "period", *[(F.col(c) - 40).alias(c) for c in names])
    long = C.melt(b, ["cell", "period"], names, "class", "v").where("v is not null").withColumn("v", F.greatest("v", F.lit(0.0)))
    share = F.try_divide("v", F.nullif(F.sum("v").over(Window.partitionBy("cell", "period")), F.lit(0.0)))
    return long.select("cell", "period", "class", F.round(F.round(share * 100, 6)).alias("share"))


@query("raster_algebra", "SELECT p_partkey, round(p_size * p_retailprice / 10, 2) AS a, round(p_retailprice / 36 * p_size, 4) AS b FROM part")
def raster_algebra(spark: SparkSession, sf: str) -> DataFrame:
    size, price = F.col("p_size"), F.col("p_retailprice")
    return table(spark, sf, "part").select("p_partkey", F.round(size * price / 10, 2).alias("a"), F.round(price / 36 * size, 4).alias("b"))


@query("array_functions", "SELECT vec_id, CAST(list_position(embedding, list_min(embedding)) AS BIGINT) AS argmin, list_min(embedding) AS least, list_sort(embedding)[1:3] AS lowest, list_reverse_sort(embedding)[1] AS top FROM embeddings")
def array_functions(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select("vec_id", F.array_position(e, F.array_min(e)).alias("argmin"), F.array_min(e).alias("least"), F.slice(F.array_sort(e), 1, 3).alias("lowest"), F.array_max(e).alias("top"))


@query("sql_area", "SELECT p_brand, round(sum(p_size * 1000.0 * p_size * 500.0 / 1e6 * 1000), 4)::DOUBLE AS area FROM part GROUP BY 1")
def sql_area(spark: SparkSession, sf: str) -> DataFrame:
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION box_km2(w DOUBLE, h DOUBLE) RETURNS DOUBLE RETURN w * h / 1e6D")
    return spark.sql("SELECT p_brand, round(sum(box_km2(p_size * 1000D, p_size * 500D) * 1000D), 4) AS area FROM {part} GROUP BY p_brand", part=table(spark, sf, "part"))


@query("row_function", "SELECT n_nationkey, upper(n_name[1]) || lower(n_name[2:]) AS name FROM nation")
def row_function(spark: SparkSession, sf: str) -> DataFrame:
    title = A.apply_rows(_title, "string")
    return table(spark, sf, "nation").select("n_nationkey", title("n_name").alias("name"))


def _title(s: pd.Series) -> pd.Series:
    return s.str.capitalize()


@query("grouped_map", f"WITH {USER_DAYS}, g AS (SELECT cell, day, v, first_value(v) OVER (PARTITION BY cell ORDER BY day) AS f FROM ud) SELECT cell, day, round(v - f, 5) AS change FROM g")
def grouped_map(spark: SparkSession, sf: str) -> DataFrame:
    g = A.apply_groups(user_days(spark, sf), ["cell"], _change, "cell long, day int, change double")
    return g.withColumn("change", F.round("change", 5))


def _change(g: pd.DataFrame) -> pd.DataFrame:
    g = g.sort_values("day")
    return pd.DataFrame({"cell": g.cell, "day": g.day, "change": g.v - g.v.iloc[0]})


@query("tile_map", "SELECT event_id, CASE WHEN value > 50 THEN 1 ELSE 0 END::BIGINT AS occurs FROM events")
def tile_map(spark: SparkSession, sf: str) -> DataFrame:
    return A.map_tiles(table(spark, sf, "events").select("event_id", "value"), _occurs, "event_id long, occurs long")


def _occurs(b: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"event_id": b.event_id, "occurs": (b.value > 50).astype("int64")})


@query("grouped_aggregate", f"WITH {PART_YEARS} SELECT cell, max(v) - min(v) AS spread FROM py GROUP BY 1")
def grouped_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    spread = A.aggregate_with(lambda v: float(v.max() - v.min()), "double")
    return part_years(spark, sf).groupBy("cell").agg(spread("v").alias("spread"))


@query("table_function", f"WITH {PART_YEARS} SELECT cell, year, v AS value FROM py")
def table_function(spark: SparkSession, sf: str) -> DataFrame:
    spark.udtf.register("year_rows", A.YearRows)
    py = part_years(spark, sf).groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("year", "v"))).alias("s"))
    first = F.get("s", 0)["year"]
    at = F.map_from_entries("s")
    dense = py.select("cell", first.alias("first"), F.transform(F.sequence(first, F.element_at("s", -1)["year"]), lambda y: F.try_element_at(at, y)).alias("values"))
    return spark.sql("SELECT cell, year, value FROM {d}, LATERAL year_rows(first, values)", d=dense)

"""Queries that write rasters from line items as tile files and read them back: cells, levels, windows; and warps of a grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagrid.operators import warp as W
from stratagrid.plans.registry import query
from stratagrid.session import scratch, table
from stratagrid.sources import raster

_CELLS = """c AS (SELECT 't' || l_suppkey % 5 AS file, CAST(l_quantity AS INT) - 1 AS row, CAST(l_partkey % 60 AS INT) AS col, round(sum(l_extendedprice), 2) AS price, count(*) AS n FROM lineitem GROUP BY 1, 2, 3)"""


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    """(file, band, row, col, value): price and number of line items by quantity and part, five tiles."""
    file, row, col = F.concat(F.lit("t"), F.col("l_suppkey") % 5), F.col("l_quantity").cast("int") - 1, (F.col("l_partkey") % 60).cast("int")
    c = table(spark, sf, "lineitem").groupBy(file.alias("file"), row.alias("row"), col.alias("col")).agg(F.round(F.sum("l_extendedprice"), 2).alias("price"), F.count("*").cast("double").alias("n"))
    band = F.explode(F.array(F.struct(F.lit(1).alias("band"), F.col("price").alias("value")), F.struct(F.lit(2).alias("band"), F.col("n").alias("value")))).alias("b")
    return c.select("file", "row", "col", band).select("file", "b.band", "row", "col", "b.value")


def _tiles(spark: SparkSession, sf: str, **options) -> DataFrame:
    return raster.write_tiles(_cells(spark, sf), scratch(spark, "tiles"), **{"height": 50, "width": 60, "bands": 2, "block": 16, "dtype": "f8", "nodata": -1} | options)


@query("raster_round_trip", f"WITH {_CELLS} SELECT file, 1 AS band, row, col, price AS value FROM c UNION ALL SELECT file, 2, row, col, n FROM c")
def raster_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    files = _tiles(spark, sf, predictor=3)
    cells = raster.cells_of(raster.read_blocks(files)).where("value is not null")
    return cells.join(files, "path").select("file", "band", "row", "col", "value")


@query("raster_counts_lzw", f"WITH {_CELLS} SELECT file, row, col, CAST(n AS BIGINT) AS n FROM c WHERE row BETWEEN 10 AND 29 AND col BETWEEN 5 AND 40")
def raster_counts_lzw(spark: SparkSession, sf: str) -> DataFrame:
    files = _tiles(spark, sf, dtype="i2", compression="lzw", predictor=2)
    window = {"rows": (10, 29), "cols": (5, 40)}
    cells = raster.cells_of(raster.read_blocks(files, **window), **window).where("band = 2 AND value is not null")
    return cells.join(files, "path").select("file", "row", "col", F.col("value").cast("long").alias("n"))


@query("raster_overview", f"WITH {_CELLS} SELECT file, CAST(floor(row / 4) AS INT) AS row, CAST(floor(col / 4) AS INT) AS col, round(avg(price), 7) AS price FROM c GROUP BY ALL")
def raster_overview(spark: SparkSession, sf: str) -> DataFrame:
    files = _tiles(spark, sf, overviews=(2, 4), predictor=2)
    cells = raster.cells_of(raster.read_blocks(files, factor=5)).where("band = 1 AND value is not null")
    return cells.join(files, "path").select("file", "row", "col", F.round("value", 7).alias("price"))


#: A world grid of line items, 50 rows by 120 columns of three degrees and more: cells hold prices or nothing.
_WORLD = """g AS (SELECT CAST(l_quantity AS INT) - 1 AS row, CAST(l_partkey % 120 AS INT) AS col, round(sum(l_extendedprice), 2) AS value FROM lineitem WHERE l_partkey % 7 <> 3 GROUP BY 1, 2)"""
_HEIGHT, _WIDTH, _DLAT, _DLON = 50, 120, 3.4, 3.0


def _world(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").where("l_partkey % 7 <> 3")
    return li.groupBy((F.col("l_quantity").cast("int") - 1).alias("row"), (F.col("l_partkey") % 120).cast("int").alias("col")).agg(F.round(F.sum("l_extendedprice"), 2).alias("value"))


# target cells: centres in metres of the homolosine plane, from customers; 240 km wide
_RES = 240_000.0
_NORTH, _SOUTH = ((-180, -40, -100), (-40, 180, 30)), ((-180, -100, -160), (-100, -20, -60), (-20, 80, 20), (80, 180, 140))
_PLACES = """t AS (SELECT DISTINCT CAST(floor(c_acctbal / 66) AS INT) - 77 AS trow, CAST(c_custkey * 13 % 160 AS INT) - 80 AS tcol FROM customer),
m AS (SELECT trow, tcol, (tcol + 0.5) * 240000.0 / 6378137.0 AS x, -(trow + 0.5) * 240000.0 / 6378137.0 AS y FROM t),
s AS (SELECT *, abs(y) > radians(40 + 44 / 60.0 + 11.8 / 3600.0) AS polar, (y + sign(y) * 0.05280352736841287) / sqrt(2) AS q FROM m),
u AS (SELECT trow, tcol, x, y, polar, CASE WHEN polar THEN (2 * asin(q) + sin(2 * asin(q))) / pi() ELSE sin(y) END AS sinlat, CASE WHEN polar THEN 2 * sqrt(2) / pi() * cos(asin(q)) ELSE cos(y) END AS wide FROM s WHERE NOT polar OR abs(q) <= 1),
l AS (SELECT *, degrees(asin(sinlat)) AS lat, c + degrees((x - radians(c)) / wide) AS lon FROM u, (VALUES """ + ", ".join(f"({a}, {b}, {c}, {n})" for n, lobes in ((1, _NORTH), (0, _SOUTH)) for a, b, c in lobes) + """) AS v(a, b, c, north) WHERE (north = 1) = (y >= 0) AND c + degrees((x - radians(c)) / wide) >= a AND c + degrees((x - radians(c)) / wide) < b),
p AS (SELECT trow, tcol, (85 - lat) / 3.4 AS fy, (lon + 180) / 3.0 AS fx FROM l WHERE abs(lat) <= 85)"""


def _targets(spark: SparkSession, sf: str) -> DataFrame:
    """(trow, tcol, fy, fx): homolosine cells with where their centres lie in the world grid, in rows and columns from its corner."""
    t = table(spark, sf, "customer").select((F.floor(F.col("c_acctbal") / 66) - 77).cast("int").alias("trow"), (F.col("c_custkey") * 13 % 160 - 80).cast("int").alias("tcol")).distinct()
    lon, lat = W.inverse_homolosine((F.col("tcol") + 0.5) * _RES, -(F.col("trow") + 0.5) * _RES)
    at = t.select("trow", "tcol", lon.alias("lon"), lat.alias("lat")).where("lon IS NOT NULL AND abs(lat) <= 85")
    return at.select("trow", "tcol", ((85 - F.col("lat")) / _DLAT).alias("fy"), ((F.col("lon") + 180) / _DLON).alias("fx"))


def _warped(spark: SparkSession, sf: str, kernel: str, digits: int = 3, **options) -> DataFrame:
    out = W.resample(_world(spark, sf), _targets(spark, sf), _HEIGHT, _WIDTH, kernel, block=16, **options)
    return out.select("trow", "tcol", F.round("value", digits).alias("value"))


@query("warp_nearest", f"WITH {_WORLD}, {_PLACES} SELECT trow, tcol, round(value, 3) AS value FROM p LEFT JOIN g ON row = floor(fy) AND col = floor(fx)")
def warp_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return _warped(spark, sf, "nearest")


@query(
    "warp_bilinear",
    f"WITH {_WORLD}, {_PLACES}, k AS (SELECT trow, tcol, (1 - abs(fy - row - 0.5)) * (1 - abs(fx - col - 0.5)) AS w, value FROM p JOIN g ON row BETWEEN floor(fy - 0.5) AND floor(fy - 0.5) + 1 AND col BETWEEN floor(fx - 0.5) AND floor(fx - 0.5) + 1) SELECT p.trow, p.tcol, round(sum(w * value) / nullif(sum(w), 0), 3) AS value FROM p LEFT JOIN k USING (trow, tcol) GROUP BY 1, 2",
)
def warp_bilinear(spark: SparkSession, sf: str) -> DataFrame:
    return _warped(spark, sf, "bilinear")


_NEAR = "k AS (SELECT trow, tcol, value FROM p JOIN g ON row + 0.5 BETWEEN fy - 1.7 AND fy + 1.7 AND col + 0.5 BETWEEN fx - 2.3 AND fx + 2.3)"


@query("warp_average", f"WITH {_WORLD}, {_PLACES}, {_NEAR} SELECT p.trow, p.tcol, round(avg(value), 7) AS value FROM p LEFT JOIN k USING (trow, tcol) GROUP BY 1, 2")
def warp_average(spark: SparkSession, sf: str) -> DataFrame:
    return _warped(spark, sf, "average", 7, reach=(1.7, 2.3))


@query(
    "warp_mode",
    f"WITH {_WORLD}, {_PLACES}, {_NEAR}, c AS (SELECT trow, tcol, floor(value / 100000) AS v, count(*) AS n FROM k GROUP BY ALL), b AS (SELECT trow, tcol, arg_min(v, (-n, v)) AS value FROM c GROUP BY 1, 2) SELECT p.trow, p.tcol, round(value, 3) AS value FROM p LEFT JOIN b USING (trow, tcol)",
)
def warp_mode(spark: SparkSession, sf: str) -> DataFrame:
    classes = _world(spark, sf).withColumn("value", F.floor(F.col("value") / 100_000).cast("double"))
    out = W.resample(classes, _targets(spark, sf), _HEIGHT, _WIDTH, "mode", block=16, reach=(1.7, 2.3))
    return out.select("trow", "tcol", F.round("value", 3).alias("value"))


@query("warp_spline")
def warp_spline(spark: SparkSession, sf: str) -> DataFrame:
    filled = table(spark, sf, "lineitem").groupBy((F.col("l_quantity").cast("int") - 1).alias("row"), (F.col("l_partkey") % 60).cast("int").alias("col")).agg(F.round(F.sum("l_extendedprice"), 2).alias("value"))
    half = _targets(spark, sf).withColumn("fx", F.col("fx") / 2)
    out = W.resample(filled, half, _HEIGHT, 60, "spline", block=32)
    return out.select("trow", "tcol", F.round("value", 3).alias("value"))

"""Queries over raster cells, with bands from events and zones from nations and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratagrid.functions import indices as I
from stratagrid.operators import cells as C
from stratagrid.plans import frames as A
from stratagrid.plans.registry import query
from stratagrid.session import table

_LUE = f"""WITH {A.BANDS},
i AS (SELECT *, (nir - red) / nullif(nir + red, 0) AS ndvi, (nir - swir) / nullif(nir + swir, 0) AS lswi, (300 * blue / 50) * 0.02 * 50 - 273.15 AS t FROM bands),
m AS (SELECT *, max(lswi) OVER (PARTITION BY cell) AS top, (ndvi - 0.03) * (0.95 - 0.001) / (0.96 - 0.03) + 0.001 AS fpar FROM i),
s AS (SELECT *, (1 + lswi) / nullif(1 + top, 0) AS w, (t - 48) * (t - 0) / nullif((t - 48) * (t - 0) - (t - 20.33) * (t - 20.33), 0) AS ts FROM m),
g AS (SELECT cell, period, CASE WHEN fpar < 0 OR swir * 0.0864 * fpar * w * ts * 10 < 0 THEN 0.0 ELSE swir * 0.0864 * fpar * w * ts * 10 END AS gpp FROM s)"""


def _gpp(spark: SparkSession, sf: str) -> DataFrame:
    b = A.bands(spark, sf)
    c = {n: F.col(n) for n in ("red", "nir", "swir", "blue")}
    b = b.withColumns({"ndvi": I.normalized_difference(c["nir"], c["red"]), "lswi": I.normalized_difference(c["nir"], c["swir"]), "t": I.lst_celsius(300 * c["blue"] / 50 * 50)})
    top = F.max("lswi").over(Window.partitionBy("cell"))
    b = b.withColumns({"fpar": I.fpar(F.col("ndvi")), "w": I.water_scalar(F.col("lswi"), top), "ts": I.temperature_scalar(F.col("t"))})
    return b.withColumn("gpp", I.gross_productivity(I.par_energy(c["swir"]), F.col("fpar"), F.col("w"), F.col("ts")))


@query("index_lue", _LUE + " SELECT cell, round(avg(gpp) * 36.5, 3) AS annual, count(gpp) AS n FROM g GROUP BY cell")
def index_lue(spark: SparkSession, sf: str) -> DataFrame:
    return _gpp(spark, sf).groupBy("cell").agg(F.round(F.avg("gpp") * 36.5, 3).alias("annual"), F.count("gpp").alias("n"))


@query("gpp_periods", _LUE + " SELECT cell, period, round(gpp, 4) AS gpp FROM g")
def gpp_periods(spark: SparkSession, sf: str) -> DataFrame:
    return _gpp(spark, sf).select("cell", "period", F.round("gpp", 4).alias("gpp"))


@query(
    "spectral_indices",
    f"""WITH {A.BANDS} SELECT cell, period, round((nir - red) / nullif(nir + red, 0), 6) AS ndvi, round(2.5 * (nir - red) / nullif(nir + 6 * red - 7.5 * blue + 1, 0), 5) AS evi,
round(((nir - red) / nullif(nir + red, 0) - 0.08) * nir, 5) AS nirv, round(((swir + red) - (nir + blue)) / nullif((swir + red) + (nir + blue), 0), 6) AS bsi FROM bands""",
)
def spectral_indices(spark: SparkSession, sf: str) -> DataFrame:
    red, nir, swir, blue = (F.col(c) for c in ("red", "nir", "swir", "blue"))
    return A.bands(spark, sf).select("cell", "period", I.rounded(I.normalized_difference(nir, red), 6).alias("ndvi"), I.rounded(I.evi(nir, red, blue), 5).alias("evi"), I.rounded(I.nirv(nir, red), 5).alias("nirv"), I.rounded(I.bsi(blue, red, nir, swir), 6).alias("bsi"))


@query("norm_diff_scaled", "WITH t AS (SELECT l_partkey AS part, CAST(year(l_shipdate) AS INT) AS year, sum(l_quantity) AS a, round(sum(l_extendedprice) / 2000, 6) AS b FROM lineitem GROUP BY 1, 2) SELECT part, year, round(CASE WHEN a + b <> 0 THEN greatest(least((a - b) / (a + b) * 125 + 125, 250), 0) END, 4) AS v FROM t")
def norm_diff_scaled(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("part"), F.year("l_shipdate").alias("year")).agg(F.sum("l_quantity").alias("a"), F.round(F.sum("l_extendedprice") / 2000, 6).alias("b"))
    return t.select("part", "year", F.round(I.scaled_index(I.normalized_difference(F.col("a"), F.col("b"))), 4).alias("v"))


@query("temperature_scalar", "SELECT c_custkey, round((t - 48) * t / nullif((t - 48) * t - (t - 20.33) * (t - 20.33), 0), 6) AS ts FROM (SELECT c_custkey, c_acctbal / 200 AS t FROM customer)")
def temperature_scalar(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", F.round(I.temperature_scalar(F.col("c_acctbal") / 200), 6).alias("ts"))


def _geo(a: float, b: float) -> str:
    return f"round_even(({a} * cos(radians(lat)) + {b} * (1 - cos((doy - 18) * pi() / 182.5 + CASE WHEN lat >= 0 THEN 1.0 ELSE 4.0 END * pi())) * abs(sin(radians(lat))) - 0.006 * elev * 0.1) * 100, 0)"


@query("geom_temp", f"SELECT c_custkey, {_geo(*I.GEO_MAX)} AS high, {_geo(*I.GEO_MIN)} AS low FROM (SELECT c_custkey, c_custkey % 180 - 90 + 0.25 AS lat, c_acctbal AS elev, 15 + c_nationkey * 10 AS doy FROM customer)")
def geom_temp(spark: SparkSession, sf: str) -> DataFrame:
    lat, elev, doy = F.col("c_custkey") % 180 - 90 + 0.25, F.col("c_acctbal"), 15 + F.col("c_nationkey") * 10
    return table(spark, sf, "customer").select("c_custkey", I.geometric_temperature(lat, elev, doy, I.GEO_MAX).alias("high"), I.geometric_temperature(lat, elev, doy, I.GEO_MIN).alias("low"))


@query(
    "bimonth_mean",
    "WITH m AS (SELECT o_custkey % 50 AS cell, CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1, 2, 3) SELECT cell, year, CAST(ceil(month / 2.0) AS INT) AS period, CASE WHEN count(v) = 2 THEN avg(v) END AS v FROM m GROUP BY 1, 2, 3",
)
def bimonth_mean(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "orders").groupBy((F.col("o_custkey") % 50).alias("cell"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    return m.groupBy("cell", "year", F.ceil(F.col("month") / 2).cast("int").alias("period")).agg(F.when(F.count("v") == 2, F.avg("v")).alias("v"))


@query("annual_mean", "SELECT o_custkey % 50 AS cell, CAST(year(o_orderdate) AS INT) AS year, round(avg(o_totalprice) * 36.5, 6) AS annual, round(max(o_totalprice), 2) AS top, round(stddev_pop(o_totalprice), 3) AS sd FROM orders GROUP BY 1, 2")
def annual_mean(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("o_totalprice")
    return table(spark, sf, "orders").groupBy((F.col("o_custkey") % 50).alias("cell"), F.year("o_orderdate").alias("year")).agg(F.round(F.avg(v) * 36.5, 6).alias("annual"), F.round(F.max(v), 2).alias("top"), F.round(F.stddev_pop(v), 3).alias("sd"))


_LS = """WITH s AS (SELECT l_partkey AS part, 120.0 * sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) / sum(l_quantity) AS crop, 100.0 * sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) / sum(l_quantity) AS cult, 100.0 * sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / sum(l_quantity) AS nat,
  13000 + 20 * count(*) AS p50, 15000 + 30 * count(*) AS p95 FROM lineitem GROUP BY 1),
r AS (SELECT part, p50, p95, CASE WHEN crop + cult + nat > 100 THEN crop / (crop + cult + nat) * 100 ELSE crop END AS crop, CASE WHEN crop + cult + nat > 100 THEN cult / (crop + cult + nat) * 100 ELSE cult END AS cult, CASE WHEN crop + cult + nat > 100 THEN nat / (crop + cult + nat) * 100 ELSE nat END AS nat FROM s),
c AS (SELECT *, CASE WHEN NOT (p50 > 13400 AND p95 < 16058) THEN 0 WHEN nat > 0 AND nat > cult AND crop <= 19 THEN 1 WHEN cult > 0 AND cult >= nat AND crop <= 19 THEN 2 WHEN cult + nat > 0 AND crop > 19 AND crop <= 37 THEN 3 WHEN crop > 0 AND crop <= 67 THEN 4 ELSE 0 END AS class FROM r)"""


@query("land_system_case", _LS + " SELECT part, class, CASE WHEN class > 0 THEN round(crop + cult + nat, 4) ELSE 0.0 END AS share FROM c")
def land_system_case(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("l_quantity")
    of = lambda f, k: k * F.sum(F.when(F.col("l_returnflag") == f, q).otherwise(0)) / F.sum(q)
    s = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(of("A", 120.0).alias("a"), of("N", 100.0).alias("b"), of("R", 100.0).alias("c"), (13000 + 20 * F.count("*")).alias("p50"), (15000 + 30 * F.count("*")).alias("p95"))
    crop, cult, nat = I.renormalised([F.col("a"), F.col("b"), F.col("c")])
    s = s.select("part", "p50", "p95", crop.alias("crop"), cult.alias("cult"), nat.alias("nat"))
    cls = I.land_system(F.col("crop"), F.col("cult"), F.col("nat"), F.col("p50"), F.col("p95"))
    return s.withColumn("class", cls).select("part", "class", F.when(F.col("class") > 0, F.round(F.col("crop") + F.col("cult") + F.col("nat"), 4)).otherwise(0.0).alias("share"))


@query("hard_class", "WITH p AS (SELECT l_orderkey, l_quantity AS c, CAST(floor(l_extendedprice) AS BIGINT) % 100 AS n FROM lineitem) SELECT l_orderkey, c, n, CASE WHEN n >= 42 THEN 2 WHEN c >= 32 THEN 1 ELSE 0 END AS class, CASE WHEN c >= 32 OR n >= 42 THEN 1 ELSE 0 END AS grass, CASE WHEN c > 45 OR n = 7 THEN 255.0 ELSE greatest(least(c * 3 - 20, 100), 0) END AS band FROM p")
def hard_class(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_quantity").alias("c"), (F.floor("l_extendedprice") % 100).alias("n"))
    c, n = F.col("c"), F.col("n")
    return p.select("l_orderkey", "c", "n", I.hard_class(c, n).alias("class"), ((c >= 32) | (n >= 42)).cast("int").alias("grass"), C.exclusion(I.clip(c * 3 - 20, 0.0, 100.0), c > 45, n == 7, nodata=255.0).alias("band"))


@query("encode_band", "SELECT l_orderkey, l_linenumber, CAST(coalesce(round_even(nullif(l_discount, 0.05) * 1000, 0), -32000) AS SMALLINT) AS stored, l_quantity AS v FROM lineitem")
def encode_band(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", I.encode_band(F.nullif(F.col("l_discount"), F.lit(0.05)), 1000, -32000).alias("stored"), F.col("l_quantity").alias("v"))


@query("box_cox", "SELECT p_partkey, round((pow(p_retailprice, 0.3) - 1) / 0.3, 6) AS bc, round(p_retailprice, 6) AS back, round(ln(p_retailprice), 6) AS log FROM part")
def box_cox(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("p_retailprice")
    return table(spark, sf, "part").select("p_partkey", F.round(I.box_cox(v, 0.3), 6).alias("bc"), F.round(I.inverse_box_cox(I.box_cox(v, 0.3), 0.3), 6).alias("back"), F.round(I.box_cox(v, 0), 6).alias("log"))


@query("density_heads", "SELECT o_orderkey, CASE WHEN area > 0 AND heads <> 0 THEN round(heads / area, 6) END AS density, round(heads / 100, 6) AS share FROM (SELECT o_orderkey, o_totalprice AS heads, o_orderkey % 7 AS area FROM orders)")
def density_heads(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", F.round(I.density(F.col("o_totalprice"), F.col("o_orderkey") % 7), 6).alias("density"), F.round(F.col("o_totalprice") / 100, 6).alias("share"))


_Z = "z AS (SELECT CAST(c_nationkey AS BIGINT) AS zone, CAST(year(o_orderdate) AS INT) AS year, o_totalprice AS v, nullif(CAST(o_orderkey % 6 * 20 AS DOUBLE), 60) AS mask, nullif(o_custkey % 9, 4) AS w FROM orders JOIN customer ON o_custkey = c_custkey)"


def _zones(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select(F.col("c_nationkey").cast("long").alias("zone"), F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("v"), F.nullif((F.col("o_orderkey") % 6 * 20).cast("double"), F.lit(60.0)).alias("mask"), F.nullif(F.col("o_custkey") % 9, F.lit(4)).alias("w"))


@query("zonal_mean_sum", f"WITH {_Z} SELECT zone, year, round_even(avg(v), 0) AS v, round_even(avg(w), 0) AS w, round_even(sum(mask), 0) AS mask_sum, round(round_even(sum(mask), 0) / 100, 6) AS mask_km2 FROM z WHERE mask <> 0 GROUP BY 1, 2")
def zonal_mean_sum(spark: SparkSession, sf: str) -> DataFrame:
    return C.zonal_statistics(_zones(spark, sf), ["zone", "year"], ["v", "w"], "mask").withColumn("mask_km2", F.round(F.col("mask_sum") / 100, 6))


@query(
    "coverage_filter",
    """WITH z AS (SELECT s_suppkey AS zone, 1200.0 AS area FROM supplier), g AS (SELECT l_suppkey AS zone, sum(CASE WHEN l_quantity > 25 THEN l_quantity END) AS a, count(CASE WHEN l_quantity > 25 THEN l_quantity END) AS an, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS b, count(CASE WHEN l_returnflag = 'A' THEN 1 END) AS bn FROM lineitem GROUP BY 1),
j AS (SELECT zone, area, a, b, coalesce(an, 0) * 4.0 / area * 100 AS ca, coalesce(bn, 0) * 4.0 / area * 100 AS cb FROM z LEFT JOIN g USING (zone))
SELECT zone, area, CASE WHEN ca >= 50 THEN a END AS a, CASE WHEN cb >= 50 THEN b END AS b FROM j WHERE ca >= 50 OR cb >= 50""",
)
def coverage_filter(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("l_quantity")
    cells = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("zone"), F.when(q > 25, q).alias("a"), F.when(F.col("l_returnflag") == "A", q).alias("b"))
    zones = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("zone"), F.lit(1200.0).alias("area"))
    return C.coverage(cells, zones, "zone", ["a", "b"], "area", 4.0)


@query("mass_preserve", f"WITH {_Z}, t AS (SELECT zone, sum(v) AS total FROM z GROUP BY 1), f AS (SELECT zone, (zone + 1) * 1000000.0 / total AS factor FROM t) SELECT zone, year, round(sum(v * factor), 2) AS adjusted, round(avg(factor), 6) AS factor, count(*) AS n FROM z JOIN f USING (zone) GROUP BY 1, 2")
def mass_preserve(spark: SparkSession, sf: str) -> DataFrame:
    targets = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("zone"), ((F.col("n_nationkey") + 1) * 1000000.0).alias("goal"))
    out = C.preserve_mass(_zones(spark, sf), ["zone"], "v", targets, "goal")
    return out.groupBy("zone", "year").agg(F.round(F.sum("adjusted"), 2).alias("adjusted"), F.round(F.avg("factor"), 6).alias("factor"), F.count("*").alias("n"))


@query(
    "largest_remainder",
    """WITH c AS (SELECT CAST(c_nationkey AS BIGINT) AS zone, c_custkey AS cell, CAST(floor(c_acctbal) AS BIGINT) AS v, (c_nationkey + 1) * 100 AS goal FROM customer),
s AS (SELECT *, sum(CASE WHEN v > 0 THEN v END) OVER (PARTITION BY zone) AS total FROM c), p AS (SELECT *, round(CAST(v AS DOUBLE) * goal / total, 9) AS share FROM s WHERE v > 0),
f AS (SELECT *, CAST(floor(share) AS BIGINT) AS low, round(share - floor(share), 9) AS frac FROM p),
r AS (SELECT zone, cell, low, goal - sum(low) OVER (PARTITION BY zone) AS short, row_number() OVER (PARTITION BY zone ORDER BY frac DESC, cell) AS k FROM f)
SELECT c.zone, c.cell, CAST(coalesce(low + CASE WHEN k <= short THEN 1 ELSE 0 END, 0) AS BIGINT) AS allocated FROM c LEFT JOIN r ON r.cell = c.cell""",
)
def largest_remainder(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_nationkey").cast("long").alias("zone"), F.col("c_custkey").alias("cell"), F.floor("c_acctbal").alias("v"))
    goals = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("zone"), ((F.col("n_nationkey") + 1) * 100).alias("goal"))
    return C.largest_remainder(c, "zone", "cell", "v", goals, "goal").select("zone", "cell", "allocated")


@query("zone_report", f"WITH {_Z} SELECT zone, year, round(sum(v), 2) AS total, round(avg(v), 6) AS density, round(1000000.0 / sum(v), 9) AS factor FROM z GROUP BY 1, 2")
def zone_report(spark: SparkSession, sf: str) -> DataFrame:
    return _zones(spark, sf).groupBy("zone", "year").agg(F.round(F.sum("v"), 2).alias("total"), F.round(F.avg("v"), 6).alias("density"), F.round(1000000.0 / F.sum("v"), 9).alias("factor"))


@query("occurrence_pct", "SELECT user_id AS cell, round(avg(CASE WHEN event_type IN ('view', 'click') THEN 1.0 ELSE 0 END) * 100, 6) AS percent FROM events GROUP BY 1")
def occurrence_pct(spark: SparkSession, sf: str) -> DataFrame:
    return C.occurrence_percent(table(spark, sf, "events").withColumnRenamed("user_id", "cell"), ["cell"], "event_type", ["view", "click"]).select("cell", F.round("percent", 6).alias("percent"))


@query("predmask_any", "SELECT l_partkey AS cell, max(CASE WHEN (l_quantity BETWEEN 1 AND 44) OR (l_quantity BETWEEN 49 AND 50) THEN 0 ELSE 1 END) AS keep FROM lineitem GROUP BY 1")
def predmask_any(spark: SparkSession, sf: str) -> DataFrame:
    return C.any_epoch_mask(table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "cell"), ["cell"], "l_quantity", [(1, 44), (49, 50)])


@query("skip_tiles", "SELECT l_orderkey, l_partkey % 100 AS tile, l_quantity FROM lineitem WHERE l_partkey % 100 IN (SELECT l_partkey % 100 FROM lineitem GROUP BY 1 HAVING min(l_discount) <> 0)")
def skip_tiles(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").withColumn("tile", F.col("l_partkey") % 100)
    return C.skip_tiles(li, "tile", "l_discount", 0.0).select("l_orderkey", "tile", "l_quantity")


@query("mask_scatter", "SELECT p_partkey, coalesce(avg_q, -1.0) AS v FROM part LEFT JOIN (SELECT l_partkey, round(avg(l_quantity), 6) AS avg_q FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-10-01' GROUP BY 1) ON l_partkey = p_partkey")
def mask_scatter(spark: SparkSession, sf: str) -> DataFrame:
    got = table(spark, sf, "lineitem").where(F.col("l_shipdate") >= F.lit("2001-10-01").cast("timestamp")).groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.round(F.avg("l_quantity"), 6).alias("v"))
    return C.scatter(table(spark, sf, "part").select("p_partkey"), got, ["p_partkey"], "v", -1.0)


@query("space_time_overlay", "WITH l AS (SELECT l_partkey AS cell, year(l_shipdate) AS year, sum(l_quantity) FILTER (l_returnflag = 'A') AS a, sum(l_quantity) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1, 2) SELECT o_orderkey, a, r FROM orders LEFT JOIN l ON l.cell = o_custkey AND l.year = year(o_orderdate)")
def space_time_overlay(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    long = li.groupBy(F.col("l_partkey").alias("cell"), F.year("l_shipdate").alias("year"), F.col("l_returnflag").alias("layer")).agg(F.sum("l_quantity").alias("value"))
    cells = C.pivot_layers(long, ["cell", "year"], "layer", "value", ["A", "R"]).withColumnsRenamed({"A": "a", "R": "r"})
    points = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("cell"), F.year("o_orderdate").alias("year"))
    return C.overlay(points, cells, ["cell", "year"], ["a", "r"]).select("o_orderkey", "a", "r")


@query("static_broadcast", "SELECT CAST(n_nationkey AS BIGINT) AS nation, y.year, r_name, coalesce(t.n, 0) AS n FROM nation JOIN region ON n_regionkey = r_regionkey CROSS JOIN (SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS year FROM orders) y LEFT JOIN (SELECT c_nationkey, year(o_orderdate) AS year, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) t ON t.c_nationkey = n_nationkey AND t.year = y.year")
def static_broadcast(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    t = o.groupBy(F.col("c_nationkey").cast("long").alias("nation"), F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))
    static = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("long").alias("nation"), "r_name")
    grid = static.crossJoin(F.broadcast(table(spark, sf, "orders").select(F.year("o_orderdate").alias("year")).distinct()))
    return grid.join(t, ["nation", "year"], "left").na.fill(0, ["n"])


@query("layer_catalogue", "SELECT p_name AS name, CAST(y AS INT) AS year, CASE WHEN p_size % 2 = 0 THEN 'x/' || p_partkey || '_' || y || '.tif' ELSE 'x/' || p_partkey || '.tif' END AS path FROM part, unnest(range(2000, 2004)) AS u(y)")
def layer_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    temporal = F.col("p_size") % 2 == 0
    cat = p.select(F.col("p_name").alias("name"), F.when(temporal, "temporal").otherwise("static").alias("type"), F.concat(F.lit("x/"), F.col("p_partkey"), F.when(temporal, "_{year}.tif").otherwise(".tif")).alias("path"))
    return C.expand_layers(cat, 2000, 2003).select("name", "year", "path")


@query("pixel_window", "SELECT o_orderkey, CAST(floor((500000 - o_totalprice) / 1000) AS BIGINT) AS row, CAST(floor(CAST(o_custkey AS DOUBLE) / 10) AS BIGINT) AS col FROM orders WHERE floor((500000 - o_totalprice) / 1000) BETWEEN 100 AND 199 AND floor(CAST(o_custkey AS DOUBLE) / 10) BETWEEN 2 AND 9")
def pixel_window(spark: SparkSession, sf: str) -> DataFrame:
    row, _ = C.pixel_of(F.lit(0.0), F.col("o_totalprice"), 0.0, 500000.0, 1000.0)
    col = F.floor(F.col("o_custkey") / 10).cast("long")
    cells = table(spark, sf, "orders").select("o_orderkey", row.alias("row"), col.alias("col"))
    return cells.where(F.col("col") >= 2).transform(lambda d: C.window_of(d, (2.0, 300.0, 10.0, 400.0), 0.0, 500.0, 1.0))


@query("overview_mean", "SELECT CAST(floor(p_size / 5.0) AS BIGINT) AS row, CAST(floor((p_partkey % 40) / 5.0) AS BIGINT) AS col, round(avg(p_retailprice), 6) AS v FROM part GROUP BY 1, 2")
def overview_mean(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_size").alias("row"), (F.col("p_partkey") % 40).alias("col"), F.col("p_retailprice").alias("v"))
    return C.overview(p, 5, "v").withColumn("v", F.round("v", 6))


@query("anti_resume", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def anti_resume(spark: SparkSession, sf: str) -> DataFrame:
    done = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return C.pending(table(spark, sf, "customer").select("c_custkey"), done, ["c_custkey"])


@query("semi_keys", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity = 50)")
def semi_keys(spark: SparkSession, sf: str) -> DataFrame:
    big = table(spark, sf, "lineitem").where("l_quantity = 50").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").join(big, "o_orderkey", "left_semi").select("o_orderkey")


@query("tile_join", "SELECT n_name, CAST(year(o_orderdate) AS INT) AS year, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")
def tile_join(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    li = li.join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return li.groupBy("n_name", F.year("o_orderdate").alias("year")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query(
    "photon_filter",
    """WITH p AS (SELECT doc_id, n_chars % 70 AS n, n_chars % 25 AS te, CASE WHEN length(a) > 0 THEN len(string_split(a, ',')) ELSE 0 END + CASE WHEN length(b) > 0 THEN len(string_split(b, ',')) ELSE 0 END AS tokens, n_chars % 7 AS veg FROM (SELECT doc_id, n_chars, substr(text, 1, CAST(length(text) // 2 AS BIGINT)) AS a, substr(text, CAST(length(text) // 2 + 1 AS BIGINT)) AS b FROM documents))
SELECT doc_id, CAST(n + tokens AS BIGINT) AS valid, n - te - veg AS signal FROM p WHERE n + tokens BETWEEN 3 AND 60 AND veg >= 3 AND n - te - veg <= 35""",
)
def photon_filter(spark: SparkSession, sf: str) -> DataFrame:
    from stratagrid.functions.text import count_tokens

    d = table(spark, sf, "documents")
    n, te, veg = F.col("n_chars") % 70, F.col("n_chars") % 25, F.col("n_chars") % 7
    half = F.floor(F.length("text") / 2).cast("int")
    valid = n + count_tokens(F.substring("text", F.lit(1), half)) + count_tokens(F.substring("text", half + 1, F.length("text")))
    return d.select("doc_id", valid.cast("long").alias("valid"), (n - te - veg).alias("signal"), veg.alias("veg")).where(F.col("valid").between(3, 60) & (F.col("veg") >= 3) & (F.col("signal") <= 35)).drop("veg")

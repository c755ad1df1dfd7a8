"""Queries over series: outliers, breaks, smoothing, gaps, trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratagrid.operators import series as S
from stratagrid.plans import frames as A
from stratagrid.plans.registry import query
from stratagrid.session import table


def _flag(v: str, lags: int, alias: str = "w") -> str:
    return " OR ".join(f"coalesce(CASE WHEN {v} = 0 THEN lag({v}, {k}) OVER {alias} <> 0 ELSE abs({v} - lag({v}, {k}) OVER {alias}) / {v} > {0.3 * k} END, false)" for k in range(1, lags + 1))


_OUT = f"""o AS (SELECT cell, year, v, ({_flag("v", 3)}) AS outlier FROM cy WINDOW w AS (PARTITION BY cell ORDER BY year))"""


@query("outlier_lag", f"WITH {A.CUSTOMER_YEARS}, {_OUT} SELECT cell, CAST(sum(CASE WHEN outlier THEN 1 ELSE 0 END) AS BIGINT) AS n_outliers, round(sum(CASE WHEN NOT outlier THEN v END), 2) AS kept_sum FROM o GROUP BY cell")
def outlier_lag(spark: SparkSession, sf: str) -> DataFrame:
    out = S.drop_outliers(A.customer_years(spark, sf), ["cell"], "year", "v")
    return out.groupBy("cell").agg(F.sum(F.col("outlier").cast("int")).alias("n_outliers"), F.round(F.sum("cleaned"), 2).alias("kept_sum"))


_BREAK = f"""c AS (SELECT cell, year, CASE WHEN NOT outlier THEN v END AS v FROM o),
f AS (SELECT *, ({_flag("v", 1)}) AS flag FROM c WINDOW w AS (PARTITION BY cell ORDER BY year)),
b AS (SELECT *, max(CASE WHEN flag THEN year END) OVER (PARTITION BY cell) AS bp FROM f)"""


@query("breakpoint_trunc", f"WITH {A.CUSTOMER_YEARS}, {_OUT}, {_BREAK} SELECT cell, year, CASE WHEN bp IS NULL OR year >= bp THEN v END AS kept FROM b")
def breakpoint_trunc(spark: SparkSession, sf: str) -> DataFrame:
    clean = S.drop_outliers(A.customer_years(spark, sf), ["cell"], "year", "v").select("cell", "year", F.col("cleaned").alias("v"))
    return S.truncate_at_break(clean, ["cell"], "year", "v").select("cell", "year", "kept")


@query(
    "series_counts",
    f"WITH {A.CUSTOMER_YEARS}, {_OUT}, {_BREAK} SELECT cell, CAST(count(v) - count(CASE WHEN bp IS NULL OR year >= bp THEN v END) AS BIGINT) AS n_breaks, CAST(count(CASE WHEN bp IS NULL OR year >= bp THEN v END) AS BIGINT) AS n_years FROM b GROUP BY cell",
)
def series_counts(spark: SparkSession, sf: str) -> DataFrame:
    clean = S.drop_outliers(A.customer_years(spark, sf), ["cell"], "year", "v").select("cell", "year", F.col("cleaned").alias("v"))
    return S.truncate_at_break(clean, ["cell"], "year", "v").groupBy("cell").agg((F.count("v") - F.count("kept")).alias("n_breaks"), F.count("kept").alias("n_years"))


@query("ols_trend", f"WITH {A.PART_YEARS} SELECT cell, round(regr_slope(v, year), 6) AS slope, round(avg(v) - regr_slope(v, year) * avg(year), 3) AS intercept, count(v) AS n FROM py GROUP BY cell")
def ols_trend(spark: SparkSession, sf: str) -> DataFrame:
    t = S.linear_trend(A.part_years(spark, sf), ["cell"], "year", "v")
    return t.select("cell", F.round("slope", 6).alias("slope"), F.round("intercept", 3).alias("intercept"), "n")


_P = "((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-x * x)"
_MK = f"""pairs AS (SELECT a.cell, sum(sign(b.v - a.v)) AS s FROM py a JOIN py b ON a.cell = b.cell AND b.year > a.year GROUP BY a.cell),
n AS (SELECT cell, count(*) AS n FROM py GROUP BY cell),
z AS (SELECT n.cell, n.n, CAST(coalesce(s, 0) AS BIGINT) AS s, (coalesce(s, 0) - sign(coalesce(s, 0))) / nullif(sqrt(n.n * (n.n - 1) * (2 * n.n + 5) / 18.0), 0) AS z FROM n LEFT JOIN pairs USING (cell)),
x AS (SELECT *, abs(z) / sqrt(2) AS x, 1 / (1 + 0.3275911 * abs(z) / sqrt(2)) AS t FROM z),
mk AS (SELECT cell, CAST(n AS BIGINT) AS n, s, round(z, 6) AS z, round({_P}, 6) AS p, {_P} AS raw FROM x)"""


@query("mk_trend", f"WITH {A.PART_YEARS}, {_MK} SELECT cell, n, s, z, p FROM mk")
def mk_trend(spark: SparkSession, sf: str) -> DataFrame:
    return S.mann_kendall(A.part_years(spark, sf), ["cell"], "year", "v").select("cell", "n", "s", F.round("z", 6).alias("z"), F.round("p", 6).alias("p"))


@query(
    "trend_filtered",
    f"WITH {A.PART_YEARS}, {_MK}, tr AS (SELECT cell, regr_slope(v, year) AS slope, count(v) AS n FROM py GROUP BY cell) SELECT tr.cell, round(CASE WHEN tr.n = 7 AND raw <= 0.2 THEN slope END, 6) AS slope, CASE WHEN tr.n = 7 THEN p END AS p FROM tr JOIN mk USING (cell)",
)
def trend_filtered(spark: SparkSession, sf: str) -> DataFrame:
    s = A.part_years(spark, sf)
    out = S.significant_trend(S.linear_trend(s, ["cell"], "year", "v"), S.mann_kendall(s, ["cell"], "year", "v"), ["cell"], 7, 0.2)
    return out.select("cell", F.round("slope", 6).alias("slope"), F.round("p", 6).alias("p"))


_SG = "(-3 * lag(v, 2) OVER w + 12 * lag(v, 1) OVER w + 17 * v + 12 * lead(v, 1) OVER w - 3 * lead(v, 2) OVER w) / 35"


@query("savgol_1d", f"WITH {A.USER_DAYS} SELECT cell, day, round({_SG}, 4) AS smooth FROM ud WINDOW w AS (PARTITION BY cell ORDER BY day)")
def savgol_1d(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("cell").orderBy("day")
    return A.user_days(spark, sf).select("cell", "day", F.round(S.savgol_5(F.col("v"), w), 4).alias("smooth"))


@query("madi", f"WITH {A.USER_DAYS}, s AS (SELECT cell, v, {_SG} AS smooth FROM ud WINDOW w AS (PARTITION BY cell ORDER BY day)) SELECT cell, round(avg(abs(v - smooth)), 4) AS madi FROM s GROUP BY cell")
def madi(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("cell").orderBy("day")
    d = A.user_days(spark, sf).withColumn("s", S.savgol_5(F.col("v"), w))
    return d.groupBy("cell").agg(F.round(F.avg(F.abs(F.col("v") - F.col("s"))), 4).alias("madi"))


@query("savgol_cube")
def savgol_cube(spark: SparkSession, sf: str) -> DataFrame:
    """Parts on a grid of 40 columns, years as time, 40-row tiles."""
    s = A.part_years(spark, sf)
    cube = s.select(F.floor(F.col("cell") / 1600).cast("int").alias("tile"), F.col("year").alias("t"), F.floor(F.col("cell") / 40).cast("int").alias("row"), (F.col("cell") % 40).cast("int").alias("col"), F.col("v").alias("value"))
    return S.savgol_cube(cube).select("tile", "t", "row", "col", F.round("smooth", 4).alias("smooth"))


@query("first_last_diff", f"WITH {A.USER_DAYS} SELECT cell, round(arg_max(v, day) - arg_min(v, day) + 101, 4) AS diff FROM ud GROUP BY cell")
def first_last_diff(spark: SparkSession, sf: str) -> DataFrame:
    return S.first_last_difference(A.user_days(spark, sf), ["cell"], "day", "v").select("cell", F.round(F.col("diff") + 101, 4).alias("diff"))


_DOM = """c AS (SELECT user_id AS cell, CAST(day(ts) AS INT) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2, 3),
dom AS (SELECT cell, day, event_type AS cls FROM c QUALIFY row_number() OVER (PARTITION BY cell, day ORDER BY n DESC, event_type) = 1)"""


def dominant_kind(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "events").groupBy(F.col("user_id").alias("cell"), F.dayofmonth("ts").alias("day"), "event_type").count()
    return c.groupBy("cell", "day").agg(F.min(F.struct((-F.col("count")).alias("n"), "event_type")).alias("m")).select("cell", "day", F.col("m.event_type").alias("cls"))


@query(
    "mode_filter",
    f"""WITH {_DOM}, o AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY day) AS i FROM dom),
k AS (SELECT a.cell, a.day, b.cls, count(*) AS n FROM o a JOIN o b ON a.cell = b.cell AND b.i BETWEEN a.i - 2 AND a.i + 2 GROUP BY 1, 2, 3)
SELECT cell, day, cls AS mode FROM k QUALIFY row_number() OVER (PARTITION BY cell, day ORDER BY n DESC, cls) = 1""",
)
def mode_filter(spark: SparkSession, sf: str) -> DataFrame:
    return S.mode_filter(dominant_kind(spark, sf), ["cell"], "day", "cls").select("cell", "day", "mode")


_W = S.gap_weights(6, 30)


@query(
    "gap_fill_weighted",
    f"""WITH {A.USER_DAYS}, g AS (SELECT c.cell, d.day, ud.v FROM (SELECT DISTINCT cell FROM ud) c CROSS JOIN (SELECT DISTINCT day FROM ud) d LEFT JOIN ud ON ud.cell = c.cell AND ud.day = d.day),
wt AS (SELECT CAST(unnest(range(0, 30)) AS INT) AS lag, unnest({_W!r}::DOUBLE[]) AS w),
m AS (SELECT g.cell, g.day, sum(w * ud.v) / nullif(sum(w), 0) AS mean FROM g JOIN ud ON ud.cell = g.cell JOIN wt ON wt.lag = abs(ud.day - g.day) WHERE g.v IS NULL GROUP BY 1, 2)
SELECT g.cell, g.day, round(coalesce(g.v, mean), 4) AS filled FROM g LEFT JOIN m ON m.cell = g.cell AND m.day = g.day""",
)
def gap_fill_weighted(spark: SparkSession, sf: str) -> DataFrame:
    d = A.user_days(spark, sf)
    grid = S.dense_grid(d, ["cell"], "day", d.select("day").distinct(), "v")
    return S.fill_gaps(grid, ["cell"], "day", "v", _W).select("cell", "day", F.round("filled", 4).alias("filled"))


@query(
    "stability_index",
    "WITH m AS (SELECT c_mktsegment AS segment, year(o_orderdate) AS year, round(avg(o_totalprice), 6) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), d AS (SELECT segment, abs(v - lag(v) OVER w) / nullif(lag(v) OVER w, 0) * 100 AS c FROM m WINDOW w AS (PARTITION BY segment ORDER BY year)) SELECT segment, round(avg(c), 6) AS stability FROM d GROUP BY segment",
)
def stability_index(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    m = o.groupBy(F.col("c_mktsegment").alias("segment"), F.year("o_orderdate").alias("year")).agg(F.round(F.avg("o_totalprice"), 6).alias("v"))
    return S.stability(m, ["segment"], "year", "v").select("segment", F.round("stability", 6).alias("stability"))

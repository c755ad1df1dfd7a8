"""Operators on yearly or periodic series of one key: outliers, breaks, smoothing, gaps, trends.

A series is a long table (keys, t, value). Windows are partitioned by the keys, so a series is
one small group; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratagrid.functions.indices import normal_tail


def dense_grid(df: DataFrame, keys: list[str], t: str, times: DataFrame, value: str) -> DataFrame:
    """One row for each key and each of the given times (a small table), NULL where df has none."""
    return df.select(*keys).distinct().crossJoin(F.broadcast(times)).join(df.select(*keys, t, value), [*keys, t], "left")


def relative_change_flag(value: Column, window: Window, lags: int, threshold: float) -> Column:
    """True where |v - v[-w]| / v exceeds threshold * w for some lag w in 1..lags; a zero after a non-zero is flagged."""
    flags = []
    for w in range(1, lags + 1):
        before = F.lag(value, w).over(window)
        flags.append(F.when(value == 0, before != 0).otherwise(F.abs(value - before) / value > threshold * w))
    return F.coalesce(F.greatest(*[F.coalesce(f, F.lit(False)) for f in flags], F.lit(False)), F.lit(False))


def drop_outliers(df: DataFrame, keys: list[str], t: str, value: str, lags: int = 3, threshold: float = 0.3) -> DataFrame:
    """df with column cleaned (NULL where flagged) and outlier (the flag); flags are from the series as given."""
    w = Window.partitionBy(*keys).orderBy(t)
    out = df.withColumn("outlier", relative_change_flag(F.col(value), w, lags, threshold))
    return out.withColumn("cleaned", F.when(~F.col("outlier"), F.col(value)))


def truncate_at_break(df: DataFrame, keys: list[str], t: str, value: str, threshold: float = 0.3) -> DataFrame:
    """df with column kept: NULL before the last lag-1 break of the series."""
    w, all_ = Window.partitionBy(*keys).orderBy(t), Window.partitionBy(*keys)
    out = df.withColumn("_flag", relative_change_flag(F.col(value), w, 1, threshold))
    out = out.withColumn("_break", F.max(F.when(F.col("_flag"), F.col(t))).over(all_))
    return out.withColumn("kept", F.when(F.col("_break").isNull() | (F.col(t) >= F.col("_break")), F.col(value))).drop("_flag", "_break")


#: Quadratic or cubic Savitzky-Golay weights for five points.
SAVGOL_5 = (-3, 12, 17, 12, -3)


def savgol_5(value: Column, window: Window) -> Column:
    """Five-point smoothing; NULL in the two places at each end and next to gaps."""
    terms = [c * (F.lag(value, 2 - i).over(window) if i != 2 else value) for i, c in enumerate(SAVGOL_5)]
    return sum(terms[1:], terms[0]) / 35


def savgol_cube(df: DataFrame, tile: str = "tile", window: int = 5, order: int = 3) -> DataFrame:
    """Savitzky-Golay smoothing over time, row and column of each tile: (tile, t, row, col, value) rows.

    The least-squares cubic polynomial in three variables over a window of side `window` is
    evaluated at its centre; edges repeat the outermost values. Tiles are worked on alone, so
    give them a halo where seams matter.
    """
    import numpy as np
    import pandas as pd

    half = window // 2
    grid = np.array([(a, b, c) for a in range(-half, half + 1) for b in range(-half, half + 1) for c in range(-half, half + 1)], float)
    powers = [(i, j, k) for i in range(order + 1) for j in range(order + 1) for k in range(order + 1) if i + j + k <= order]
    design = np.stack([grid[:, 0] ** i * grid[:, 1] ** j * grid[:, 2] ** k for i, j, k in powers], axis=1)
    kernel = np.linalg.pinv(design)[0].reshape(window, window, window)

    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        axes = [np.unique(pdf[c]) for c in ("t", "row", "col")]
        at = tuple(np.searchsorted(a, pdf[c]) for a, c in zip(axes, ("t", "row", "col"), strict=True))
        cube = np.full([len(a) for a in axes], np.nan)
        cube[at] = pdf["value"]
        padded = np.pad(cube, half, mode="edge")
        views = np.lib.stride_tricks.sliding_window_view(padded, (window,) * 3)
        out = np.einsum("abcijk,ijk->abc", views, kernel)
        return pdf.assign(smooth=out[at])

    return df.groupBy(tile).applyInPandas(smooth, f"{tile} {dict(df.dtypes)[tile]}, t int, row int, col int, value double, smooth double")


def mode_filter(df: DataFrame, keys: list[str], t: str, cls: str, half: int = 2) -> DataFrame:
    """df with column mode: the most frequent class within half steps; ties go to the least class."""
    w = Window.partitionBy(*keys).orderBy(t).rowsBetween(-half, half)
    seen = F.collect_list(cls).over(w)
    counts = F.transform(F.array_distinct(seen), lambda c: F.struct((-F.size(F.filter(seen, lambda x: x == c))).alias("n"), c.alias("c")))
    return df.withColumn("mode", F.array_min(counts)["c"])


def gap_weights(season: int, n: int, att_env: float = 46.0, att_seas: float = 45.0, period: int = 3) -> list[float]:
    """Weight of each lag 0..n-1: ten to the seasonal base plus the envelope."""
    slope = att_seas / 10 / period
    base = [-slope * i if i <= period else slope * (i - period) - period * slope for i in range(season)]
    return [10 ** (base[i % season] - att_env / 10 / n * i) for i in range(n)]


def fill_gaps(df: DataFrame, keys: list[str], t: str, value: str, weights: list[float]) -> DataFrame:
    """df with column filled: where value is NULL, the mean of the series' other values weighted by their lag in t."""
    table = F.array(*[F.lit(float(x)) for x in weights])
    all_ = F.collect_list(F.when(F.col(value).isNotNull(), F.struct(F.col(t).alias("t"), F.col(value).alias("v")))).over(Window.partitionBy(*keys).orderBy(t).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    weight = lambda x: F.coalesce(F.get(table, F.abs(x["t"] - F.col(t)).cast("int")), F.lit(0.0))
    total = lambda f: F.aggregate(F.col("_all"), F.lit(0.0), lambda a, x: a + f(x))
    mean = F.try_divide(total(lambda x: weight(x) * x["v"]), total(weight))
    return df.withColumn("_all", all_).withColumn("filled", F.coalesce(F.col(value), mean)).drop("_all")


def first_last_difference(df: DataFrame, keys: list[str], t: str, value: str) -> DataFrame:
    """keys, diff: the last value minus the first."""
    return df.groupBy(*keys).agg((F.max_by(value, t) - F.min_by(value, t)).alias("diff"))


def linear_trend(df: DataFrame, keys: list[str], t: str, value: str) -> DataFrame:
    """keys, slope, intercept, n of the least-squares line."""
    return df.groupBy(*keys).agg(F.regr_slope(F.col(value), F.col(t)).alias("slope"), F.regr_intercept(F.col(value), F.col(t)).alias("intercept"), F.count(value).alias("n"))


def mann_kendall(df: DataFrame, keys: list[str], t: str, value: str) -> DataFrame:
    """keys, n, s, z, p: the rank trend test (no tie correction, continuity correction of one).

    Pairs are taken within each series by a higher-order expression, so no row is multiplied.
    """
    got = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(t).alias("t"), F.col(value).cast("double").alias("v")))).alias("_s"))
    later = lambda x, i: F.slice("_s", i + 2, F.size("_s"))
    s = F.aggregate(F.transform("_s", lambda x, i: F.aggregate(later(x, i), F.lit(0), lambda a, y: a + F.signum(y["v"] - x["v"]).cast("int"))), F.lit(0), lambda a, b: a + b)
    n = F.size("_s").cast("double")
    got = got.select(*keys, F.size("_s").cast("long").alias("n"), s.cast("long").alias("s"), (n * (n - 1) * (2 * n + 5) / 18).alias("_var"))
    z = F.try_divide(F.col("s") - F.signum(F.col("s").cast("double")), F.sqrt("_var"))
    return got.withColumn("z", z).withColumn("p", normal_tail(F.col("z"))).drop("_var")


def significant_trend(trend: DataFrame, test: DataFrame, keys: list[str], years: int, level: float = 0.05) -> DataFrame:
    """keys, slope (NULL unless every year is there and p <= level), p."""
    both = trend.join(test.select(*keys, "p"), keys)
    whole = F.col("n") == years
    return both.select(*keys, F.when(whole & (F.col("p") <= level), F.col("slope")).alias("slope"), F.when(whole, F.col("p")).alias("p"))


def stability(df: DataFrame, keys: list[str], t: str, value: str) -> DataFrame:
    """keys, stability: mean of |change| in percent of the value before."""
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(t)
    before = F.lag(value).over(w)
    change = df.withColumn("_c", F.try_divide(F.abs(F.col(value) - before), before) * 100)
    return change.groupBy(*keys).agg(F.avg("_c").alias("stability"))

"""Accuracy metrics as grouped aggregates over columns of truth (y) and prediction (p)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _group(df: DataFrame, keys: list[str]):
    return df.groupBy(*keys) if keys else df.groupBy()


def binary_metrics(df: DataFrame, keys: list[str], y: str, p: str) -> DataFrame:
    """keys, n, accuracy, precision, recall, f1 of 0/1 columns."""
    one = lambda c: F.sum(c.cast("long"))
    t, q = F.col(y) == 1, F.col(p) == 1
    c = _group(df, keys).agg(F.count("*").alias("n"), one(t & q).alias("tp"), one(~t & q).alias("fp"), one(t & ~q).alias("fn"), one(t == q).alias("right"))
    return c.select(*keys, "n", F.try_divide("right", "n").alias("accuracy"), F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"), F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall"), F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def class_report(df: DataFrame, y: str, p: str) -> DataFrame:
    """class, precision, recall, f1, support of every class, from one confusion count."""
    pairs = df.groupBy(F.col(y).alias("y"), F.col(p).alias("p")).count()
    both = pairs.select(F.explode(F.array(F.struct(F.col("y").alias("class"), F.lit(True).alias("truth")), F.struct(F.col("p").alias("class"), F.lit(False).alias("truth")))).alias("c"), (F.col("y") == F.col("p")).alias("hit"), "count")
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("count"))), F.lit(0))
    c = both.groupBy("c.class").agg(n(F.col("c.truth") & F.col("hit")).alias("tp"), n(F.col("c.truth")).alias("support"), n(~F.col("c.truth")).alias("said"))
    return c.select("class", F.try_divide("tp", "said").alias("precision"), F.try_divide("tp", "support").alias("recall"), F.try_divide(2 * F.col("tp"), F.col("support") + F.col("said")).alias("f1"), "support")


def balanced_threshold(df: DataFrame, y: str, score: str) -> DataFrame:
    """One row: the score at which precision and recall are nearest, with both; ties to the highest score.

    Counts are by distinct score, so the running sums are over score values, not rows.
    """
    by = df.groupBy(F.col(score).alias("score")).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("long")).alias("pos"))
    w = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    total = by.agg(F.sum("pos").alias("_all"))
    c = by.withColumns({"tp": F.sum("pos").over(w), "said": F.sum("n").over(w)}).crossJoin(F.broadcast(total))
    c = c.withColumns({"precision": F.col("tp") / F.col("said"), "recall": F.try_divide("tp", "_all")})
    best = F.max_by(F.struct("score", "precision", "recall"), F.struct(F.round(1 - F.abs(F.col("precision") - F.col("recall")), 9), F.col("score")))
    return c.agg(best.alias("b")).select("b.*")


def log_loss_skill(df: DataFrame, keys: list[str], y: str, prob: str, eps: float = 1e-15) -> DataFrame:
    """keys, skill: 1 - log loss over that of the base rate (the rate for positives, its complement for the others)."""
    p = F.least(F.greatest(F.col(prob), F.lit(eps)), F.lit(1 - eps))
    loss = -F.when(F.col(y) == 1, F.log(p)).otherwise(F.log(1 - p))
    g = _group(df, keys).agg(F.avg(loss).alias("loss"), F.avg(F.col(y).cast("double")).alias("rate"))
    r = F.col("rate")
    dumb = -(r * F.log(r) + (1 - r) * F.log(1 - r))
    return g.select(*keys, F.when((r > 0) & (r < 1), 1 - F.col("loss") / dumb).alias("skill"))


def tweedie_deviance(y: Column, p: Column, power: int = 1) -> Column:
    """Unit deviance of power 1 (Poisson) or 2 (gamma)."""
    if power == 1:
        return 2 * (F.when(y > 0, y * F.log(y / p)).otherwise(0.0) - y + p)
    return 2 * (F.log(p / y) + y / p - 1)


def regression_metrics(df: DataFrame, keys: list[str], y: str, p: str) -> DataFrame:
    """keys, rmse, r2, d2 (power 1), rmsle, nrmse_sd/mean/minmax/iqr, ccc: two grouped passes."""
    a, b = F.col(y), F.col(p)
    mean = _group(df, keys).agg(F.avg(a).alias("_mean"))
    both = df.join(mean, keys) if keys else df.crossJoin(F.broadcast(mean))
    g = _group(both, keys).agg(
        F.sqrt(F.avg((a - b) * (a - b))).alias("rmse"),
        F.sum((a - b) * (a - b)).alias("_res"),
        F.sum((a - F.col("_mean")) * (a - F.col("_mean"))).alias("_tot"),
        F.avg(tweedie_deviance(a, b)).alias("_dev"),
        F.avg(tweedie_deviance(a, F.col("_mean"))).alias("_dev0"),
        F.sqrt(F.avg(F.pow(F.log1p(a) - F.log1p(b), F.lit(2)))).alias("rmsle"),
        F.stddev_pop(a).alias("_sd"),
        F.avg(a).alias("_m"),
        (F.max(a) - F.min(a)).alias("_range"),
        F.percentile(y, F.array(F.lit(0.25), F.lit(0.75))).alias("_q"),
        F.covar_pop(a, b).alias("_cov"),
        F.var_pop(a).alias("_va"),
        F.var_pop(b).alias("_vb"),
        F.avg(b).alias("_mb"),
    )
    r = F.col("rmse")
    return g.select(
        *keys,
        "rmse",
        (1 - F.try_divide("_res", "_tot")).alias("r2"),
        (1 - F.try_divide("_dev", "_dev0")).alias("d2"),
        "rmsle",
        F.try_divide(r, F.col("_sd")).alias("nrmse_sd"),
        F.try_divide(r, F.col("_m")).alias("nrmse_mean"),
        F.try_divide(r, F.col("_range")).alias("nrmse_minmax"),
        F.try_divide(r, F.element_at("_q", 2) - F.element_at("_q", 1)).alias("nrmse_iqr"),
        F.try_divide(2 * F.col("_cov"), F.col("_va") + F.col("_vb") + F.pow(F.col("_m") - F.col("_mb"), F.lit(2))).alias("ccc"),
    )


def weighted_concordance(df: DataFrame, keys: list[str], y: str, p: str, w: str) -> DataFrame:
    """keys, ccc with sample weights, from weighted sums."""
    a, b, c = F.col(y), F.col(p), F.col(w)
    s = _group(df, keys).agg(F.sum(c).alias("w"), F.sum(c * a).alias("a"), F.sum(c * b).alias("b"), F.sum(c * a * a).alias("aa"), F.sum(c * b * b).alias("bb"), F.sum(c * a * b).alias("ab"))
    ma, mb = F.col("a") / F.col("w"), F.col("b") / F.col("w")
    va, vb, cov = F.col("aa") / F.col("w") - ma * ma, F.col("bb") / F.col("w") - mb * mb, F.col("ab") / F.col("w") - ma * mb
    return s.select(*keys, F.try_divide(2 * cov, va + vb + (ma - mb) * (ma - mb)).alias("ccc"))


def interval_coverage(df: DataFrame, keys: list[str], y: str, low: str, high: str) -> DataFrame:
    """keys, picp: share of rows strictly inside their interval."""
    inside = (F.col(low) < F.col(y)) & (F.col(y) < F.col(high))
    return _group(df, keys).agg(F.avg(inside.cast("double")).alias("picp"))


def interval_sd(low: Column, high: Column) -> Column:
    return (high - low) / 4

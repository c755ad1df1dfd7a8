"""Queries of metrics, with prices and labels as truth and prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagrid.operators import metrics as M
from stratagrid.plans.registry import query
from stratagrid.session import table

_T = "t AS (SELECT lang, quality AS y, CASE WHEN n_chars % 10 < 6 THEN 1 ELSE 0 END AS p, 0.05 + (n_chars % 90) / 100.0 AS prob FROM labels JOIN documents USING (doc_id))"


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    return j.select("lang", F.col("quality").alias("y"), (F.col("n_chars") % 10 < 6).cast("int").alias("p"), (0.05 + F.col("n_chars") % 90 / 100.0).alias("prob"))


@query(
    "conf_metrics",
    f"""WITH {_T}, c AS (SELECT lang, count(*) AS n, sum(CASE WHEN y = 1 AND p = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN y = 0 AND p = 1 THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN y = 1 AND p = 0 THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN y = p THEN 1 ELSE 0 END) AS ok FROM t GROUP BY 1)
SELECT lang, n, round(ok / n, 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c""",
)
def conf_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = M.binary_metrics(_labelled(spark, sf), ["lang"], "y", "p")
    return m.select("lang", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query(
    "class_report",
    """WITH t AS (SELECT l_returnflag AS y, CASE WHEN l_quantity < 15 THEN 'A' WHEN l_quantity < 30 THEN 'N' ELSE 'R' END AS p FROM lineitem), k AS (SELECT DISTINCT y AS class FROM t UNION SELECT DISTINCT p FROM t),
c AS (SELECT class, count(*) FILTER (y = class AND p = class) AS tp, count(*) FILTER (y = class) AS support, count(*) FILTER (p = class) AS said FROM k, t GROUP BY 1)
SELECT class, round(tp / nullif(said, 0), 6) AS precision, round(tp / nullif(support, 0), 6) AS recall, round(2 * tp / (support + said), 6) AS f1, support FROM c""",
)
def class_report(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("l_quantity")
    t = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("y"), F.when(q < 15, "A").when(q < 30, "N").otherwise("R").alias("p"))
    r = M.class_report(t, "y", "p")
    return r.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(
    "pr_threshold",
    f"""WITH {_T}, b AS (SELECT round(prob, 4) AS score, count(*) AS n, sum(y) AS pos FROM t GROUP BY 1), c AS (SELECT score, sum(pos) OVER w AS tp, sum(n) OVER w AS said, sum(pos) OVER () AS total FROM b WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT score, round(tp / said, 6) AS precision, round(tp / total, 6) AS recall FROM c ORDER BY round(1 - abs(tp / said - tp / total), 9) DESC, score DESC LIMIT 1""",
)
def pr_threshold(spark: SparkSession, sf: str) -> DataFrame:
    t = _labelled(spark, sf).withColumn("prob", F.round("prob", 4))
    return M.balanced_threshold(t, "y", "prob").select("score", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(
    "r2_logloss",
    f"""WITH {_T}, g AS (SELECT lang, avg(-CASE WHEN y = 1 THEN ln(prob) ELSE ln(1 - prob) END) AS loss, avg(y) AS r FROM t GROUP BY 1)
SELECT lang, CASE WHEN r > 0 AND r < 1 THEN round(1 - loss / -(r * ln(r) + (1 - r) * ln(1 - r)), 6) END AS skill FROM g""",
)
def r2_logloss(spark: SparkSession, sf: str) -> DataFrame:
    return M.log_loss_skill(_labelled(spark, sf), ["lang"], "y", "prob").select("lang", F.round("skill", 6).alias("skill"))


_R = "r AS (SELECT l_returnflag AS g, l_extendedprice / 1000 AS y, l_quantity * 1.4 + l_tax * 50 + 1 AS p, l_quantity AS w FROM lineitem)"


def _prices(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("g"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_quantity") * 1.4 + F.col("l_tax") * 50 + 1).alias("p"), F.col("l_quantity").alias("w"))


@query(
    "regression_metrics",
    f"""WITH {_R}, m AS (SELECT *, avg(y) OVER (PARTITION BY g) AS ym FROM r),
a AS (SELECT g, sqrt(avg((y - p) * (y - p))) AS rmse, sum((y - p) * (y - p)) / sum((y - ym) * (y - ym)) AS res, avg(2 * (CASE WHEN y > 0 THEN y * ln(y / p) ELSE 0 END - y + p)) / avg(2 * (CASE WHEN y > 0 THEN y * ln(y / ym) ELSE 0 END - y + ym)) AS dev,
  sqrt(avg(pow(ln(1 + y) - ln(1 + p), 2))) AS rmsle, stddev_pop(y) AS sd, avg(y) AS mean, max(y) - min(y) AS rng, quantile_cont(y, 0.75) - quantile_cont(y, 0.25) AS iqr, covar_pop(y, p) AS cov, var_pop(y) AS vy, var_pop(p) AS vp, avg(p) AS mp FROM m GROUP BY 1)
SELECT g, round(rmse, 6) AS rmse, round(1 - res, 6) AS r2, round(1 - dev, 6) AS d2, round(rmsle, 6) AS rmsle, round(rmse / sd, 6) AS nrmse_sd, round(rmse / mean, 6) AS nrmse_mean, round(rmse / rng, 6) AS nrmse_minmax, round(rmse / iqr, 6) AS nrmse_iqr, round(2 * cov / (vy + vp + pow(mean - mp, 2)), 6) AS ccc FROM a""",
)
def regression_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = M.regression_metrics(_prices(spark, sf), ["g"], "y", "p")
    return m.select("g", *[F.round(c, 6).alias(c) for c in m.columns if c != "g"])


@query("weighted_ccc", f"WITH {_R}, s AS (SELECT g, sum(w) AS w, sum(w * y) / sum(w) AS a, sum(w * p) / sum(w) AS b, sum(w * y * y) / sum(w) AS aa, sum(w * p * p) / sum(w) AS bb, sum(w * y * p) / sum(w) AS ab FROM r GROUP BY 1) SELECT g, round(2 * (ab - a * b) / (aa - a * a + bb - b * b + (a - b) * (a - b)), 6) AS ccc FROM s")
def weighted_ccc(spark: SparkSession, sf: str) -> DataFrame:
    return M.weighted_concordance(_prices(spark, sf), ["g"], "y", "p", "w").select("g", F.round("ccc", 6).alias("ccc"))


@query("tweedie_power2", f"WITH {_R} SELECT g, round(avg(2 * (ln(p / y) + y / p - 1)), 6) AS deviance FROM r GROUP BY 1")
def tweedie_power2(spark: SparkSession, sf: str) -> DataFrame:
    return _prices(spark, sf).groupBy("g").agg(F.round(F.avg(M.tweedie_deviance(F.col("y"), F.col("p"), 2)), 6).alias("deviance"))


@query("interval_percentile", "SELECT l_partkey AS cell, round(quantile_cont(l_extendedprice, 0.05), 4) AS low, round(sum(l_extendedprice), 2) AS total, round(quantile_cont(l_extendedprice, 0.95), 4) AS high, median(l_extendedprice) AS middle FROM lineitem GROUP BY 1")
def interval_percentile(spark: SparkSession, sf: str) -> DataFrame:
    q = F.percentile("l_extendedprice", F.array(F.lit(0.05), F.lit(0.95)))
    g = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("cell")).agg(q.alias("q"), F.round(F.sum("l_extendedprice"), 2).alias("total"), F.median("l_extendedprice").alias("middle"))
    return g.select("cell", F.round(F.element_at("q", 1), 4).alias("low"), "total", F.round(F.element_at("q", 2), 4).alias("high"), "middle")


@query(
    "picp",
    "WITH i AS (SELECT l_partkey, quantile_cont(l_extendedprice, 0.05) AS lo, quantile_cont(l_extendedprice, 0.95) AS hi FROM lineitem GROUP BY 1) SELECT l_returnflag AS g, round(avg(CASE WHEN lo < l_extendedprice AND l_extendedprice < hi THEN 1.0 ELSE 0 END), 6) AS picp, round(avg((hi - lo) / 4), 4) AS sd FROM lineitem JOIN i USING (l_partkey) GROUP BY 1",
)
def picp(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    i = li.groupBy("l_partkey").agg(F.percentile("l_extendedprice", F.array(F.lit(0.05), F.lit(0.95))).alias("q")).select("l_partkey", F.element_at("q", 1).alias("lo"), F.element_at("q", 2).alias("hi"))
    j = li.join(i, "l_partkey").withColumnRenamed("l_returnflag", "g")
    cover = M.interval_coverage(j, ["g"], "l_extendedprice", "lo", "hi")
    sd = j.groupBy("g").agg(F.round(F.avg(M.interval_sd(F.col("lo"), F.col("hi"))), 4).alias("sd"))
    return cover.join(sd, "g").select("g", F.round("picp", 6).alias("picp"), "sd")

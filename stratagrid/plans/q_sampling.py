"""Queries of samples, splits and ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagrid.operators import sampling as S
from stratagrid.plans.registry import query
from stratagrid.session import table


@query("sample_per_group", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY md5('3:' || o_orderkey), o_orderkey) <= 2")
def sample_per_group(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    return S.sample_per_group(o, ["o_custkey", "year"], "o_orderkey", 2, 3).select("o_custkey", "o_orderkey")


@query("sample_fraction", "SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('1:' || o_orderkey), o_orderkey) AS r, floor(count(*) OVER (PARTITION BY o_orderpriority) * 0.1) AS n FROM orders) WHERE r <= n")
def sample_fraction(spark: SparkSession, sf: str) -> DataFrame:
    return S.sample_fraction(table(spark, sf, "orders"), "o_orderpriority", "o_orderkey", 0.1, 1).select("o_orderpriority", "o_orderkey")


@query("bootstrap_weights", "WITH u AS (SELECT o_orderkey, CAST('0x' || substr(md5('1:' || o_orderkey), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM orders) SELECT o_orderkey, CAST(u >= 0.36787944117144233 AS INT) + CAST(u >= 0.7357588823428847 AS INT) + CAST(u >= 0.9196986029286058 AS INT) + CAST(u >= 0.9810118431238462 AS INT) + CAST(u >= 0.9963401531726563 AS INT) + CAST(u >= 0.9994058151824183 AS INT) AS boot_1 FROM u")
def bootstrap_weights(spark: SparkSession, sf: str) -> DataFrame:
    return S.bootstrap_weights(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 1)


_EDGES = ", ".join(f"quantile_cont(v, {i / 10})" for i in range(1, 10))
_BINS = f"t AS (SELECT o_custkey AS tile, count(*) AS v FROM orders GROUP BY 1), e AS (SELECT list_distinct([{_EDGES}]) AS e FROM t), b AS (SELECT tile, v, CAST(len(list_filter(e, lambda x: x < v)) AS BIGINT) AS bin FROM t, e)"


@query("qcut_bins", f"WITH {_BINS} SELECT tile, v, bin FROM b")
def qcut_bins(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("tile")).agg(F.count("*").alias("v"))
    return S.quantile_bins(t, "v", 10)


@query(
    "strat_split",
    f"WITH {_BINS}, r AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY md5('0:' || tile), tile) AS r, floor(count(*) OVER (PARTITION BY bin) * 0.1) AS nt, count(*) OVER (PARTITION BY bin) AS n FROM b) SELECT tile, v, CASE WHEN r <= nt THEN 'test' WHEN r <= nt + floor((n - nt) * 0.1) THEN 'calibration' ELSE 'training' END AS role FROM r",
)
def strat_split(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("tile")).agg(F.count("*").alias("v"))
    return S.stratified_split(t, "tile", "v")


@query(
    "group_folds",
    "WITH s AS (SELECT o_custkey, row_number() OVER (ORDER BY count(*) DESC, o_custkey) - 1 AS k FROM orders GROUP BY 1) SELECT o_orderkey, CAST(CASE WHEN (k // 5) % 2 = 0 THEN k % 5 ELSE 4 - k % 5 END AS INT) AS fold FROM orders JOIN s USING (o_custkey)",
)
def group_folds(spark: SparkSession, sf: str) -> DataFrame:
    return S.group_folds(table(spark, sf, "orders"), "o_custkey", 5).select("o_orderkey", "fold")


@query("cluster_priority", "WITH s AS (SELECT l_partkey AS cluster, count(*) AS size FROM lineitem GROUP BY 1) SELECT cluster, size, row_number() OVER w - 1 AS priority, ntile(10) OVER w AS batch FROM s WINDOW w AS (ORDER BY size DESC, cluster)")
def cluster_priority(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("cluster")).agg(F.count("*").alias("size"))
    return S.priority(s, "size", "cluster")


@query("work_slice", "SELECT s_suppkey FROM supplier ORDER BY s_suppkey LIMIT 5 OFFSET 3")
def work_slice(spark: SparkSession, sf: str) -> DataFrame:
    return S.slice_of(table(spark, sf, "supplier").select("s_suppkey"), "s_suppkey", 3, 8)


@query("top_n", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def top_n(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(20)


@query("sorted_rows", "SELECT n_name, n_regionkey FROM nation ORDER BY n_regionkey DESC, n_name")
def sorted_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select("n_name", "n_regionkey").orderBy(F.desc("n_regionkey"), "n_name")


@query("min_max_weight", "SELECT c_custkey, round((c_acctbal - a * 0.1) / (b - a * 0.1), 6) AS weight FROM customer, (SELECT min(c_acctbal) AS a, max(c_acctbal) AS b FROM customer)")
def min_max_weight(spark: SparkSession, sf: str) -> DataFrame:
    return S.min_max(table(spark, sf, "customer"), "c_acctbal", "weight").select("c_custkey", F.round("weight", 6).alias("weight"))


@query("histogram_2d", "SELECT CAST(floor(l_quantity / 5) AS BIGINT) AS bx, CAST(floor(l_extendedprice / 10000) AS BIGINT) AS by, count(*) AS n FROM lineitem GROUP BY 1, 2")
def histogram_2d(spark: SparkSession, sf: str) -> DataFrame:
    return S.histogram(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", 5.0, 10000.0)


@query("feature_frequency", "WITH a AS (SELECT DISTINCT p_brand AS name FROM part WHERE p_size > 40), b AS (SELECT DISTINCT p_brand AS name FROM part WHERE p_retailprice < 950), u AS (SELECT name FROM a UNION SELECT name FROM b) SELECT u.name, a.name IS NOT NULL AS class_31, b.name IS NOT NULL AS class_32, CAST((a.name IS NOT NULL) AS INT) + CAST((b.name IS NOT NULL) AS INT) AS frequency FROM u LEFT JOIN a ON a.name = u.name LEFT JOIN b ON b.name = u.name")
def feature_frequency(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    long = p.where("p_size > 40").select(F.col("p_brand").alias("name"), F.lit("class_31").alias("m")).union(p.where("p_retailprice < 950").select("p_brand", F.lit("class_32"))).distinct()
    wide = long.groupBy("name").pivot("m", ["class_31", "class_32"]).agg(F.lit(True)).na.fill(False)
    return wide.withColumn("frequency", F.col("class_31").cast("int") + F.col("class_32").cast("int"))

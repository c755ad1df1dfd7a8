"""Queries of model operators; searches and fits have no SQL."""

from __future__ import annotations

from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagrid.functions.indices import box_cox, inverse_box_cox
from stratagrid.operators import ml as M
from stratagrid.operators.boosting import fit_poisson_boosting
from stratagrid.operators.metrics import regression_metrics
from stratagrid.plans.registry import query
from stratagrid.session import table

FEATURES = ["quantity", "discount", "tax", "month", "line"]


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_partkey", F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.month("l_shipdate").cast("double").alias("month"), F.col("l_linenumber").cast("double").alias("line"), (F.col("l_extendedprice") / 1000).alias("price"), (F.col("l_returnflag") == "R").cast("double").alias("returned"))


@query("nearest_centroid", "WITH v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(x) AS c FROM v GROUP BY 1, 2), d AS (SELECT vec_id, c.label AS k, sqrt(sum((x - c) * (x - c))) AS d FROM v JOIN c USING (i) GROUP BY 1, 2) SELECT vec_id, CAST(arg_min(k, d) AS BIGINT) AS nearest, round(min(d), 5) AS distance FROM d GROUP BY 1")
def nearest_centroid(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    flat = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("c"))
    c = flat.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "c"))), lambda s: s["c"]).alias("c"))
    return M.nearest_centroid(e, c, "embedding", "c", "label").select("vec_id", F.col("nearest").cast("long").alias("nearest"), F.round("distance", 5).alias("distance"))


@query("kmeans_fscs")
def kmeans_fscs(spark: SparkSession, sf: str) -> DataFrame:
    rows = _lines(spark, sf).withColumn("id", F.xxhash64("l_orderkey", "l_partkey", "line"))
    return M.coverage_sample(rows, FEATURES, "id", 3, 12)


@query("rf_interval")
def rf_interval(spark: SparkSession, sf: str) -> DataFrame:
    x = M.assemble(_lines(spark, sf).withColumn("bc", box_cox(F.col("price"), 0.5)), FEATURES)
    model = M.fit(RandomForestRegressor(labelCol="bc", numTrees=10, maxDepth=4, seed=1), x)
    out = M.forest_interval(model, x, back=lambda t: inverse_box_cox(t, 0.5))
    return out.select("l_orderkey", "l_partkey", F.round("mean", 4).alias("mean"), F.round("lower", 4).alias("lower"), F.round("upper", 4).alias("upper"))


@query("gbt_ensemble")
def gbt_ensemble(spark: SparkSession, sf: str) -> DataFrame:
    x = M.assemble(_lines(spark, sf).withColumn("id", F.xxhash64("l_orderkey", "l_partkey", "line")), FEATURES)
    models = M.bootstrap_ensemble(GBTRegressor(labelCol="price", weightCol="boot", maxIter=3, maxDepth=3, seed=1), x, "id", 3)
    return M.ensemble_interval(models, x).select("l_orderkey", F.round("mean", 4).alias("mean"), F.round("lower", 4).alias("lower"), F.round("upper", 4).alias("upper"))


@query("group_cv")
def group_cv(spark: SparkSession, sf: str) -> DataFrame:
    rows = _lines(spark, sf).select("l_partkey", "price", *FEATURES)
    x = M.assemble(M.kept(M.grouped_folds(rows, "l_partkey", 3), "folds"), FEATURES)
    held = M.cross_predict(RandomForestRegressor(labelCol="price", numTrees=8, maxDepth=4, seed=1), x, "fold", 3)
    return regression_metrics(held, ["fold"], "price", "prediction")


@query("poisson_glm")
def poisson_glm(spark: SparkSession, sf: str) -> DataFrame:
    x = M.assemble(_lines(spark, sf), FEATURES)
    model = M.fit(GeneralizedLinearRegression(labelCol="price", family="poisson", link="log", regParam=0.01), x)
    return spark.createDataFrame([(n, float(c)) for n, c in zip(FEATURES, model.coefficients, strict=True)], "name string, coefficient double")


@query("poisson_boosting")
def poisson_boosting(spark: SparkSession, sf: str) -> DataFrame:
    rows = _lines(spark, sf)
    model = fit_poisson_boosting(rows, FEATURES, "price", "l_orderkey", rounds=5, depth=3, rate=0.3, l1=0.1, l2=1.0)
    return model.transform(rows).select("l_orderkey", "line", "price", F.round("prediction", 4).alias("prediction"))


@query("rfe")
def rfe(spark: SparkSession, sf: str) -> DataFrame:
    kept = M.eliminate_features(RandomForestRegressor(labelCol="price", numTrees=5, maxDepth=3, seed=1), _lines(spark, sf), FEATURES, 2, 0.3)
    return spark.createDataFrame([(f,) for f in kept], "name string")


@query("halving")
def halving(spark: SparkSession, sf: str) -> DataFrame:
    x = M.assemble(_lines(spark, sf), FEATURES)
    make = lambda p: RandomForestRegressor(labelCol="price", seed=1, **p)
    best = M.halving_search(make, {"numTrees": [3, 6], "maxDepth": [2, 4]}, x, "price", "l_partkey", folds=2, least=2000)
    return spark.createDataFrame([(p["numTrees"], p["maxDepth"], s) for p, s in best], "trees int, depth int, d2 double")


@query("automl")
def automl(spark: SparkSession, sf: str) -> DataFrame:
    found = M.automatic_search(M.assemble(_lines(spark, sf), FEATURES), "price", "l_partkey", 2)
    return spark.createDataFrame(found, "model string, d2 double")


@query("class_probability")
def class_probability(spark: SparkSession, sf: str) -> DataFrame:
    x = M.assemble(_lines(spark, sf), FEATURES)
    model = M.fit(RandomForestClassifier(labelCol="returned", numTrees=8, maxDepth=4, seed=1), x)
    return M.class_percent(model, x).select("l_orderkey", F.round("percent", 4).alias("percent"))


@query("mlp_classifier")
def mlp_classifier(spark: SparkSession, sf: str) -> DataFrame:
    x = M.assemble(_lines(spark, sf), FEATURES)
    model = M.fit(MultilayerPerceptronClassifier(labelCol="returned", layers=[len(FEATURES), 6, 2], maxIter=15, seed=1), x)
    return model.transform(x).groupBy("returned", "prediction").agg(F.count("*").alias("n"))


@query("importance")
def importance(spark: SparkSession, sf: str) -> DataFrame:
    model = M.fit(RandomForestRegressor(labelCol="price", numTrees=8, maxDepth=4, seed=1), M.assemble(_lines(spark, sf), FEATURES))
    return spark.createDataFrame(M.importances(model, FEATURES), "name string, importance double")


@query("partial_dependence")
def partial_dependence(spark: SparkSession, sf: str) -> DataFrame:
    rows = _lines(spark, sf)
    model = M.fit(RandomForestRegressor(labelCol="price", numTrees=8, maxDepth=4, seed=1), M.assemble(rows, FEATURES))
    return M.partial_dependence(model, rows, FEATURES, "quantity", [1, 10, 25, 50]).select("value", F.round("prediction", 4).alias("prediction"))


@query("boxcox_fit")
def boxcox_fit(spark: SparkSession, sf: str) -> DataFrame:
    lam = M.box_cox_lambda(_lines(spark, sf), "price", [i / 10 for i in range(-10, 21)])
    return spark.createDataFrame([(lam,)], "lam double")

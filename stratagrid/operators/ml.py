"""Model operators on pyspark.ml: coverage sampling, feature elimination, halving search, intervals.

Search loops run on the driver over Spark jobs; the data stays distributed. Impurities and losses
are those of pyspark.ml; boosting.py has trees with a Poisson objective.
"""

from __future__ import annotations

from itertools import product
from typing import Any

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagrid.operators.metrics import regression_metrics
from stratagrid.session import scratch


def assemble(df: DataFrame, features: list[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol=name, handleInvalid="skip").transform(df)


def spread(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """df dealt into parts of about most rows where it has more, as learners cache and read each part whole; the parts of files grow with row groups."""
    n = -(-df.count() // most)
    return df if n < 2 else df.repartition(max(n, df.sparkSession.sparkContext.defaultParallelism))


def own_columns(estimator, df: DataFrame, *more: str) -> DataFrame:
    """df with the columns that the estimator reads, and more."""
    own = {estimator.getOrDefault(p) for p in estimator.params if p.name in ("featuresCol", "labelCol", "weightCol") and (estimator.isSet(p) or estimator.hasDefault(p))}
    return df.select(*[c for c in df.columns if c in own or c in more])


def fit(estimator, df: DataFrame):
    """The fitted model, over its own columns of df in parts of bounded size."""
    return estimator.fit(spread(own_columns(estimator, df)))


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written once below the shared folder and read back, for searches that go over it many times."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def cases(df: DataFrame, keys: list[str], label: str, weight: str) -> DataFrame:
    """keys, the mean label and the count of rows (weight) of equal keys: all that squared and Poisson losses take from them."""
    return df.groupBy(*keys).agg(F.avg(label).alias(label), F.count("*").cast("double").alias(weight))


def squared_distance(a: Column, b: Column) -> Column:
    """Of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def nearest_centroid(points: DataFrame, centroids: DataFrame, vector: str, centroid: str, key: str, max_centroids: int = 20_000) -> DataFrame:
    """points with the key and distance of their nearest centroid (ties to the least key).

    The centroids are the few: their number is checked before they are broadcast as one array.
    """
    n = centroids.count()
    if n > max_centroids:
        raise ValueError(f"{n} centroids: over the bound of {max_centroids}")
    table = centroids.agg(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), F.col(centroid).cast("array<double>").alias("c")))).alias("_table"))
    near = F.array_min(F.transform("_table", lambda t: F.struct(squared_distance(F.col(vector).cast("array<double>"), t["c"]).alias("d"), t["k"].alias("k"))))
    out = points.crossJoin(F.broadcast(table)).withColumn("_n", near)
    return out.withColumns({"nearest": F.col("_n.k"), "distance": F.sqrt("_n.d")}).drop("_table", "_n")


def coverage_sample(df: DataFrame, features: list[str], key: str, components: int, clusters: int, seed: int = 1) -> DataFrame:
    """cluster, the sample nearest to its centre, size and priority: standardise, reduce, cluster, pick."""
    x = assemble(df.dropna(subset=features), features, "_raw")
    scaled = StandardScaler(inputCol="_raw", outputCol="_std", withMean=True).fit(x).transform(x)
    reduced = PCA(k=components, inputCol="_std", outputCol="_pc").fit(scaled).transform(scaled)
    model = fit(KMeans(k=clusters, seed=seed, featuresCol="_pc", predictionCol="cluster"), reduced)
    centres = df.sparkSession.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, _c array<double>")
    at = model.transform(reduced).join(F.broadcast(centres), "cluster").withColumn("_d", squared_distance(vector_to_array("_pc"), F.col("_c")))
    best = at.groupBy("cluster").agg(F.count("*").alias("size"), F.min(F.struct("_d", key)).alias("_b"))
    from stratagrid.operators.sampling import priority

    return priority(best.select("cluster", F.col(f"_b.{key}").alias(key), F.sqrt("_b._d").alias("distance"), "size"), "size", "cluster")


def grouped_folds(df: DataFrame, group: str, folds: int) -> DataFrame:
    from stratagrid.operators.sampling import group_folds

    return group_folds(df, group, folds)


def cross_predict(estimator, df: DataFrame, fold: str, folds: int, over: DataFrame | None = None) -> DataFrame:
    """Held-out predictions of every row of df, or of over: one fit a fold, on df."""
    over = df if over is None else over
    out = None
    for k in range(folds):
        part = fit(estimator, df.where(F.col(fold) != k)).transform(over.where(F.col(fold) == k))
        out = part if out is None else out.unionByName(part)
    return out


def importances(model, features: list[str]) -> list[tuple[str, float]]:
    """Normalised importances, greatest first, ties by name."""
    v = model.featureImportances.toArray() if hasattr(model, "featureImportances") else abs(model.coefficients.toArray())
    total = float(v.sum()) or 1.0
    return sorted(((f, float(x) / total) for f, x in zip(features, v, strict=True)), key=lambda t: (-t[1], t[0]))


def eliminate_features(estimator, df: DataFrame, features: list[str], keep: int, step: float = 0.05) -> list[str]:
    """Recursive elimination: the least important share goes until keep are left."""
    own = list(features)
    while len(own) > keep:
        model = fit(estimator, assemble(df, own))
        drop = min(len(own) - keep, max(1, int(step * len(own))))
        own = [f for f, _ in importances(model, own)[: len(own) - drop]]
    return sorted(own, key=features.index)


def halving_search(make, grid: dict[str, list[Any]], df: DataFrame, label: str, group: str, folds: int = 3, factor: float = 2.0, least: int = 500, metric: str = "d2") -> list[tuple[dict, float]]:
    """Successive halving: candidates compete on growing samples of groups, the best share goes on.

    make(params) gives an estimator with featuresCol `features`. Returns the last round's
    candidates with their scores, best first.
    """
    tried = [dict(zip(grid, v, strict=True)) for v in product(*grid.values())]
    n, size = df.count(), least
    scored: list[tuple[dict, float]] = []
    while tried:
        share = min(1.0, size / max(n, 1))
        part = df.where(F.pmod(F.xxhash64(group), F.lit(1000)) < int(1000 * share) + 1)
        part = grouped_folds(part, group, folds).persist()
        scored = []
        for params in tried:
            held = cross_predict(make(params), part, "fold", folds)
            row = regression_metrics(held.withColumn("prediction", F.greatest("prediction", F.lit(1e-6))), [], label, "prediction").first()
            scored.append((params, float(row[metric]) if row[metric] is not None else float("-inf")))
        part.unpersist()
        scored.sort(key=lambda t: -t[1])
        if len(tried) == 1 or share >= 1.0:
            return scored
        tried = [p for p, _ in scored[: max(1, round(len(scored) / factor))]]
        size = int(size * factor)
    return scored


def tree_predictions(model, df: DataFrame, name: str = "trees") -> DataFrame:
    """df with the predictions of every tree as an array."""
    cols = []
    for i, tree in enumerate(model.trees):
        df = tree.setPredictionCol(f"_t{i}").setFeaturesCol("features").transform(df)
        cols.append(f"_t{i}")
    return df.withColumn(name, F.array(*cols)).drop(*cols)


def array_quantile(values: Column, q: float) -> Column:
    """Linear quantile of an array's values."""
    s = F.sort_array(values)
    at = (F.size(s) - 1) * F.lit(q)
    low = F.get(s, F.floor(at).cast("int"))
    return low + (F.get(s, F.ceil(at).cast("int")) - low) * (at - F.floor(at))


def forest_interval(model, df: DataFrame, low: float = 0.025, high: float = 0.975, back=None) -> DataFrame:
    """df with mean, lower and upper over the trees; back (an expression) is applied to each tree first."""
    t = tree_predictions(model, df)
    if back is not None:
        t = t.withColumn("trees", F.transform("trees", back))
    mean = F.aggregate("trees", F.lit(0.0), lambda a, x: a + x) / F.size("trees")
    return t.withColumns({"mean": mean, "lower": array_quantile(F.col("trees"), low), "upper": array_quantile(F.col("trees"), high)}).drop("trees")


def bootstrap_ensemble(estimator, df: DataFrame, key: str, rounds: int, seed: int = 0) -> list:
    """Models fitted with Poisson weights by hash; the estimator takes weightCol `boot`."""
    from stratagrid.operators.sampling import bootstrap_weights

    w = bootstrap_weights(spread(own_columns(estimator, df, key)), key, rounds, seed).persist()
    models = [estimator.fit(w.withColumn("boot", F.col(f"boot_{r}").cast("double")).where("boot > 0")) for r in range(1, rounds + 1)]
    w.unpersist()
    return models


def ensemble_interval(models: list, df: DataFrame, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """df with mean, lower and upper over the models' predictions."""
    cols = []
    for i, m in enumerate(models):
        df = m.transform(df).withColumnRenamed("prediction", f"_m{i}")
        cols.append(f"_m{i}")
    a = F.array(*cols)
    return df.withColumns({"mean": F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / len(cols), "lower": array_quantile(a, low), "upper": array_quantile(a, high)}).drop(*cols)


def class_percent(model, df: DataFrame, cls: int = 0) -> DataFrame:
    """df with percent: the probability of a class in hundredths."""
    return model.transform(df).withColumn("percent", F.get(vector_to_array("probability"), cls) * 100)


def partial_dependence(model, df: DataFrame, features: list[str], name: str, grid: list[float]) -> DataFrame:
    """value, prediction: mean prediction with one feature set to each grid value."""
    values = F.explode(F.array(*[F.lit(float(g)) for g in grid]))
    x = df.select(*features).withColumn("value", values).withColumn(name, F.col("value"))
    return model.transform(assemble(x, features)).groupBy("value").agg(F.avg("prediction").alias("prediction"))


def box_cox_lambda(df: DataFrame, value: str, grid: list[float]) -> float:
    """The exponent with the greatest profile likelihood, all candidates in one aggregate."""
    v = F.col(value)
    cand = {f"_l{i}": (F.log(v) if lam == 0 else (F.pow(v, F.lit(lam)) - 1) / lam) for i, lam in enumerate(grid)}
    row = df.where(v > 0).select(v.alias("_v"), *[e.alias(n) for n, e in cand.items()]).agg(F.count("*").alias("n"), F.sum(F.log("_v")).alias("s"), *[F.log(F.var_pop(n)).alias(n) for n in cand]).first()
    score = [-row["n"] / 2 * row[f"_l{i}"] + (lam - 1) * row["s"] for i, lam in enumerate(grid)]
    return grid[score.index(max(score))]


def model_zoo(label: str) -> dict[str, Any]:
    """Estimators that a small automatic search tries."""
    return {
        "forest": RandomForestRegressor(labelCol=label, numTrees=20, maxDepth=6, seed=1),
        "boosted": GBTRegressor(labelCol=label, maxIter=15, maxDepth=4, seed=1),
        "poisson": GeneralizedLinearRegression(labelCol=label, family="poisson", link="log", regParam=0.1),
    }


def automatic_search(df: DataFrame, label: str, group: str, folds: int = 3) -> list[tuple[str, float]]:
    """Names of the zoo with their held-out d2, best first."""
    part = kept(grouped_folds(df.select("features", label, group), group, folds), "search")
    few = cases(part, ["fold", "features"], label, "weight").persist()
    out = []
    for name, est in model_zoo(label).items():
        # bags of the forest are drawn from rows; the other losses have no draws
        rows = part if name == "forest" else few
        est = est if name == "forest" else est.setWeightCol("weight")
        held = cross_predict(est, rows, "fold", folds, part).withColumn("prediction", F.greatest("prediction", F.lit(1e-6)))
        out.append((name, float(regression_metrics(held, [], label, "prediction").select("d2").first()[0])))
    few.unpersist()
    return sorted(out, key=lambda t: -t[1])


def as_vector(array: Column) -> Column:
    return array_to_vector(array.cast("array<double>"))

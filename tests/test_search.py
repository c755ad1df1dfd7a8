"""Searches go over folds that are dealt once, and losses without draws over cases."""

from __future__ import annotations

import pytest
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression
from pyspark.sql import functions as F

from stratagrid.operators import ml as M
from stratagrid.plans import catalog


def rows_of(spark):
    df = spark.range(6000).select((F.col("id") % 500).alias("g"), (F.col("id") % 6).cast("double").alias("a"), (F.col("id") % 4).cast("double").alias("b"), (F.col("id") % 11 + 1.0).alias("y"))
    return M.assemble(df, ["a", "b"])


def test_models_of_cases_equal_those_of_rows(spark):
    x = rows_of(spark)
    few = M.cases(x, ["features"], "y", "weight")
    assert few.count() == 12 and few.agg(F.sum("weight")).first()[0] == 6000
    glm = GeneralizedLinearRegression(labelCol="y", family="poisson", link="log", regParam=0.1)
    assert list(glm.copy().setWeightCol("weight").fit(few).coefficients) == pytest.approx(list(glm.fit(x).coefficients), abs=1e-8)
    trees = GBTRegressor(labelCol="y", maxIter=3, maxDepth=3, seed=1)
    one, two = trees.fit(x), trees.copy().setWeightCol("weight").fit(few)
    for v in few.select("features").collect():
        assert one.predict(v[0]) == pytest.approx(two.predict(v[0]), abs=1e-9)


def test_folds_are_dealt_once(spark, monkeypatch):
    seen, cross = [], M.cross_predict
    monkeypatch.setattr(M, "cross_predict", lambda est, df, *a: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or cross(est, df, *a))
    found = dict(M.automatic_search(rows_of(spark), "y", "g", 2))
    catalog.queries()["group_cv"](spark, "/root/testdata/sf0.001")
    assert set(found) == {"forest", "boosted", "poisson"} and len(seen) == 4
    assert not any("Window" in plan for plan in (seen[0], seen[3]))

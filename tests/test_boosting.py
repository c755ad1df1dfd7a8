from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import functions as F

from stratagrid.operators.boosting import fit_poisson_boosting, poisson_deviance
from stratagrid.operators.ml import assemble

FEATURES = ["l_quantity", "l_tax", "hole"]


@pytest.fixture(scope="module")
def lines(spark):
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    hole = F.when(F.col("l_linenumber") < 5, F.col("l_discount"))
    return li.select("l_orderkey", "l_quantity", "l_tax", hole.alias("hole"), (F.col("l_extendedprice") / 1000).alias("price"))


def side(g, h, l1, l2):
    return max(abs(g) - l1, 0) ** 2 / (h + l2)


def brute(x, cuts, y, rounds, depth, rate, l1, l2, least):
    """Rates by trees grown row set by row set, every cut tried on the values themselves."""
    f = np.full(len(y), np.log(y.mean()))
    for _ in range(rounds):
        h = np.exp(f)
        g, step = h - y, np.zeros(len(y))

        def grow(rows, level):
            G, H = g[rows].sum(), h[rows].sum()
            best = (0, None)
            if level < depth:
                for k in range(x.shape[1]):
                    for c in [-np.inf, *cuts[k]]:
                        left = rows[np.isnan(x[rows, k]) | (x[rows, k] <= c)]
                        gl, hl = g[left].sum(), h[left].sum()
                        if 0 < len(left) < len(rows) and hl >= least and H - hl >= least:
                            gain = round(side(gl, hl, l1, l2) + side(G - gl, H - hl, l1, l2) - side(G, H, l1, l2), 7)
                            if gain > best[0]:
                                best = (gain, left)
            if best[1] is None:
                step[rows] = -rate * np.sign(G) * max(abs(G) - l1, 0) / (H + l2)
            else:
                grow(best[1], level + 1)
                grow(np.setdiff1d(rows, best[1]), level + 1)

        grow(np.arange(len(y)), 0)
        f = f + step
    return np.exp(f)


def test_trees_equal_brute_force(spark, lines):
    some = lines.where("l_orderkey % 3 = 0")
    model = fit_poisson_boosting(some, FEATURES, "price", "l_orderkey", rounds=3, depth=2, rate=0.3, bins=8, l1=2.0, l2=3.0, least=5.0, held_out=0)
    got = model.transform(some).select(*FEATURES, "price", "prediction").toPandas().astype(float)
    want = brute(got[FEATURES].to_numpy(), model.cuts, got["price"].to_numpy(), 3, 2, 0.3, 2.0, 3.0, 5.0)
    assert len(model.trees) == 3 and got["prediction"].to_numpy() == pytest.approx(want, rel=1e-6)


def test_deviance_is_below_the_linear_model_and_stops_early(spark, lines):
    curved = lines.withColumn("price", F.pow((F.col("l_quantity") - 25) / 5, 2))
    model = fit_poisson_boosting(curved, FEATURES[:2], "price", "l_orderkey", rounds=6, depth=2, rate=0.5, patience=2)
    mean = lambda df: df.agg(F.avg(poisson_deviance(F.col("price"), F.col("prediction")))).first()[0]
    x = assemble(curved, FEATURES[:2])
    linear = GeneralizedLinearRegression(labelCol="price", family="poisson", link="log").fit(x).transform(x)
    assert mean(model.transform(curved)) < 0.5 * mean(linear)
    assert len(model.trees) == model.deviances.index(min(model.deviances))
    noise = curved.withColumn("price", F.pmod(F.xxhash64("l_orderkey", "l_quantity", "price"), F.lit(7)).cast("double"))
    stopped = fit_poisson_boosting(noise, ["l_tax"], "price", "l_orderkey", rounds=8, depth=1, rate=1.0, patience=1)
    assert len(stopped.deviances) < 9 and len(stopped.trees) == stopped.deviances.index(min(stopped.deviances))


def test_missing_values_and_refusals(spark):
    rows = [(i, None if i % 4 == 0 else float("nan") if i % 4 == 1 else float(i % 4), 9.0 if i % 4 < 2 else 1.0, "kept") for i in range(80)] + [(90, 2.0, None, "kept"), (91, 2.0, -5.0, "kept")]
    df = spark.createDataFrame(rows, "id long, x double, y double, bins string")
    model = fit_poisson_boosting(df, ["x"], "y", "id", rounds=4, depth=1, rate=1.0, l2=0.0, held_out=0)
    out = model.transform(df, "rate")
    assert out.columns == [*df.columns, "rate"] and out.count() == 82
    means = {r["y"]: r["m"] for r in out.where("y > 0").groupBy("y").agg(F.avg("rate").alias("m")).collect()}
    assert means[9.0] == pytest.approx(9, rel=0.05) and means[1.0] == pytest.approx(1, rel=0.2)
    for bad in (df.limit(0), df.withColumn("y", F.lit(0.0))):
        with pytest.raises(ValueError):
            fit_poisson_boosting(bad, ["x"], "y", "id", held_out=0)

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratagrid.operators import geometry as G
from stratagrid.operators import warp as W


def test_inverse_undoes_the_projection(spark):
    lat = [-89.0, -85.0, -60.5, -41.0, -40.0, -1.0, 0.0, 3.0, 40.7, 40.8, 55.0, 85.0, 89.5]
    lon = [-179.9, -101.0, -99.0, -41.0, -39.0, -19.0, 0.0, 79.0, 81.0, 179.0]
    df = spark.createDataFrame([(a, b) for a in lat for b in lon], "lat double, lon double")
    x, y = G.homolosine(F.col("lon"), F.col("lat"))
    lon2, lat2 = W.inverse_homolosine(x, y)
    for r in df.select("lat", "lon", lat2.alias("lat2"), lon2.alias("lon2")).collect():
        assert r["lat2"] == pytest.approx(r["lat"], abs=1e-7) and r["lon2"] == pytest.approx(r["lon"], abs=1e-5)
    gap = spark.range(1).select(*W.inverse_homolosine(F.lit(math.radians(-42.0) * G.RADIUS), F.lit(math.radians(60.0) * G.RADIUS)), *W.inverse_homolosine(F.lit(0.0), F.lit(9.9e6))).first()
    assert tuple(gap) == (None, None, None, None)


def test_bracketed_steps_reach_the_pole(spark):
    lats = [0.0, 1e-9, 30.0, -45.0, 80.0, 89.9, 89.99999, 90.0, -90.0]
    df = spark.createDataFrame([(math.sin(math.radians(a)),) for a in lats], "s double")
    for r in df.select("s", W.forward_angle(F.col("s")).alias("t")).collect():
        assert 2 * r["t"] + math.sin(2 * r["t"]) == pytest.approx(math.pi * r["s"], abs=1e-12)


RIM, SOLVED = 40, {}


def base(d):
    """The cubic B-spline."""
    return (2 / 3 - d * d + abs(d) ** 3 / 2) if abs(d) <= 1 else (2 - abs(d)) ** 3 / 6 if abs(d) < 2 else 0.0


def tridiagonal(a):
    """x with (x[k - 1] + 4 x[k] + x[k + 1]) / 6 = a[k], by elimination."""
    ahead, x = [], 6 * a
    for k in range(len(x)):
        pivot = 4 - (ahead[-1] if ahead else 0)
        x[k] = (x[k] - (x[k - 1] if k else 0)) / pivot
        ahead.append(1 / pivot)
    for k in range(len(x) - 2, -1, -1):
        x[k] -= ahead[k] * x[k + 1]
    return x


def coefficients(grid):
    """Spline coefficients of a grid with a wide rim of zeros, once a grid."""
    if id(grid) not in SOLVED:
        SOLVED[id(grid)] = tridiagonal(tridiagonal(np.pad(np.nan_to_num(grid), RIM)).T.copy()).T
    return SOLVED[id(grid)]


def brute(grid, fy, fx, kernel, reach):
    """One place at a time; the spline by solving for its coefficients on a grid with a wide rim of zeros."""
    h, w = grid.shape
    get = lambda i, j: grid[i, j] if 0 <= i < h and 0 <= j < w else math.nan
    if not (0 <= fy < h and 0 <= fx < w):
        return None
    if kernel == "nearest":
        v = get(int(fy), int(fx))
    elif kernel in ("average", "mode"):
        got = [grid[i, j] for i in range(h) for j in range(w) if abs(i + 0.5 - fy) <= reach[0] and abs(j + 0.5 - fx) <= reach[1] and not math.isnan(grid[i, j])]
        if kernel == "average":
            v = sum(got) / len(got) if got else math.nan
        else:
            v = min(Counter(got).items(), key=lambda x: (-x[1], x[0]))[0] if got else math.nan
    elif kernel == "bilinear":
        parts = [((1 - abs(i + 0.5 - fy)) * (1 - abs(j + 0.5 - fx)), get(i, j)) for i in range(h) for j in range(w) if abs(i + 0.5 - fy) < 1 and abs(j + 0.5 - fx) < 1]
        parts = [(k, g) for k, g in parts if not math.isnan(g)]
        v = sum(k * g for k, g in parts) / sum(k for k, _ in parts) if parts and sum(k for k, _ in parts) > 0 else math.nan
    else:
        cells = [(i, j) for i in range(math.floor(fy - 0.5) - 1, math.floor(fy - 0.5) + 3) for j in range(math.floor(fx - 0.5) - 1, math.floor(fx - 0.5) + 3)]
        if kernel == "cubicspline":
            parts = [(base(i + 0.5 - fy) * base(j + 0.5 - fx), get(i, j)) for i, j in cells]
            parts = [(k, g) for k, g in parts if not math.isnan(g)]
            v = sum(k * g for k, g in parts) / sum(k for k, _ in parts) if sum(k for k, _ in parts) > 0 else math.nan
        else:
            if any(math.isnan(get(i, j)) for i, j in cells):
                return None
            coef, rim = coefficients(grid), RIM
            v = sum(base(i + 0.5 - fy) * base(j + 0.5 - fx) * coef[i + rim, j + rim] for i, j in cells)
    return None if math.isnan(v) else v


@pytest.mark.parametrize("kernel", W.KERNELS)
def test_kernels_equal_brute_force(spark, kernel):
    rng = np.random.default_rng(3)
    grid = rng.integers(0, 9, (41, 53)).astype("f8")
    grid[rng.random(grid.shape) < (0.004 if kernel == "spline" else 0.25)] = math.nan
    grid[20:25, 20:27] = math.nan
    places = [(float(a), float(b)) for a, b in zip(rng.uniform(-2, 43, 90), rng.uniform(-2, 55, 90))] + [(0.0, 0.0), (40.999, 52.999), (31.5, 32.5), (32.0, 32.0), (22.5, 23.5)]
    source = spark.createDataFrame([(i, j, None if math.isnan(grid[i, j]) else float(grid[i, j])) for i in range(41) for j in range(53)] + [(-1, 3, 5.0), (41, 0, 5.0)], "row int, col int, value double").withColumn("v", F.lit("x")).repartition(5)
    targets = spark.createDataFrame([(k, a, b, "own") for k, (a, b) in enumerate(places)] + [(999, None, 1.0, "own")], "k int, fy double, fx double, value string")
    reach = (1.7, 2.2)
    for block in (32, 64):
        got = {r["k"]: r for r in W.resample(source, targets, 41, 53, kernel, reach=reach, block=block).collect()}
        assert len(got) == len(places) + 1 and got[999]["_value"] is None and got[0]["value"] == "own"
        for k, (a, b) in enumerate(places):
            want = brute(grid, a, b, kernel, reach)
            assert got[k]["_value"] == (None if want is None else pytest.approx(want, abs=1e-9)), (k, a, b)


def test_spline_goes_through_the_cells(spark):
    rng = np.random.default_rng(5)
    grid = rng.normal(size=(70, 70))
    c = W.prefilter(W.prefilter(grid, 0), 1)
    w = W._spline_weights(np.zeros(1))[:, 0]
    back = sum(w[a] * w[b] * c[10 + a - 1 : 60 + a - 1, 10 + b - 1 : 60 + b - 1] for a in range(4) for b in range(4))
    assert np.allclose(back, grid[10:60, 10:60], atol=1e-12)


def test_empty_sides(spark):
    source = spark.createDataFrame([(0, 0, 1.0)], "row int, col int, value double")
    targets = spark.createDataFrame([(0.5, 0.5)], "fy double, fx double")
    assert W.resample(source, targets.where("false"), 4, 4, "nearest").collect() == []
    assert [r["value"] for r in W.resample(source.where("false"), targets, 4, 4, "bilinear").collect()] == [None]
    with pytest.raises(ValueError, match="kernel"):
        W.resample(source, targets, 4, 4, "lanczos")

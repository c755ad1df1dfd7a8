"""Joins of points and polygons equal the general tests on all pairs, and make their rows with plain tests in many tasks."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from stratagrid.operators import geometry as G
from stratagrid.plans import catalog
from tests.test_geometry import SLANTED, SLIVER, shape

STAR = [[(5.0, 5.0), (9.0, 5.5), (8.0, 7.0), (5.0, 5.0), (4.0, 9.0), (2.5, 8.0), (5.0, 5.0), (1.0, 4.0), (2.0, 2.0)]]
CLOSED = [[(1.0, 1.0), (7.0, 1.0), (7.0, 7.0), (1.0, 7.0), (1.0, 1.0)], [(3.0, 3.0), (3.0, 5.0), (5.0, 5.0), (5.0, 3.0)]]
LINE, DOT = [[(2.0, 2.0), (2.2, 2.1)]], [[(4.0, 4.0)]]
SHAPES = [SLANTED, SLIVER, STAR, CLOSED, LINE, DOT]


def polygons(spark, shapes, key, column):
    return spark.createDataFrame([*[(k, shape(s)) for k, s in enumerate(shapes)], (98, []), (99, None)], f"{key} int, {column} {G.RINGS}")


@pytest.mark.parametrize("slack", [None, 1e-9])
def test_points_equal_all_pairs(spark, slack):
    draw = random.Random(5)
    places = [(draw.uniform(0, 10), draw.uniform(0, 10)) for _ in range(300)] + [(a / 2, b / 2) for a in range(20) for b in range(20)] + [p for s in SHAPES for r in s for p in r]
    points = spark.createDataFrame([*[(i, x, y) for i, (x, y) in enumerate(places)], (-1, None, 1.0), (-2, float("nan"), 5.0)], "i int, x double, y double")
    polys = polygons(spark, SHAPES, "k", "rings")
    want = {tuple(r) for r in points.crossJoin(polys).where(G.point_in_polygon(F.col("x"), F.col("y"), F.col("rings"), slack)).select("i", "k").collect()}
    for size in (0.7, 100.0):
        got = [tuple(r) for r in G.join_points_polygons(points, polys, "x", "y", "rings", size, slack=slack).select("i", "k").collect()]
        assert len(got) == len(set(got)) and set(got) == want
    left = [tuple(r) for r in G.join_points_polygons(points, polys, "x", "y", "rings", 5.0, "left", slack).select("i", "k").collect()]
    lone = {i for i in [*range(len(places)), -1, -2]} - {i for i, _ in want}
    assert len(left) == len(set(left)) and set(left) == want | {(i, None) for i in lone}


def test_small_polygons_equal_all_pairs(spark):
    draw = random.Random(9)

    def small(corners):
        x, y = draw.uniform(0, 10), draw.uniform(0, 10)
        ring = [(x + draw.uniform(-0.8, 0.8), y + draw.uniform(-0.8, 0.8)) for _ in range(corners)]
        return [ring + ring[: corners % 2]]

    left, right = polygons(spark, SHAPES, "i", "a"), polygons(spark, [small(1 + k % 5) for k in range(300)] + [CLOSED, [[(1.9, 1.9), (2.5, 1.9), (2.5, 2.5), (1.9, 2.5)]]], "j", "b")
    want = {tuple(r) for r in left.crossJoin(right).where(G.polygons_meet(F.col("a"), F.col("b"))).select("i", "j").collect()}
    for size in (2.0, 100.0):
        got = [tuple(r) for r in G.join_polygons(left, right, "a", "b", size).select("i", "j").collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


@pytest.mark.parametrize("name", ["point_in_polygon", "point_tile_left", "parted_points", "polygon_pairs"])
def test_joins_deal_their_rows_and_hold_plain_tests(spark, name):
    plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    joins = [part for part in plan.split("\n\n") if re.match(r"\(\d+\) \w*Join", part)]
    assert joins and all("SortMergeJoin" in j and "lambda" not in j for j in joins)
    assert len(re.findall(r"hashpartitioning\(_cx#\w+, _cy#\w+, 16\), REPARTITION_BY_NUM", plan)) >= 2

from __future__ import annotations

import random

from pyspark.sql import functions as F

from stratagrid.operators import geometry as G

SLANTED = [[(0.3, 0.2), (9.1, 1.4), (5.2, 3.3), (8.4, 8.8), (1.1, 6.7)], [(2.2, 2.1), (4.3, 2.9), (3.1, 5.2)]]
SLIVER = [[(0.1, 0.9), (8.9, 5.15), (8.9, 5.2)]]


def shape(rings):
    return [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]


def inside(x, y, rings):
    odd = False
    for r in rings:
        for (ax, ay), (bx, by) in zip(r, r[1:] + r[:1]):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd = not odd
    return odd


def cut(p, q, x0, y0, x1, y1):
    """Clips the segment to the box (Liang-Barsky)."""
    a, b = 0.0, 1.0
    for d, lo, hi in ((q[0] - p[0], x0 - p[0], x1 - p[0]), (q[1] - p[1], y0 - p[1], y1 - p[1])):
        if d == 0:
            if lo > 0 or hi < 0:
                return False
            continue
        t, u = sorted((lo / d, hi / d))
        a, b = max(a, t), min(b, u)
    return a <= b


def test_all_touched_meets_every_cell_of_slanted_rings(spark):
    for rings in (SLANTED, SLIVER):
        df = spark.createDataFrame([(1, shape(rings))], f"id int, rings {G.RINGS}")
        got = {(r["row"], r["col"]) for r in G.rasterize(df, "rings", 1.0, all_touched=True).collect()}
        want = {(r, c) for r in range(10) for c in range(10) if inside(c + 0.5, r + 0.5, rings) or any(cut(p, q, c, r, c + 1, r + 1) for ring in rings for p, q in zip(ring, ring[1:] + ring[:1]))}
        assert got == want
        centre = {(r["row"], r["col"]) for r in G.rasterize(df, "rings", 1.0).collect()}
        assert centre == {(r, c) for r in range(10) for c in range(10) if inside(c + 0.5, r + 0.5, rings)}


def test_lines_burn_each_cell_once(spark):
    line = [(0.5, 0.5), (3.5, 0.6), (0.6, 2.9), (0.5, 0.4)]
    df = spark.createDataFrame([(1, shape([line])[0]), (2, []), (3, None)], "id int, points array<struct<x:double,y:double>>")
    got = [(r["row"], r["col"]) for r in G.burn_lines(df, "points", 1.0).collect()]
    want = {(r, c) for r in range(5) for c in range(5) if any(cut(p, q, c, r, c + 1, r + 1) for p, q in zip(line, line[1:]))}
    assert len(got) == len(set(got)) and set(got) == want


def test_polygon_pairs_against_brute_force(spark):
    rng = random.Random(3)

    def triangle():
        x, y = rng.uniform(0, 30), rng.uniform(0, 30)
        return [[(x + rng.uniform(-4, 4), y + rng.uniform(-4, 4)) for _ in range(3)]]

    a, b = [triangle() for _ in range(40)] + [SLANTED], [triangle() for _ in range(40)] + [[[(3.0, 3.0), (3.2, 3.1), (3.1, 3.3)]]]
    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    edges = lambda rings: [(p, q) for r in rings for p, q in zip(r, r[1:] + r[:1])]

    def meet(s, t):
        if inside(*s[0][0], t) or inside(*t[0][0], s):
            return True
        return any(side(p, q, u) * side(p, q, v) <= 0 and side(u, v, p) * side(u, v, q) <= 0 for p, q in edges(s) for u, v in edges(t))

    want = {(i, j) for i, s in enumerate(a) for j, t in enumerate(b) if meet(s, t)}
    left = spark.createDataFrame([(i, shape(s)) for i, s in enumerate(a)], f"i int, a {G.RINGS}")
    right = spark.createDataFrame([(j, shape(t)) for j, t in enumerate(b)], f"j int, b {G.RINGS}")
    got = [(r["i"], r["j"]) for r in G.join_polygons(left, right, "a", "b", 5.0).select("i", "j").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
    hole = (40, 40)
    assert (hole in want) == meet(a[40], b[40])


def test_segments_in_general_position(spark):
    p = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    row = spark.range(1).select(G.segments_meet(p(0, 0), p(2, 2), p(0, 2), p(2, 0)), G.segments_meet(p(0, 0), p(1, 1), p(2, 2), p(3, 2.5))).first()
    assert row[0] is True and row[1] is False


def segment(*ends):
    return [F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ends]


def test_segments_on_one_line(spark):
    cases = {
        ((0, 0), (1, 0), (5, 0), (6, 0)): False, ((0, 0), (1, 0), (1, 0), (2, 0)): True, ((0, 0), (4, 0), (1, 0), (2, 0)): True, ((0, 0), (3, 3), (2, 2), (5, 5)): True, ((0, 0), (1, 1), (2, 2), (3, 3)): False,
        ((1, 1), (1, 1), (0, 0), (2, 2)): True, ((3, 3), (3, 3), (0, 0), (2, 2)): False, ((1, 1), (1, 1), (1, 1), (1, 1)): True, ((0, 0), (0, 2), (-1, 1), (1, 1)): True, ((0, 0), (0, 2), (0.5, 1), (1, 1)): False,
    }
    got = spark.range(1).select(*[G.segments_meet(*segment(*c)).alias(f"c{k}") for k, c in enumerate(cases)]).first()
    assert list(got) == list(cases.values())


def test_closed_and_touching_polygons(spark):
    ring = lambda x, y, s=1.0: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    closed = lambda r: [*r, r[0]]
    a = [[ring(0, 0)], [closed(ring(0, 0))], [ring(0, 0, 9.0), ring(3, 3, 3.0)], [ring(0, 0), closed(ring(7, 7))]]
    b = [[closed(ring(3, 0))], [ring(1, 0)], [closed(ring(1, 1))], [ring(4, 4)], [ring(7.2, 7.2, 0.1)], [closed(ring(20, 0))]]
    left = spark.createDataFrame([(i, shape(s)) for i, s in enumerate(a)], f"i int, a {G.RINGS}")
    right = spark.createDataFrame([(j, shape(t)) for j, t in enumerate(b)], f"j int, b {G.RINGS}")
    want = {(0, 1), (0, 2), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2), (2, 4), (3, 1), (3, 2), (3, 4)}
    for size in (0.7, 5.0, 100.0):
        got = [(r["i"], r["j"]) for r in G.join_polygons(left, right, "a", "b", size).select("i", "j").collect()]
        assert sorted(got) == sorted(want)


def test_parts_holes_and_islands(spark):
    ring = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    cases = [([ring(0, 0, 1), ring(5, 5, 1)], 2.0, 2, (3.0, 3.0)), ([ring(4, 4, 2), ring(0, 0, 10), ring(1, 1, 8)], 100 - 64 + 4, 2, (5.0, 5.0)), ([ring(0, 0, 2)[::-1] + [(0, 2)]], 4.0, 1, (1.0, 1.0))]
    df = spark.createDataFrame([(k, shape(c[0])) for k, c in enumerate(cases)], f"k int, rings {G.RINGS}")
    r = F.col("rings")
    at = G.inner_point(r)
    for row in df.select("k", G.polygon_area(r).alias("area"), F.size(G.parts_of(r)).alias("parts"), G.centroid(r).alias("c"), G.point_in_polygon(at["x"], at["y"], r).alias("inside"), G.bounds(r).alias("b")).collect():
        _, area, parts, (x, y) = cases[row["k"]]
        assert (row["area"], row["parts"], row["inside"]) == (area, parts, True) and abs(row["c"]["x"] - x) + abs(row["c"]["y"] - y) < 1e-9
    assert tuple(df.where("k = 0").select(G.bounds(r).alias("b")).first()["b"]) == (0.0, 0.0, 6.0, 6.0)
    assert spark.createDataFrame([([],)], f"rings {G.RINGS}").select(G.polygon_area(r), G.centroid(r)["x"]).first()[:] == (0.0, None)

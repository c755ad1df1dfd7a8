from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratagrid.llm import queries, sortmeans


def brute(rows, k, rounds, dim):
    """Plain Python: all distances in every round. rows: (id, vector)."""
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    begin = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cents = [list(v) for _, v in begin[:k]]
    d = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))

    def nearest(v):
        return min((d(v, c), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(cents)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                cents[j] = [sum(c) // len(mine) for c in zip(*mine)]
    last = [nearest(v) for _, v in kept]
    total, by = sum(x for x, _ in last), {}
    for x, j in last:
        by[j] = by.get(j, 0) + x
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, j, x, by[j], total, sha[j]) for (i, _), (x, j) in zip(kept, last)), key=repr)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.op12_sort_means(spark, sf)
    assert dict(got.dtypes) == {"vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"}
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, 40, 5, 64)


def test_odd_vectors_ties_and_repeats(spark):
    rng = random.Random(4)
    rows = [(k, [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)]) for k in range(300)]
    rows += [(7, rows[7][1]), (7, [9.0, 9.0, 9.0, 9.0]), (None, [1.0, 1.0, 1.0, 1.0]), (400, None), (401, []), (402, [1.0, None, 1.0, 1.0]), (403, [1.0, float("nan"), 1.0, 1.0]), (404, [1.0, float("-inf"), 1.0, 1.0]), (405, [1.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("cluster", "v", "id", "n")}).repartition(7)
    got = sortmeans.sort_means(df, k=6, rounds=4, dim=4)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, 6, 4, 4)


def test_few_vectors_and_none(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [-1.5, 0.0])], "vec_id long, embedding array<float>")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    assert sorted(map(tuple, sortmeans.sort_means(df, dim=2).collect()), key=repr) == brute(rows, 40, 5, 2)
    assert sortmeans.sort_means(df.where("vec_id > 9"), dim=2).collect() == []
    with pytest.raises(Exception, match="too large"):
        sortmeans.sort_means(spark.createDataFrame([(1, [1e30, 0.0])], df.schema), dim=2).collect()


def test_scan_skips_centroids_and_stays_exact():
    rng = np.random.default_rng(0)
    cents = rng.integers(-5000, 5000, (40, 8))
    x = np.concatenate([c + rng.integers(-300, 300, (50, 8)) for c in cents])
    near, least, _ = sortmeans.assign(x, np.zeros(len(x), "i4"), cents)
    full = ((x[:, None] - cents[None]) ** 2).sum(axis=2)
    assert (near == full.argmin(axis=1)).all() and (least == full.min(axis=1)).all()
    again, least2, taken = sortmeans.assign(x, near, cents)
    assert (again == near).all() and (least2 == least).all() and taken < 0.2 * full.size
    # ties on both sides of where the scan begins, and at twice the distance exactly
    line = np.array([[0], [2], [4], [-2]])
    for begin in range(4):
        near, least, _ = sortmeans.assign(np.array([[1], [3], [-1], [0]]), np.full(4, begin, "i4"), line)
        assert near.tolist() == [0, 1, 0, 0] and least.tolist() == [1, 1, 1, 0]

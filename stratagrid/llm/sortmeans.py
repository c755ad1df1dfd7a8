"""Centroid clustering by sort-means: exact rounds of k-means that skip centroids by the triangle inequality.

In every round the other centroids are ordered by their distance from each centroid. A vector's
scan begins at the centroid that it was assigned to in the round before and goes on in that
centroid's order; it stops at the first one that lies strictly beyond twice the vector's distance
from where it began (squared: beyond four times), as no centroid from there on can be nearer or
as near. Ties go to the smaller number. All arithmetic is on whole numbers.

A round is one pass in Arrow batches over a written table; the next table holds the vectors with
their new centroid and, in rows of their own, the componentwise sums of each task and centroid,
so that only those few rows are read for the new centroids. The driver and the tasks hold k
centroids, never vectors. A table goes when the next one is complete.

Defined results: vectors with another number of components, with a null or a non-finite one, or
that are null are left out; rows with the same id are vectors of their own; equal vectors are in
one cluster, the one with the smallest number; with fewer than k vectors each begins as a
centroid; a null id counts as an empty one in the hash; an empty table gives an empty result;
other columns are ignored whatever their names. Components beyond 2 ** 27 in size are refused, as their squared
distances would not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratagrid.llm.common import discard, scratch

#: Components of vectors lie within plus or minus this.
LARGEST = 1 << 27


def assign(x: np.ndarray, previous: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid and squared distance of each row of x, and how many distances that took; previous is where scans begin."""
    gaps = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
    best, least, taken = previous.copy(), np.empty(len(x), "i8"), len(x)
    for c in np.unique(previous):
        rows = np.flatnonzero(previous == c)
        here = x[rows]
        began = ((here - centroids[c]) ** 2).sum(axis=1)
        order = np.lexsort((np.arange(len(centroids)), gaps[c]))
        order = order[order != c]
        # how far down the order each row looks: to the first centroid strictly beyond twice its distance
        depth = np.searchsorted(gaps[c][order], 4 * began, side="right")
        by_depth = np.argsort(-depth, kind="stable")
        here, now, near, sizes = here[by_depth], began[by_depth], np.full(len(rows), c), -depth[by_depth]
        for step, j in enumerate(order[: depth.max(initial=0)]):
            n = int(np.searchsorted(sizes, -step, side="left"))
            d = ((here[:n] - centroids[j]) ** 2).sum(axis=1)
            taken += n
            better = (d < now[:n]) | ((d == now[:n]) & (j < near[:n]))
            now[:n][better], near[:n][better] = d[better], j
        best[rows[by_depth]], least[rows[by_depth]] = near, now
    return best, least, taken


def _table(id_type: str) -> str:
    return f"id {id_type}, v array<long>, cluster int, distance long, n long, sums array<long>"


def _rounds(points: DataFrame, centroids: list[list[int]], id_type: str) -> DataFrame:
    """points with their nearest centroid, and a row a task and centroid with count and sums."""
    fixed, dim = np.array(centroids, "i8"), len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(fixed.shape, "i8"), np.zeros(len(fixed), "i8")
        ids = None
        for batch in batches:
            ids, n = batch.column(0), batch.num_rows
            if not n:
                continue
            v = batch.column(1)
            x = v.flatten().to_numpy(zero_copy_only=False).reshape(n, dim)
            if np.abs(x).max() > LARGEST:
                raise ValueError("a component is too large for whole-number distances")
            near, least, _ = assign(x, batch.column(2).to_numpy(zero_copy_only=False), fixed)
            order = np.argsort(near, kind="stable")
            found, first = np.unique(near[order], return_index=True)
            sums[found] += np.add.reduceat(x[order], first, axis=0)
            counts += np.bincount(near, minlength=len(fixed))
            yield pa.RecordBatch.from_arrays([ids, v, pa.array(near.astype("i4")), pa.array(least), pa.nulls(n, pa.int64()), pa.nulls(n, v.type)], ["id", "v", "cluster", "distance", "n", "sums"])
        live = np.flatnonzero(counts)
        if len(live):
            k = len(live)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(k, ids.type), pa.nulls(k, pa.list_(pa.int64())), pa.array(live.astype("i4")), pa.nulls(k, pa.int64()), pa.array(counts[live]), pa.array(sums[live].tolist(), pa.list_(pa.int64()))],
                ["id", "v", "cluster", "distance", "n", "sums"],
            )

    return points.select("id", "v", "cluster").mapInArrow(run, _table(id_type))


def sort_means(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: str = "2") -> DataFrame:
    """A row a vector: its id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Components are floor(scale * x). Centroids begin as the k vectors with the smallest
    sha256 of `seed:id`; each of `rounds` rounds assigns every vector and moves every centroid
    that has vectors to floor(sum / count) by component; then vectors are assigned once more.
    """
    spark, id_type = vectors.sparkSession, dict(vectors.dtypes)[id_col]
    raw, ident = F.col(f"`{vector_col}`"), F.col(f"`{id_col}`")
    finite = (F.size(raw) == dim) & ~F.exists(raw, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    points = vectors.where(F.coalesce(finite, F.lit(False))).select(ident.alias("id"), F.transform(raw, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    centroids = [list(r["v"]) for r in points.select("v", mark.alias("mark")).orderBy("mark", "v").limit(k).collect()]
    if not centroids:
        return spark.createDataFrame([], f"{id_col} {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    table, last = points.withColumn("cluster", F.lit(0)), None
    for r in range(rounds + 1):
        path = scratch(spark, f"sortmeans-{r}")
        _rounds(table, centroids, id_type).write.parquet(path)
        written = spark.read.schema(_table(id_type)).parquet(path)
        if last is not None:
            discard(spark, last)
        if r < rounds:
            # a row a task and centroid: summed to k times dim numbers
            parts = written.where("n is not null")
            totals = parts.select("cluster", "n", F.posexplode("sums").alias("at", "s")).groupBy("cluster", "at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))
            for t in totals.toLocalIterator():
                centroids[t["cluster"]][t["at"]] = int(t["s"]) // int(t["n"])
        table, last = written.where("n is null"), path
    digests = [(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids)]
    each = table.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    # both sides have at most k rows
    facts = each.withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy(F.lit(0)))).join(spark.createDataFrame(digests, "cluster int, centroid_sha256 string"), "cluster")
    out = table.select(F.col("id").alias(id_col), "cluster", "distance").join(F.broadcast(facts), "cluster")
    return out.select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

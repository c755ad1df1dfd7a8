"""Deterministic samples and splits: order is by hash of the key and a seed, never by a random state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hashed(key: str, seed: int) -> Column:
    """Order of a row in a sample: MD5 of seed and key, the same in any engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def sample_per_group(df: DataFrame, groups: list[str], key: str, n: int, seed: int = 0) -> DataFrame:
    """At most n rows of each group; Spark limits the ranks within tasks before the shuffle."""
    w = Window.partitionBy(*groups).orderBy(hashed(key, seed), key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def sample_fraction(df: DataFrame, stratum: str, key: str, share: float, seed: int = 0) -> DataFrame:
    """floor(n * share) rows of each stratum."""
    sizes = df.groupBy(stratum).agg(F.floor(F.count("*") * share).alias("_n"))
    w = Window.partitionBy(stratum).orderBy(hashed(key, seed), key)
    return df.join(sizes, stratum).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= F.col("_n")).drop("_r", "_n")


def bootstrap_weights(df: DataFrame, key: str, rounds: int, seed: int = 0) -> DataFrame:
    """df with boot_1.. : Poisson(1) counts from the key's hash, the weights of a resample with replacement."""
    edges = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183)
    for r in range(1, rounds + 1):
        u = F.conv(F.substring(hashed(key, seed * 1000 + r), 1, 8), 16, 10).cast("double") / float(1 << 32)
        df = df.withColumn(f"boot_{r}", sum(((u >= e).cast("int") for e in edges[1:]), (u >= edges[0]).cast("int")))
    return df


def quantile_bins(df: DataFrame, value: str, bins: int, name: str = "bin") -> DataFrame:
    """df with its bin 0..bins-1 by linear quantile edges; right edges belong to the bin, as in qcut; equal edges merge."""
    qs = [i / bins for i in range(1, bins)]
    edges = df.agg(F.array_distinct(F.percentile(value, F.array(*[F.lit(q) for q in qs]))).alias("_e"))
    return df.crossJoin(F.broadcast(edges)).withColumn(name, F.size(F.filter("_e", lambda e: e < F.col(value))).cast("long")).drop("_e")


def stratified_split(tiles: DataFrame, tile: str, count: str, share: float = 0.1, bins: int = 10, seed: int = 0) -> DataFrame:
    """tiles with role: floor(n * share) tiles of each decile of count for test, as many of the rest for calibration."""
    b = quantile_bins(tiles, count, bins, "_bin")
    sizes = b.groupBy("_bin").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("_bin").orderBy(hashed(tile, seed), tile)
    b = b.join(sizes, "_bin").withColumn("_r", F.row_number().over(w))
    n_test = F.floor(F.col("_n") * share)
    n_cal = F.floor((F.col("_n") - n_test) * share)
    role = F.when(F.col("_r") <= n_test, "test").when(F.col("_r") <= n_test + n_cal, "calibration").otherwise("training")
    return b.select(*tiles.columns, role.alias("role"))


def group_folds(df: DataFrame, group: str, folds: int, seed: int = 0) -> DataFrame:
    """df with fold: all rows of a group are in one; groups are dealt by hash order of their size rank."""
    sizes = df.groupBy(group).agg(F.count("*").alias("_n"))
    order = Window.orderBy(F.desc("_n"), group)  # one row a group
    turn = sizes.withColumn("_k", F.row_number().over(order) - 1)
    lap, place = F.floor(F.col("_k") / folds), F.col("_k") % folds
    fold = F.when(lap % 2 == 0, place).otherwise(folds - 1 - place).cast("int")
    return df.join(turn.select(group, fold.alias("fold")), group)


def priority(df: DataFrame, size: str, key: str) -> DataFrame:
    """df with priority (0-based rank by descending size, ties by key) and batch (ten equal parts); df has a row a cluster."""
    w = Window.orderBy(F.desc(size), key)
    return df.withColumn("priority", (F.row_number().over(w) - 1).cast("long")).withColumn("batch", F.ntile(10).over(w).cast("long"))


def slice_of(df: DataFrame, key: str, start: int, end: int) -> DataFrame:
    """Rows start..end-1 by key order, of a list of work items."""
    return df.withColumn("_r", F.row_number().over(Window.orderBy(key)) - 1).where(F.col("_r").between(start, end - 1)).drop("_r")


def min_max(df: DataFrame, value: str, name: str, low: float = 0.1) -> DataFrame:
    """df with (v - min * low) / (max - min * low); one row of extremes is broadcast."""
    ends = df.agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
    v = F.try_divide(F.col(value) - F.col("_a") * low, F.col("_b") - F.col("_a") * low)
    return df.crossJoin(F.broadcast(ends)).withColumn(name, v).drop("_a", "_b")


def histogram(df: DataFrame, x: str, y: str, width: float, height: float) -> DataFrame:
    """(bx, by, n): counts of a two-dimensional grid."""
    return df.groupBy(F.floor(F.col(x) / width).alias("bx"), F.floor(F.col(y) / height).alias("by")).agg(F.count("*").alias("n"))


def choose_keys(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """(draw, key): n draws of a distinct key with replacement; each draw takes the key of least hash."""
    draws = df.select(F.col(key).alias("key")).distinct().select("key", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long"))).alias("draw"))
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("draw").cast("string"), F.col("key").cast("string")))
    return draws.groupBy("draw").agg(F.min_by("key", h).alias("key"))

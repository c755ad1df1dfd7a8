"""Operators on raster cells: masks, zonal statistics, overlays, allocation of regional totals.

Cells are rows keyed by tile, row and column (or one cell id), wide in their layers. Zones are a
key column. Aggregates are partial before the shuffle, so a zone with a third of all cells is
many partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def zonal_statistics(cells: DataFrame, keys: list[str], layers: list[str], mask: str, ndigits: int = 0) -> DataFrame:
    """keys, rounded mean of each layer and mask_sum over cells whose mask is neither 0 nor NULL."""
    inside = cells.where(F.coalesce(F.col(mask) != 0, F.lit(False)))
    return inside.groupBy(*keys).agg(*[F.bround(F.avg(c), ndigits).alias(c) for c in layers], F.bround(F.sum(mask), ndigits).alias("mask_sum"))


def coverage(cells: DataFrame, zones: DataFrame, key: str, layers: list[str], area: str, cell_area: float, least: float = 50.0) -> DataFrame:
    """Zones with sums of the layers that cover at least `least` percent of them; zones without any such layer go."""
    got = cells.groupBy(key).agg(*[x for c in layers for x in (F.sum(c).alias(c), F.count(c).alias(f"{c}_n"))])
    out = zones.join(got, key, "left")
    cover = {c: F.try_divide(F.coalesce(F.col(f"{c}_n"), F.lit(0)) * cell_area, F.col(area)) * 100 for c in layers}
    some = F.lit(False)
    for c in layers:
        some = some | F.coalesce(cover[c] >= least, F.lit(False))
    out = out.where(some)
    return out.select(key, area, *[F.when(cover[c] >= least, F.col(c)).alias(c) for c in layers])


def preserve_mass(cells: DataFrame, keys: list[str], value: str, targets: DataFrame, target: str) -> DataFrame:
    """cells with factor and adjusted: value scaled so that each zone's sum is its target (targets: one row a zone)."""
    total = cells.groupBy(*keys).agg(F.sum(value).alias("_total"))
    factors = total.join(targets, keys).select(*keys, F.try_divide(F.col(target), F.col("_total")).alias("factor"))
    return cells.join(factors, keys).withColumn("adjusted", F.col(value) * F.col("factor"))


def largest_remainder(cells: DataFrame, zone: str, cell: str, value: str, targets: DataFrame, target: str, ndigits: int = 9, ranges: int = 64) -> DataFrame:
    """cells with allocated: whole numbers in proportion to value whose sum in each zone is the target.

    Positive cells get the floor of their share; the largest fractions get one more (if the
    floors exceed the target, the smallest lose one, not below zero). Ties go by cell id. Other
    cells, and zones with no positive cell or a target of at most 0, get 0.

    Ranks are by range of the fraction, so a large zone is ranked in `ranges` pieces.
    """
    total = cells.where(F.col(value) > 0).groupBy(zone).agg(F.sum(value).alias("_sum"))
    c = cells.join(targets.select(zone, F.col(target).alias("_goal")), zone, "left").join(total, zone, "left")
    live = F.coalesce((F.col(value) > 0) & (F.col("_goal") > 0), F.lit(False))
    share = F.col(value) * F.col("_goal") / F.col("_sum")
    c = c.withColumn("_live", live).withColumn("_share", F.when(live, F.round(share, ndigits)))
    c = c.withColumn("_floor", F.floor("_share")).withColumn("_frac", F.round(F.col("_share") - F.col("_floor"), ndigits))
    c = c.withColumn("_range", F.floor(F.coalesce(F.col("_frac"), F.lit(0.0)) * ranges).cast("int"))
    sizes = c.where("_live").groupBy(zone, "_range").agg(F.count("*").alias("_n"), F.sum("_floor").alias("_f"))
    w, down = Window.partitionBy(zone), Window.partitionBy(zone).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(zone, "_range", F.coalesce(F.sum("_n").over(down), F.lit(0)).alias("_before"), F.sum("_f").over(w).alias("_floors"), F.sum("_n").over(w).alias("_all"))
    # cells that get nothing need no rank: they are dealt by hash, as they may be most of a zone
    c = c.withColumn("_dead", F.when(F.col("_live"), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64(cell), F.lit(1 << 20))))
    order = Window.partitionBy(zone, "_live", "_range", "_dead").orderBy(F.desc("_frac"), cell)
    c = c.withColumn("_rank", F.row_number().over(order)).join(sizes, [zone, "_range"], "left").withColumn("_rank", F.col("_rank") + F.col("_before"))
    short = F.col("_goal") - F.col("_floors")
    more = F.when(F.col("_rank") <= short, 1).when(F.col("_rank") > F.col("_all") + short, -1).otherwise(0)
    out = F.when(F.col("_live"), F.greatest(F.col("_floor") + more, F.lit(0))).otherwise(0).cast("long")
    return c.select(*[F.col(f"`{x}`") for x in cells.columns], out.alias("allocated"))


def occurrence_percent(df: DataFrame, keys: list[str], cls: str, wanted: list) -> DataFrame:
    """keys, percent of a cell's steps whose class is wanted."""
    return df.groupBy(*keys).agg((F.avg(F.coalesce(F.col(cls).isin(wanted), F.lit(False)).cast("double")) * 100).alias("percent"))


def any_epoch_mask(df: DataFrame, keys: list[str], value: str, masked: list[tuple[float, float]]) -> DataFrame:
    """keys, keep: 1 if in some step the value is in none of the masked ranges (NULL steps count as kept)."""
    hit = F.lit(False)
    for low, high in masked:
        hit = hit | F.coalesce(F.col(value).between(low, high), F.lit(False))
    return df.groupBy(*keys).agg(F.max((~hit).cast("int")).alias("keep"))


def skip_tiles(df: DataFrame, tile: str, value: str, empty: float) -> DataFrame:
    """Rows of the tiles whose least value is not the empty one."""
    live = df.groupBy(tile).agg(F.min(value).alias("_m")).where(F.col("_m") != empty)
    return df.join(live, tile, "left_semi")


def exclusion(value: Column, *conditions: Column, nodata: float = 255) -> Column:
    any_ = F.lit(False)
    for c in conditions:
        any_ = any_ | F.coalesce(c, F.lit(False))
    return F.when(any_, F.lit(nodata)).otherwise(value)


def scatter(grid: DataFrame, predicted: DataFrame, keys: list[str], value: str, nodata: float) -> DataFrame:
    """Every cell of the grid, with its prediction or nodata."""
    return grid.join(predicted.select(*keys, value), keys, "left").withColumn(value, F.coalesce(F.col(value), F.lit(nodata)))


def overlay(points: DataFrame, cells: DataFrame, keys: list[str], layers: list[str]) -> DataFrame:
    """points with the layers of their cell (keys hold the cell, and the year for layers in time); NULL outside."""
    return points.join(cells.select(*keys, *layers), keys, "left")


def pivot_layers(cells: DataFrame, keys: list[str], layer: str, value: str, names: list[str]) -> DataFrame:
    """Long layers as columns in one aggregate with conditional values; the names are given, so nothing is scanned for them."""
    return cells.groupBy(*keys).agg(*[F.max(F.when(F.col(layer) == n, F.col(value))).alias(n) for n in names])


def expand_layers(catalogue: DataFrame, first: int, last: int) -> DataFrame:
    """One row a layer and year: static layers repeat, {year} in the path of the others is replaced."""
    years = catalogue.withColumn("year", F.explode(F.sequence(F.lit(first), F.lit(last))))
    return years.withColumn("path", F.when(F.col("type") == "temporal", F.replace("path", F.lit("{year}"), F.col("year").cast("string"))).otherwise(F.col("path")))


def pixel_of(x: Column, y: Column, x0: float, y0: float, res: float) -> tuple[Column, Column]:
    """Row and column of a point in a grid whose upper left corner is (x0, y0)."""
    return F.floor((F.lit(y0) - y) / res).cast("long"), F.floor((x - F.lit(x0)) / res).cast("long")


def window_of(cells: DataFrame, bounds: tuple[float, float, float, float], x0: float, y0: float, res: float, row: str = "row", col: str = "col") -> DataFrame:
    """Cells of a bounding box (min x, min y, max x, max y): plain ranges, so files are pruned by their statistics."""
    a, b, c, d = bounds
    r0, r1, c0, c1 = int((y0 - d) // res), int(-(-(y0 - b) // res)), int((a - x0) // res), int(-(-(c - x0) // res))
    return cells.where(F.col(row).between(r0, r1 - 1) & F.col(col).between(c0, c1 - 1))


def overview(cells: DataFrame, k: int, value: str, row: str = "row", col: str = "col") -> DataFrame:
    """Mean over k x k blocks."""
    return cells.groupBy(F.floor(F.col(row) / k).alias(row), F.floor(F.col(col) / k).alias(col)).agg(F.avg(value).alias(value))


def pending(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work that has no output yet."""
    return wanted.join(done, keys, "left_anti")

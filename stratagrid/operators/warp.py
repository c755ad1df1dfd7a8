"""Warping of rasters: the inverse of the interrupted homolosine projection, and resampling by five kernels.

Source cells stand in square blocks and, near a block's edge, also in the halo of its
neighbours; target cells come with fractional places in the source grid, so each belongs to one
block. One equi-join on the block brings both together, and a block is resampled as arrays:
memory is bounded by the block, halo and the targets within it, whatever the size of the rasters.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagrid.operators.geometry import NORTH, RADIUS, SEAM, SOUTH
from stratagrid.session import free_name

KERNELS = ("nearest", "average", "mode", "bilinear", "cubicspline", "spline")
#: Pole of the cubic B-spline prefilter; its powers past HALO are below double precision.
POLE = math.sqrt(3) - 2
HALO = 30


def _seam_shift() -> float:
    """How far the two halves of the projection stand apart where they meet."""
    low, high = 0.0, SEAM
    t = SEAM
    for _ in range(60):
        step = (2 * t + math.sin(2 * t) - math.pi * math.sin(SEAM)) / (2 + 2 * math.cos(2 * t))
        low, high = (low, t) if step > 0 else (t, high)
        t = t - step if low <= t - step <= high else (low + high) / 2
    return math.sqrt(2) * math.sin(t) - SEAM


def inverse_homolosine(x: Column, y: Column, radius: float = RADIUS) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of homolosine x, y; NULL in the gaps between lobes and outside."""
    v = y / radius
    q = (v + F.signum(v) * _seam_shift()) / math.sqrt(2)
    polar = F.abs(v) > SEAM
    theta = F.asin(F.when(F.abs(q) <= 1, q))
    # closed from here: sin(lat) = (2 t + sin 2t) / pi for the auxiliary angle t that y gives
    lat = F.when(polar, F.asin(F.least((2 * theta + F.sin(2 * theta)) / math.pi, F.lit(1.0)))).when(F.abs(v) <= SEAM, v)
    wide = F.when(polar, 2 * math.sqrt(2) / math.pi * F.cos(theta)).otherwise(F.cos(v))

    def lobe(lobes: tuple) -> Column:
        found = []
        for a, b, c in lobes:
            lon = c + F.degrees(F.try_divide(x / radius - math.radians(c), wide))
            found.append(F.when((lon >= a) & (lon < b), lon))
        return F.coalesce(*found)

    lon = F.when(v >= 0, lobe(NORTH)).otherwise(lobe(SOUTH))
    return lon, F.when(lon.isNotNull(), F.degrees(lat))


def forward_angle(sin_lat: Column) -> Column:
    """Mollweide's auxiliary angle by Newton steps that stay within a bracket: exact up to the poles, where plain steps fail."""

    def step(s: Column, _: Column) -> Column:
        f = 2 * s["t"] + F.sin(2 * s["t"]) - math.pi * sin_lat
        low, high = F.when(f > 0, s["low"]).otherwise(s["t"]), F.when(f > 0, s["t"]).otherwise(s["high"])
        newton = s["t"] - F.try_divide(f, 2 + 2 * F.cos(2 * s["t"]))
        return F.struct(F.when((newton >= low) & (newton <= high), newton).otherwise((low + high) / 2).alias("t"), low.alias("low"), high.alias("high"))

    begin = F.struct((sin_lat * 1.0).alias("t"), F.lit(-math.pi / 2).alias("low"), F.lit(math.pi / 2).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(48)), begin, step)["t"]


def _spline_weights(t: np.ndarray) -> np.ndarray:
    """Weights of the four cells around a place: cubic B-spline, t the way from the second cell to the third."""
    u = 1 - t
    return np.stack([u**3, 3 * t**3 - 6 * t**2 + 4, 3 * u**3 - 6 * u**2 + 4, t**3]) / 6


def prefilter(a: np.ndarray, axis: int) -> np.ndarray:
    """Spline coefficients along an axis: a causal and an anticausal recursion over values that are 0 beyond the ends."""
    c = np.moveaxis(6.0 * a, axis, 0).copy()
    for k in range(1, len(c)):
        c[k] += POLE * c[k - 1]
    # beyond the end the causal part decays by the pole; its anticausal sum is closed
    c[-1] *= -POLE / (1 - POLE * POLE)
    for k in range(len(c) - 2, -1, -1):
        c[k] = POLE * (c[k + 1] - c[k])
    return np.moveaxis(c, 0, axis)


def _kernel(grid: np.ndarray, fy: np.ndarray, fx: np.ndarray, kernel: str, reach: tuple[float, float]) -> np.ndarray:
    """Values at places of a grid (NaN where there is none); cell (i, j) has its centre at (i + 0.5, j + 0.5)."""
    height, width = grid.shape

    def at(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        inside = (i >= 0) & (i < height) & (j >= 0) & (j < width)
        return np.where(inside, grid[np.clip(i, 0, height - 1), np.clip(j, 0, width - 1)], np.nan)

    if kernel == "nearest":
        return at(np.floor(fy).astype("i8"), np.floor(fx).astype("i8"))
    if kernel in ("average", "mode"):
        i0, j0 = np.ceil(fy - reach[0] - 0.5).astype("i8"), np.ceil(fx - reach[1] - 0.5).astype("i8")
        rows, cols = int(2 * reach[0]) + 1, int(2 * reach[1]) + 1
        found = []
        for di in range(rows):
            for dj in range(cols):
                i, j = i0 + di, j0 + dj
                found.append(np.where((i + 0.5 <= fy + reach[0]) & (j + 0.5 <= fx + reach[1]), at(i, j), np.nan))
        found = np.sort(np.stack(found), axis=0)  # NaN last
        n = np.isfinite(found).sum(axis=0)
        if kernel == "average":
            return np.where(n > 0, np.nansum(found, axis=0) / np.maximum(n, 1), np.nan)
        run, best, out = np.zeros(len(fy), "i8"), np.zeros(len(fy), "i8"), np.full(len(fy), np.nan)
        for k in range(len(found)):
            run = np.where(found[k] == found[k - 1], run + 1, 1) if k else np.ones(len(fy), "i8")
            more = (k < n) & (run > best)  # the smallest value wins a tie, as it comes first
            best, out = np.where(more, run, best), np.where(more, found[k], out)
        return out
    i0, j0 = np.floor(fy - 0.5).astype("i8"), np.floor(fx - 0.5).astype("i8")
    ty, tx = fy - 0.5 - i0, fx - 0.5 - j0
    if kernel == "bilinear":
        wy, wx, first = np.stack([1 - ty, ty]), np.stack([1 - tx, tx]), 0
    else:
        wy, wx, first = _spline_weights(ty), _spline_weights(tx), -1
    values = grid if kernel != "spline" else prefilter(prefilter(np.nan_to_num(grid), 0), 1)
    total, weight, lacks = np.zeros(len(fy)), np.zeros(len(fy)), np.zeros(len(fy), bool)
    for a in range(len(wy)):
        for b in range(len(wx)):
            i, j = i0 + first + a, j0 + first + b
            known, w = np.isfinite(at(i, j)), wy[a] * wx[b]
            v = values[np.clip(i, 0, height - 1), np.clip(j, 0, width - 1)]
            total, weight, lacks = total + np.where(known, w * np.nan_to_num(v), 0), weight + np.where(known, w, 0), lacks | ~known
    if kernel == "spline":
        return np.where(lacks, np.nan, total)
    return np.where(weight > 0, total / np.where(weight > 0, weight, 1), np.nan)


def resample(source: DataFrame, targets: DataFrame, height: int, width: int, kernel: str, *, reach: tuple[float, float] = (0.5, 0.5), block: int = 256, row: str = "row", col: str = "col", value: str = "value", fy: str = "fy", fx: str = "fx") -> DataFrame:
    """targets with `value`: the source grid at their places (fy, fx), in cells from the grid's upper left corner.

    nearest takes the cell that holds the place. bilinear and cubicspline (B-spline weights as
    they are, so smoothing) leave out missing cells and scale the others' weights; spline
    goes through the cells' values (recursive prefilter) and is NULL where one of its 16 cells is
    missing. average and mode are over cells whose centres are within `reach` (rows, columns) of
    the place, equal counts to the smallest value. Missing, NULL and not finite are one. Places outside
    the grid, or NULL, give NULL, and so do places with no source cell around them; every
    target row comes back once. Source cells are unique; columns of targets are kept, and the
    result takes a name with an underscore before it if `value` is taken.
    """
    if kernel not in KERNELS:
        raise ValueError(f"kernel {kernel}")
    halo = {"nearest": 0, "bilinear": 1, "cubicspline": 2, "spline": HALO}.get(kernel, math.ceil(max(reach)) + 1)
    if halo > block:
        raise ValueError("the halo is wider than a block")
    near = lambda c: F.array_distinct(F.transform(F.array(F.lit(-halo), F.lit(0), F.lit(halo)), lambda d: F.floor((F.col(c) + d) / block).cast("int")))
    cells = source.select(F.col(row).cast("int").alias("r"), F.col(col).cast("int").alias("c"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('Infinity')")
    cells = cells.where(F.col("r").between(0, height - 1) & F.col("c").between(0, width - 1))
    cells = cells.withColumn("br", F.explode(near("r"))).withColumn("bc", F.explode(near("c")))
    cells = cells.where(F.col("br").between(0, (height - 1) // block) & F.col("bc").between(0, (width - 1) // block))
    inside = (F.col(fy) >= 0) & (F.col(fy) < height) & (F.col(fx) >= 0) & (F.col(fx) < width)
    brow, bcol, out = free_name(targets, "block_row"), free_name(targets, "block_col"), free_name(targets, "value")
    placed = targets.withColumns({brow: F.when(inside, F.floor(F.col(fy) / block).cast("int")), bcol: F.when(inside, F.floor(F.col(fx) / block).cast("int"))})
    away = placed.where(F.col(brow).isNull()).drop(brow, bcol).withColumn(out, F.lit(None).cast("double"))
    names, schema = targets.columns, ", ".join(f"`{c}` {t}" for c, t in targets.dtypes) + f", `{out}` double"

    def run(key: tuple, own: pd.DataFrame, here: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return own[names].assign(**{out: np.empty(0)})
        r0, c0 = int(key[0]) * block - halo, int(key[1]) * block - halo
        grid = np.full((block + 2 * halo, block + 2 * halo), np.nan)
        i, j = here["r"].to_numpy("i8") - r0, here["c"].to_numpy("i8") - c0
        fit = (i >= 0) & (i < len(grid)) & (j >= 0) & (j < len(grid))
        grid[i[fit], j[fit]] = here["v"].to_numpy("f8")[fit]
        v = _kernel(grid, own[fy].to_numpy("f8") - r0, own[fx].to_numpy("f8") - c0, kernel, reach)
        # NaN comes out as NULL
        return own[names].assign(**{out: v})

    joined = placed.where(F.col(brow).isNotNull()).groupBy(brow, bcol).cogroup(cells.groupBy("br", "bc")).applyInPandas(run, schema)
    return joined.unionByName(away)

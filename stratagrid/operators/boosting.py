"""Boosted trees with a Poisson objective, L1 and L2 penalties and early stopping.

The boosting of pyspark.ml has squared, absolute and logistic losses only. Here the rate is
exp(base + sum of trees). Rows of the same bins are counted and added up once, and each level of a
tree is one grouped aggregate over these cases: they give their gradient n exp(f) - y and curvature
n exp(f) to (node, feature, bin), partial sums come before the shuffle, and running sums over the bins give the gain of every cut,

    s(GL)^2 / (HL + l2) + s(GR)^2 / (HR + l2) - s(G)^2 / (H + l2),    s(x): x moved by l1 towards 0.

Leaves are -rate * s(G) / (H + l2). The driver sees one row a node; histograms have at most
2^depth * features * (bins + 1) rows and stay in Spark. The rows that stop the search are chosen
by a hash of key.

Defined results: a missing or NaN feature has a bin of its own, below all others; rows whose label is
missing or negative are left out of the fit; equal gains go to the first feature, then the least
cut; a node without an admissible cut keeps its rows together; labels that are all zero, and
empty tables, are refused; other columns are untouched.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_NO_CUT = 1 << 30


@dataclass
class PoissonBoosting:
    """A fitted model: cuts of each feature, and complete trees of one depth (feature, cut, leaf)."""

    features: list[str]
    cuts: list[list[float]]
    base: float
    depth: int
    trees: list[dict] = field(default_factory=list)
    #: mean deviance of the held-out rows after each round, that without trees first
    deviances: list[float] = field(default_factory=list)

    def bins(self) -> Column:
        """The bin of each feature: 0 where missing, else one more than the cuts below the value."""

        def one(name: str, cuts: list[float]) -> Column:
            x = F.col(f"`{name}`").cast("double")
            return F.when(x.isNull() | F.isnan(x), 0).otherwise(F.size(F.filter(_literal(cuts, "array<double>"), lambda c: c < x)) + 1)

        return F.array(*[one(n, c) for n, c in zip(self.features, self.cuts, strict=True)])

    def margin(self, bins: Column) -> Column:
        """The logarithm of the rate."""
        trees = _literal(self.trees, "array<struct<feature:array<int>,cut:array<int>,leaf:array<double>>>")
        leaf = lambda t: F.get(t["leaf"], _node(bins, t["feature"], t["cut"], self.depth) - ((1 << self.depth) - 1))
        return F.aggregate(trees, F.lit(self.base), lambda f, t: f + leaf(t))

    def transform(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """df with the predicted rate."""
        return df.withColumn(name, F.exp(self.margin(self.bins())))


def _literal(value: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def _node(bins: Column, feature: Column, cut: Column, levels: int) -> Column:
    """The node that a row is in after so many levels; the root is 0, the children of i are 2i + 1 and 2i + 2."""
    if levels == 0:
        return F.lit(0)
    down = lambda at, _: at * 2 + 1 + (F.get(bins, F.get(feature, at)) > F.get(cut, at)).cast("int")
    return F.aggregate(F.sequence(F.lit(1), F.lit(levels)), F.lit(0), down)


def poisson_deviance(y: Column, rate: Column) -> Column:
    return 2 * (F.when(y > 0, y * F.log(y / rate)).otherwise(0.0) - (y - rate))


def _shrunk(g: Column, l1: float) -> Column:
    return F.signum(g) * F.greatest(F.abs(g) - l1, F.lit(0.0))


def _best_cuts(rows: DataFrame, node: Column, l1: float, l2: float, least: float) -> list:
    """One row a node: its sums g and h, and its best cut (gain, f, b and the left side's sums), if any is admissible."""
    flat = rows.select(node.alias("node"), "g", "h", F.posexplode("bins").alias("f", "b"))
    bars = flat.groupBy("node", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    all_ = Window.partitionBy("node", "f")
    upto = all_.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = bars.select("node", "f", "b", F.sum("g").over(upto).alias("gl"), F.sum("h").over(upto).alias("hl"), F.sum("g").over(all_).alias("g"), F.sum("h").over(all_).alias("h"), (F.col("b") < F.max("b").over(all_)).alias("inner"))
    part = lambda g, h: F.pow(_shrunk(g, l1), 2) / (h + l2 + 1e-12)
    g, h, gl, hl = (F.col(c) for c in ("g", "h", "gl", "hl"))
    gain = F.round(part(gl, hl) + part(g - gl, h - hl) - part(g, h), 7)
    ok = F.col("inner") & (hl >= least) & (h - hl >= least) & (gain > 0)
    best = F.max(F.when(ok, F.struct(gain.alias("gain"), (-F.col("f")).alias("f"), (-F.col("b")).alias("b"), "gl", "hl"))).alias("best")
    # the sums of the first feature's bins are the node's
    return cut.groupBy("node").agg(F.max(F.when(F.col("f") == 0, F.struct("h", "g"))).alias("total"), best).collect()


def _grow(rows: DataFrame, depth: int, rate: float, l1: float, l2: float, least: float) -> dict:
    inner, leaves = (1 << depth) - 1, [0.0] * (1 << depth)
    tree = {"feature": [0] * inner, "cut": [_NO_CUT] * inner, "leaf": leaves}
    weight = lambda g, h: -rate * math.copysign(max(abs(g) - l1, 0.0), g) / (h + l2 + 1e-12)
    for level in range(depth):
        at = _node(F.col("bins"), _literal(tree["feature"], "array<int>"), _literal(tree["cut"], "array<int>"), level)
        for r in _best_cuts(rows, at, l1, l2, least):
            i, g, h, best = r["node"], r["total"]["g"], r["total"]["h"], r["best"]
            gl, hl = (best["gl"], best["hl"]) if best else (g, h)
            if best:
                tree["feature"][i], tree["cut"][i] = -best["f"], -best["b"]
            if level == depth - 1:
                first = 2 * i + 1 - inner
                leaves[first] = weight(gl, hl)
                leaves[first + 1] = weight(g - gl, h - hl) if best else 0.0
    return tree


def fit_poisson_boosting(
    df: DataFrame, features: list[str], label: str, key: str, *, rounds: int = 50, depth: int = 3, rate: float = 0.1, bins: int = 32, l1: float = 0.0, l2: float = 1.0, least: float = 1.0, held_out: int = 10, patience: int = 5
) -> PoissonBoosting:
    """A model of at most `rounds` trees; one in held_out rows (by key) says when to stop, none where it is 0.

    The search ends when `patience` rounds brought no lower held-out deviance, and the trees after the
    best round are dropped. least is the smallest curvature on each side of a cut.
    """
    y = F.col(f"`{label}`").cast("double")
    used = df.where(y.isNotNull() & ~F.isnan(y) & (y >= 0))
    held = (F.pmod(F.xxhash64(F.col(f"`{key}`"), F.lit("held")), F.lit(held_out)) == 0) if held_out else F.lit(False)
    mean = used.where(~held).agg(F.avg(y)).first()[0]
    if not mean:
        raise ValueError("a Poisson objective needs a positive label")
    as_double = used.where(~held).select(*[F.nanvl(F.col(f"`{f}`").cast("double"), F.lit(None).cast("double")).alias(f"x{i}") for i, f in enumerate(features)])
    found = as_double.approxQuantile([f"x{i}" for i in range(len(features))], [i / bins for i in range(1, bins)], 0.1 / bins)
    model = PoissonBoosting(list(features), [sorted(set(c)) for c in found], math.log(mean), depth)
    # rows of the same bins have the same rate, so their sums say all that trees and deviances need
    cases = used.select(model.bins().alias("bins"), y.alias("y"), held.alias("held")).groupBy("bins", "held")
    base = cases.agg(F.count("*").alias("n"), F.sum("y").alias("y"), F.sum(F.when(F.col("y") > 0, F.col("y") * F.log("y")).otherwise(0.0)).alias("ylogy")).persist()

    def deviance() -> float | None:
        f = model.margin(F.col("bins"))
        of = 2 * (F.col("ylogy") - F.col("y") * f - F.col("y") + F.col("n") * F.exp(f))
        return base.where("held").agg(F.sum(of) / F.sum("n")).first()[0]

    try:
        best = deviance()
        stops = best is not None
        model.deviances = [best] if stops else []
        for _ in range(rounds):
            mu = F.exp(model.margin(F.col("bins")))
            rows = base.where(~F.col("held")).select("bins", "y", (F.col("n") * mu).alias("h")).withColumn("g", F.col("h") - F.col("y"))
            model.trees.append(_grow(rows, depth, rate, l1, l2, least))
            if stops:
                model.deviances.append(deviance())
                at = model.deviances.index(min(model.deviances))
                if len(model.trees) - at >= patience:
                    break
        if stops:
            model.trees = model.trees[: model.deviances.index(min(model.deviances))]
    finally:
        base.unpersist()
    return model

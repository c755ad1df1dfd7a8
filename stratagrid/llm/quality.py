"""Quality classifier: hierarchical empirical Bayes over documents, hosts and paths.

A logistic classifier on text statistics gives each document's evidence. Hosts and paths (host
sections) give priors: with s the sum of a group's evidence (a label where there is one) and n
its documents,

    host posterior   = (s + k1 * m) / (n + k1),              m: the global rate
    path posterior   = (s + k2 * host posterior) / (n + k2),

so a sparse site is near the global rate and a sparse path near its site; a label is one more
observation beside the evidence. The strengths k1, k2 are estimated from the variance between
groups beyond that of chance (method of moments). The document's posterior odds are its
classifier's likelihood ratio times the path's prior odds, with the document's own evidence and
own label left out of the prior: no answer is an input of its own posterior.

The classifier is fitted on at most max_rows labelled rows, chosen by hash. All counts are over
all documents, in grouped aggregates: paths first, hosts from paths, three numbers to the driver.

Defined results: a null or empty text has zero statistics and is scored like any other; null
hosts and paths are the groups ''; a text of any length is read whole; repeated ids are scored
each, and of several texts of an id that of the least hash is fitted; ties at the threshold are
kept; several labels of an id are
averaged, null ones ignored; without labels of both kinds every document has the evidence 0.5
and is kept; extra columns are kept, and where one has the
name of a result, the result has underscores before its name; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import unicodedata
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagrid.llm.common import free_name, small_batches, text_or_empty, written

SYMBOLS = "*$%&#|@^~<>{}[]\\=+_"
STOPS = ".,;:"
NAMES = ("log_words", "repeated", "stutter", "upper", "symbols", "shouts", "bars", "stops", "word_length", "letters")
_CLASSES: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """Class of every code point: 1 letter, 2 upper-case letter, 3 symbol, 4 '!', 5 '|', 6 stop, else 0; built once a worker."""
    if not _CLASSES:
        kinds = [unicodedata.category(chr(c)) for c in range(0x110000)]
        table = np.fromiter((2 if k == "Lu" else k[0] == "L" for k in kinds), np.uint8, len(kinds))
        for chars, kind in ((SYMBOLS, 3), ("!", 4), ("|", 5), (STOPS, 6)):
            table[[ord(c) for c in chars]] = kind
        _CLASSES.append(table)
    return _CLASSES[0]


def text_statistics(text: str) -> list[float]:
    """The statistics of a whole text, in the order of NAMES."""
    words = text.split()
    n, k = max(len(text), 1), max(len(words), 1)
    _, letters, upper, symbols, shouts, bars, stops = np.bincount(_classes()[np.frombuffer(text.encode("utf-32-le"), "<u4")], minlength=7).tolist()
    letters += upper
    same = sum(map(eq, words, islice(words, 1, None)))
    return [math.log1p(len(words)), 1 - len(set(words)) / k, same / k, upper / letters if letters else 0.0, (symbols + bars) / n, shouts / n, bars / k, stops / k, len(text) / k, letters / n]


def add_statistics(df: DataFrame, text: Column, prefix: str = "_x") -> DataFrame:
    """df with the statistics as columns _x0.. (in the order of NAMES); only the text goes to Python, in Arrow batches."""
    small_batches(df.sparkSession)

    @F.pandas_udf("array<double>")
    def statistics(texts: pd.Series) -> pd.Series:
        return pd.Series([text_statistics(t) for t in texts])

    stats = free_name(df, "_stats")
    df = df.withColumn(stats, statistics(text))
    return df.withColumns({f"{prefix}{i}": F.get(stats, i) for i in range(len(NAMES))}).drop(stats)


@dataclass
class Evidence:
    """Standardised logistic model and the rate of good documents it was fitted at."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    rate: float

    def logit(self, prefix: str = "_x") -> Column:
        """Log odds of quality from the columns _x0.."""
        out = F.lit(float(self.bias))
        for i in range(len(NAMES)):
            # clipped as in the fit, so one odd statistic cannot outweigh all others
            z = (F.col(f"{prefix}{i}") - float(self.mean[i])) / float(self.scale[i])
            out = out + float(self.weights[i]) * F.least(F.greatest(z, F.lit(-5.0)), F.lit(5.0))
        return out


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 30) -> Evidence:
    """Newton's method on standardised statistics; y may be fractions."""
    k = x.shape[1] if x.size else len(NAMES)
    if len(y) == 0 or y.min() >= 0.5 or y.max() < 0.5:
        return Evidence(np.zeros(k), np.ones(k), np.zeros(k), 0.0, 0.5)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.column_stack([np.ones(len(x)), np.clip((x - mean) / scale, -5, 5)])
    w, ridge = np.zeros(k + 1), np.diag([1e-6] + [l2] * k)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge, z.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return Evidence(mean, scale, w[1:], float(w[0]), float(np.clip(y.mean(), 1e-3, 1 - 1e-3)))


def fit_evidence(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 15_000) -> Evidence:
    """The classifier from at most max_rows labelled rows, chosen by hash of the id."""
    known = labels.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").cast("double").alias("_y")).where("_id is not null and _y is not null").groupBy("_id").agg(F.avg("_y").alias("_y"))
    share = max_rows / max(1, known.count())
    # a hash threshold thins the labels before the exact bound
    some = known.withColumn("_h", F.xxhash64("_id")).where(F.pmod("_h", F.lit(1_000_000)) < int(min(1.0, 1.2 * share) * 1_000_000) + 1).orderBy("_h").limit(max_rows)
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), text_or_empty(text_col).alias("_t")).join(F.broadcast(some), "_id")
    rows = rows.groupBy("_id", "_h", "_y").agg(F.min_by("_t", F.struct(F.xxhash64("_t"), F.length("_t"))).alias("_t"))
    got = add_statistics(rows, F.col("_t")).select("_h", "_y", *[f"_x{i}" for i in range(len(NAMES))]).collect()
    table = np.array(sorted(map(tuple, got)), float).reshape(-1, 2 + len(NAMES))
    return fit_logistic(table[:, 2:], table[:, 1])


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def _strength(between: float, n: float, groups: float, rate: float) -> float:
    """Prior strength in documents: rate (1 - rate) over the variance between groups beyond chance."""
    chance = rate * (1 - rate) * max(groups - 1, 0) / max(n, 1)
    extra = between / max(n, 1) - chance
    return min(1e6, max(1.0, rate * (1 - rate) / extra - 1)) if extra > 1e-9 else 1e6


@dataclass
class Sites:
    """Path posteriors (columns _host, _path, host_posterior, path_posterior, and the sums s, n, hs, hn) and the numbers behind them."""

    paths: DataFrame
    rate: float
    host_strength: float
    path_strength: float


def site_posteriors(evidence: DataFrame) -> Sites:
    """Posteriors from evidence (columns _host, _path, _p), one row a document."""
    paths = written(evidence.groupBy("_host", "_path").agg(F.sum("_p").alias("s"), F.count("*").cast("double").alias("n")), "quality-paths")
    hosts = paths.groupBy("_host").agg(F.sum("s").alias("hs"), F.sum("n").alias("hn"))
    s, n, groups, squares = hosts.agg(F.sum("hs"), F.sum("hn"), F.count("*"), F.sum(F.col("hs") * F.col("hs") / F.col("hn"))).first()
    if not n:
        return Sites(paths.select("_host", "_path", F.lit(0.5).alias("host_posterior"), F.lit(0.5).alias("path_posterior"), "s", "n", F.col("s").alias("hs"), F.col("n").alias("hn")), 0.5, 1e6, 1e6)
    rate = s / n
    k1 = _strength(squares - n * rate * rate, n, groups, rate)
    both = paths.join(hosts, "_host")
    within, n_paths = both.agg(F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("hs") / F.col("hn"), F.lit(2))), F.count("*")).first()
    k2 = _strength(within, n, n_paths - groups + 1, rate)
    both = both.withColumn("host_posterior", (F.col("hs") + k1 * rate) / (F.col("hn") + k1))
    both = both.withColumn("path_posterior", (F.col("s") + k2 * F.col("host_posterior")) / (F.col("n") + k2))
    return Sites(written(both.select("_host", "_path", "host_posterior", "path_posterior", "s", "n", "hs", "hn"), "quality-sites"), rate, k1, k2)


def score_names(docs: DataFrame) -> dict[str, str]:
    """Names of the results beside the columns of docs: their own where they are free."""
    return {n: free_name(docs, n) for n in ("quality_evidence", "host_posterior", "path_posterior", "quality_posterior", "quality_keep")}


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    host: Column,
    path: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float = 0.5,
    max_rows: int = 15_000,
    broadcast_paths: int = 200_000,
) -> DataFrame:
    """docs with quality_evidence, host_posterior, path_posterior, quality_posterior and quality_keep.

    A result whose name docs has already is called as score_names(docs) says.
    """
    model = fit_evidence(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, max_rows=max_rows)
    called = score_names(docs)
    p = "_q"
    while any(c.lower().startswith(p) for c in docs.columns):
        p += "_"
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.withColumns({f"{p}text": text_or_empty(text_col), f"{p}host": F.coalesce(host.cast("string"), F.lit("")), f"{p}path": F.coalesce(path.cast("string"), F.lit(""))})
    rows = add_statistics(rows, F.col(f"{p}text"), f"{p}x").withColumn(f"{p}z", model.logit(f"{p}x"))
    z = F.col(f"{p}z")
    lid, y = f"{p}lid", f"{p}y"
    known = labels.select(F.col(f"`{id_col}`").alias(lid), F.col(f"`{label_col}`").cast("double").alias(y)).where(F.col(lid).isNotNull() & F.col(y).isNotNull()).groupBy(lid).agg(F.avg(y).alias(y))
    known = F.broadcast(known) if known.count() <= broadcast_paths else known
    rows = rows.join(known, F.col(f"`{id_col}`") == F.col(lid), "left")
    seen = rows.select(F.col(f"{p}host").alias("_host"), F.col(f"{p}path").alias("_path"), F.explode(F.array_compact(F.array(_sigmoid(z), F.col(y)))).alias("_p"))
    sites = site_posteriors(seen)
    names = {c: f"{p}{c}" for c in ("s", "n", "hs", "hn", "host_posterior", "path_posterior")} | {"_host": f"{p}host", "_path": f"{p}path"}
    paths = sites.paths.withColumnsRenamed(names)
    paths = F.broadcast(paths) if sites.paths.count() <= broadcast_paths else paths
    base = float(np.log(model.rate / (1 - model.rate)))
    # the prior without the document's own evidence and label
    less = lambda total: F.greatest(F.col(f"{p}{total}") - _sigmoid(z) - F.coalesce(F.col(y), F.lit(0.0)), F.lit(0.0))
    own = F.when(F.col(y).isNull(), 1).otherwise(2)
    host_prior = (less("hs") + sites.host_strength * sites.rate) / (F.col(f"{p}hn") - own + sites.host_strength)
    prior = (less("s") + sites.path_strength * host_prior) / (F.col(f"{p}n") - own + sites.path_strength)
    out = rows.join(paths, [f"{p}host", f"{p}path"]).withColumn(f"{p}q", _sigmoid(z - base + _logit(prior)))
    results = {
        "quality_evidence": _sigmoid(z),
        "host_posterior": F.col(f"{p}host_posterior"),
        "path_posterior": F.col(f"{p}path_posterior"),
        "quality_posterior": F.col(f"{p}q"),
        "quality_keep": F.col(f"{p}q") >= threshold,
    }
    return out.select(*columns, *[c.alias(called[n]) for n, c in results.items()])


def keep_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that the classifier keeps, with their own columns."""
    return score_quality(docs, labels, **options).where(F.col(score_names(docs)["quality_keep"])).select(*[f"`{c}`" for c in docs.columns])

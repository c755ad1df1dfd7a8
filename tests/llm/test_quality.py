from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratagrid.llm import quality as Q

DATA = "/root/testdata/sf0.01"


def plain(t):
    t = t or ""
    w = t.split()
    n, k = max(len(t), 1), max(len(w), 1)
    letters = len(re.findall(r"[^\W\d_]", t))
    up = sum(c.isupper() for c in t)
    sym = sum(c in Q.SYMBOLS for c in t)
    return [np.log1p(len(w)), 1 - len(set(w)) / k, sum(a == b for a, b in zip(w, w[1:])) / k, up / letters if letters else 0, sym / n, t.count("!") / n, t.count("|") / k, sum(c in ".,;:" for c in t) / k, len(t) / k, letters / n]


def test_statistics(spark):
    texts = ["", None, " ", "One one one two!!", "A | b | c.\nd,e;f", "ÉTÉ été", "x" * 3000 + " ***", "a " * 4000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = Q.add_statistics(rows.withColumn("t", F.coalesce("t", F.lit(""))), F.col("t")).orderBy("i").collect()
    for r, t in zip(got, texts, strict=True):
        assert [r[f"_x{i}"] for i in range(len(Q.NAMES))] == pytest.approx(plain(t), abs=1e-9), t


def test_posteriors_against_the_formulas(spark):
    rng = np.random.default_rng(1)
    rows = []
    for h in range(12):
        p = rng.beta(4, 2)
        for k in range(rng.integers(1, 4)):
            rows += [(f"h{h}", f"p{k}", float(rng.random() < p)) for _ in range(int(rng.integers(1, 60)))]
    s = Q.site_posteriors(spark.createDataFrame(rows, "_host string, _path string, _p double"))
    n, m = len(rows), np.mean([r[2] for r in rows])
    hosts = {h: [r[2] for r in rows if r[0] == h] for h in {r[0] for r in rows}}
    between = sum(len(v) * (np.mean(v) - m) ** 2 for v in hosts.values())
    k1 = Q._strength(between, n, len(hosts), m)
    assert s.host_strength == pytest.approx(k1)
    for r in s.paths.collect():
        v = hosts[r["_host"]]
        hp = (sum(v) + k1 * m) / (len(v) + k1)
        own = [x[2] for x in rows if x[:2] == (r["_host"], r["_path"])]
        assert r["host_posterior"] == pytest.approx(hp)
        assert r["path_posterior"] == pytest.approx((sum(own) + s.path_strength * hp) / (len(own) + s.path_strength))


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    seen = labels.where("doc_id % 3 != 0")
    got = Q.score_quality(docs, seen, host=F.col("source"), path=F.col("lang")).join(labels.where("doc_id % 3 = 0"), "doc_id").select("quality_keep", "quality").collect()
    assert np.mean([r[0] == bool(r[1]) for r in got]) >= 0.95
    good = [r[0] for r in got if r[1]]
    assert np.mean(good) >= 0.97


def test_nulls_ties_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, None, None, "k"), (1, "good text here.", "s", "k"), (None, "x", "s", None), (2, "", "s", "l")], "doc_id long, text string, source string, quality string")
    labels = spark.createDataFrame([(1, 1, "z"), (1, 0, "z"), (2, None, "z"), (None, 1, "z")], "doc_id long, quality int, text string")
    got = Q.score_quality(docs, labels, host=F.col("source"), path=F.col("quality"))
    assert got.count() == 4 and got.columns[:4] == docs.columns
    kept = Q.keep_quality(docs, labels.limit(0), host=F.col("source"), path=F.col("quality"))
    assert kept.count() == 4 and kept.columns == docs.columns
    assert Q.keep_quality(docs.limit(0), labels, host=F.col("source"), path=F.col("quality")).count() == 0


def test_clashing_names_long_texts_and_order_of_rows(spark):
    rows = [(i, f"Some good text here, number {i}." if i % 3 else "*** $$$ BUY !!! " * (2 + i % 5), "s" if i % 2 else "t", 1, 2.0, "h", "p", "q") for i in range(60)]
    rows += [(1, "*** $$$ other text of the id", "s", 1, 2.0, "h", "p", "q"), (70, "fine words. " * 20_000, "s", 1, 2.0, "h", "p", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _x0 int, _z double, _host string, _path string, _qhost string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(50)], "doc_id long, quality int")
    score = lambda df: {(r["doc_id"], r["text"]): tuple(r) for r in Q.score_quality(df, labels, host=F.col("source"), path=F.col("_path")).collect()}
    got = score(docs.repartition(7))
    assert len(got) == 62 and all(r[3:8] == (1, 2.0, "h", "p", "q") for r in got.values())
    other = score(docs.orderBy(F.desc("text")).coalesce(2))
    assert all(other[k] == pytest.approx(v) if isinstance(v, float) else other[k][8:12] == pytest.approx(v[8:12]) for k, v in got.items())
    assert got[70, rows[-1][1]][-1] is True


def test_document_posteriors_against_the_formulas(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(["Good", "words", "***", "$$", "here."], 12)), f"h{i % 4}", f"p{i % 3}") for i in range(80)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in Q.score_quality(docs, labels, host=F.col("source"), path=F.col("lang")).collect()}
    model = Q.fit_evidence(docs, labels)
    c = {i: got[i]["quality_evidence"] for i in got}
    z = {i: model.bias + float(np.clip((np.array(plain(t)) - model.mean) / model.scale, -5, 5) @ model.weights) for i, t, _, _ in rows}
    seen = [(i, h, p, v) for i, _, h, p in rows for v in ([c[i]] + ([float(i % 2)] if i < 40 else []))]
    s = Q.site_posteriors(spark.createDataFrame([x[1:] for x in seen], "_host string, _path string, _p double"))
    for i, _, h, p in rows:
        assert c[i] == pytest.approx(1 / (1 + np.exp(-z[i])))
        # what the other documents say
        hv, pv = [x[3] for x in seen if x[0] != i and x[1] == h], [x[3] for x in seen if x[0] != i and x[1:3] == (h, p)]
        hp = (sum(hv) + s.host_strength * s.rate) / (len(hv) + s.host_strength)
        pp = (sum(pv) + s.path_strength * hp) / (len(pv) + s.path_strength)
        odds = np.exp(z[i]) * (1 - model.rate) / model.rate * pp / (1 - pp)
        assert got[i]["quality_posterior"] == pytest.approx(odds / (1 + odds)) and got[i]["quality_keep"] == (got[i]["quality_posterior"] >= 0.5)


def test_columns_with_the_names_of_results_stay(spark):
    rows = [(i, "Good words are here." if i % 2 else "*** $$$ !!!", "s", -1.0, -2.0, "mine") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, quality_evidence double, Path_Posterior double, quality_keep string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    site = {"host": F.col("source"), "path": F.col("quality_keep")}
    scored = Q.score_quality(docs, labels, **site)
    assert scored.columns == [*docs.columns, "_quality_evidence", "host_posterior", "_path_posterior", "quality_posterior", "_quality_keep"]
    kept = Q.keep_quality(docs, labels, **site)
    assert kept.columns == docs.columns and {tuple(r) for r in kept.collect()} == {r for r in rows if r[0] % 2}

from __future__ import annotations

import random

import pytest

from stratagrid.llm import nearcopies as N
from tests.llm.test_simhash import roots


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {()}


def corpus():
    """Originals, and copies with one to eight words changed: most are over 0.8, some below."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(500)]
    base = [" ".join(rng.choices(vocabulary, k=rng.choice((60, 150, 400)))) for _ in range(15)]
    rows = list(enumerate(base))
    for i in range(15, 150):
        w = (base[0] if i < 75 else rng.choice(base)).split()
        for _ in range(rng.randint(1, 8)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i, " ".join(w).upper() if i % 7 == 0 else " ".join(w)))
    return rows + [(150, None), (151, " "), (152, "a b"), (153, "A  b"), (154, "a b c"), (None, base[1]), (3, base[3])]


@pytest.mark.parametrize("rounds", [1, 3])
def test_one_of_each_group_of_similar_texts_stays(spark, rounds):
    rows = corpus()
    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = roots(range(len(rows)), links)
    want = {min(rows[i][0] for i in root if root[i] == r and rows[i][0] is not None) for r in set(root.values())}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [r["doc_id"] for r in N.drop_near_copies(docs, rounds=rounds).collect()]
    assert sorted(kept) == sorted(want)


def test_the_stage_drops_a_copy_that_three_bits_miss(spark):
    import corpus_pipeline
    from stratagrid.llm.simhash import drop_near_duplicates

    rng = random.Random(6)
    w = rng.choices([f"w{i}" for i in range(500)], k=200)
    near = w.copy()
    for p in (20, 90, 150):
        near[p] = "changed"
    docs = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(near)), (3, "other words are here too")], "doc_id long, text string")
    assert drop_near_duplicates(docs).count() == 3
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 3]
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").collect() == []


def test_parity_sketches_never_count_more_than_stands_apart():
    import numpy as np

    rng = np.random.default_rng(3)
    for n, apart in ((1, 1), (5, 0), (60, 12), (400, 90), (3000, 700), (20_000, 4000)):
        common, a, b = (rng.integers(0, 1 << 63, k, dtype=np.uint64) for k in (n, apart, apart))
        differ = sum(int(x).bit_count() for x in N._parity(np.union1d(common, a)) ^ N._parity(np.union1d(common, b)))
        real = len(np.setxor1d(np.union1d(common, a), np.union1d(common, b)))
        assert differ <= real and (real - differ) % 2 == 0
        assert n > 1000 or differ >= 0.9 * real


def test_large_buckets_in_parts_and_long_texts_lose_no_pair(spark, monkeypatch):
    """Pairs of the last step equal brute force where buckets are dealt into many parts."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = {k: rng.choices(vocabulary, k=n) for k, n in (("short", 120), ("long", 6000))}
    rows = []
    for kind, copies, most in (("short", 60, 4), ("long", 6, 400)):
        for _ in range(copies):
            w = base[kind].copy()
            for _ in range(rng.randint(1, most)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = N.prints(docs, "doc_id", "text", 5, 48, 8, 42).drop("doc_id").persist()
    ids = {r["node"]: i for i, r in enumerate(found.collect())}
    from pyspark.sql import functions as F

    # every text a component of its own, in every bucket that it shares
    buckets = found.select("node", "n", F.explode("bands").alias("key"), F.col("node").alias("root"))
    monkeypatch.setattr(N, "_PART", 7)
    got = {frozenset((ids[r["a"]], ids[r["b"]])) for r in N._rest_pairs(buckets, found, 0.8, 384).collect()}
    sets = [shingles(t) for _, t in rows]
    close = {frozenset((i, j)) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert close <= got and len(close) > 100
    assert all(len(sets[i] & sets[j]) >= 0.7 * len(sets[i] | sets[j]) for i, j in map(tuple, got))
    found.unpersist()

from __future__ import annotations

import random

import numpy as np

from stratagrid.llm import decontam as D


def distance(item, text):
    """Least edits between item and any stretch of text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item):
        new = [i + 1]
        for j, x in enumerate(text):
            new.append(min(row[j] + (w != x), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_best_match_is_the_least_edit_distance():
    rng = random.Random(1)
    for _ in range(200):
        item = np.array([rng.randint(1, 4) for _ in range(rng.randint(1, 9))])
        text = np.array([rng.randint(0, 4) for _ in range(rng.randint(0, 14))], int)
        got, want = D.best_match(item, text, 99), distance(item.tolist(), text.tolist())
        assert got[0] == want
        assert distance(item.tolist(), text[got[1] : got[2]].tolist()) == want


VOCAB = [f"w{i}" for i in range(300)]


def edited(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        p, op = rng.randrange(len(w)), rng.random()
        if op < 0.5:
            w[p] = rng.choice(VOCAB)
        elif op < 0.75:
            w.insert(p, rng.choice(VOCAB))
        else:
            del w[p]
    return w


def build(rng, n_items=30, n_docs=240):
    items = [(k, " ".join(rng.choices(VOCAB, k=rng.choice((3, 6, 9, 15, 25, 40))))) for k in range(n_items)]
    docs = []
    for d in range(n_docs):
        w = rng.choices(VOCAB, k=rng.randint(0, 120))
        if d % 2:
            own = rng.choice(items)[1].split()
            p = rng.randint(0, len(w))
            w[p:p] = edited(rng, own, rng.randint(0, int(0.2 * len(own))))
        docs.append((d, " ".join(w).title() if d % 5 == 0 else ", ".join(w)))
    return docs, items


def test_recall_and_exactness_against_brute_force(spark):
    docs, items = build(random.Random(2))
    words = {d: D.words_of(t) for d, t in docs}
    want = {}
    for k, t in items:
        i = D.words_of(t)
        for d, w in words.items():
            e = distance(i, w)
            if 1 - e / len(i) >= 0.8 - 1e-9:
                want[d, k] = e
    got = {(r["doc_id"], r["item_id"]): r for r in D.benchmark_matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) <= set(want)
    assert len(got) >= 0.95 * len(want)
    exact = {k for k, e in want.items() if e == 0}
    assert exact <= set(got)
    for (d, k), r in got.items():
        assert r["edits"] >= want[d, k] and r["similarity"] >= 0.8 - 1e-9
        assert distance(D.words_of(dict(items)[k]), words[d][r["first_word"] : r["end_word"]]) == r["edits"]


def test_long_document_and_place_of_the_match():
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho"
    index = D.Index([(7, item)], 0.8, 4, 8, 11)
    for at in (0, 1, 2, 3, 5000):
        text = ["x"] * at + item.split() + ["y"] * 3
        ids = np.array([index.vocab.get(w, 0) for w in text], np.int32)
        assert D._match_group(index, [(1, ids), (2, ids[:5])]) == [(1, 7, 0, 17, 1.0, at, at + 17)]


def test_drop_keeps_clean_rows_and_columns(spark):
    item = " ".join(VOCAB[:20])
    rows = [(1, item, "a"), (1, "clean text", "b"), (2, None, "c"), (3, "", "d"), (None, f"so {item} it is", "e"), (None, "fine", "f"), (1, item, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(5, item), (5, item), (6, None), (7, "?!"), (None, "clean text but longer")], "item_id long, text string")
    kept = D.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r["item_id"] for r in kept.collect()) == ["b", "c", "d", "f"]
    assert D.drop_contaminated(docs, items.limit(0)).count() == len(rows)
    assert D.benchmark_matches(docs.limit(0), items).collect() == []
    got = sorted((tuple(r)[:2] for r in D.benchmark_matches(docs, items).collect()), key=str)
    assert got == [(1, 5)] * 4 + [(None, 5)] * 2


def test_recall_of_every_length_at_the_edit_limit():
    for n in (8, 9, 10, 12, 15, 16, 17, 18, 20, 24, 25, 40, 200, 1000):
        rng = random.Random(3 + n)
        items = [(k, rng.choices(range(2000), k=n)) for k in range(300 if n <= 40 else 12)]
        index = D.Index([(k, " ".join(f"w{x}" for x in w)) for k, w in items], 0.8, 4, 8, 11)
        docs = []
        for k, w in items:
            around = [[f"w{x}" for x in rng.choices(range(2000), k=rng.randint(0, 60))] for _ in range(2)]
            text = around[0] + edited(rng, [f"w{x}" for x in w], n // 5) + around[1]
            docs.append((k, np.array([index.vocab.get(x, 0) for x in text], np.int32)))
        got = {m[:2] for m in D._match_group(index, docs)}
        assert sum((k, k) in got for k, _ in items) >= 0.99 * len(items), n


def test_items_in_slices_have_the_same_matches(spark):
    docs, items = build(random.Random(6), n_items=12, n_docs=60)
    items += [(100, items[0][1]), (101, items[0][1].upper())]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = lambda df: sorted(tuple(r)[:2] for r in df.collect())
    whole = rows(D.benchmark_matches(d, i))
    size = sum(len(t) for _, t in items)
    assert rows(D.benchmark_matches(d, i, slice_chars=size // 3)) == whole
    assert {(k, 100) for k, j in whole if j == 0} | {(k, 101) for k, j in whole if j == 0} <= set(whole)

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pytest

from stratagrid.llm import langid as L

DATA = "/root/testdata/sf0.001"


def brute(scores, t, start):
    n, k = scores.shape
    total, marg = 0.0, np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        s = start[path[0]] + sum(scores[i, c] for i, c in enumerate(path)) + sum(t[a, b] for a, b in zip(path, path[1:]))
        p = np.exp(s)
        total += p
        for i, c in enumerate(path):
            marg[i, c] += p
    return marg / total


@pytest.mark.parametrize("segment", [1, 2, 3, 32])
def test_forward_backward_is_exact(segment):
    rng = np.random.default_rng(1)
    lengths = np.array([1, 7, 2, 6, 3])
    scores, t, start = rng.normal(size=(lengths.sum(), 3)) * 3, rng.normal(size=(3, 3)), rng.normal(size=3)
    got = L.marginals(scores, lengths, t, start, segment)
    want = np.concatenate([brute(s, t, start) for s in np.split(scores, np.cumsum(lengths)[:-1])])
    assert np.allclose(got, want, atol=1e-9)


def test_training_marginals_agree_with_brute_force():
    rng = np.random.default_rng(2)
    e, t, start = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    marg, pairs = L._expected(e, t, start)
    assert np.allclose(marg[1], brute(e[1], t, start)) and np.isclose(pairs.sum(), 6)


EN, DE = "the cat and this other thing with that", "der hund und nicht eine sache mit dem"


def tiny():
    rng = np.random.default_rng(3)
    return L.fit([(" ".join(rng.permutation(s.split())), lang) for s, lang in ((EN, "en"), (DE, "de")) for _ in range(30)])


def test_switched_text_is_labelled_by_piece():
    model = tiny()
    post = L.Labeller(model).label([EN + ". " + DE, None, "12 - 3", EN.upper() * 3000])
    best = [model.langs[k] for k in post[0].argmax(1)]
    assert best == ["en"] * 8 + ["de"] * 8
    assert len(post[1]) == len(post[2]) == 0 and (post[3].argmax(1) == 1).all()


def test_cache_size_changes_nothing(monkeypatch):
    model, texts = tiny(), [EN, DE, "andere thing cat", EN + DE]
    want = L.Labeller(model).label(texts)
    monkeypatch.setattr(L, "CACHE_WORDS", 3)
    monkeypatch.setattr(L, "BATCH_WORDS", 5)
    got = L.Labeller(model).label(texts)
    assert all(np.allclose(a, b) for a, b in zip(want, got))


def test_held_out_accuracy_and_sample(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    sample = L.training_sample(docs, docs_per_lang=5)
    assert len(sample) <= 20
    kept = {r["text"] for d, r in rows.items() if zlib.crc32(str(d).encode()) % 4 != 2}
    assert all(t in kept for t, _ in sample)
    assert len(L.training_sample(docs, docs_per_lang=50, max_rows=8)) <= 8
    with pytest.raises(ValueError, match="languages"):
        L.training_sample(docs, max_langs=1)
    got = L.identify_languages(docs.withColumnRenamed("n_chars", "score")).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    out = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in out} == {d for d in rows if zlib.crc32(str(d).encode()) % 4 == 2}
    assert sum(r["lang_pred"] == rows[r["doc_id"]]["lang"] for r in out) >= 0.95 * len(out)


def test_only_letters_are_words():
    assert L.WORD.findall("½ ² ① Ⅷ 12 _ ٣") == [] and L.WORD.findall("a½b 一二 é1 x_y") == ["a", "b", "一二", "é", "x", "y"]


def test_words_of_any_text_are_runs_of_letters():
    for t in ("Ab½cd Ⅷ² É1 x", "plain Words here", "", "① ②", "一二½三"):
        assert L.letter_runs(t) == L.WORD.findall(t.lower())


def test_document_scores_against_brute_force(spark):
    model = tiny()
    texts = ["the hund and cat", "½ ² ①", "der the", "a"]
    got = {r["doc_id"]: r for r in L.predict_languages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for k, t in enumerate(texts):
        words = L.WORD.findall(t)
        if not words:
            assert (got[k]["lang_pred"], got[k]["score"]) == ("und", 0.0)
            continue
        mean = brute(model.word_scores(words).astype(float), model.transitions, model.start).mean(axis=0)
        assert got[k]["lang_pred"] == model.langs[int(mean.argmax())] and got[k]["score"] == pytest.approx(mean.max(), abs=1e-5)


def test_nulls_and_empty(spark):
    docs = spark.createDataFrame([(1, None, "en"), (2, "42!", None), (None, EN, None), (2, DE, "x")], "doc_id long, text string, lang string")
    got = sorted((tuple(r)[:4] for r in L.predict_languages(docs, tiny()).collect()), key=str)
    assert [g[2] for g in got if g[0] == 1] == ["und"] and [g[2] for g in got if g[0] is None] == ["en"]
    assert sorted(g[2] for g in got if g[0] == 2) == ["de", "und"]
    spans = L.language_spans(docs, tiny()).collect()
    assert {(r["lang"], r["n_words"]) for r in spans} == {("en", 8), ("de", 8)}
    assert L.identify_languages(docs.limit(0)).collect() == []
    assert L.identify_languages(docs.where("text is null")).first()["lang_pred"] == "und"

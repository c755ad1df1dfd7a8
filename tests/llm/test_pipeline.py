from __future__ import annotations

import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as C
from stratagrid.llm import decontam, simhash
from stratagrid.llm.mixing import mix_sources
from stratagrid.llm.queries import SHARES
from tests.llm.test_simhash import roots

DATA = "/root/testdata/sf0.001"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {()}


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """What each stage has written, the input first."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for k, (_, f) in enumerate(C.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        f(spark, out[-1], DATA).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stage_columns(steps):
    for df in steps[1:-1]:
        assert df.columns == steps[0].columns


def test_quality_rejects_the_bad_and_keeps_the_good(spark, steps):
    kept = {r["doc_id"] for r in steps[1].collect()}
    labels = spark.read.parquet(f"{DATA}/labels.parquet").collect()
    good, bad = [r["doc_id"] for r in labels if r["quality"]], [r["doc_id"] for r in labels if not r["quality"]]
    assert np.mean([d in kept for d in good]) >= 0.95 and np.mean([d in kept for d in bad]) <= 0.2


def test_one_of_each_near_duplicate_group_stays(steps):
    """Groups are linked at five-word shingle similarity of 0.8 or more, as stages on word shingles have to be."""
    rows = [(r["doc_id"], shingles(r["text"])) for r in steps[1].collect()]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if len(rows[i][1] & rows[j][1]) >= 0.8 * len(rows[i][1] | rows[j][1])]
    root = roots(range(len(rows)), links)
    want = {min(rows[i][0] for i in root if root[i] == r) for r in set(root.values())}
    assert {r["doc_id"] for r in steps[2].collect()} == want and steps[2].count() == len(want)


def test_contaminated_documents_go(spark, steps):
    items = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    words = [" ".join(decontam.words_of(t)) for t in items]
    for r in steps[3].collect():
        text = f" {' '.join(decontam.words_of(r['text']))} "
        assert not any(f" {w} " in text for w in words)
    gone = {r["doc_id"]: r["text"] for r in steps[2].collect()}
    for r in steps[3].collect():
        gone.pop(r["doc_id"])
    assert sum(any(t in x for t in items) for x in gone.values()) >= 0.9 * len(gone)


def test_mix_and_token_files_follow_the_schedule(spark, steps):
    order = {r["doc_id"]: r["mix_order"] for r in mix_sources(steps[3], SHARES).collect()}
    assert steps[4].count() == steps[3].count() == len(order)
    got = sorted(steps[5].collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted(order, key=order.get)
    tok = Tokenizer.from_file(public_tokenizers.path(C.TOKENIZER))
    text, at = {r["doc_id"]: r["text"] for r in steps[3].collect()}, 0
    for r in got:
        ids = np.array([*tok.encode(text[r["doc_id"]], add_special_tokens=False).ids, 0], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_run_is_the_stages_in_turn(spark, steps):
    assert sorted(map(tuple, C.run(spark, DATA).collect())) == sorted(map(tuple, steps[5].collect()))


def test_rows_without_files_and_odd_rows(spark):
    docs = spark.createDataFrame([(5, None, "en", None, 0), (2, "", None, "a", 0), (None, "lone text", "en", "a", 9), (2, "", None, "a", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, f in C.STAGES:
        assert f(spark, docs, DATA).count() <= 4, name
        assert f(spark, docs.limit(0), DATA).collect() == []
    assert [r["doc_id"] for r in C.token_output(spark, docs, DATA).orderBy("start").collect()] == [None, 2, 2, 5]
    assert simhash.drop_near_duplicates(docs).where(F.col("doc_id").isNotNull()).count() == 1

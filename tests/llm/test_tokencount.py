from __future__ import annotations

import random
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from stratagrid.llm import tokencount as T

JSON, WORDS, MODEL = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def library(path):
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda t: len(sp.encode(t))
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    return lambda t: len(tok.encode(t, add_special_tokens=False).ids)


ODD = [
    "", " ", "\n", "  \n ", "a", " a", "don't we'll I'M 's", "x  y   z\n\n\tq  r", "<|endoftext|>", "a<|endoftext|> b<|startoftext|>c", "\u0000\u001c\u0085﻿",
    "汉字 仮名 한글 🙂🙂 ١٢٣ ²³ Ⅷ", "՘x\U00010ec5y\U0001d6a6z", "word " * 5000, "x" * 30000, " " * 3000 + "y", "é‍­",
]


def random_text(rng):
    alphabet = "abcXYZ019 .,!?'-\n\t  éß漢🙂  ​<|endoftext|>"
    return "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 80)))


@pytest.mark.parametrize("path", [JSON, WORDS, MODEL])
def test_counts_are_those_of_the_library(spark, path):
    rng, count = random.Random(5), library(path)
    texts = [*ODD, *[random_text(rng) for _ in range(1500)], None, None, "same", "same"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    for entries in (50, 32_768):
        got = {r["doc_id"]: r for r in T.with_token_counts(df, path, limit=20, entries=entries).collect()}
        assert len(got) == len(texts)
        for k, t in enumerate(texts):
            want = count(t or "")
            assert (got[k]["n_bytes"], got[k]["n_tokens"], got[k]["over_limit"]) == (len((t or "").encode()), want, want > 20), repr(t)


def test_query_counts_whole_documents(spark):
    from stratagrid.llm import queries

    sf, count = "/root/testdata/sf0.001", library(JSON)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op13_token_counts(spark, sf)
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"}
    rows = got.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        n = count(texts[r["doc_id"]])
        assert tuple(r)[1:] == (len(texts[r["doc_id"]].encode()), n, n > 512)


def test_pre_tokens_agree_with_the_library_on_every_settled_character():
    from tokenizers import Tokenizer

    pre, tok = T.PreTokens(JSON), Tokenizer.from_file(JSON).pre_tokenizer
    for base in range(0, 0x20000, 0x800):
        chars = [chr(c) for c in range(base, base + 0x800) if not 0xD800 <= c < 0xE000]
        text = "".join(f"\na{c}1{c}!{c} \n" for c in chars if not T.RECENT.search(c))
        assert BYTE_PIECES(tok, text) == [p for part in pre.pieces(text) or [[]] for p in part]


def BYTE_PIECES(tok, text):
    return [text[a:b] for _, (a, b) in tok.pre_tokenize_str(text)]


def test_long_texts_are_cut_only_where_the_library_cuts(monkeypatch):
    monkeypatch.setattr(T, "STRIDE", 7)
    rng, count, pre = random.Random(1), library(JSON), T.PreTokens(JSON)
    lengths = T.Lengths(T.packed({}), pre)
    for _ in range(3000):
        text = random_text(rng)
        assert lengths.count(text) == count(text)


def test_summaries_keep_the_frequent_pieces(spark):
    words = [f"w{k}" for k in range(300) for _ in range(300 - k)]
    random.Random(2).shuffle(words)
    df = spark.createDataFrame([(" ".join(words[k : k + 90]),) for k in range(0, len(words), 90)], "text string").repartition(40)
    pre = T.PreTokens(JSON)
    exact = Counter(p for r in df.collect() for part in pre.pieces(r["text"]) for p in part)
    total, got = sum(exact.values()), T.frequent_pieces(df, JSON, entries=128)
    assert len(got) <= 128
    for p, n in exact.items():
        assert got.get(p, 0) <= n and n - got.get(p, 0) <= total / 128
    assert T.frequent_pieces(df, JSON, entries=100_000) == exact


def test_table_round_trip_and_bound():
    table = {" the": 1, "漢": 2, "x" * 64: 30}
    assert T.unpacked(T.packed(table)) == table and T.unpacked(T.packed({})) == {}


def test_empty_tables_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", 7, "x", True, "p")], "doc_id long, text string, n_tokens int, N_BYTES string, over_limit boolean, part string")
    out = T.with_token_counts(df, JSON)
    row = out.first()
    assert (row["n_tokens"], row["N_BYTES"], row["over_limit"], row["part"]) == (7, "x", True, "p") and (row["_n_tokens"], row["_n_bytes"], row["_over_limit"]) == (2, 3, False)
    assert T.with_token_counts(df.where(F.lit(False)), JSON).collect() == []
    assert T.with_token_counts(df.withColumn("text", F.lit(None).cast("string")), JSON).first()["_n_tokens"] == 0

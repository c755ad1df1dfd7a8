from __future__ import annotations

import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stratagrid.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", "a", "One two  three\n\nfour\tfive \n", "\x1c odd \x85 spaces\xa0here ", "don't (can't) 12.5% it's'", "été – naïve, Straße!!!\nnext line",
    "日本語 テキスト, mixed", "<|endoftext|> stays text", "x<|endoftext|>y", "so  <|endoftext|>\n<|endoftext|>", "é" * 400_000, "   leading", "trailing   ", "a\r\nb", "***$$$ x&&&, y", "word, word. word; word's", "\n\n\n", "x" * 5000, "-a -- 'b' ''c",
]


def plain(text: str) -> np.ndarray:
    t = Tokenizer.from_file(PATH)
    return np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4")


def test_pieces_have_the_ids_of_the_whole_text():
    e = tokens.Encoder(PATH)
    for text in TEXTS * 2:
        assert np.frombuffer(e.ids(text), "<u4").tolist() == plain(text)[:-1].tolist(), text


def test_other_kinds_of_tokenizer_encode_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    e, t = tokens.Encoder(path), Tokenizer.from_file(path)
    for text in TEXTS:
        assert np.frombuffer(e.ids(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_special_tokens_are_those_of_the_plain_call():
    ids = np.frombuffer(tokens.Encoder(PATH).ids("x<|endoftext|>y"), "<u4").tolist()
    assert ids == Tokenizer.from_file(PATH).encode("x<|endoftext|>y", add_special_tokens=False).ids and 50256 in ids


def test_small_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PIECES", 2)
    e = tokens.Encoder(PATH)
    for text in TEXTS:
        assert np.frombuffer(e.ids(text), "<u4").tolist() == plain(text)[:-1].tolist()


def test_seek_table_reads_single_frames_and_checks_them():
    out = io.BytesIO()
    w = tokens.ShardWriter(out)
    w.add(None, b"\1\0\0\0")
    for d in (3, 3, 9):
        w.add(d, np.arange(d, dtype="<u4").tobytes())
    w.close()
    r = tokens.ShardReader(io.BytesIO(out.getvalue()))
    assert len(r) == 4 and r.find(3) == [1, 2] and r.find(4) == [] and r.frame(0).doc_id is None
    assert np.frombuffer(r.raw(3), "<u4").tolist() == list(range(9))
    import zstandard

    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue()), read_across_frames=True).read()
    assert whole == b"".join(r.raw(k) for k in range(4))
    bad = bytearray(out.getvalue())
    bad[r.frame(3).offset + r.frame(3).size - 1] ^= 1
    with pytest.raises(Exception):  # noqa: B017
        tokens.ShardReader(io.BytesIO(bytes(bad))).raw(3)


def test_files_round_trip_with_nulls_ties_and_extra_columns(spark):
    rows = [(i * 7 % 19, t, "x") for i, t in enumerate(TEXTS)] + [(5, None, "y"), (5, TEXTS[2], "z"), (None, "lost id", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    out = tokens.scratch(spark, "t")
    manifest = tokens.write_token_shards(docs, out, PATH)
    got = sorted((tuple(r) for r in tokens.read_token_shards(manifest).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d))
    at = 0
    for _, start, n, _ in got:
        assert start == at
        at += n
    want = {(d, len(plain(t or "")), zlib.crc32(plain(t or "").tobytes())) for d, t, _ in rows}
    assert {(d, n, c) for d, _, n, c in got} == want
    one = tokens.read_documents(manifest, [0, 4])
    assert one[0][0].tolist() == plain(TEXTS[0]).tolist() and len(one[4]) == 1
    many = tokens.write_token_shards(docs, tokens.scratch(spark, "t"), PATH, shard_bytes=50_000)
    assert many.count() > 4 and sorted(tuple(r)[2:] for r in tokens.read_token_shards(many).collect()) == sorted(r[2:] for r in got)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.token_table(spark, docs, PATH).collect() == []

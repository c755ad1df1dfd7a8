from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from stratagrid.llm import collocations as C
from stratagrid.llm import queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, longest=3, least=10, top=2000):
    f, out = Counter(), []
    for text, lang in docs:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            for size in range(1, longest + 1):
                f.update((lang or "und", tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    n = Counter()
    for (lang, p), k in f.items():
        n[lang] += k * (len(p) == 1)
    found = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    for lang in n:
        rows = []
        for (at, p), a in found.items():
            inside = any(q[i : i + len(p)] == p and 100 * b >= 50 * a for (o, q), b in found.items() if o == lang and len(q) > len(p) for i in range(len(q) - len(p) + 1))
            if at == lang and not inside:
                cuts = [(1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
                score, _, left, right = min(cuts)
                rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, r, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def mined(df, **options):
    return sorted(map(tuple, C.collocations(df, **options).collect()))


def corpus(seed=1, docs=60):
    rng = random.Random(seed)
    words = ["New", "york", "CITY", "the", "of", "état", "漢字", "a b", "x", "Zz", "hall", "\x1c", " ", "ﬁ", "don't"]
    gaps = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r", "\x0b ", "; "]
    text = lambda n: "".join(rng.choice(words[:9] if rng.random() < 0.8 else words) + rng.choice(gaps) for _ in range(n))
    rows = [(text(rng.randrange(0, 120)), rng.choice(["en", "en", "de", None, "und"])) for _ in range(docs)]
    return [*rows, *rows[:5], (None, "en"), ("", None), ("   \t .;", "fr"), (text(5000), "en"), ("one " * 900, "de"), ("q" * 30000, "de")]


def test_phrases_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "text string, lang string").withColumns({c: F.lit(1) for c in ("phrase", "f", "words", "size")}).repartition(5)
    want = brute(rows)
    assert len(want) > 100 and mined(df) == want
    # small blocks end within texts, pieces and phrases; a tiny filter lets everything by
    assert mined(df, block_words=7, filter_bits=10) == want
    assert mined(df, block_words=1, filter_bits=15) == want
    assert mined(df, top=3) == brute(rows, top=3)


def test_four_words_and_strides(spark, monkeypatch):
    monkeypatch.setattr(C, "STRIDE", 11)
    rows = corpus(2, 10)
    lists = lambda text: [w for s in C._strides(text, 3) for w in s]
    for text, _ in rows:
        raw = (text or "").encode()
        assert lists(raw) == C.words_of(raw)
    df = spark.createDataFrame(rows, "text string, lang string")
    assert mined(df, longest=4, least=5, block_words=20) == brute(rows, longest=4, least=5)


def test_query_equals_sql_and_empty_tables(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.op11_collocations(spark, sf)
    assert [t for _, t in got.dtypes] == ["string", "bigint", "string", "bigint", "bigint", "bigint", "bigint", "bigint"]
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(map(tuple, got.collect())) == sorted(duck.sql(queries.oracle_sql()["op11_collocations"]).fetchall())
    assert mined(spark.createDataFrame([], "text string, lang string")) == []
    assert mined(spark.createDataFrame([(None, None)], "text string, lang string")) == []


def test_scores_are_exact_beyond_64_bits(spark):
    f = spark.createDataFrame([(10**12, 10**12 + 7, 10**12 + 9)], "a long, l long, r long")
    square = F.col("a").cast("decimal(15,0)") * F.col("a").cast("decimal(15,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    row = f.withColumn("square", square).withColumn("product", F.col("l").cast("decimal(18,0)") * F.col("r").cast("decimal(18,0)")).withColumn("score", F.expr("square div product")).first()
    assert row["score"] == 10**30 // ((10**12 + 7) * (10**12 + 9))

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from stratagrid.llm import sketch as S


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def rows_of(rng):
    words = [f"w{i}" for i in range(500)]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice((0, 1, 4, 5, 6, 60, 900))))) for i in range(0, 400, 7)]
    return rows + [(3, None), (5, ""), (8, "Ünï CODE 日本 x y z"), (9, "\n a\tb"), (-4, "A B C d e"), (700, "a b c D e")]


@pytest.mark.parametrize("parts", ["1", "4", "50"])
def test_report_against_brute_force(spark, parts):
    rows = rows_of(random.Random(1))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, next_text string, key int")
        got = {r["doc_id"]: r for r in S.fingerprint_report(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    order = sorted(rows, key=lambda r: -r[0])
    assert len(got) == len(rows)
    for (d, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        t, nxt, r = t or "", nxt or "", got[d]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest(), d
        for name, other in (("near_edited", edited), ("near_next", nxt)):
            small = len(shingles(t) | shingles(other)) <= S.K
            assert r[name] == pytest.approx(jaccard(shingles(t), shingles(other)), abs=1e-9 if small else 0.2)
        assert r["n_shingles"] == pytest.approx(len(shingles(t)), rel=0.4)
    assert got[-4]["fingerprint"] == got[700]["fingerprint"]


def test_merge_equals_the_sketch_of_all_parts(spark):
    rng = random.Random(2)
    rows = [(g, rng.getrandbits(64) - (1 << 63)) for g in range(3) for _ in range(400)]
    df = spark.createDataFrame(rows + rows[:50], "g int, h long")
    parts = df.groupBy("g", (F.col("h") % 3).alias("m")).agg(S.bottom(F.collect_list("h"), 16).alias("s"))
    got = {r["g"]: r["s"] for r in S.merge_groups(parts, ["g"], "s", 16).collect()}
    assert got == {g: sorted({h for x, h in rows if x == g})[:16] for g in range(3)}
    two = parts.where("m = 0").alias("a").join(parts.where("m = 1").alias("b"), "g").select("g", S.merged(F.col("a.s"), F.col("b.s"), 16).alias("s"))
    assert all(len(r["s"]) == 16 for r in two.collect())


def test_text_form_round_trips(spark):
    df = spark.createDataFrame([([-5, 0, 7, 1 << 62],), ([],)], "s array<bigint>")
    assert all(r["s"] == r["t"] for r in df.select("s", S.from_text(S.as_text(F.col("s"))).alias("t")).collect())


def test_null_ids_repeats_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (2, "same words in both of these"), (2, "same words in both of these"), (None, None)], "doc_id long, text string")
    got = S.fingerprint_report(docs).collect()
    assert len(got) == 4 and sorted(r["near_next"] for r in got if r["doc_id"] == 2)[1] == 1.0
    assert S.fingerprint_report(docs.limit(0)).collect() == []
    one = S.fingerprint_report(docs.limit(1)).first()
    assert one["near_next"] == 1.0


def test_one_id_in_a_third_of_the_rows_is_many_ranges(spark):
    rng = random.Random(4)
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"t{rng.random()} a b c") for i in range(300)] + [(900, "w " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.coalesce("doc_id", F.lit(-(1 << 63))), "tie": F.xxhash64("text")})
    out = S.with_next(docs, "key", ["text"], "tie", parts=12).collect()
    order = sorted(out, key=lambda r: (-r["key"], r["tie"]))
    assert len(out) == len(rows)
    assert all(a["next_text"] == b["text"] for a, b in zip(order, order[1:] + order[:1], strict=True))
    sizes = docs.groupBy(S._ranges(docs, "key", "tie", 12)).count().collect()
    assert max(r["count"] for r in sizes) <= 80
    long = S.fingerprint_report(docs.where("doc_id = 900")).first()
    assert long["n_chars"] == 40_000 and long["n_shingles"] == 1 and long["near_next"] == 1.0


def test_ranges_are_bounded_at_every_size(spark):
    docs = spark.createDataFrame([(i, "some text") for i in range(40)], "key long, text string").withColumn("tie", F.xxhash64("text"))
    for limit in (2, 9):
        out = S.with_next(docs, "key", ["key"], "tie", size=F.lit(1 << 40), max_ranges=limit).collect()
        assert sorted((r["key"], r["next_key"]) for r in out) == [(i, (i - 1) % 40) for i in range(40)]

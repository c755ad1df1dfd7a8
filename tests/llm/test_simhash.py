from __future__ import annotations

import random
import re

import xxhash
from pyspark.sql import functions as F

from stratagrid.llm import simhash as S


def plain(text: str | None) -> int:
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprint():
    rng = random.Random(1)
    texts = [None, "", " \n", "One", "one TWO", "ÀB c\x0bd", "a b c", "a\xa0b c d"] + [" ".join(rng.choices("Ab cd É fg".split(), k=rng.choice((5, 300, 900)))) for _ in range(20)]
    for t in texts:
        assert S.fingerprint(t or "") == plain(t), t


def test_links_are_those_of_brute_force(spark):
    rng = random.Random(2)
    fps = set()
    for _ in range(40):
        f = rng.getrandbits(64)
        for _ in range(6):
            fps.add(f)
            for b in rng.sample(range(64), rng.randint(1, 4)):
                f ^= 1 << b
    fps |= {0, 1, (1 << 64) - 1, (1 << 63), 7 << 31}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = S.near_links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 3}
    assert len(got) == len(want) and {(min(r), max(r)) for r in got} == want


def test_components_of_paths_stars_and_cycles(spark):
    links = [(i, i + 1) for i in range(0, 30)] + [(100, i) for i in range(101, 140)] + [(201, 202), (202, 203), (203, 201)] + [(-5, 300), (300, -5), (7, 7)]
    nodes = {x for e in links for x in e}
    got = {r["node"]: r["root"] for r in S.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: r for n, r in roots(nodes, links).items()}
    assert S.components(spark.createDataFrame([], "a long, b long")).collect() == []


def corpus():
    rng = random.Random(3)
    base = [" ".join(rng.choices([f"w{i}" for i in range(400)], k=120)) for _ in range(12)]
    rows = [(i, b) for i, b in enumerate(base)]
    for i in range(12, 60):
        w = rng.choice(base).split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w) if i % 3 else base[i % 12].upper()))
    return rows + [(60, None), (61, ""), (62, "  "), (63, "x"), (3, base[3])]


def want_components(rows):
    fp = [plain(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if bin(fp[i] ^ fp[j]).count("1") <= 3]
    root = roots(range(len(rows)), links)
    least = {}
    for k, r in root.items():
        least[r] = min(least.get(r, 1 << 60), rows[k][0])
    return sorted((rows[k][0], f"{fp[k]:016x}", least[root[k]]) for k in root)


def test_documents_against_brute_force(spark):
    rows = corpus()
    rows += [(70 + i, "one hot text " * 30_000 if i < 2 else "hot copies of this text") for i in range(40)]
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "doc_id long, text string, fp int, component_id int, _kept_id int, _own_hash int")
    assert sorted(map(tuple, S.near_duplicates(docs).collect())) == want_components(rows)
    kept = S.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.collect())
    assert ids == sorted({c for _, _, c in want_components(rows)})


def test_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (4, "a b c d"), (None, "other words here now")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in S.near_duplicates(docs).collect()), key=str)
    assert got == [(4, 4), (None, 4), (None, 4), (None, None)]
    assert [r["doc_id"] for r in S.drop_near_duplicates(docs).orderBy(F.col("doc_id").asc_nulls_last()).collect()] == [4, None]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(none).collect() == [] and S.drop_near_duplicates(none).collect() == []

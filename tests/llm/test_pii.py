from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from stratagrid.llm import pii as P

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def ok(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "phone":
        return 8 <= len(d) <= 15
    if kind == "card":
        tot = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, d[::-1])))
        return 16 <= len(d) <= 19 and tot % 10 == 0
    return True


def base(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if ok(k, m[0])]


def texts(rng):
    alphabet = ["a", "Z", "0", "1", "25", "255", "300", ".", ".", "@", "@", "-", "+", "+1", " ", "(", ")", "_", "%", "é", "\n", "4111 1111 1111 1111", "4111111111111111", "+1 (415) 555-0100", "1.2.3.4", "x@y.z", "日", "x" * 30]
    out = ["".join(rng.choices(alphabet, k=rng.randint(0, 25))) for _ in range(700)]
    return out + [None, "", "1." * 9000 + "1", "a." * 9000 + "b@c" + ".d" * 9000, "1 " * 9000, "a" * 60000 + "@", "+" * 3000, "+1" + " " * 5000, "é日 +1 (415) 555-0100 x", "0001.002.000003.0@a.b.c_d@e.f"]


def test_base_spans_are_those_of_the_plain_patterns(spark):
    rows = list(enumerate(texts(random.Random(1))))
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, spans string, row int").repartition(4)
    got = {r["doc_id"]: r for r in P.personal_data_report(docs).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        want = base(t)
        for k in PLAIN:
            assert got[d][f"n_{k}"] == sum(s[0] == k for s in want), (d, t, k)
        assert got[d]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest(), (d, t)
        assert got[d]["spans"].startswith(",".join(f"{k}:{a}:{b}" for k, a, b in want))


def brute_terms(rows, min_support, at):
    n = len(rows)
    df_t, df_e, df_te, where = defaultdict(int), defaultdict(int), defaultdict(int), []
    for d, t in rows:
        for w in set(re.findall(r"[^\W\d_]{2,}", t.lower())):
            df_t[w] += 1
        spans, seen = base(t), set()
        for e in {t[a:b].lower() for _, a, b in spans}:
            df_e[e] += 1
        for _, a, b in spans:
            e, lo = t[a:b].lower(), t.rfind("\n", 0, a) + 1
            hi = t.find("\n", b)
            hi = len(t) if hi < 0 else hi
            for m in re.finditer(r"[^\W\d_]{2,}", t[lo:hi]):
                x, y = lo + m.start(), lo + m.end()
                if not any(p < y and q > x for _, p, q in spans):
                    where.append((d, e, m[0].lower(), x, y))
                    seen.add((e, m[0].lower()))
        for s in seen:
            df_te[s] += 1
    out = set()
    for d, e, w, x, y in where:
        if df_te[e, w] >= min_support and math.log2(n * df_te[e, w] / (df_t[w] * df_e[e])) / math.log2(n / df_e[e]) >= at - 1e-12:
            out.add((d, x, y))
    return out


def test_terms_against_brute_force(spark):
    rng = random.Random(2)
    common = ["the", "and", "of", "to", "in", "paper"]
    rows = []
    for d in range(120):
        w = rng.choices(common, k=12)
        if d % 6 == 0:
            w[3:3] = ["Director", "of", "Acme", "jane@acme.org", "Zurich"] if d % 12 else ["jane@acme.org", "zurich\nAcme", "lab"]
        if d % 10 == 0:
            w += ["call", "+1 (415) 555-0100"]
        rows.append((d, " ".join(w)))
    got = set()
    for r in P.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got |= {(r["doc_id"], s["start"], s["end"]) for s in r["spans"] if s["kind"] == "term"}
    assert got == brute_terms(rows, 3, 0.6) and got


def test_sanitised_text(spark):
    rows = [(i, f"Acme mail jane@acme.org now {i}" if i < 5 else "plain now") for i in range(200)]
    got = {r["doc_id"]: r for r in P.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[3]["sanitised"] == "  [EMAIL] now 3" and got[9]["sanitised"] is None and got[9]["spans"] == []
    over = P.sanitised(F.lit("a 1.2.3.4 b"), F.expr("array(named_struct('kind','ip','start',2,'end',9,'action','mask'),named_struct('kind','x','start',4,'end',9,'action','mask'))"))
    assert spark.range(1).select(over).first()[0] == "a [IP] b"


def test_nulls_repeats_and_empty(spark):
    docs = spark.createDataFrame([(None, "a@b.c"), (1, "a@b.c"), (1, "a@b.c"), (2, None)], "doc_id long, text string")
    got = P.personal_data_report(docs).collect()
    assert sorted((r["n_email"] for r in got)) == [0, 1, 1, 1]
    assert P.personal_data_report(docs.limit(0)).collect() == []


def test_values_met_once_or_twice_are_judged(spark):
    rows = [(i, f"the paper of today {i}") for i in range(2000)]
    rows[7] = (7, "the paper of Quillfeather jane@acme.org today")
    rows[8] = rows[9] = (8, "the Ombersley paper of bob@acme.org today")
    for i in range(10, 30):
        rows[i] = (i, "some Lisbon paper of today" + (" eve@acme.org" if i == 10 else ""))
    got = {r["doc_id"]: r for r in P.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    terms = {d: [(rows[d][1][s["start"] : s["end"]], s["action"]) for s in got[d]["spans"] if s["kind"] == "term"] for d in (7, 8, 10)}
    # shares log2((2000 + 1) / 2) / log2(2000), log2((4000 + 2) / (2 * 3)) / log2(1000); Lisbon and some: log2((2000 + 20) / 40) / log2(2000) = 0.52
    assert terms == {7: [("Quillfeather", "remove")], 8: [("Ombersley", "remove")], 10: []}
    assert got[7]["sanitised"] == "the paper of  [EMAIL] today"


def test_groups_of_values_that_stand_once_are_judged(spark):
    rows = [(i, f"the paper of today {i}") for i in range(400)]
    for i in range(20):
        rows[i] = (i, f"the paper of Brackwater n{i}@harbour.org today")
    for i in range(40, 52):
        rows[i] = (i, f"the paper XENO of today 10.9.{i}.7 of +1 415 55{i} 0100")
    got = {r["doc_id"]: r for r in P.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    words = lambda d: {(rows[d][1][s["start"] : s["end"]], s["action"]) for s in got[d]["spans"] if s["kind"] == "term"}
    # each address stands once; its domain, network or prefix stands with the word in all its documents
    assert words(3) == {("Brackwater", "remove")} and words(45) == {("XENO", "remove")} and words(100) == set()
    one = P.sanitised(F.lit("Jo ABC word"), F.expr("array(" + ",".join(f"named_struct('kind','term','start',{a},'end',{b},'action','generalise')" for a, b in ((0, 2), (3, 6), (7, 11))) + ")"))
    assert spark.range(1).select(one).first()[0] == "[NAME] [CODE] [WORD]"


def test_places_in_a_line_of_many_words_and_values(spark):
    line = " ".join(f"word{chr(97 + i % 26)} {'x@y.zz' if i % 40 == 0 else ''}" for i in range(16_000))
    docs = spark.createDataFrame([(1, "first line\n" + line + "\nlast"), (2, "other")], "doc_id long, text string")
    found = P.find_personal_data(docs).where("doc_id = 1").first()
    text = "first line\n" + line + "\nlast"
    emails = [(m.start(), m.end()) for m in re.finditer("x@y.zz", text)]
    assert [(s["start"], s["end"]) for s in found["spans"] if s["kind"] == "email"] == emails and len(emails) == 400
    terms = P._near(docs.select(F.col("doc_id").alias("row"), "text"), reach=3).where("row = 1").select("start", "end").distinct().collect()
    words = [(m.start(), m.end()) for m in re.finditer("word[a-z]?", text)]
    want = set()
    for a, _ in emails:
        k = sum(1 for w in words if w[0] < a)
        want |= set(words[max(0, k - 3) : k + 3])
    assert {tuple(t) for t in terms} == want


def test_query_finds_terms_on_the_fixture(spark):
    from stratagrid.llm import queries

    got = queries.op10_personal_data(spark, "/root/testdata/sf0.001")
    assert got.agg(F.sum("n_terms")).first()[0] > 0
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in got.collect():
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in base(docs[r["doc_id"]]))
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()

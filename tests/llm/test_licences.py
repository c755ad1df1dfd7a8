from __future__ import annotations

import random
import re

from stratagrid.llm import licences as L


def sequence(text):
    cut = [re.sub("[^a-z0-9]+", " ", s.lower()).strip() for s in re.split(r"[.!?;:]+(?:[ \t\r\n\f]+|$)|\n+", text)]
    names = {s: n for n, s in L.SENTENCES.items()}
    return [names.get(s) for s in cut if s]


def brute(seq):
    found = []
    for rule, licence, ids in L.RULES:
        at = 0
        while at < len(seq):
            p = at
            ok = seq[p] == ids[0]
            for i in ids[1:] if ok else ():
                q = p + 1
                while q < len(seq) and seq[q] is None and q - p <= L.MAX_GAP:
                    q += 1
                if q >= len(seq) or seq[q] != i:
                    ok = False
                    break
                p = q
            if ok:
                found.append((licence, rule, at, p - at + 1))
                at = p + 1
            else:
                at += 1
    return [m for m in found if not any(o[3] > m[3] and o[2] <= m[2] and o[2] + o[3] >= m[2] + m[3] for o in found)]


def want(text):
    a, b = brute(sequence(text or "")), brute(sequence((text or "").replace("\n", " ")))
    return sorted(a + [m for m in b if m[0] not in {x[0] for x in a}])


def test_scan_against_brute_force(spark):
    rng = random.Random(1)
    pool = list(L.SENTENCES)
    texts = []
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(0, 4)):
            ids = rng.choice(L.RULES)[2] if rng.random() < 0.7 else rng.choices(pool, k=2)
            for i in ids:
                parts += ["Other words here"] * rng.choice((0, 0, 0, 1, 2, 3)) + [L.SENTENCES[i].capitalize()]
        text = ". ".join(parts) + rng.choice((".", "", "!\n"))
        if rng.random() < 0.3:
            text = re.sub("of the ", "of\nthe ", text)
        texts.append(text)
    texts += [None, "", "\n\n", "Licensed under CC BY-NC 4.0.", "x.\nThis work is licensed under the GNU General Public License, version 3.\ny", "Nothing about a license.", "é " * 50000 + ". Released under the MIT License."]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)] + [(None, texts[-1], 6), (3, texts[3], 7)], "doc_id long, text string, n_known int")
    got = L.scan_licences(docs).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        text = texts[-1] if r["doc_id"] is None else texts[r["doc_id"]]
        assert sorted((m["licence"], m["rule"], m["first"], m["n"]) for m in r["matches"]) == want(text), text
    rows = {r["doc_id"]: r for r in L.licence_report(docs).collect()}
    assert rows[153]["licences"] == "CC-BY-NC-4.0" and rows[154]["rules"] == "gpl-3.0-work:1:1" and rows[155]["licences"] == ""
    assert L.licence_report(docs.limit(0)).collect() == []


def test_report_keeps_wrapped_rules_beside_others_of_the_licence(spark):
    ids = dict((r[0], r[2]) for r in L.RULES)["mit-text"]
    full = ". ".join(L.SENTENCES[i].capitalize() for i in ids) + "."
    wrapped = full.replace(" of ", "\nof ").replace(" the ", "\nthe ")
    texts = [f"Released under the MIT License.\n{wrapped}", f"{full}\n{full}", f"{full}\nMore.\n{wrapped}", wrapped, full.replace(". ", ".\n"), "Released under the MIT License."]
    got = {r["doc_id"]: r["rules"] for r in L.licence_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0] == "mit-released:0:1,mit-text:1:4"
    assert got[1] == "mit-text:0:4,mit-text:4:4" and got[3] == got[4] == "mit-text:0:4" and got[5] == "mit-released:0:1"
    assert got[2].count("mit-text") == 2


def test_sentences_that_name_a_licence(spark):
    cases = {
        "This file is licensed under the MIT License.": "MIT",
        "Copyright 2020 X. Licensed under the MIT license, see LICENSE": "MIT",
        "Copyright (c) 2019-2021 Some One, released under the Apache License, Version 2.0": "Apache-2.0",
        "// SPDX-License-Identifier: Apache-2.0\ncode": "Apache-2.0",
        "# SPDX-License-Identifier:GPL-2.0-or-later": "GPL-2.0-or-later",
        "SPDX-License-Identifier: LGPL-2.1-only": "LGPL-2.1-only",
        "The MIT License (MIT)\n\nhello": "MIT",
        "All our documents are made available under the terms of the Creative Commons Attribution-NoDerivatives 4.0 International License.": "CC-BY-ND-4.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "AGPL-3.0-or-later",
        "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1": "",
        "We talked about a license for the boat, licensed under stars.": "",
        "The driver license of the MIT student was lost.": "",
        "Licensed to nobody. All rights reserved. Copyright 2020.": "",
        "A license.": "",
    }
    got = L.licence_report(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")).collect()
    assert {list(cases)[r["doc_id"]]: r["licences"] for r in got} == cases


def test_sentences_of_any_length_with_a_cue(spark):
    filler = "word " * 20_000
    texts = ["license " + filler, filler + "license " + filler, filler + "the license", "copyright " + filler + "licensed under the MIT license", "This " + "licence " * 20_000 + "is licensed under x", "the mit license"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["licences"] for r in L.licence_report(df).collect()}
    assert got == {0: "", 1: "", 2: "", 3: "MIT", 4: "", 5: "MIT"}

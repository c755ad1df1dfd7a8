"""Licence scan by sentence rules.

A text is cut into sentences, each normalised (lower case, runs of other characters than letters
and digits to one space) and mapped to the identifier of a known licence sentence. A text is then
a sequence of identifiers with gaps; licence rules are ordered identifier sequences and match
with at most max_gap unknown sentences between two identifiers. A match inside a longer one is
not reported.

A text is read twice: with line ends ending sentences, and with line ends as spaces (wrapped
licence texts); rules found in the second reading only are added.

Besides whole known sentences, sentences that name a licence are known in one form: `this file
is released under the x`, `copyright 2020 y, licensed under the x, see LICENSE`, `the x` as a
heading and `SPDX-License-Identifier: x` are the sentence `licensed under x`.

Everything is DataFrame expressions. A sequence is a string with one character a sentence, so
rules are regular expressions over it. Texts without any cue word are skipped; every rule
holds one (checked at import), so nothing is lost.

Defined results: null and empty texts have no matches; texts of any length are read whole; of
matches of equal length (ties) all are reported; repeated ids and rows are each scanned;
a null doc_id is kept; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagrid.llm.common import placed, text_or_empty

# Sentences of public licences and notices, as normalised, by identifier.
SENTENCES = {
    "apache-licensed": "licensed under the apache license version 2 0",
    "apache-licensed-the-license": "licensed under the apache license version 2 0 the license",
    "apache-may-not-use": "you may not use this file except in compliance with the license",
    "apache-obtain": "you may obtain a copy of the license at",
    "apache-url": "http www apache org licenses license 2 0",
    "apache-unless": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "mit-released": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liable": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "gpl3-work": "this work is licensed under the gnu general public license version 3",
    "gpl-redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-details": "see the gnu general public license for more details",
    "gpl-received": "you should have received a copy of the gnu general public license along with this program",
    "cc-by-nc-4": "licensed under cc by nc 4 0",
    "cc-by-4": "licensed under cc by 4 0",
    "cc-by-sa-4": "licensed under cc by sa 4 0",
    "cc-by-intl": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc-intl": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc-by-sa-intl": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "bsd-permitted": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "mpl-subject": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "free-program": "this program is free software",
    "free-library": "this library is free software",
    "gpl3-you-can": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-you-can": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl2-only-you-can": "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "lgpl21-you-can": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3-you-can": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl3-you-can": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "boost-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "cc0-dedicated": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "unlicense": "this is free and unencumbered software released into the public domain under the unlicense",
}
#: (rule, licence, identifiers in order).
RULES = (
    ("apache-2.0-notice", "Apache-2.0", ("apache-licensed-the-license", "apache-may-not-use", "apache-obtain", "apache-url", "apache-unless", "apache-see")),
    ("apache-2.0-terms", "Apache-2.0", ("apache-unless", "apache-see")),
    ("apache-2.0-reference", "Apache-2.0", ("apache-licensed",)),
    ("apache-2.0-reference-the-license", "Apache-2.0", ("apache-licensed-the-license",)),
    ("mit-text", "MIT", ("mit-grant", "mit-notice", "mit-as-is", "mit-liable")),
    ("mit-grant", "MIT", ("mit-grant", "mit-notice")),
    ("mit-released", "MIT", ("mit-released",)),
    ("mit-licensed", "MIT", ("mit-licensed",)),
    ("gpl-3.0-notice", "GPL-3.0-or-later", ("gpl-redistribute", "gpl-hope", "gpl-details", "gpl-received")),
    ("gpl-3.0-short", "GPL-3.0-or-later", ("gpl-redistribute", "gpl-hope")),
    ("gpl-2.0-notice", "GPL-2.0-or-later", ("gpl2-redistribute", "gpl-hope", "gpl-details", "gpl-received")),
    ("gpl-3.0-work", "GPL-3.0-only", ("gpl3-work",)),
    ("cc-by-nc-4.0", "CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("cc-by-4.0", "CC-BY-4.0", ("cc-by-4",)),
    ("cc-by-sa-4.0", "CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("cc-by-4.0-deed", "CC-BY-4.0", ("cc-by-intl",)),
    ("cc-by-nc-4.0-deed", "CC-BY-NC-4.0", ("cc-by-nc-intl",)),
    ("cc-by-sa-4.0-deed", "CC-BY-SA-4.0", ("cc-by-sa-intl",)),
    ("bsd-3-clause", "BSD-3-Clause", ("bsd-permitted", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("bsd-2-clause", "BSD-2-Clause", ("bsd-permitted", "bsd-source", "bsd-binary")),
    ("gpl-3.0-free", "GPL-3.0-or-later", ("free-program", "gpl3-you-can")),
    ("gpl-2.0-free", "GPL-2.0-or-later", ("free-program", "gpl2-you-can")),
    ("gpl-2.0-only-free", "GPL-2.0-only", ("free-program", "gpl2-only-you-can")),
    ("lgpl-2.1-free", "LGPL-2.1-or-later", ("free-library", "lgpl21-you-can")),
    ("lgpl-3.0-free", "LGPL-3.0-or-later", ("free-library", "lgpl3-you-can")),
    ("agpl-3.0-free", "AGPL-3.0-or-later", ("free-program", "agpl3-you-can")),
    ("zlib", "Zlib", ("zlib-as-is", "zlib-grant")),
    ("boost-1.0", "BSL-1.0", ("boost-grant",)),
    ("cc0-1.0", "CC0-1.0", ("cc0-dedicated",)),
    ("mpl-2.0", "MPL-2.0", ("mpl-subject",)),
    ("isc", "ISC", ("isc-grant",)),
    ("unlicense", "Unlicense", ("unlicense",)),
)
# Names of public licences, as normalised, by SPDX identifier.
NAMES = {
    "AGPL-3.0": ("gnu affero general public license version 3", "gnu affero general public license v3 0", "gnu agpl v3"),
    "Apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache 2 0"),
    "Artistic-2.0": ("artistic license 2 0", "artistic license version 2 0"),
    "BSD-2-Clause": ("bsd 2 clause license", "2 clause bsd license", "simplified bsd license"),
    "BSD-3-Clause": ("bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license"),
    "BSD-4-Clause": ("bsd 4 clause license", "4 clause bsd license", "original bsd license"),
    "BSL-1.0": ("boost software license version 1 0", "boost software license 1 0"),
    "CC-BY-4.0": ("creative commons attribution 4 0 international license", "cc by 4 0", "cc by 4 0 license"),
    "CC-BY-NC-4.0": ("creative commons attribution noncommercial 4 0 international license", "cc by nc 4 0", "cc by nc 4 0 license"),
    "CC-BY-ND-4.0": ("creative commons attribution noderivatives 4 0 international license", "cc by nd 4 0", "cc by nd 4 0 license"),
    "CC-BY-SA-4.0": ("creative commons attribution sharealike 4 0 international license", "cc by sa 4 0", "cc by sa 4 0 license"),
    "CC0-1.0": ("cc0 1 0", "cc0 1 0 universal", "creative commons zero v1 0 universal", "cc0 license"),
    "EPL-2.0": ("eclipse public license 2 0", "eclipse public license v 2 0", "eclipse public license version 2 0"),
    "GPL-2.0": ("gnu general public license version 2", "gnu general public license v2 0", "gnu gpl v2", "gpl v2"),
    "GPL-3.0": ("gnu general public license version 3", "gnu general public license v3 0", "gnu gpl v3", "gpl v3"),
    "ISC": ("isc license",),
    "LGPL-2.1": ("gnu lesser general public license version 2 1", "gnu lesser general public license v2 1", "gnu lgpl v2 1"),
    "LGPL-3.0": ("gnu lesser general public license version 3", "gnu lesser general public license v3 0", "gnu lgpl v3"),
    "MIT": ("mit license", "expat license", "mit license mit"),
    "MPL-2.0": ("mozilla public license version 2 0", "mozilla public license 2 0", "mozilla public license v 2 0"),
    "Unlicense": ("unlicense",),
    "Zlib": ("zlib license",),
}
#: Endings of SPDX identifiers of licences with versions that may or may not go on.
GOING_ON = ("-only", "-or-later")
#: Subjects and verbs before a licence's name, and what may follow it, become one form: `licensed under x`.
FORMS = (
    (r"^copyright .*? (?=(?:licensed|released|distributed|published|available) under )", ""),
    (r"^(?:this|these|the|all|our) (?:[a-z0-9]+ ){1,4}?(?:is|are) (?:also |hereby |dual )?(?=(?:licensed|released|distributed|published|provided|made available|available) under )", ""),
    (r"^(?:licensed|released|distributed|published|provided|made available|available) under (?:the terms of )?(?:the |a )?", "licensed under "),
    (r"^(licensed under .*?) (?:see|as found in) (?:the )?(?:accompanying |file )?(?:license|licence|copying)(?: file| txt| md)?(?: .*)?$", "$1"),
    (r"^(?!licensed under )(?:the )?((?:[a-z0-9 ]* )?licen[sc]e(?: mit)?)$", "licensed under $1"),
)
CUES = ("licens", "permission", "warrant", "copyright", "redistribut")
SPLIT = "[.!?;:]+(?:[ \\t\\r\\n\\f]+|$)|\\n+"
#: Identifiers are characters of the private use area, in the order above; an unknown sentence is '-'.
CODE = {name: chr(0xE000 + i) for i, name in enumerate(SENTENCES)}
MAX_GAP = 2

NAMED = {
    f"licensed under {name}": licence for licence, names in NAMES.items() for name in names
} | {
    "spdx license identifier " + re.sub("[^a-z0-9]+", " ", (licence + end).lower()): licence + (end if end in GOING_ON else "")
    for licence in NAMES
    for end in (("", "-only", "-or-later") if "GPL" in licence else ("",))
}
NAMED_CODE = {licence: chr(0xE800 + i) for i, licence in enumerate(dict.fromkeys(NAMED.values()))}
NAMED_RULES = tuple((f"{licence.lower()}-named", licence) for licence in NAMED_CODE)

if any(not any(c in SENTENCES[i] for i in ids for c in CUES) for _, _, ids in RULES) or any(not any(c in s for c in CUES) for s in NAMED):
    raise ValueError("a rule holds no cue word")


def rule_pattern(ids: tuple[str, ...], max_gap: int = MAX_GAP) -> str:
    return f"-{{0,{max_gap}}}".join(CODE[i] for i in ids)


def sentences(text: Column) -> Column:
    """Normalised sentences, without the empty ones; an SPDX tag stays with its identifier."""
    tagged = F.regexp_replace(text, r"(?i)(SPDX-License-Identifier):[ \t]*", "$1 ")
    cut = F.transform(F.split(tagged, SPLIT), lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")))
    return F.filter(cut, lambda s: s != "")


def sequence_of(text: Column) -> Column:
    """One character a sentence: its identifier, that of the licence it names, or '-'."""
    named = F.create_map(*[F.lit(x) for s, licence in NAMED.items() for x in (s, NAMED_CODE[licence])])

    def form(s: Column) -> Column:
        for pattern, put in FORMS:
            s = F.regexp_replace(s, pattern, put)
        return s

    known = F.create_map(*[F.lit(x) for name, s in SENTENCES.items() for x in (s, CODE[name])])
    return F.array_join(F.transform(sentences(text), lambda s: F.coalesce(F.try_element_at(known, s), F.when(s.rlike("licen"), F.try_element_at(named, form(s))), F.lit("-"))), "")


MATCH = "array<struct<licence:string,rule:string,first:int,n:int>>"


def _places(sequence: Column, rule: Column) -> Column:
    """Matches of one rule (name, licence, pattern), placed by the lengths of what lies between them."""
    found = placed(F.regexp_extract_all(sequence, rule["pattern"], F.lit(0)), F.split(sequence, rule["pattern"], -1))
    return F.transform(found, lambda m: F.struct(rule["licence"].alias("licence"), rule["name"].alias("rule"), m["start"].alias("first"), (m["end"] - m["start"]).alias("n")))


def rule_matches(sequence: Column, max_gap: int = MAX_GAP) -> Column:
    """(licence, rule, first sentence, sentences) of every rule in a sequence, longest rules first."""
    rules = [(rule, licence, rule_pattern(ids, max_gap)) for rule, licence, ids in sorted(RULES, key=lambda r: (-len(r[2]), r[0]))]
    rules += [(rule, licence, NAMED_CODE[licence]) for rule, licence in NAMED_RULES]
    # one expression for all rules, so that the plan stays small
    known = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(x).alias("licence"), F.lit(pattern).alias("pattern")) for n, x, pattern in rules])
    own = F.filter(known, lambda r: F.regexp_like(sequence, r["pattern"]))
    return F.when(sequence != "", F.flatten(F.transform(own, lambda r: _places(sequence, r)))).otherwise(F.array().cast(MATCH))


def _outermost(matches: Column) -> Column:
    """Matches that lie in no longer one."""
    return F.filter(matches, lambda m: ~F.exists(matches, lambda o: (o["n"] > m["n"]) & (o["first"] <= m["first"]) & (o["first"] + o["n"] >= m["first"] + m["n"])))


def _in_text(matches: Column, sizes: Column) -> Column:
    """Matches with where they begin and end in letters and digits, which both readings share."""
    upto = lambda n: F.aggregate(F.slice(sizes, F.lit(1), n), F.lit(0), lambda a, x: a + x)
    return F.transform(matches, lambda m: F.struct(m.alias("m"), upto(m["first"]).alias("start"), upto(m["first"] + m["n"]).alias("end")))


def scan_licences(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", by_place: bool = False) -> DataFrame:
    """doc_id, matches (licence, rule, first, n, in the line reading, then those of the flow reading only), n_known.

    A flow match counts as found in the line reading if that has the licence anywhere; with
    by_place only if it has the same rule in an overlapping stretch of the text.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    cue = F.lower(F.col("text")).rlike("|".join(CUES))
    rows = rows.withColumns({"lines": F.when(cue, sequence_of(F.col("text"))).otherwise(""), "flow": F.when(cue, sequence_of(F.translate("text", "\n", " "))).otherwise("")})
    known = lambda c: F.regexp_replace(c, "-", "")
    rows = rows.select("doc_id", "text", *[F.when(known(c) != "", F.col(c)).otherwise("").alias(c) for c in ("lines", "flow")])
    rows = rows.withColumns({"a": rule_matches(F.col("lines")), "b": rule_matches(F.col("flow"))})
    rows = rows.withColumns({"a": _outermost(F.col("a")), "b": _outermost(F.col("b"))})
    more = F.filter("b", lambda m: ~F.exists("a", lambda o: o["licence"] == m["licence"]))
    if by_place:
        sizes = lambda t: F.transform(sentences(t), lambda s: F.length(F.replace(s, F.lit(" "), F.lit(""))))
        both = (F.size("a") > 0) & (F.size("b") > 0) & (F.col("lines") != F.col("flow"))
        rows = rows.withColumns({"sa": F.when(both, sizes(F.col("text"))), "sb": F.when(both, sizes(F.translate("text", "\n", " ")))})
        rows = rows.withColumns({"pa": F.when(both, _in_text(F.col("a"), F.col("sa"))), "pb": F.when(both, _in_text(F.col("b"), F.col("sb")))})
        met = lambda x: F.exists("pa", lambda o: (o["m"]["rule"] == x["m"]["rule"]) & (o["start"] < x["end"]) & (o["end"] > x["start"]))
        apart = F.transform(F.filter("pb", lambda x: ~met(x)), lambda x: x["m"])
        more = F.when(both, apart).when(F.size("a") == 0, F.col("b")).otherwise(F.array().cast(MATCH))
    return rows.select("doc_id", F.concat("a", more).alias("matches"), F.greatest(F.length(known(F.col("lines"))), F.length(known(F.col("flow")))).cast("long").alias("n_known"))


def licence_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, licences (sorted, comma-joined), rules (rule:first:n), n_known of every row."""
    out = scan_licences(docs, **{"by_place": True} | options)
    return out.select(
        "doc_id",
        F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["licence"]))), ",").alias("licences"),
        F.array_join(F.array_sort(F.transform("matches", lambda m: F.concat_ws(":", m["rule"], m["first"].cast("string"), m["n"].cast("string")))), ",").alias("rules"),
        "n_known",
    )

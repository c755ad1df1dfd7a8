"""Personal data: pattern spans, and information-theoretic sanitisation of the terms around them.

Base spans are the leftmost non-overlapping matches of four patterns (e-mail, IP address, payment
card, telephone), each with a check; a match that fails is dropped and its characters are not
tried again. No pattern matches a line end, so the lines of a text have the text's spans.

Sanitisation: every value found is a protected entity, and so is the group that it names: the
domain of an e-mail address, the network (first two numbers) of an IP address, the first four
digits of a telephone number. Values mostly stand once, their groups recur. A term t discloses
the share PMI(t; e) / IC(e) of an entity e, with IC(e) = log2(N / df(e)) and
PMI(t; e) = log2(N * df(t, e) / (df(t) * df(e))); df counts documents, N all of them, and df(t, e)
those where t stands within `reach` terms of e in a line. Every entity and every term met with it
is judged. A pair met in fewer than min_support documents says less, so its share of e's documents
is drawn towards that of the corpus by one document:
PMI = log2(((df(t, e) + df(t) / N) / (df(e) + 1)) / (df(t) / N)). A value met once can still lose
its terms: one that is met nowhere else has a share of about 1 - 1 / log2(N). A share of at least
remove_at removes the term near e, one of at least generalise_at replaces it with its class: NAME
(begins with a capital), CODE (capitals only) or WORD. Both add spans of kind `term` to the base
ones.

Everything is DataFrame expressions. The patterns are written so that a match never needs more
than one pass over a run of characters and never recurses: a run is entered at its start, or
where the match before ended (\\G), and repeated groups are possessive. Their matches are those
of the plain patterns.

Defined results: a null text is an empty text, without spans; a text or line of any length is
read whole; of terms with the greatest share for several entities that share counts; repeated ids
and rows each get their spans (and count as documents); a null doc_id is kept; extra columns are
ignored; an empty table gives an empty result; offsets count code points, ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagrid.llm.common import joined_by_key, placed, text_or_empty, upto, written

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this cannot match, which is cheaper to see.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"
TERMS = r"\p{L}[\p{L}\p{M}]+"


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    value = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + F.when(i % 2 == 0, value(i)).otherwise(doubled(value(i))))
    return total % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(match, "[.]"), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.concat(F.lit("0"), F.right(p, F.lit(3))).cast("int") <= 255))
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)


def spans_of(text: Column, kind: str) -> Column:
    """Spans of one kind: the matches, placed by the lengths of what lies between them."""
    pattern = PATTERNS[kind]
    found = placed(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), F.split(text, pattern, -1))
    spans = F.transform(F.filter(found, lambda s: _valid(kind, s["value"])), lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    may = F.contains(text, F.lit(NEEDS[kind])) & text.rlike(pattern) if NEEDS[kind] else text.rlike(pattern)
    return F.when(may, spans).otherwise(F.array().cast(SPAN))


def with_base_spans(docs: DataFrame, text: Column, name: str = "spans") -> DataFrame:
    """docs with the base spans of a text, by kind as listed, then start."""
    return docs.withColumn(name, F.concat(*[spans_of(text, k) for k in KINDS]))


def _terms_of_corpus(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TERMS})"), F.lit(1))


def _entities(span: Column) -> Column:
    """Hashes of the entities that a span names: its value, and the group of the value."""
    value, kind = F.lower(span["value"]), span["kind"]
    digits = F.regexp_replace(value, "[^0-9]", "")
    group = (
        F.when(kind == "email", F.concat(F.lit("@"), F.substring_index(value, "@", -1)))
        .when(kind == "ip", F.concat(F.lit("net "), F.substring_index(value, ".", 2)))
        .when(kind == "phone", F.concat(F.lit("tel "), F.substring(digits, 1, 4)))
    )
    return F.transform(F.array_compact(F.array(value, group)), lambda e: F.xxhash64(e))


def _clear_terms(line: Column, emails: Column) -> Column:
    """Terms of a line with their places, but for those in an e-mail address; other spans hold no letters."""
    terms = placed(F.regexp_extract_all(line, F.lit(f"({TERMS})"), F.lit(1)), F.split(line, TERMS, -1))

    def outside(t: Column) -> Column:
        before = F.get(emails, upto(emails, t["end"]) - 1)
        return before.isNull() | (before["end"] <= t["start"])

    hashed = F.transform(F.filter(terms, outside), lambda t: F.struct(F.xxhash64(F.lower(t["value"])).alias("t"), t["start"].alias("start"), t["end"].alias("end")))
    return hashed


def _near(held: DataFrame, reach: int = 40) -> DataFrame:
    """(row, e, t, start, end): terms within reach terms of an entity in its line; held has row and text."""
    cut = F.split("text", "\n", -1)
    lines = held.select("row", F.explode(placed(cut, F.transform(cut, lambda _, i: F.when(i > 0, "n").otherwise("")))).alias("l"))
    lines = with_base_spans(lines.select("row", F.col("l.start").alias("at"), F.col("l.value").alias("line")), F.col("line")).where(F.size("spans") > 0)
    lines = lines.withColumn("emails", F.filter("spans", lambda s: s["kind"] == "email")).withColumn("terms", _clear_terms(F.col("line"), F.col("emails")))

    def around(s: Column) -> Column:
        before = upto(F.col("terms"), s["start"])
        low = F.greatest(before - (reach - 1), F.lit(1))
        return F.struct(_entities(s).alias("es"), F.slice("terms", low, before + reach - low + 1).alias("ts"))

    near = lines.select("row", "at", F.explode(F.transform("spans", around)).alias("x")).select("row", "at", F.explode("x.es").alias("e"), F.col("x.ts").alias("ts"))
    near = near.select("row", "at", "e", F.explode("ts").alias("x"))
    return near.select("row", "e", F.col("x.t").alias("t"), (F.col("at") + F.col("x.start")).alias("start"), (F.col("at") + F.col("x.end")).alias("end"))


def disclosures(near: DataFrame, held: DataFrame, texts: DataFrame, total: int, *, min_support: int = 3, generalise_at: float = 0.6) -> DataFrame:
    """(e, t, share, n): terms (by hash) that disclose an entity (by hash) to that share, met n times near it."""
    of_value = held.select(F.explode(F.array_distinct(F.flatten(F.transform("spans", _entities)))).alias("e")).groupBy("e").agg(F.count("*").alias("df_e"))
    pairs = near.groupBy("row", "e", "t").agg(F.count("*").alias("n")).groupBy("e", "t").agg(F.count("*").alias("df_te"), F.sum("n").alias("n"))
    # every term of the corpus, counted within each task before the shuffle
    of_term = texts.select(F.explode(F.array_distinct(F.transform(_terms_of_corpus(F.col("text")), lambda t: F.xxhash64(t)))).alias("t")).groupBy("t").agg(F.count("*").alias("df_t"))
    n = F.lit(float(total))
    plain = n * F.col("df_te") / (F.col("df_t") * F.col("df_e"))
    rare = (n * F.col("df_te") + F.col("df_t")) / (F.col("df_t") * (F.col("df_e") + 1))
    share = F.log2(F.when(F.col("df_te") >= min_support, plain).otherwise(rare)) / F.greatest(F.log2(n / F.col("df_e")), F.lit(1e-9))
    found = pairs.join(of_value, "e").join(of_term, "t").select("e", "t", F.least(F.lit(1.0), share).alias("share"), "n")
    return found.where(F.col("share") >= generalise_at)


SPANS = "array<struct<kind:string,start:int,end:int,action:string>>"


def sanitised(text: Column, spans: Column) -> Column:
    """The text with each span masked, generalised or removed; of overlapping spans the first counts."""
    piece = lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"])
    capital = lambda c: F.lower(c) != c
    name = lambda s: F.when(capital(piece(s)) & (F.upper(piece(s)) == piece(s)), "CODE").when(capital(F.substring(piece(s), 1, 1)), "NAME").otherwise("WORD")
    shown = lambda s: F.when(s["kind"] == TERM, name(s)).otherwise(F.upper(s["kind"]))
    put = lambda s: F.when(s["action"] == "remove", "").otherwise(F.concat(F.lit("["), shown(s), F.lit("]")))
    by_place = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("less"), s.alias("s"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        s = x["s"]
        free = s["start"] >= a["at"]
        added = F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), put(s))
        return F.struct(F.when(free, s["end"]).otherwise(a["at"]).alias("at"), F.when(free, added).otherwise(a["out"]).alias("out"))

    return F.aggregate(by_place, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_support: int = 3, generalise_at: float = 0.6, remove_at: float = 0.9, reach: int = 40) -> DataFrame:
    """doc_id, spans and sanitised of every row.

    spans is an array of (kind, start, end, action): base spans by kind as listed, then start,
    with action `mask`; then terms by start with action `remove` or `generalise`. sanitised is
    null where there is no span: the text stays as it is.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    # one pass over the patterns; texts are kept only where something was found
    based = with_base_spans(rows, F.col("text")).select(F.monotonically_increasing_id().alias("row"), "doc_id", "spans", F.when(F.size("spans") > 0, F.col("text")).alias("text"))
    based = written(based, "pii-spans")
    held = based.where("text is not null")
    near = written(_near(held, reach), "pii-near")
    shares = disclosures(near, held, rows.select("text"), based.count(), min_support=min_support, generalise_at=generalise_at)
    met = joined_by_key(near, written(shares, "pii-shares"), ["e", "t"], "n").groupBy("row", "start", "end").agg(F.max("share").alias("share"))
    term = F.struct(F.lit(TERM).alias("kind"), "start", "end", F.when(F.col("share") >= remove_at, "remove").otherwise("generalise").alias("action"))
    added = met.groupBy("row").agg(F.sort_array(F.collect_list(term)).alias("terms"))  # at most the terms of one document's lines
    base = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit("mask").alias("action")))
    spans = F.concat(base, F.coalesce(F.col("terms"), F.array().cast(SPANS)))
    out = based.join(added, "row", "left").withColumn("all", spans)
    return out.select("doc_id", F.col("all").alias("spans"), F.when(F.size("all") > 0, sanitised(F.col("text"), F.col("all"))).alias("sanitised"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, counts by kind, base_sha256, spans, n_terms of every row."""
    found = find_personal_data(docs, **options)
    of = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_joined(F.filter("spans", lambda s: s["kind"] != TERM)), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        F.size(of(TERM)).cast("long").alias("n_terms"),
        F.sha2("sanitised", 256).alias("sanitised_sha256"),
    )

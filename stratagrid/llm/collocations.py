"""Phrase collocation mining on vertical positional inverted lists.

Texts are laid out in blocks of one language: the words of a block stand at positions 0, 1, ...
with one position left free at each piece boundary. A block keeps, for every word, the ascending
list of its positions (its inverted list). A phrase's list holds the positions of its first word;
a phrase grows by one word by a merge-join of its occurrence positions with the postings of the
words that stand next, and the summed lengths of its lists are its exact frequency. Only phrases
that are frequent over all texts grow (all parts of a frequent phrase are frequent).

What is frequent reaches the blocks as a bit filter of fixed size (`filter_bits`), the only thing
that is sent to every task. Its false hits cost time alone, since phrases are judged by their
exact frequencies. Counts are summed in tasks before they are shuffled.

Defined results: a null text is an empty text and a null language is `und`; texts of any length
are read whole, a block ends within a text where it is full and then carries the next words along
as context, so that no occurrence is lost or counted twice; ties end with the phrase in byte
order; repeated rows count each; empty tables give an empty result; columns besides text and
language are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratagrid.llm.common import discard, scratch

#: Words of a block.
BLOCK_WORDS = 1 << 19
#: Bytes of a text that are cut up at a time.
STRIDE = 4 << 20
#: Parts of a language that are ranked apart first.
PARTS = 32
UNKNOWN = "und"
#: A-Z in lower case, piece ends as a byte that UTF-8 has not, tab as space.
ENDS, MARK = b".,;:!?\n\x0b\x0c\r", b"\xff"
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + ENDS, b"abcdefghijklmnopqrstuvwxyz " + MARK * len(ENDS))
SPACED = b" " + MARK + b" "

LISTS = "lang string, words array<string>, lengths array<long>, postings binary, owned long"


def words_of(text: bytes) -> list[bytes]:
    """Words of a text in order, MARK where a piece ends."""
    return text.translate(_TABLE).replace(MARK, SPACED).split()


class _Ids(dict):
    """Numbers of words in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        return found


class _Block:
    """Words of one language as they come in; positions of MARK are free."""

    def __init__(self) -> None:
        self.ids = _Ids({MARK: 0})
        self.parts: list[np.ndarray] = []
        self.n = 0

    def add(self, words: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.ids.__getitem__, words), "i4", len(words)))
        self.n += len(words)

    def row(self, lang: str, owned: int) -> pa.RecordBatch:
        """Words, list lengths over owned positions, postings by word (list sizes, then gaps), number of owned positions."""
        at = np.concatenate(self.parts)
        sizes = np.bincount(at, minlength=len(self.ids))
        order = np.argsort(at, kind="stable").astype("<i4")[sizes[0] :]
        first = np.concatenate([[0], sizes[1:-1].cumsum()]).astype("i8") if len(sizes) > 1 else np.empty(0, "i8")
        gaps = np.diff(order, prepend=np.int32(0)).astype("<i4")
        gaps[first] = order[first]
        own = np.bincount(at[:owned], minlength=len(self.ids))[1:]
        words = pa.array(list(self.ids)[1:], pa.binary()).cast(pa.string())
        whole = pa.array([0, len(words)], pa.int32())
        postings = sizes[1:].astype("<i4").tobytes() + gaps.tobytes()
        return pa.RecordBatch.from_arrays(
            [pa.array([lang], pa.string()), pa.ListArray.from_arrays(whole, words), pa.ListArray.from_arrays(whole, pa.array(own, pa.int64())), pa.array([postings], pa.binary()), pa.array([owned], pa.int64())],
            ["lang", "words", "lengths", "postings", "owned"],
        )


def _strides(text: bytes, least: int) -> Iterator[list[bytes]]:
    """Words of a text, those of a long text in strides that end where a word ends and have `least` words or more (the last may have fewer)."""
    start, found = 0, []
    while start < len(text):
        stop = start + STRIDE
        while stop < len(text) and text[stop] not in b" \t\n":
            stop += 1
        found += words_of(text[start:stop])
        start = stop
        if len(found) >= least:
            yield found
            found = []
    if found:
        yield found


def inverted_lists(docs: DataFrame, text_col: str, lang_col: str, longest: int, block_words: int) -> DataFrame:
    """A row a block: language, words, their list lengths, their postings, number of owned positions."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[str, _Block] = {}
        held = 0

        def full(lang: str, owned: int | None = None) -> pa.RecordBatch:
            nonlocal held
            block = blocks.pop(lang)
            held -= block.n
            return block.row(lang, block.n if owned is None else owned)

        def take(lang: str, words: list[bytes], after: list[bytes]) -> Iterator[pa.RecordBatch]:
            nonlocal held
            k = 0
            while k < len(words):
                block = blocks.setdefault(lang, _Block())
                part = words[k : k + max(1, block_words - block.n)]
                block.add(part)
                k, held = k + len(part), held + len(part)
                if block.n >= block_words:
                    # the next words are context: phrases that begin before them may reach into them
                    owned, ahead = block.n, (words[k : k + longest] + after)[: longest - 1]
                    block.add(ahead)
                    held += len(ahead)
                    yield full(lang, owned)

        for batch in batches:
            for lang, text in zip(batch.column(1).to_pylist(), batch.column(0), strict=True):
                strides = _strides(text.as_py(), longest)
                words = next(strides, [])
                while words:
                    after = next(strides, [])
                    yield from take(lang, words, after)
                    words = after
                yield from take(lang, [MARK], [])
                if held > 4 * block_words:
                    yield full(max(blocks, key=lambda x: blocks[x].n))
        for lang in list(blocks):
            yield full(lang)

    text, lang = F.col(f"`{text_col}`").cast("string"), F.col(f"`{lang_col}`").cast("string")
    return docs.select(F.coalesce(text, F.lit("")).cast("binary").alias("text"), F.coalesce(lang, F.lit(UNKNOWN)).alias("lang")).mapInArrow(build, LISTS)


class _Lists:
    """The inverted lists of a block, decoded."""

    def __init__(self, lang: str, words: pa.Array, postings: bytes, owned: int):
        n, raw = len(words), np.frombuffer(postings, "<i4")
        self.lang, self.words, self.owned = lang, words, owned
        self.sizes, gaps = raw[:n].astype("i8"), raw[n:].astype("i8")
        first = self.sizes.cumsum() - self.sizes
        at = gaps.cumsum()
        self.positions = at - np.repeat(at[first] - gaps[first], self.sizes)

    def grown(self, filters: list[np.ndarray], level: int) -> tuple[pa.Array, np.ndarray]:
        """Phrases of `level` words whose parts may be frequent, with the lengths of their lists."""
        keep = _may_be_frequent(filters[0], self.lang, self.words)
        ids = np.repeat(np.arange(len(self.words)), self.sizes)
        live = keep[ids]
        # postings of the words that may be frequent, by position
        order = np.argsort(self.positions[live], kind="stable")
        places, word_at = self.positions[live][order], ids[live][order]
        starts, phrase_at, phrases = places, word_at, self.words
        for size in range(1, level):
            # merge-join: occurrences with the postings of the word behind them, and with the list of the phrase that begins one word on
            at = np.minimum(np.searchsorted(places, starts + size), len(places) - 1)
            on = np.minimum(np.searchsorted(starts, starts + 1), len(starts) - 1)
            hit = (places[at] == starts + size) & (starts[on] == starts + 1)
            if not hit.any():
                return pa.array([], pa.string()), np.empty(0, "i8")
            keys, phrase_at = np.unique(phrase_at[hit] * len(self.words) + word_at[at[hit]], return_inverse=True)
            starts = starts[hit]
            phrases = pc.binary_join_element_wise(phrases.take(pa.array(keys // len(self.words))), self.words.take(pa.array(keys % len(self.words))), " ")
            if size + 1 < level:
                keep = _may_be_frequent(filters[size], self.lang, phrases)[phrase_at]
                starts, phrase_at = starts[keep], phrase_at[keep]
                if not len(starts):
                    return pa.array([], pa.string()), np.empty(0, "i8")
        return phrases, np.bincount(phrase_at[starts < self.owned], minlength=len(phrases))


def _may_be_frequent(table: np.ndarray, lang: str, phrases: pa.Array) -> np.ndarray:
    digest, head, mask = xxhash.xxh64_intdigest, lang.encode() + b" ", 8 * len(table) - 1
    slots = np.fromiter((digest(head + p, 42) & mask for p in phrases.cast(pa.binary()).to_pylist()), "i8", len(phrases))
    return (table[slots >> 3] >> (slots & 7).astype("u1") & 1).astype(bool)


def bit_filter(frequent: DataFrame, bits: int) -> bytes:
    """A bit for each hash value of (language, phrase) in frequent: 2 ** bits of them, whatever the number of phrases."""
    slot = F.xxhash64(F.concat_ws(" ", "lang", "phrase")).bitwiseAND(F.lit((1 << bits) - 1)) + 1
    pages = frequent.groupBy(F.bitmap_bucket_number(slot).alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    table = bytearray(1 << (bits - 3))
    for row in pages.toLocalIterator():
        at = (row["page"] - 1) * 4096
        table[at : at + 4096] = row["bits"][: len(table) - at]
    return bytes(table)


def phrase_counts(lists: DataFrame, level: int, filters: list[bytes]) -> DataFrame:
    """(lang, phrase, f): exact frequency of each phrase of `level` words whose parts may be frequent."""
    if level == 1:
        rows = lists.select("lang", F.inline(F.arrays_zip(F.col("words").alias("phrase"), F.col("lengths").alias("n"))))
        return rows.groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
    tables = lists.sparkSession.sparkContext.broadcast(filters)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [np.frombuffer(t, "u1") for t in tables.value]
        for batch in batches:
            for lang, words, postings, owned in zip(*batch.columns, strict=True):
                if len(words.values):
                    phrases, n = _Lists(lang.as_py(), words.values, postings.as_py(), owned.as_py()).grown(own, level)
                    if len(phrases):
                        yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()] * len(phrases), pa.string()), phrases, pa.array(n, pa.int64())], ["lang", "phrase", "n"])

    grown = lists.select("lang", "words", "postings", "owned").mapInArrow(grow, "lang string, phrase string, n long")
    return grown.where("n > 0").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 3, least: int = 10, filter_bits: int = 24, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """Phrases of up to `longest` words that occur `least` times or more in their language: (lang, phrase, size, f), and (lang, n) with the number of all words."""
    spark = docs.sparkSession
    folder, at = scratch(spark, "lists"), scratch(spark, "phrases")
    inverted_lists(docs, text_col, lang_col, longest, block_words).write.option("compression", "zstd").parquet(folder)
    lists = spark.read.schema(LISTS).parquet(folder)
    filters: list[bytes] = []
    for level in range(1, longest + 1):
        counts = phrase_counts(lists, level, filters).where(F.col("f") >= least)
        counts.write.parquet(f"{at}/size={level}")
        if level < longest:
            filters.append(bit_filter(spark.read.schema("lang string, phrase string, f long").parquet(f"{at}/size={level}"), filter_bits))
    totals = f"{at}-totals"
    lists.groupBy("lang").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).write.parquet(totals)
    discard(spark, folder)
    return spark.read.schema("lang string, phrase string, f long, size int").parquet(at), spark.read.schema("lang string, n long").parquet(totals)


def _part(words: Column, first: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, first, size), " ")


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", *, longest: int = 3, least: int = 10, scale: int = 1_000_000, inside: int = 50, top: int = 2000, filter_bits: int = 24, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """The best `top` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase of 2 to `longest` words with a >= `least` occurrences is cut after its first k words
    into parts of l and r occurrences; its score is the least floor(scale * a * a / (l * r)) of its
    cuts, the smallest k where scores are equal. Phrases that lie inside a longer one with at least
    `inside` percent of their occurrences go.
    """
    frequent, totals = frequent_phrases(docs, text_col, lang_col, longest, least, filter_bits, block_words)
    f = frequent.select("lang", "phrase", "f")
    words = F.split("phrase", " ")
    found = frequent.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"))
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "size", "a", "k", _part(words, F.lit(1), F.col("k")).alias("left"), _part(words, F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    cuts = cuts.join(f.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(f.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    # whole numbers of 38 digits hold the products; the quotient is at most scale
    square = F.col("a").cast("decimal(15,0)") * F.col("a").cast("decimal(15,0)") * F.lit(scale).cast("decimal(7,0)")
    cuts = cuts.withColumn("square", square).withColumn("product", F.col("l").cast("decimal(18,0)") * F.col("r").cast("decimal(18,0)")).withColumn("score", F.expr("square div product"))
    scored = cuts.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # the largest count among the longer phrases around a phrase
    shorter = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: _part(words, i, m))))
    around = found.where("size > 2").select("lang", F.explode(shorter).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(around, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
    # the best of a language are among the best of its parts, so no task ranks more than `top` of each part
    order = (F.desc("score"), F.desc("a"), "phrase")
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    best = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", part.alias("part")).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def report_sql() -> str:
    """DuckDB SQL for collocations() of `documents` with its defaults."""
    return f"""
WITH d AS (SELECT coalesce(lang, '{UNKNOWN}') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?' || chr(11) || chr(12) || chr(13) || chr(9), 'abcdefghijklmnopqrstuvwxyz' || repeat(chr(10), 9) || ' ') AS text FROM documents),
p AS (SELECT row_number() OVER () AS id, lang, piece FROM (SELECT lang, unnest(string_split(text, chr(10))) AS piece FROM d)),
w AS (SELECT id, lang, unnest(string_split(piece, ' ')) AS w, generate_subscripts(string_split(piece, ' '), 1) AS i FROM p),
t AS (SELECT lang, w, lead(w, 1) OVER x AS w2, lead(w, 2) OVER x AS w3 FROM w WHERE w <> '' WINDOW x AS (PARTITION BY id ORDER BY i)),
g AS (SELECT lang, 1 AS size, w AS phrase FROM t UNION ALL SELECT lang, 2, w || ' ' || w2 FROM t WHERE w2 IS NOT NULL UNION ALL SELECT lang, 3, w || ' ' || w2 || ' ' || w3 FROM t WHERE w3 IS NOT NULL),
f AS (SELECT lang, size, phrase, CAST(count(*) AS BIGINT) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY 1),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE size > 1 AND f >= 10),
k AS (SELECT c.*, k FROM c, (VALUES (1), (2)) AS s(k) WHERE k < size),
x AS (SELECT k.lang, k.phrase, k.a, k.k, l.f AS l, r.f AS r, CAST((1000000::HUGEINT * k.a * k.a) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM k JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(ws[1 : k], ' ') JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(ws[k + 1 :], ' ')),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, array_to_string(ws[1 : 2], ' ') AS phrase FROM c WHERE size = 3 UNION ALL SELECT lang, a, array_to_string(ws[2 : 3], ' ') FROM c WHERE size = 3) GROUP BY ALL),
z AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank FROM b LEFT JOIN o USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM z JOIN n USING (lang) WHERE rank <= 2000
"""

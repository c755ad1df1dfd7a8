"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch is the ascending array of the k least distinct 64-bit hashes of a text's shingles (five
words; a shorter text is one shingle, a text without words has an empty sketch). Sketches merge:
the sketch of a whole is the k least hashes of its parts' sketches. From two sketches come
estimates of resemblance (Jaccard), containment and distinct shingle count; while a sketch has
fewer than k hashes they are exact.

Everything is DataFrame expressions. The words are the runs of characters other than white space
(space, tab to carriage return) with A-Z lower-cased.

Defined results: a null text is an empty text; two empty sketches resemble each other fully (1),
an empty and a non-empty one not at all (0), and an empty sketch is contained in any (1); ties
(equal ids) follow each other by the hash of their texts, repeated rows are each reported; null
ids come last; a text of any length is sketched whole; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratagrid.llm.common import free_name, text_or_empty

K = 128
WORDS = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACES = "\t\n\x0b\f\r"


def word_hashes(text: Column) -> Column:
    """64-bit hash of each word of a text."""
    words = F.array_remove(F.split(F.translate(text, _UPPER + _SPACES, _LOWER + " " * len(_SPACES)), " "), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_hashes(hashes: Column, words: int = WORDS) -> Column:
    """Hash of each run of `words` word hashes; all of them as one if there are fewer."""
    n = F.size(hashes)
    runs = F.transform(F.slice(hashes, 1, F.greatest(n - (words - 1), F.lit(0))), lambda h, i: F.xxhash64(h, *[F.get(hashes, i + j) for j in range(1, words)]))
    return F.when(n >= words, runs).when(n > 0, F.array(F.xxhash64(hashes))).otherwise(F.array().cast("array<bigint>"))


def bottom(hashes: Column, k: int = K) -> Column:
    """The k least distinct hashes, ascending."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def add_sketch(df: DataFrame, text: Column, name: str, k: int = K, words: int = WORDS) -> DataFrame:
    """df with the sketch of a text as column name."""
    h = f"{name}_words"
    return df.withColumn(h, word_hashes(text)).withColumn(name, bottom(shingle_hashes(F.col(h), words), k)).drop(h)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two sketched texts."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_groups(df: DataFrame, keys: list[str], sketch: str, k: int = K) -> DataFrame:
    """Sketch of each group's union. Hashes are made distinct and ranked, never gathered by group first."""
    one = df.select(*keys, F.explode(sketch).alias("_h")).distinct()
    ranked = one.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_h"))).where(F.col("_r") <= k)
    return ranked.groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias(sketch))


def resemblance(a: Column, b: Column, k: int = K, union: Column | None = None) -> Column:
    """Estimated Jaccard likeness of two sketched texts, 0 to 1; union is merged(a, b), if it is at hand."""
    union = merged(a, b, k) if union is None else union
    shared = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / F.size(union))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    # the k-th least of n uniform hashes stands near k/n of their range
    place = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / place)


def containment(a: Column, b: Column, k: int = K, union: Column | None = None, likeness: Column | None = None) -> Column:
    """Estimated share of a's shingles that are in b, 0 to 1; union and likeness (the resemblance) if they are at hand."""
    union = merged(a, b, k) if union is None else union
    inside = (resemblance(a, b, k, union) if likeness is None else likeness) * distinct_count(union, k)
    return F.when(F.size(a) == 0, 1.0).when(F.size(b) == 0, 0.0).otherwise(F.least(F.lit(1.0), inside / distinct_count(a, k)))


def as_text(sketch: Column) -> Column:
    """A sketch as a string: 16 hexadecimal digits a hash, ascending as signed numbers."""
    return F.lower(F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def from_text(text: Column) -> Column:
    """The sketch that as_text() has written."""
    n = (F.length(text) / 16).cast("int")
    part = lambda i: F.substring(text, i * 16 + 1, F.lit(16))
    one = lambda i: F.shiftleft(F.conv(F.substring(part(i), 1, 8), 16, 10).cast("long"), 32).bitwiseOR(F.conv(F.substring(part(i), 9, 8), 16, 10).cast("long"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array().cast("array<bigint>"))


def _part_of(key: Column, bounds: list[int]) -> Column:
    """How many bounds are below key, by binary search in expressions."""
    if not bounds:
        return F.lit(0)
    array, n, top = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>"), len(bounds), len(bounds).bit_length()
    steps = F.array(*[F.lit(1 << (top - 1 - j)) for j in range(top)])
    ahead = lambda at, step: (at + step <= n) & (F.element_at(array, F.greatest(F.least(at + step, F.lit(n)), F.lit(1))) < key)
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(ahead(at, step), step).otherwise(0))


def _ranges(rows: DataFrame, key: str, tie: str, parts: int) -> Column:
    """Range of each row, ascending with its place by descending key and ascending tie.

    A key that fills several ranges by itself has ranges of its own, by its ties (hashes).
    """
    cuts = [int(b) for b in rows.select(key).approxQuantile(key, [i / parts for i in range(1, parts)], 0.2 / parts)] if parts > 1 else []
    often = {b: cuts.count(b) for b in set(cuts) if cuts.count(b) > 1}
    bounds = sorted({b for c in cuts for b in ((c, max(c - 1, -(1 << 63))) if c in often else (c,))})
    base = (F.lit(len(bounds)) - _part_of(F.col(key), bounds)).cast("long")
    if not often:
        return base
    width = max(often.values()) + 1
    share = F.lit(0)
    for value, n in often.items():
        share = F.when(F.col(key) == value, F.floor((F.shiftright(tie, 32) + (1 << 31)) * (n + 1) / float(1 << 32))).otherwise(share)
    return base * width + share.cast("long")


def with_next(rows: DataFrame, key: str, carry: list[str], tie: str, parts: int | None = None, size: Column | None = None, range_bytes: int = 64 << 20, max_ranges: int = 20_000) -> DataFrame:
    """rows with next_<c> for c in carry: the value in the next row by descending key (ties by tie, a hash), the first row's after the last.

    Rows are dealt into ranges of the key, of about range_bytes by size (bytes of a row); beyond
    max_ranges of them the ranges grow instead, and their sort spills. A range also gets a copy of
    the row that follows its last one, so each range is worked on alone; the ranges' first rows (two
    numbers a range, so at most about max_ranges of them at any size) are all that the driver sees. key must be a long
    without nulls. Rows that share key and tie are taken to be equal.
    """
    spark = rows.sparkSession
    if parts is None:
        total = rows.agg(F.coalesce(F.sum(size if size is not None else F.lit(64)), F.lit(0))).first()[0]
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(-(-int(total) // range_bytes), max_ranges))
    taken = [free_name(rows, n) for n in ("_part", "_g", "_above", "_most", "_least", "_to")]
    part, ghost, above, most, least, to = taken
    placed = rows.withColumn(part, _ranges(rows, key, tie, parts))
    # the first row of each range by descending key and ascending tie follows the last of the range before it; the very first the very last
    first = F.max(F.struct(F.col(key).alias("k"), F.bitwise_not(F.col(tie)).alias("t"))).alias("m")
    ends = placed.groupBy(part).agg(first).orderBy(part).collect()  # one row a range
    follow = [(e["m"]["k"], ~e["m"]["t"], ends[i - 1][part]) for i, e in enumerate(ends)]
    ghosts = F.broadcast(spark.createDataFrame(follow or [(0, 0, 0)], f"{most} long, {least} long, {above} long"))
    both = placed.join(ghosts, (F.col(key) == F.col(most)) & (F.col(tie) == F.col(least)), "left")
    own = F.struct(F.col(part).alias("p"), F.lit(0).alias("g"))
    both = both.withColumn(to, F.explode(F.when(F.col(above).isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col(above).alias("p"), F.lit(1).alias("g"))))))
    both = both.withColumns({part: F.col(f"{to}.p"), ghost: F.col(f"{to}.g")})
    order = Window.partitionBy(part).orderBy(ghost, F.desc(key), tie)
    out = both.withColumns({f"next_{c}": F.lead(c).over(order) for c in carry})
    return out.where(F.col(ghost) == 0).select(*rows.columns, *[f"next_{c}" for c in carry])


def edited_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, words: int = WORDS) -> DataFrame:
    """Each document with its sketch, the next document's sketch, and the edited text.

    The edited text has the last third of its characters replaced by the first as many of the
    next document, by descending id; null ids come last, ties by the text's hash.
    """
    text = text_or_empty(text_col)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumns({"key": F.coalesce("doc_id", F.lit(-(1 << 63))), "tie": F.xxhash64("text")})
    rows = with_next(add_sketch(rows, F.col("text"), "sketch", k, words), "key", ["text", "sketch"], "tie", size=F.octet_length("text") + 8 * k)
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    rows = rows.withColumns({"n_chars": n.cast("long"), "edited": F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))})
    return add_sketch(rows, F.col("edited"), "edited_sketch", k, words)


def fingerprint_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints, likeness to the edited text and to the next document."""
    rows = edited_texts(docs, id_col, text_col)
    a, e, n = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    # each union is worked out once
    rows = rows.withColumns({"with_edited": merged(a, e), "with_next": merged(a, n)})
    rows = rows.withColumn("near_edited", resemblance(a, e, union=F.col("with_edited")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(a).alias("fingerprint"),
        as_text(e).alias("edited_fingerprint"),
        "near_edited",
        resemblance(a, n, union=F.col("with_next")).alias("near_next"),
        distinct_count(a).alias("n_shingles"),
        containment(a, e, union=F.col("with_edited"), likeness=F.col("near_edited")).alias("kept_in_edited"),
    )

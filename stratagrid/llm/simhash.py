"""SimHash near-duplicates by multi-index hashing, and connected components over the links.

A 64-bit fingerprint is cut into two 32-bit segments. If two fingerprints differ in at most
three bits, they differ in at most one bit of one of the segments. Every fingerprint stands in a
table under each of its segments; a probe enumerates the Hamming ball of radius one around a
segment (itself and 32 neighbours), fetches the table's matches and keeps those whose complete
distance is small enough. All work is on distinct fingerprints, so copies of a text, however
many, are one row.

Flips go from an unset to a set bit only, so each pair is met from one side, and a pair that
both segments would find is taken from the first: a link is one row, and only links that have
passed the complete distance leave the join.

Defined results: a null text is an empty text; a text without words has fingerprint zero and is
linked like any other; a text of one or two words is one shingle, one of any length is hashed
whole; repeated ids and rows are kept; ties (equal fingerprints) share a component; a null doc_id is kept and never names a component if another id is there; columns besides
doc_id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagrid.llm.common import free_name, joined_by_key, small_batches, text_or_empty, written

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """64-bit SimHash over word shingles: a bit is set if over half the shingles' hashes have it."""
    import xxhash

    parts = text.encode().translate(_LOWER).split()
    if not parts:
        return 0
    joined, digest = b" ".join(parts), xxhash.xxh64_digest
    if len(parts) <= words:
        raw = digest(joined, seed)
        n = 1
    else:
        ends = list(accumulate((len(p) + 1 for p in parts)))
        starts = [0, *ends]
        n = len(parts) - words + 1
        raw = b"".join([digest(joined[a : b - 1], seed) for a, b in zip(starts, ends[words - 1 :])])
    return bits_over_half(raw, n)


def bits_over_half(raw: bytes, n: int) -> int:
    """The bits that over half of n 64-bit hashes have."""
    bits = np.unpackbits(np.frombuffer(raw, "u1").reshape(n, 8), axis=1)
    counts = bits.sum(axis=0, dtype=np.int64) if n < 256 else sum(bits[i : i + 255].sum(axis=0, dtype=np.uint8).astype(np.int64) for i in range(0, n, 255))
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


FINGERPRINTS = "doc_id long, text_hash long, fp long"


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, a hash of the text and the fingerprint (as a signed long) of every row."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), words, seed) for t in b.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp, pa.int64())], ["doc_id", "text_hash", "fp"])

    return rows.mapInArrow(hashed, FINGERPRINTS)


def hex16(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def near_links(nodes: DataFrame, radius: int = 3) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) at 1 to radius differing bits.

    radius may be 1 to 3: two segments with balls of radius one cover up to three bits.
    """
    if not 1 <= radius <= 3:
        raise ValueError("two segments with balls of one bit find distances up to three")
    table = nodes.select("fp", F.explode(F.array(*[F.struct(F.lit(s).alias("seg"), F.shiftrightunsigned("fp", 32 * s).bitwiseAND(F.lit(0xFFFFFFFF)).alias("key")) for s in (0, 1)])).alias("t")).select("fp", "t.seg", "t.key")
    unset = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda b: F.expr("key").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), b)) == 0)
    ball = F.concat(F.array(F.col("key")), F.transform(unset, lambda b: F.col("key").bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))))
    probes = table.select(F.col("fp").alias("a"), "seg", F.col("key").alias("own"), F.explode(ball).alias("key"))
    table = table.withColumnRenamed("fp", "b")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    far = F.bit_count(F.shiftrightunsigned(differ, 0).bitwiseAND(F.lit(0xFFFFFFFF))) > 1
    return (
        probes.join(table, ["seg", "key"])
        .where((F.bit_count(differ) <= radius) & ((F.col("own") != F.col("key")) | (F.col("a") < F.col("b"))) & ((F.col("seg") == 0) | far))
        .select("a", "b")
    )


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of links (a, b): rows (node, root), root the least node of each.

    Large-star and small-star steps alternate until nothing changes; each step's links are
    written to the shared folder, so no lineage grows and a lost executor costs one step. Nodes
    without links have no row.
    """
    both = lambda e: e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    links = links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = written(links, name)
    mark = None
    while True:
        # large star: every larger neighbour is tied to the least of the neighbourhood
        all_ = both(links)
        least = all_.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = all_.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = written(large, name)
        # small star: smaller neighbours and the node itself are tied to the least
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        links = written(small, name)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


def classes(prints: DataFrame, radius: int = 3) -> DataFrame:
    """fp, component_id, n (rows) of every distinct fingerprint; prints has doc_id and fp."""
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "simhash-nodes")
    roots = components(near_links(nodes, radius), "simhash-links")
    linked = roots.join(nodes, roots.node == nodes.fp).select("fp", "root", "first")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    linked = linked.join(least, "root").select("fp", "least")
    return written(nodes.join(linked, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"), "n"), "simhash-classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42, radius: int = 3) -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hex digits), component_id."""
    prints = written(fingerprints(docs, id_col, text_col, words, seed), "simhash-prints")
    return joined_by_key(prints, classes(prints, radius), "fp", "n").select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42, radius: int = 3) -> DataFrame:
    """The documents with one of each component kept: that of the least id (nulls last), then least text hash.

    Columns are those of docs. Rows that repeat the kept id and text are dropped too.
    """
    prints = written(fingerprints(docs, id_col, text_col, words, seed), "simhash-prints")
    of = joined_by_key(prints, classes(prints, radius), "fp", "n")
    return one_of_each(docs, of, [F.coalesce("component_id", "fp").alias("c"), F.col("component_id").isNull().alias("n")], id_col, text_col)


def one_of_each(docs: DataFrame, of: DataFrame, keys: list, id_col: str, text_col: str) -> DataFrame:
    """The documents with one of each group (doc_id and text_hash in of, grouped by keys) kept."""
    kept_id, kept_hash, own_id, own_hash = (free_name(docs, n) for n in ("_kept_id", "_kept_hash", "_own_id", "_own_hash"))
    kept = of.groupBy(*keys).agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_hash")).alias("k")).select(F.col("k.doc_id").alias(kept_id), F.col("k.text_hash").alias(kept_hash))
    repeated = of.groupBy("doc_id", "text_hash").count().where("count > 1").select(F.col("doc_id").alias(kept_id), F.col("text_hash").alias(kept_hash))
    kept, repeated = written(kept, "simhash-kept"), written(repeated, "simhash-repeated")
    own = [F.col(f"`{id_col}`").cast("long"), F.xxhash64(text_or_empty(text_col))]
    mine = own[0].eqNullSafe(F.col(kept_id)) & (own[1] == F.col(kept_hash))
    out = docs.join(kept, mine, "left_semi")
    if repeated.isEmpty():
        return out
    again = out.join(repeated, mine, "left_semi")
    one = again.withColumns({own_id: own[0], own_hash: own[1]}).dropDuplicates([own_id, own_hash]).drop(own_id, own_hash)
    return out.join(repeated, mine, "left_anti").unionByName(one)

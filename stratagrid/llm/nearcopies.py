"""Near copies for the pipeline: texts whose sets of word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from 64-bit SimHash fingerprints (those at up to three bits, by the multi-index
of simhash.py) and from min-hash bands: a fingerprint weighs repeated shingles, so pairs at 0.8
stand at up to 17 of 64 bits and no radius that a multi-index can enumerate meets them. Texts
that share a band's least hashes are a bucket; at the default 48 bands of 8 a pair at 0.8 shares
one with probability 0.9998, more above, and a pair at 0.5 with 0.17. Every candidate is compared
by its exact shingle sets, so only pairs that are similar enough are linked. Groups are the
connected components.

In each bucket, each text is compared with one leader; in the next rounds, those that are not in
the leader's component with a leader of their own. Texts of a bucket that are in different
components after that are compared pair by pair. What is left out joins texts that are linked
already, so the components are those of all pairs that share a bucket. Pairs of the last step are
first compared by parity sketches: 4,096 bits, each the parity of the shingles that fall on it.
Every shingle that only one of two texts has turns one bit, so the bits that differ are no more
than those shingles, and no pair at the similarity asked for is lost. Texts of over 4,096 shingles
fill these bits; pairs of such texts are compared by four bits of each least hash instead, and stay
unless more hashes differ than five deviations over what the similarity makes expect. A pair that
shares several buckets is taken in the one of the least key only, and large buckets are dealt into
parts, so no task holds all pairs of one.

Defined results: words are split at ASCII white space, ASCII letters lower-cased; texts of equal
words are one; a text of up to five words is one shingle; a null text is an empty text; texts
without words are equal to each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratagrid.llm.common import joined_by_key, small_batches, text_or_empty, written
from stratagrid.llm.simhash import _LOWER, bits_over_half, components, near_links, one_of_each

PRINTS = "doc_id long, text_hash long, node long, n long, fp long, bands array<long>, bits array<long>, odd array<long>"
SETS = "node long, shingles array<long>"
_CHUNK = 512
_PLANES = 4
_PARITY_WORDS = 64
_PART = 500


def _hashes(text: str, words: int, seed: int) -> tuple[int, np.ndarray]:
    """Hash of a text's words, and of each of its shingles (none without words)."""
    import xxhash

    parts = text.encode().translate(_LOWER).split()
    joined, digest = b" ".join(parts), xxhash.xxh64_digest
    if len(parts) <= words:
        raw = digest(joined, seed) if parts else b""
    else:
        ends = list(accumulate((len(p) + 1 for p in parts)))
        raw = b"".join([digest(joined[a : b - 1], seed) for a, b in zip([0, *ends], ends[words - 1 :])])
    return xxhash.xxh64_intdigest(joined), np.frombuffer(raw, ">u8").astype(np.uint64)


def _mixers(bands: int, rows: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda bits, kind, *shape: rng.integers(0, 1 << (bits - 1), shape, dtype=kind) * kind(2) + kind(1)
    return draw(32, np.uint32, bands * rows, 1), draw(32, np.uint32, bands * rows, 1), draw(64, np.uint64, bands, rows)


def _band_keys(hashes: np.ndarray, mixers: tuple) -> tuple[np.ndarray, np.ndarray]:
    """A key for each band, and the sketch: four bits of each least hash, a plane of 64-bit words for each of the four."""
    turn, by, fold = mixers
    short = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    least = np.full(len(turn), (1 << 32) - 1, np.uint32)
    for i in range(0, len(short), _CHUNK):
        mixed = short[None, i : i + _CHUNK] ^ turn
        mixed *= by
        np.minimum(least, mixed.min(axis=1), out=least)
    bits = np.zeros((_PLANES, -(-len(least) // 64) * 64), bool)
    bits[:, : len(least)] = least >> np.arange(5, 5 + _PLANES, dtype=np.uint32)[:, None] & np.uint32(1)
    return (least.reshape(fold.shape) * fold).sum(axis=1, dtype=np.uint64), np.packbits(bits).view(np.uint64)


def _parity(hashes: np.ndarray) -> np.ndarray:
    """The parity sketch of distinct hashes, as 64-bit words."""
    places = (hashes >> np.uint64(7)) & np.uint64(64 * _PARITY_WORDS - 1)
    odd = np.bincount(places.astype(np.int64), minlength=64 * _PARITY_WORDS) & 1
    return np.packbits(odd.astype(bool)).view(np.uint64)


def prints(docs: DataFrame, id_col: str, text_col: str, words: int, bands: int, rows: int, seed: int) -> DataFrame:
    """doc_id, text_hash, node (hash of the words), n (distinct shingles), fp, band keys, sketch and parity sketch of every row."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixers = _mixers(bands, rows, seed)
        signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64), pa.int64())
        lists = lambda x: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), signed(np.concatenate(x) if x else []))
        for b in batches:
            nodes, sizes, fps, keys, bits, odd = [], [], [], [], [], []
            for t in b.column(2):
                node, hashes = _hashes(t.as_py(), words, seed)
                once = np.unique(hashes)
                nodes.append(node)
                sizes.append(len(once))
                fps.append(bits_over_half(hashes.astype(">u8").tobytes(), len(hashes)) if len(hashes) else 0)
                of_bands, sketch = _band_keys(once, mixers)
                keys.append(of_bands)
                bits.append(sketch)
                odd.append(_parity(once))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), signed(nodes), pa.array(sizes, pa.int64()), signed(fps), lists(keys), lists(bits), lists(odd)], ["doc_id", "text_hash", "node", "n", "fp", "bands", "bits", "odd"])

    return source.mapInArrow(work, PRINTS)


def _shingle_sets(docs: DataFrame, wanted: DataFrame, text_col: str, words: int, seed: int) -> DataFrame:
    """node, shingles (distinct hashes) of the wanted texts (text_hash)."""
    texts = docs.select(F.xxhash64(text_or_empty(text_col)).alias("text_hash"), text_or_empty(text_col).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            nodes, sets = [], []
            for t in b.column(0):
                node, hashes = _hashes(t.as_py(), words, seed)
                if node not in seen:
                    seen.add(node)
                    nodes.append(node)
                    sets.append(np.unique(hashes).view(np.int64))
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return texts.join(wanted, "text_hash", "left_semi").select("text").mapInArrow(work, SETS).dropDuplicates(["node"])


def _sizes_fit(a: str, b: str, similarity: float) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return F.least(a, b) >= similarity * F.greatest(a, b) - 1e-9


def _sketches_fit(a: str, b: str, similarity: float, hashes: int) -> Column:
    """Whether no more least hashes differ in the sketches than five deviations over what the similarity makes expect."""
    words = -(-hashes // 64)
    p = (1 - similarity) * (1 - 0.5**_PLANES)
    apart = lambda i: reduce(Column.bitwiseOR, [F.col(a)[k].bitwiseXOR(F.col(b)[k]) for k in range(i, _PLANES * words, words)])
    differ = reduce(Column.__add__, [F.bit_count(apart(i)) for i in range(words)])
    return differ <= hashes * p + 5 * (hashes * p * (1 - p)) ** 0.5


def _parities_fit(a: str, b: str, n_a: str, n_b: str, similarity: float) -> Column:
    """Whether no more parities differ than sets of these sizes and that similarity can have shingles apart."""
    differ = reduce(Column.__add__, [F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(_PARITY_WORDS)])
    return differ <= (F.col(n_a) + F.col(n_b)) * ((1 - similarity) / (1 + similarity)) + 1e-9


def _may_be_similar(similarity: float, hashes: int) -> Column:
    """The test of a pair of the last step (columns of its sides end in _a and _b)."""
    long_texts = F.least("n_a", "n_b") > 64 * _PARITY_WORDS
    sketched = F.when(long_texts, _sketches_fit("bits_a", "bits_b", similarity, hashes)).otherwise(True)
    return _sizes_fit("n_a", "n_b", similarity) & _parities_fit("odd_a", "odd_b", "n_a", "n_b", similarity) & sketched


def _rest_pairs(open_: DataFrame, nodes: DataFrame, similarity: float, hashes: int) -> DataFrame:
    """Pairs (a, b) that share an open bucket, are in different components and may be similar.

    One side of a bucket is dealt into parts of about _PART texts, the other goes to each of them.
    """
    sizes = open_.groupBy("key").agg(F.ceil(F.count("*") / _PART).cast("int").alias("parts"))
    # sketches of texts beyond the parity sketch alone are needed, the others' would only be moved
    sketch = F.when(F.col("n") > 64 * _PARITY_WORDS, F.col("bits"))
    rest = written(open_.join(sizes, "key").join(nodes.select("node", "odd", "bands", sketch.alias("bits")), "node"), "nearcopy-rest")
    side = lambda s, part: rest.select("key", part.alias("part"), *[F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "root", "odd", "bands", "bits")])
    dealt = side("a", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    copied = side("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    apart = (F.col("root_a") != F.col("root_b")) & (F.col("node_a") < F.col("node_b"))
    here = F.array_min(F.array_intersect("bands_a", "bands_b")) == F.col("key")
    pairs = dealt.join(copied, ["key", "part"]).where(apart & _may_be_similar(similarity, hashes) & here)
    return pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def _with_leader(members: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of each member of a bucket (key) and its leader; members of other roots than the main one lead first."""
    of = Window.partitionBy("key")
    led = members.withColumn("leader", F.min(F.struct((F.col("root") == F.col("main")).alias("last"), F.xxhash64("node").alias("h"), "node", "n", "root")).over(of))
    return led.where((F.col("root") != F.col("leader.root")) & _sizes_fit("n", "leader.n", similarity)).select(F.col("node").alias("a"), F.col("leader.node").alias("b"))


def _open_buckets(buckets: DataFrame, groups: DataFrame) -> DataFrame:
    """key, node, n, root and main (the most frequent root) of the buckets with more than one root."""
    rooted = buckets.select("key", "node", "n").join(groups, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
    of = rooted.groupBy("key", "root").agg(F.count("*").alias("k")).groupBy("key").agg(F.max(F.struct("k", "root")).alias("m"), F.count("*").alias("roots")).where("roots > 1")
    return rooted.join(of.select("key", F.col("m.root").alias("main")), "key")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar enough."""
    both = _ordered(pairs).join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common >= similarity * (F.size("x") + F.size("y") - common) - 1e-9).select("a", "b")


def similar_groups(docs: DataFrame, text_col: str, found: DataFrame, *, words: int, similarity: float, hashes: int, rounds: int, seed: int) -> DataFrame:
    """(node, root) of the texts that have a similar other one; found has the prints of so many hashes."""
    nodes = written(found.drop("doc_id").dropDuplicates(["node"]), "nearcopy-nodes")
    of = Window.partitionBy("key")
    buckets = written(nodes.select("node", "n", F.explode("bands").alias("key")).withColumn("size", F.count("*").over(of)).where("size > 1").drop("size"), "nearcopy-buckets")
    # fingerprints: one node stands for all that share one
    first = written(nodes.groupBy("fp").agg(F.min("node").alias("node")), "nearcopy-fps")
    near = near_links(first).join(first.select(F.col("fp").alias("a"), F.col("node").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("node").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    near = written(near, "nearcopy-near")
    # the shingle sets of all texts that are in some pair, made once
    wanted = buckets.select("node").union(near.select("a")).union(near.select("b")).distinct().join(nodes, "node").select("text_hash")
    sets = written(_shingle_sets(docs, wanted, text_col, words, seed), "nearcopy-sets")
    pairs = _with_leader(buckets.withColumns({"root": F.col("node"), "main": F.lit(None).cast("long")}), similarity).union(near)
    links = written(_similar(pairs, sets, similarity), "nearcopy-links")
    for k in range(1, rounds + 1):
        groups = written(components(links, "nearcopy-components"), "nearcopy-groups")
        buckets = written(_open_buckets(buckets, groups), "nearcopy-open")
        if k == rounds or buckets.isEmpty():
            break
        links = written(links.union(_similar(_with_leader(buckets, similarity), sets, similarity)), "nearcopy-links")
    if buckets.isEmpty():
        return groups
    more = _similar(_rest_pairs(buckets, nodes, similarity, hashes), sets, similarity)
    return components(links.union(more), "nearcopy-components")


def drop_near_copies(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, bands: int = 48, rows: int = 8, rounds: int = 3, seed: int = 42
) -> DataFrame:
    """The documents with one of each group kept: that of the least id (nulls last), then least text hash.

    Columns are those of docs. Rows that repeat the kept id and text are dropped too.
    """
    found = written(prints(docs, id_col, text_col, words, bands, rows, seed), "nearcopy-prints")
    groups = similar_groups(docs, text_col, found, words=words, similarity=similarity, hashes=bands * rows, rounds=rounds, seed=seed)
    classes = found.groupBy("node").agg(F.count("*").alias("n")).join(groups, "node", "left").select("node", "n", F.coalesce("root", "node").alias("c"))
    of = joined_by_key(found.select("doc_id", "text_hash", "node"), written(classes, "nearcopy-classes"), "node", "n")
    return one_of_each(docs, of, ["c"], id_col, text_col)

"""Benchmark passages in documents: CGK embedding, bit-sampling LSH, exact edit distance.

Texts are sequences of lower-cased words. The Chakraborty-Goldenberg-Koucky (CGK) random walk
embeds a sequence: at step j it outputs the word under its cursor and moves the cursor on if a
random bit of (step, word) is set, so sequences at a small edit distance have outputs at a small
Hamming distance. Bit sampling takes a few of the walk's output positions as a key. Each
repetition has its own random bits and positions.

Windows start at every stride-th word of a document and have an item's size class; the walk from
a start does not depend on the window's end, so one walk serves all items of a class. Items are
embedded from every word on, so whichever word of a passage a window starts at, there is an
entry that starts there. A key match proposes (item, place); the whole item is then compared
with the document around that place by word edit distance, and kept at
1 - edits / words >= similarity.

Recall: with a fraction d of a passage's words edited, a key of k sampled positions survives
with probability of about (1 - d)^(positions walked up to the last sample); each of some
words / stride windows has `repeats` trials. At the default parameters exact passages are always
found and passages edited by the whole limit with probability of 0.99 or more at every length
(8 to 1,000 words, measured in the tests). Windows have at most 24 steps: a walk over more words
would hardly ever survive edits of a fifth of them, and a long passage has many windows.

Items are the smaller side: an index of them is in each task's worker. Items of over slice_chars
characters are dealt into slices by hash, each with its own index and pass over the documents, so
any number of items has the same result in bounded memory (about 300 bytes a character of a slice).

Defined results: null and empty texts match nothing; items without words match nothing; equal
items are one in the index and reported each; of equally good places (ties) the first counts;
documents and items of any length are read whole; repeated documents are each reported; a document or item with a null id
keeps it; extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagrid.llm.common import free_name, small_batches, written

WORD = re.compile(r"\w+")
#: Walk steps, sampled positions and windows a stride of a size class, by the least words that an item of it has.
CLASSES = ((25, 24, 4, 1), (12, 10, 3, 1), (8, 10, 3, 2), (4, 4, 3, 4), (1, 1, 1, 4))
BATCH_WORDS = 400_000


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


@dataclass
class SizeClass:
    """LSH tables of the items of one size class."""

    steps: int
    samples: np.ndarray  # repeats x k: positions of the walk, ascending
    bits: np.ndarray  # repeats x (vocabulary + 1): bit j moves the cursor at step j
    keys: np.ndarray  # ascending, with the repetition mixed in
    entries: np.ndarray  # (item, word) of each key
    maybe: np.ndarray  # bitmap over the keys' low bits
    stride: int


def walk(ids: np.ndarray, starts: np.ndarray, steps: int, samples: np.ndarray, bits: np.ndarray, repeat: int) -> np.ndarray:
    """Keys of the windows at starts; a cursor past the end, or a key with an unknown word, gives 0."""
    key = np.full(len(starts), repeat + 1, np.uint64)
    at = starts.astype(np.int64)
    known = np.ones(len(starts), bool)
    wanted, one = set(samples.tolist()), np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(int(samples[-1]) + 1):
            w = ids[at]
            if j in wanted:
                known &= w > 0
                key = (key + w.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(31)
            at += ((bits[w] >> np.uint64(j)) & one).astype(np.int64)
    key[~known] = 0
    return key


class Index:
    """Vocabulary, words and LSH tables of the items."""

    def __init__(self, items: list[tuple], similarity: float, stride: int, repeats: int, seed: int):
        self.similarity = similarity
        same: dict[tuple[str, ...], list] = {}
        for i, t in items:
            same.setdefault(tuple(words_of(t)), []).append(i)
        #: Equal items are one, with all their ids.
        self.ids = list(same.values())
        texts = list(same)
        self.vocab = {w: k + 1 for k, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
        self.words = [np.array([self.vocab[w] for w in t], np.int32) for t in texts]
        self.edits = [int((1 - similarity) * len(t) + 1e-9) for t in texts]
        self.there = np.zeros(len(self.vocab) + 1, bool)
        rng = np.random.default_rng(seed)
        self.classes: list[SizeClass] = []
        upper = 1 << 60
        for least, steps, k, dense in CLASSES:
            own = [i for i, w in enumerate(self.words) if least <= len(w) < upper]
            upper = least
            if not own:
                continue
            apart = max(1, stride // dense) if steps >= 10 else 1
            n = max(1, repeats if apart > 1 else repeats // 2)
            samples = np.sort(np.array([np.concatenate([[0], 1 + rng.permutation(steps - 1)[: k - 1]]) for _ in range(n)]).astype(int), axis=1)
            bits = rng.integers(0, 1 << 63, (n, len(self.vocab) + 1), dtype=np.uint64)
            # an unknown word or the end always moves on, so that a walk cannot hang on it
            bits[:, 0] = np.uint64((1 << 64) - 1)
            # the items' words end to end, with a gap that no walk crosses after each
            lengths = np.array([len(self.words[i]) for i in own])
            first = np.concatenate([[0], np.cumsum(lengths + steps + 1)[:-1]])
            laid = np.zeros(int((lengths + steps + 1).sum()), np.int32)
            for f, i in zip(first, own, strict=True):
                laid[f : f + len(self.words[i])] = self.words[i]
            item = np.repeat(np.array(own), lengths)
            word = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            begin = np.repeat(first, lengths) + word
            keys, entries = [], []
            for r in range(n):
                key = walk(laid, begin, steps, samples[r], bits[r], r)
                keys.append(key[key > 0])
                entries.append(np.stack([item[key > 0], word[key > 0]], axis=1))
            key, entry = np.concatenate(keys), np.concatenate(entries)
            order = np.argsort(key, kind="stable")
            maybe = np.zeros(1 << 20, bool)
            maybe[key & np.uint64((1 << 20) - 1)] = True
            self.classes.append(SizeClass(steps, samples, bits, key[order], entry[order], maybe, apart))

    def candidates(self, ids: np.ndarray, starts: np.ndarray, c: SizeClass) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, item, word) proposals: the item's word may stand at the place."""
        out = []
        for r in range(len(c.samples)):
            key = walk(ids, starts, c.steps, c.samples[r], c.bits[r], r)
            hit = np.flatnonzero(c.maybe[key & np.uint64((1 << 20) - 1)] & (key > 0))
            if not len(hit):
                continue
            a, b = np.searchsorted(c.keys, key[hit], "left"), np.searchsorted(c.keys, key[hit], "right")
            n = b - a
            e = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
            out.append(np.column_stack([np.repeat(starts[hit], n), c.entries[e]]))
        if not out:
            none = np.zeros(0, np.int64)
            return none, none, none
        found = np.unique(np.concatenate(out), axis=0)
        return found[:, 0], found[:, 1], found[:, 2]

    def verify(self, ids: np.ndarray, lo: int, hi: int, place: int, item: int, word: int) -> tuple[int, int, int] | None:
        """(edits, first word, end) of the item's best match near the place within words lo..hi of ids, if within its limit."""
        w, most = self.words[item], self.edits[item]
        a, b = max(lo, place - word - 2 * most), min(hi, place - word + len(w) + 2 * most)
        # each word of the item that is nowhere in the region costs an edit
        self.there[ids[a:b]] = True
        absent = len(w) - int(np.count_nonzero(self.there[w]))
        self.there[ids[a:b]] = False
        if absent > most:
            return None
        return best_match(w, ids[a:b], most, a)


_INDEXES: dict[str, Index] = {}


def index_for(key: str, items: list[tuple], *options) -> Index:
    """The index of this Python worker, built once for all tasks that it runs."""
    if key not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[key] = Index(items, *options)
    return _INDEXES[key]


def best_match(item: np.ndarray, text: np.ndarray, most: int, offset: int = 0) -> tuple[int, int, int] | None:
    """Least word edit distance between item and any stretch of text, if at most `most`.

    Sellers' dynamic programme, a column of the text at a time is a row here: the insertions
    within a row are resolved by a running minimum.
    """
    n = len(text)
    row = np.zeros(n + 1, np.int64)
    begin = np.arange(n + 1)
    steps = np.arange(n + 1)
    for i in range(len(item)):
        swap = row[:-1] + (text != item[i])
        drop = row + 1
        new, source = drop.copy(), begin.copy()
        better = swap < new[1:]
        new[1:][better] = swap[better]
        source[1:][better] = begin[:-1][better]
        flat = new - steps
        low = np.minimum.accumulate(flat)
        at = np.maximum.accumulate(np.where(flat == low, steps, 0))
        row, begin = low + steps, source[at]
    k = int(row.argmin())
    if row[k] > most:
        return None
    return int(row[k]), offset + int(begin[k]), offset + k


MATCHES = "doc_id long, item_id long, edits long, n_words long, similarity double, first_word long, end_word long"


def benchmark_matches(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    similarity: float = 0.8,
    stride: int = 4,
    repeats: int = 8,
    seed: int = 11,
    slice_chars: int = 2_000_000,
) -> DataFrame:
    """The best match of each item in each document that holds it: one row a (document, item)."""
    small_batches(docs.sparkSession)
    named = items.select(F.col(f"`{item_id_col}`").cast("long").alias("item_id"), F.col(f"`{item_text_col}`").cast("string").alias("text"))
    size = named.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    slices = max(1, -(-int(size) // slice_chars))
    out = None
    for k in range(slices):
        # equal items have equal hashes, so they stay together
        some = named if slices == 1 else named.where(F.pmod(F.xxhash64("text"), F.lit(slices)) == k)
        got = _matches_of(docs, [tuple(r) for r in some.collect()], id_col, text_col, similarity, stride, repeats, seed)
        out = got if out is None else out.union(got)
    return out


def _matches_of(docs: DataFrame, rows: list[tuple], id_col: str, text_col: str, *options) -> DataFrame:
    """The matches of items (id, text) of bounded size."""
    packed = docs.sparkSession.sparkContext.broadcast(sorted((r for r in rows if words_of(r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1])))
    key = uuid.uuid4().hex
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None
        for b in batches:
            if index is None:
                index = index_for(key, packed.value, *options)
            if not index.classes:
                continue
            out, texts, doc_ids = [], b.column(1), b.column(0).to_pylist()
            k = 0
            while k < len(texts):
                group, n = [], 0
                while k < len(texts) and (not group or n < BATCH_WORDS):
                    found = words_of(texts[k].as_py())
                    group.append((doc_ids[k], np.fromiter(map(index.vocab.get, found, repeat(0)), np.int32, len(found))))
                    n += len(found)
                    k += 1
                out += _match_group(index, group)
            if out:
                cols = list(zip(*out))
                types = [pa.int64()] * 4 + [pa.float64()] + [pa.int64()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "item_id", "edits", "n_words", "similarity", "first_word", "end_word"])

    return source.mapInArrow(match, MATCHES)


def _match_group(index: Index, group: list[tuple]) -> list[tuple]:
    """Matches of some documents, their words laid end to end with a gap after each."""
    gap = max(c.steps for c in index.classes) + 1
    sizes = np.array([len(w) for _, w in group])
    first = np.concatenate([[0], np.cumsum(sizes + gap)[:-1]])
    ids = np.zeros(int((sizes + gap).sum()), np.int32)
    for f, (_, w) in zip(first, group, strict=True):
        ids[f : f + len(w)] = w
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    tried: set[tuple[int, int, int]] = set()
    for c in index.classes:
        starts = np.concatenate([np.arange(f, f + n, c.stride) for f, n in zip(first, sizes)]) if len(group) else np.zeros(0, int)
        starts = starts[ids[starts] > 0]
        for place, item, word in zip(*(x.tolist() for x in index.candidates(ids, starts, c))):
            d = int(np.searchsorted(first, place, "right")) - 1
            had = best.get((d, item))
            if had is not None and had[0] == 0:
                continue
            # a region covers places up to twice the edits away, so nearby diagonals repeat it
            spread = max(1, index.edits[item])
            at = (d, item, (place - word) // spread)
            if at in tried:
                continue
            tried.add(at)
            got = index.verify(ids, int(first[d]), int(first[d] + sizes[d]), place, item, word)
            if got is not None and (had is None or got < had):
                best[d, item] = got
    return [
        (group[d][0], item_id, e, len(index.words[i]), 1 - e / len(index.words[i]), int(a - first[d]), int(b - first[d]))
        for (d, i), (e, a, b) in sorted(best.items())
        for item_id in index.ids[i]
    ]


def drop_contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that hold no benchmark item; columns are those of docs.

    Matches are rows of contaminated documents only. Rows are told apart by id and text, so a
    clean document that shares its id with another stays.
    """
    key = free_name(docs, "_row_key")
    keyed = docs.withColumn(key, F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")))
    found = benchmark_matches(keyed, items, id_col=key, text_col=text_col, **options)
    found = written(found.select(F.col("doc_id").alias(key)).distinct(), "contaminated")
    return keyed.join(found, key, "left_anti").drop(key).select(*[f"`{c}`" for c in docs.columns])

"""Language of each word of a text by a linear-chain conditional random field.

Words are the runs of letters of the lower-cased text. A word's emission score is the sum of
learned weights of its affixes (prefixes and suffixes of one to four letters), its character
n-grams (one to three, word ends included) and its lexicon entry; transition weights between the
languages of neighbouring words are learned with them. Forward-backward gives each word's
posterior, so a text that switches language is labelled piece by piece; the document's language
is the one with the greatest mean posterior.

The model is fitted on a bounded sample of labelled rows (docs_per_lang whole texts a language,
fewer if there are over max_rows / docs_per_lang languages, chosen by hash). Half of the sampled texts make the
lexicon, the other half the weights. Part of the training sequences are spliced from several
languages, so that transitions between languages are seen.

Prediction runs over whole texts. Forward-backward is done exactly in segments: products of
transfer matrices for all segments of a batch at once, then a scan over each document's
segments, then each segment from its true start and end.

Defined results: a null text, or one without letters, is `und` with score 0; a text of any length
is read whole; ties go to the
first language in alphabetical order; repeated ids and rows are each predicted; extra columns
are ignored; with no labelled rows every text is `und`; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratagrid.llm.common import small_batches

#: Runs of letters: word characters but for '_' and all numbers (decimal digits, letter-like and other ones).
WORD = re.compile(f"[^\\W\\d_{''.join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) in ('Nl', 'No'))}]+")
#: The same and letter-like or other numbers: a much faster pattern, right for texts without those.
_RUN = re.compile(r"[^\W\d_]+")
UND = "und"
#: Hashed n-gram and affix weights.
BITS = 15
SIZE = 1 << BITS
MAX_AFFIX = 4
#: Words of which a worker remembers the scores, and words handled at once; only speed depends on them.
CACHE_WORDS = 400_000
BATCH_WORDS = 200_000
SEGMENT = 32
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)


def letter_runs(text: str) -> list[str]:
    """The runs of letters of a text, lower-cased."""
    text = text.lower()
    words = _RUN.findall(text)
    return words if all(map(str.isalpha, words)) else WORD.findall(text)


def _slot(h: np.ndarray, family: int) -> np.ndarray:
    """Weight row of each hash value, apart for each feature family."""
    with np.errstate(over="ignore"):
        h = (h + np.uint64(family + 1) * _Q) * _P
        h ^= h >> np.uint64(29)
        return ((h * _Q) >> np.uint64(64 - BITS)).astype(np.int32)


@dataclass
class Features:
    """Weight rows of some words: by position in their joined letters, and by word."""

    at_position: list[np.ndarray]
    at_word: list[np.ndarray]
    starts: np.ndarray
    word_of: np.ndarray

    def scores(self, weights: np.ndarray) -> np.ndarray:
        out = sum(weights[i] for i in self.at_word)
        for i in self.at_position:
            out = out + np.add.reduceat(weights[i], self.starts, axis=0)
        return out

    def gradient(self, by_word: np.ndarray, rows: int) -> np.ndarray:
        out = np.zeros((rows, by_word.shape[1]))
        for k in range(by_word.shape[1]):
            g = by_word[:, k]
            spread = g[self.word_of]
            for i in self.at_position:
                out[:, k] += np.bincount(i, spread, rows)
            for i in self.at_word:
                out[:, k] += np.bincount(i, g, rows)
        return out


def features(words: list[str], lexicon: dict[str, int], langs: int) -> Features:
    """Rows 0..SIZE-1 are hashed features, then one for each language's lexicon, then a row of zeros."""
    zero = SIZE + langs
    c = np.frombuffer("".join([f"\x02{w}\x03" for w in words]).encode("utf-32-le"), "<u4").astype(np.uint64)
    n = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(n + 2)
    starts = ends - n - 2
    word_of = np.repeat(np.arange(len(words)), n + 2)
    positions = []
    with np.errstate(over="ignore"):
        h = np.zeros(len(c), np.uint64)
        for order in (1, 2, 3):
            h = h * _Q + np.concatenate([c[order - 1 :], np.zeros(order - 1, np.uint64)])
            slot = _slot(h, order)
            if order == 1:
                slot[starts] = zero
            for back in range(1, max(2, order)):
                slot[ends - back] = zero
            positions.append(slot)
        by_word = []
        for side in (0, 1):
            h = np.zeros(len(words), np.uint64)
            for k in range(1, MAX_AFFIX + 1):
                has = n >= k
                at = np.where(has, starts + k if side == 0 else ends - 1 - k, starts)
                h = h * _Q + c[at]
                by_word.append(np.where(has, _slot(h, 10 * (side + 1) + k), zero))
    by_word.append(np.fromiter((SIZE + lexicon[w] if w in lexicon else zero for w in words), np.int64, len(words)))
    return Features(positions, by_word, starts, word_of)


@dataclass
class Crf:
    """Languages, feature weights, lexicon and transition scores."""

    langs: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray
    lexicon: dict[str, int] = field(default_factory=dict)
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def word_scores(self, words: list[str]) -> np.ndarray:
        return features(words, self.lexicon, len(self.langs)).scores(self.weights).astype(np.float32)


def _potentials(scores: np.ndarray) -> np.ndarray:
    return np.exp(np.maximum(scores - scores.max(axis=-1, keepdims=True), -60))


def marginals(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """Posterior of every word's language for sequences laid end to end (scores: words x languages)."""
    lang, docs = scores.shape[1], len(lengths)
    a = np.exp(transitions - transitions.max()).astype(np.float64)
    segs = -(-lengths // segment)
    first = np.concatenate([[0], np.cumsum(segs)[:-1]])
    total = int(segs.sum())
    doc_start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    doc_of = np.repeat(np.arange(docs), segs)
    seg_start = doc_start[doc_of] + (np.arange(total) - first[doc_of]) * segment
    size = np.minimum(segment, doc_start[doc_of] + lengths[doc_of] - seg_start)
    cell = seg_start[:, None] + np.arange(segment)[None, :]
    there = np.arange(segment)[None, :] < size[:, None]
    psi = np.ones((total, segment, lang))
    psi[there] = _potentials(scores)[cell[there]]
    opens = np.zeros(total, bool)
    opens[first] = True
    # transfer matrix of each segment
    p = np.broadcast_to(np.eye(lang), (total, lang, lang)).copy()
    for s in range(segment):
        q = (p @ a) * psi[:, s, None, :]
        if s == 0:
            q[opens] = p[opens] * psi[opens, 0, None, :]
        q /= q.max(axis=(1, 2), keepdims=True)
        p = np.where(there[:, s, None, None], q, p)
    # along each document's segments
    into, out = np.empty((total, lang)), np.empty((total, lang))
    begin = np.exp(start - start.max())
    state = np.broadcast_to(begin, (docs, lang)).copy()
    tail = np.ones((docs, lang))
    order = np.argsort(-segs, kind="stable")
    most = int(segs.max())
    count = np.array([int((segs > k).sum()) for k in range(most)])
    for k in range(most):
        d = order[: count[k]]
        at = first[d] + k
        into[at] = state[d]
        v = np.einsum("di,dij->dj", state[d], p[at])
        state[d] = v / v.sum(axis=1, keepdims=True)
        at = first[d] + segs[d] - 1 - k
        out[at] = tail[d]
        v = np.einsum("dij,dj->di", p[at], tail[d])
        tail[d] = v / v.sum(axis=1, keepdims=True)
    # within each segment
    alpha = np.empty_like(psi)
    state = into
    for s in range(segment):
        v = (state @ a) * psi[:, s]
        if s == 0:
            v[opens] = state[opens] * psi[opens, 0]
        v /= v.sum(axis=1, keepdims=True)
        state = np.where(there[:, s, None], v, state)
        alpha[:, s] = state
    beta = out
    for s in range(segment - 1, -1, -1):
        alpha[:, s] *= beta
        v = (psi[:, s] * beta) @ a.T
        v /= v.sum(axis=1, keepdims=True)
        beta = np.where(there[:, s, None], v, beta)
    found = alpha[there]
    return found / found.sum(axis=1, keepdims=True)


def _expected(e: np.ndarray, t: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word marginals and summed transition marginals of equally long sequences (e: batch x words x languages)."""
    a, psi = np.exp(t - t.max()), _potentials(e)
    n = e.shape[1]
    alpha, beta = np.empty_like(psi), np.empty_like(psi)
    v = psi[:, 0] * np.exp(start - start.max())
    alpha[:, 0] = v / v.sum(1, keepdims=True)
    for s in range(1, n):
        v = (alpha[:, s - 1] @ a) * psi[:, s]
        alpha[:, s] = v / v.sum(1, keepdims=True)
    beta[:, -1] = 1
    for s in range(n - 2, -1, -1):
        v = (psi[:, s + 1] * beta[:, s + 1]) @ a.T
        beta[:, s] = v / v.sum(1, keepdims=True)
    marg = alpha * beta
    marg /= marg.sum(2, keepdims=True)
    pair = alpha[:, :-1, :, None] * a * (psi * beta)[:, 1:, None, :]
    pair /= pair.sum((2, 3), keepdims=True)
    return marg, pair.sum((0, 1))


def fit(texts: list[tuple[str, str]], steps: int = 60, rate: float = 0.15, l2: float = 2e-6, length: int = 40, switched: float = 0.5, seed: int = 7) -> Crf:
    """A model from (text, language) rows, held on the driver: their number is bounded by the caller."""
    langs = sorted({lang for _, lang in texts})
    at = {lang: k for k, lang in enumerate(langs)}
    if not langs:
        return Crf([], np.zeros((SIZE + 1, 0), np.float32), np.zeros((0, 0)), np.zeros(0))
    n = len(langs)
    bags: list[list[list[str]]] = [[] for _ in langs]
    counts: list[Counter] = [Counter() for _ in langs]
    seen = [0] * n
    for text, lang in texts:
        k, words = at[lang], letter_runs(text)
        if words:
            seen[k] += 1
            if seen[k] % 2 == 0:
                counts[k].update(words)
            else:
                bags[k].append(words)
    lexicon = {}
    for k in range(n):
        for w, c in counts[k].items():
            if c >= 3 and c + 0.1 >= 0.8 * (sum(x[w] for x in counts) + 0.1 * n):
                lexicon[w] = k
    rng = np.random.default_rng(seed)
    words_of, label_of = [], []
    for k in range(n):
        for words in bags[k]:
            for i in range(0, len(words), length):
                part = words[i : i + length]
                seq, lab = list(part), [k] * len(part)
                while len(seq) < length:
                    j = int(rng.integers(n))
                    if not bags[j]:
                        continue
                    src = bags[j][int(rng.integers(len(bags[j])))]
                    m = int(rng.integers(2, 13))
                    b = int(rng.integers(max(1, len(src) - m + 1)))
                    seq += src[b : b + m]
                    lab += [j] * len(src[b : b + m])
                if rng.random() < switched:
                    cut = int(rng.integers(4, length - 3))
                    j = int(rng.integers(n))
                    if bags[j]:
                        src = bags[j][int(rng.integers(len(bags[j])))]
                        b = int(rng.integers(max(1, len(src) - length + cut + 1)))
                        piece = src[b : b + length - cut]
                        seq[cut : cut + len(piece)], lab[cut : cut + len(piece)] = piece, [j] * len(piece)
                words_of.append(seq[:length])
                label_of.append(lab[:length])
    if not words_of:
        return Crf(langs, np.zeros((SIZE + n + 1, n), np.float32), np.zeros((n, n)), np.zeros(n), lexicon)
    vocab = {w: i for i, w in enumerate(dict.fromkeys(w for s in words_of for w in s))}
    feats = features(list(vocab), lexicon, n)
    ids = np.array([[vocab[w] for w in s] for s in words_of])
    gold = np.array(label_of)
    hot = np.eye(n)[gold]
    seen_pairs = np.zeros((n, n))
    np.add.at(seen_pairs, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
    rows = SIZE + n + 1
    w, t, start = np.zeros((rows, n)), np.zeros((n, n)), np.zeros(n)
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, t, start)]
    scale = 1 / ids.size
    for step in range(1, steps + 1):
        marg, pairs = _expected(feats.scores(w)[ids], t, start)
        diff = (marg - hot).reshape(-1, n)
        flat = ids.ravel()
        by_word = np.stack([np.bincount(flat, diff[:, k], len(vocab)) for k in range(n)], axis=1)
        first = (marg[:, 0] - hot[:, 0]).sum(axis=0)
        grads = (feats.gradient(by_word, rows) * scale + l2 * w, (pairs - seen_pairs) * scale + l2 * t, first * scale + l2 * start)
        for x, g, m in zip((w, t, start), grads, moments, strict=True):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            x -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
        w[-1] = 0
    return Crf(langs, w.astype(np.float32), t, start, lexicon)


class Labeller:
    """Word posteriors of texts, with the scores of words seen before kept."""

    def __init__(self, model: Crf):
        self.model, self.rows, self.table = model, {}, np.zeros((0, len(model.langs)), np.float32)
        self.used = 0

    def _ids(self, words: list[str]) -> np.ndarray:
        new = list(dict.fromkeys(w for w in words if w not in self.rows))
        if new:
            if self.used + len(new) > CACHE_WORDS and self.used:
                self.rows, self.used = {}, 0
                new = list(dict.fromkeys(words))
            if self.used + len(new) > len(self.table):
                self.table = np.concatenate([self.table[: self.used], np.zeros((max(len(new), self.used), self.table.shape[1]), np.float32)])
            for i in range(0, len(new), 50_000):
                part = new[i : i + 50_000]
                self.table[self.used : self.used + len(part)] = self.model.word_scores(part)
                self.rows.update(zip(part, range(self.used, self.used + len(part)), strict=True))
                self.used += len(part)
        return np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))

    def label(self, texts: list[str | None]) -> list[np.ndarray]:
        """For each text the posteriors of its words (words x languages)."""
        words = [letter_runs(t) if t else [] for t in texts]
        out: list[np.ndarray] = [np.zeros((0, len(self.model.langs)))] * len(texts)
        some = [k for k, w in enumerate(words) if w]
        if not self.model.langs:
            return out
        while some:
            take, n = [], 0
            while some and (not take or n + len(words[some[0]]) <= BATCH_WORDS):
                n += len(words[some[0]])
                take.append(some.pop(0))
            lengths = np.array([len(words[k]) for k in take])
            ids = self._ids([w for k in take for w in words[k]])
            scores = self.table[ids]
            post = marginals(scores, lengths, self.model.transitions, self.model.start)
            for k, part in zip(take, np.split(post, np.cumsum(lengths)[:-1]), strict=True):
                out[k] = part
        return out


_LABELLERS: dict[str, Labeller] = {}


def labeller_for(model: Crf) -> Labeller:
    """The labeller of this Python worker: tasks that a worker runs in turn share its word scores."""
    if model.key not in _LABELLERS:
        _LABELLERS.clear()
        _LABELLERS[model.key] = Labeller(model)
    return _LABELLERS[model.key]


def held_out(doc_id: str = "doc_id", fold: int = 2, folds: int = 4) -> Column:
    """Whether a row is kept from learning: CRC-32 of the id as text, by its remainder."""
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % folds == fold, F.lit(False))


def training_sample(docs: DataFrame, *, docs_per_lang: int = 250, max_rows: int = 10_000, max_langs: int = 1000, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> list[tuple[str, str]]:
    """At most docs_per_lang whole texts of each language, and max_rows in all, chosen by hash.

    Null texts and languages and held-out rows are left out; repeated rows count once. The model
    has a weight row a language, so more than max_langs languages are refused.
    """
    rows = docs.select(
        F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"), F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("h"), held_out(id_col).alias("out")
    ).where("lang is not null and text is not null and not out")
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).limit(max_langs + 1).collect()
    if len(sizes) > max_langs:
        raise ValueError(f"over {max_langs} languages: state a coarser column")
    if not sizes:
        return []
    each = max(1, min(docs_per_lang, max_rows // len(sizes)))
    # hashes are uniform: below this one lie about eight times the rows wanted of a language, whatever its size
    cut = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], int(min(1.0, 8 * each / max(1, r["n"])) * (1 << 32)))])
    low = rows.where(F.shiftrightunsigned("h", 32) < F.element_at(cut, F.col("lang")))
    ranked = Window.partitionBy("lang").orderBy("h")
    picked = low.select("lang", "h").distinct().withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= each).select("lang", "h")
    found = low.join(F.broadcast(picked), ["lang", "h"]).select("lang", "h", "text").dropDuplicates(["lang", "h"])
    return [(r["text"], r["lang"]) for r in sorted(found.collect(), key=lambda r: (r["lang"], r["h"]))]


PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double, n_words long, n_switches long"


def predict_languages(docs: DataFrame, model: Crf, *, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_words and n_switches (changes of language between words)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = labeller_for(model)
        for b in batches:
            lang, score, words, switches = [], [], [], []
            for post in labeller.label(b.column(2).to_pylist()):
                if len(post) == 0:
                    lang.append(UND), score.append(0.0), switches.append(0)
                else:
                    mean = post.mean(axis=0)
                    k = int(mean.argmax())
                    best = post.argmax(axis=1)
                    lang.append(model.langs[k]), score.append(min(1.0, float(mean[k]))), switches.append(int((best[1:] != best[:-1]).sum()))
                words.append(len(post))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(words, pa.int64()), pa.array(switches, pa.int64())],
                ["doc_id", "held_out", "lang_pred", "score", "n_words", "n_switches"],
            )

    return rows.mapInArrow(predict, PREDICTED)


SPANS = "doc_id long, lang string, first_word long, n_words long, score double"


def language_spans(docs: DataFrame, model: Crf, *, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Runs of words of one language in each text: doc_id, lang, first_word, n_words, mean posterior."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = labeller_for(model)
        for b in batches:
            out: list[tuple] = []
            for doc_id, post in zip(b.column(0).to_pylist(), labeller.label(b.column(1).to_pylist()), strict=True):
                if len(post):
                    best = post.argmax(axis=1)
                    cuts = [0, *(np.flatnonzero(best[1:] != best[:-1]) + 1).tolist(), len(best)]
                    out += [(doc_id, model.langs[best[i]], i, j - i, float(post[i:j, best[i]].mean())) for i, j in zip(cuts, cuts[1:])]
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()))], ["doc_id", "lang", "first_word", "n_words", "score"])

    return rows.mapInArrow(spans, SPANS)


def identify_languages(docs: DataFrame, *, docs_per_lang: int = 250, max_rows: int = 10_000) -> DataFrame:
    """Fit on the rows that are not held out and predict every row."""
    return predict_languages(docs, fit(training_sample(docs, docs_per_lang=docs_per_lang, max_rows=max_rows)))

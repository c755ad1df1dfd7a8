"""Token counts of whole texts by a two-tier lookup on the map side.

Texts are cut into pre-tokens where they lie. Tier one is a small hash table of the lengths (in
tokens) of frequent pre-tokens, sent to every worker; what it lacks is encoded once and kept in a
cache of the worker, tier two. Pre-tokens themselves are never shuffled: to find the frequent
ones, every task over all texts makes one bounded summary (Misra-Gries counts, at most `entries`
of them), and only the summaries are merged, in a tree.

The table decides speed alone: the counts are those of the library for whole texts, whatever is
in it. Its size is bounded by `entries` pre-tokens of at most KEPT_BYTES bytes each.

Defined results: a null text is an empty text (0 bytes, 0 tokens); texts of any length are
counted whole, in pieces of about a million characters at a time; text that holds a special
string is counted as the library does by default; repeated rows are counted each; an empty table
gives an empty result; the caller's other columns stay, and where one has the name of an output
column the output takes that name with an underscore before it.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagrid.llm.common import free_name, scratch, text_or_empty

#: Pre-tokens of more bytes than this are in no table and no cache.
KEPT_BYTES = 64
#: Pre-tokens in a worker's cache; only speed depends on it.
CACHE_PIECES = 400_000
#: Summaries merged into one at each level of the tree.
FAN = 16
#: Characters of a long text that are cut up at a time.
STRIDE = 1 << 20

# Fixed value: the pre-token pattern of the byte-level tokenizer.
BYTE_LEVEL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Characters that one Unicode version has and another has not: texts with them are left to the library.
RECENT = regex.compile(r"[\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u2089-\u209f\ua7c8-\ua7ff\uab6c\uab6d\U00010000-\U0001cfff\U0001d000-\U0001efff\U0001fb00-\U0010ffff]")
#: A single space between other characters begins a pre-token, so texts may be cut before it.
CUT = regex.compile(r"(?<=\S) (?=\S)")


class PreTokens:
    """Pre-tokens of texts and their lengths, for one tokenizer file of the tokenizers or sentencepiece library."""

    def __init__(self, tokenizer_path: str):
        self.split: Callable[[str], Iterator[list[str]]] | None = None
        if tokenizer_path.endswith(".model"):
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path)
            self.whole = lambda text: len(pieces.encode(text, add_bos=False, add_eos=False))
            return
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(tokenizer_path)
        tok.no_truncation()
        tok.no_padding()
        pre, normal, tokenize = tok.pre_tokenizer, tok.normalizer, tok.model.tokenize
        self.whole = lambda text: len(tok.encode(text, add_special_tokens=False).ids)
        if pre is None:
            return
        names = {a.content for a in tok.get_added_tokens_decoder().values()}
        names |= {normal.normalize_str(n) for n in names} if normal is not None else set()
        self.special = regex.compile("|".join(map(regex.escape, sorted(names - {""}))) or "(?!)")
        if type(pre).__name__ == "ByteLevel" and not pre.add_prefix_space and pre.use_regex and normal is None:
            self.split = self._byte_level
            self.length = lambda piece: sum(len(tokenize(m)) for m, _ in pre.pre_tokenize_str(piece))
        else:
            self.split = lambda text: iter([[m for m, _ in pre.pre_tokenize_str(text if normal is None else normal.normalize_str(text))]])
            self.length = lambda piece: len(tokenize(piece))
        self.byte_level = self.split == self._byte_level
        self.normal = normal

    @staticmethod
    def _byte_level(text: str) -> Iterator[list[str]]:
        start = 0
        while len(text) - start > 2 * STRIDE:
            cut = CUT.search(text, start + STRIDE)
            if cut is None:
                break
            yield BYTE_LEVEL.findall(text, start, cut.start())
            start = cut.start()
        yield BYTE_LEVEL.findall(text, start)

    def pieces(self, text: str) -> Iterator[list[str]] | None:
        """Pre-tokens of a text in lists, or None if the text has to be encoded whole."""
        if self.split is None or self.special.search(text):
            return None
        if self.byte_level:
            return None if not text.isascii() and RECENT.search(text) else self.split(text)
        if self.normal is not None and self.special.search(self.normal.normalize_str(text)):
            return None
        return self.split(text)


class Lengths(dict):
    """Lengths of pre-tokens: tier one are the items, tier two the cache that a miss goes to."""

    def __init__(self, table: bytes, pre: PreTokens):
        super().__init__(unpacked(table))
        self.pre, self.cache = pre, {}

    def __missing__(self, piece: str) -> int:
        found = self.cache.get(piece)
        if found is None:
            found = self.pre.length(piece)
            if len(piece) <= KEPT_BYTES:
                if len(self.cache) >= CACHE_PIECES:
                    self.cache.clear()
                self.cache[piece] = found
        return found

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        lists = self.pre.pieces(text)
        return self.pre.whole(text) if lists is None else sum(sum(map(self.__getitem__, found)) for found in lists)


def packed(lengths: dict[str, int]) -> bytes:
    """The table as bytes: number of entries, their sizes and lengths, then their characters."""
    raw = [p.encode("utf-8", "surrogatepass") for p in lengths]
    return struct.pack("<I", len(raw)) + np.array([len(r) for r in raw], "<u2").tobytes() + np.array(list(lengths.values()), "<u2").tobytes() + b"".join(raw)


def unpacked(table: bytes) -> dict[str, int]:
    n = struct.unpack_from("<I", table)[0]
    ends = np.frombuffer(table, "<u2", n, 4).astype("i8").cumsum() + 4 + 4 * n
    lengths, starts = np.frombuffer(table, "<u2", n, 4 + 2 * n).tolist(), [4 + 4 * n, *ends.tolist()[:-1]] if n else []
    return {table[a:b].decode("utf-8", "surrogatepass"): k for a, b, k in zip(starts, ends.tolist(), lengths, strict=True)}


_PRE: dict[str, PreTokens] = {}
_LENGTHS: dict[tuple[str, int], Lengths] = {}


def _pre(tokenizer_path: str) -> PreTokens:
    """The pre-tokenizer of this worker: tasks that it runs in turn share it."""
    if tokenizer_path not in _PRE:
        _PRE[tokenizer_path] = PreTokens(tokenizer_path)
    return _PRE[tokenizer_path]


def _lengths(tokenizer_path: str, table: bytes) -> Lengths:
    key = (tokenizer_path, hash(table))
    if key not in _LENGTHS:
        _LENGTHS.clear()
        _LENGTHS[key] = Lengths(table, _pre(tokenizer_path))
    return _LENGTHS[key]


def shrunk(counts: Counter, entries: int) -> Counter:
    """At most `entries` of the counts, each less the largest count left out: the Misra-Gries rule, which merging keeps."""
    if len(counts) <= entries:
        return counts
    cut = -np.partition(-np.fromiter(counts.values(), "i8", len(counts)), entries)[entries]
    return Counter({p: n - int(cut) for p, n in counts.items() if n > cut})


SUMMARY = "part long, pieces array<string>, counts array<long>"


def frequent_pieces(docs: DataFrame, tokenizer_path: str, text_col: str = "text", entries: int = 32_768) -> dict[str, int]:
    """Frequent pre-tokens of all texts with counts that are too low by at most (all pre-tokens) / entries; at most `entries` of them.

    The driver gets the one summary that is left of the tree, so at most `entries` pre-tokens.
    """
    spark = docs.sparkSession

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre, counts, part = _pre(tokenizer_path), Counter(), 0
        for batch in batches:
            part = batch.column(1)[0].as_py() if batch.num_rows else part
            for value in batch.column(0):
                for found in pre.pieces(value.as_py()) or ():
                    counts.update(found)
                    if len(counts) > 8 * entries:
                        counts = shrunk(counts, entries)
        counts = shrunk(Counter({p: n for p, n in counts.items() if len(p) <= KEPT_BYTES // 4 or len(p.encode("utf-8", "surrogatepass")) <= KEPT_BYTES}), entries)
        if counts:
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([list(counts)], pa.list_(pa.string())), pa.array([list(counts.values())], pa.list_(pa.int64()))], ["part", "pieces", "counts"]
            )

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        counts = Counter()
        for pieces, ns in zip(rows["pieces"], rows["counts"], strict=True):
            counts.update(dict(zip(pieces, map(int, ns), strict=True)))
            counts = shrunk(counts, entries)
        return pd.DataFrame({"part": [key[0]], "pieces": [list(counts)], "counts": [list(counts.values())]})

    def kept(rows: DataFrame) -> DataFrame:
        path = scratch(spark, "pieces")
        rows.write.parquet(path)
        return spark.read.schema(SUMMARY).parquet(path)

    tree = kept(docs.select(text_or_empty(text_col).alias("text"), F.spark_partition_id().cast("long").alias("part")).mapInArrow(summarise, SUMMARY))
    # one row a task; a group has the parts of FAN neighbouring tasks
    top = tree.agg(F.max("part")).first()[0]
    while top:
        tree = kept(tree.groupBy(F.floor(F.col("part") / FAN).alias("part")).applyInPandas(merge, SUMMARY))
        top //= FAN
    last = tree.first()
    return {} if last is None else dict(zip(last["pieces"], last["counts"], strict=True))


def length_table(tokenizer_path: str, pieces: dict[str, int]) -> bytes:
    """The hash table that workers get: lengths of the given pre-tokens, the most frequent first."""
    pre = _pre(tokenizer_path)
    if pre.split is None:
        return packed({})
    return packed({p: k for p, _ in sorted(pieces.items(), key=lambda x: (-x[1], x[0])) if (k := pre.length(p)) < 1 << 16})


def with_token_counts(docs: DataFrame, tokenizer_path: str, text_col: str = "text", limit: int = 512, entries: int = 32_768) -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and over_limit (more than `limit` tokens) of each whole text."""
    spark: SparkSession = docs.sparkSession
    pieces = {} if _pre(tokenizer_path).split is None else frequent_pieces(docs, tokenizer_path, text_col, entries)
    table = spark.sparkContext.broadcast(length_table(tokenizer_path, pieces))

    @F.pandas_udf("long")
    def counted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lengths = _lengths(tokenizer_path, table.value)
        for batch in texts:
            yield pd.Series([lengths.count(t) for t in batch], dtype="int64")

    n_bytes, n_tokens, over = (free_name(docs, c) for c in ("n_bytes", "n_tokens", "over_limit"))
    text = text_or_empty(text_col)
    return docs.withColumns({n_bytes: F.octet_length(text).cast("long"), n_tokens: counted(text)}).withColumn(over, F.col(n_tokens) > limit)

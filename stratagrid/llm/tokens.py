"""Token ids in files of independent zstandard frames with a trailing seek table.

A shard file is

    frame 0 | frame 1 | ... | index frame | seek table

Each document's ids (little-endian unsigned 32-bit, end id included) are one zstandard frame,
so a reader decompresses only the documents it is asked for. The index is a zstandard
skippable frame with the document ids. The seek table is that of the public zstandard seekable
format: a skippable frame with, for each frame before it, compressed size, decompressed size
and the low 32 bits of the XXH64 of its decompressed bytes, then a footer.

Defined results: a null text is an empty text (only the end id); a text of any length is one
frame; a null doc_id is kept, sorts before all others and is flagged in the index; repeated ids
and repeated rows are kept, ties ordered by the text's hash; columns besides doc_id and text are ignored whatever their names;
an empty table gives no shards and an empty result.
"""

from __future__ import annotations

import io
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratagrid.llm.common import scratch, small_batches, text_or_empty

# Fixed values of the zstandard seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
INDEX_MAGIC = 0x184D2A50
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

#: White space of the byte-level pre-tokenizer; Latin letters; ASCII punctuation without the apostrophe.
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
_PUNCT = "!-&(-/:-@\\[-`{-~"
_WORD = re.compile(f"[{_LETTERS}]+")
_HAS_WS = re.compile(f"[{_WS}]")
_WORD_PUNCT = re.compile(f"([{_LETTERS}]+)([{_PUNCT}]+)")
_ANY = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]")
#: Pieces remembered by a worker; only speed depends on it.
CACHE_PIECES = 600_000


class _Irregular(Exception):
    """A piece that holds or borders on a run of white space."""


class _Pieces(dict):
    """Token bytes of words without white space, as they stand after lead (a space or nothing)."""

    def __init__(self, encode, word_ids, lead: str, bare: _Pieces | None = None):
        super().__init__()
        self.encode, self.word_ids, self.lead, self.bare = encode, word_ids, lead, bare

    def __missing__(self, word: str) -> bytes:
        if not word or _HAS_WS.search(word):
            raise _Irregular
        if len(self) >= CACHE_PIECES:
            self.clear()
        # letters end where ASCII punctuation begins, so the two parts are encoded apart
        if _WORD.fullmatch(word):
            found = self.word_ids(self.lead + word)
        elif m := _WORD_PUNCT.fullmatch(word):
            found = self[m[1]] + (self if self.bare is None else self.bare)[m[2]]
        else:
            found = self.encode(self.lead + word)
        self[word] = found
        return found


class Encoder:
    """Ids of whole texts by the tokenizers library, each distinct word encoded once.

    The byte-level pre-tokenizer never joins characters across a single space or newline that
    stands between other characters, so pieces cut there have the ids they have in the text.
    Texts with other white space are cut by the pre-tokenizer's own white-space rule instead, and
    texts that hold an added token (such as an end mark written out) are encoded whole.
    Letters after at most one space are one pre-token, so they go straight to the model. With any
    other kind of tokenizer whole texts are encoded.
    """

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(tokenizer_path)

        def encode(s: str) -> bytes:
            return np.array(tok.encode(s, add_special_tokens=False).ids, "<u4").tobytes()

        # the byte-level alphabet: printable bytes are themselves, the others follow from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        alphabet = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(shown)))}
        tokenize, pre = tok.model.tokenize, tok.pre_tokenizer
        self.by_piece = type(pre).__name__ == "ByteLevel" and not pre.add_prefix_space and tok.normalizer is None
        added = [a.content for a in tok.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None

        def word_ids(s: str) -> bytes:
            return np.array([t.id for t in tokenize(s.encode().decode("latin-1").translate(alphabet))], "<u4").tobytes()

        self.newline = encode("\n")
        self.first = _Pieces(encode, word_ids, "")
        self.spaced = _Pieces(encode, word_ids, " ", self.first)
        self.encode = encode
        self.runs: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text."""
        if not text:
            return b""
        if not self.by_piece or (self.added is not None and self.added.search(text)):
            return self.encode(text)
        try:
            lines = []
            for line in text.split("\n"):
                words = line.split(" ")
                lines.append(b"".join([self.first[words[0]], *map(self.spaced.__getitem__, words[1:])]))
            return self.newline.join(lines)
        except _Irregular:
            return b"".join(map(self._run, _ANY.findall(text)))

    def _run(self, piece: str) -> bytes:
        if piece[0] == " " and len(piece) > 1 and not _HAS_WS.search(piece, 1):
            return self.spaced[piece[1:]]
        if not _HAS_WS.search(piece):
            return self.first[piece]
        if piece not in self.runs:
            if len(self.runs) >= CACHE_PIECES:
                self.runs.clear()
            self.runs[piece] = self.encode(piece)
        return self.runs[piece]


_ENCODERS: dict[str, Encoder] = {}


def encoder_for(tokenizer_path: str) -> Encoder:
    """The encoder of this Python worker: tasks that a worker runs in turn share its pieces."""
    if tokenizer_path not in _ENCODERS:
        _ENCODERS[tokenizer_path] = Encoder(tokenizer_path)
    return _ENCODERS[tokenizer_path]


@dataclass
class Frame:
    """One document in a shard: its id (None if null) and where its frame lies."""

    doc_id: int | None
    offset: int
    size: int
    raw_size: int
    checksum: int


class ShardWriter:
    """Writes frames to a binary stream, then the index and the seek table."""

    def __init__(self, out, level: int = 1):
        import xxhash
        import zstandard

        self._zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self._xxh = xxhash.xxh64_intdigest
        self.out, self.table, self.ids, self.nulls = out, io.BytesIO(), [], []

    def add(self, doc_id: int | None, raw: bytes) -> None:
        frame = self._zstd.compress(raw)
        self.out.write(frame)
        self.table.write(struct.pack("<III", len(frame), len(raw), self._xxh(raw) & 0xFFFFFFFF))
        self.ids.append(0 if doc_id is None else doc_id)
        self.nulls.append(doc_id is None)

    def close(self) -> None:
        n = len(self.ids)
        index = struct.pack("<Q", n) + np.array(self.ids, "<i8").tobytes() + np.array(self.nulls, "u1").tobytes()
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        self.table.write(struct.pack("<III", len(index) + 8, 0, 0))
        table = self.table.getvalue() + struct.pack("<IBI", n + 1, CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)


class ShardReader:
    """Random access to a shard by its seek table; every frame read is checked."""

    def __init__(self, file):
        import zstandard

        self.file, self._zstd = file, zstandard.ZstdDecompressor()
        size = file.size() if callable(getattr(file, "size", None)) else file.seek(0, 2)
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError("not a shard with a checksummed seek table")
        table = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3)
        ends = table[:, 0].astype("i8").cumsum()
        head, length = struct.unpack("<II", self._at(int(ends[-2]) if n > 1 else 0, 8))
        if head != INDEX_MAGIC or length + 8 != table[-1, 0]:
            raise ValueError("the index frame is damaged")
        index = self._at(int(ends[-1]) - length, length)
        m = struct.unpack_from("<Q", index)[0]
        self.ids = np.frombuffer(index, "<i8", m, 8)
        self.null = np.frombuffer(index, "u1", m, 8 + 8 * m).astype(bool)
        self._table, self._starts = table, ends - table[:, 0]

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def __len__(self) -> int:
        return len(self.ids)

    def frame(self, k: int) -> Frame:
        size, raw, check = map(int, self._table[k])
        return Frame(None if self.null[k] else int(self.ids[k]), int(self._starts[k]), size, raw, check)

    def raw(self, k: int) -> bytes:
        """Ids of the k-th document as bytes."""
        import xxhash

        f = self.frame(k)
        raw = self._zstd.decompress(self._at(f.offset, f.size))
        if len(raw) != f.raw_size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != f.checksum:
            raise ValueError(f"frame {k} fails its checksum")
        return raw

    def find(self, doc_id: int) -> list[int]:
        """Frames of a document id: a binary search where ids ascend, else a scan of the index."""
        first = int(self.null.sum())
        if self.null[first:].any() or (np.diff(self.ids[first:]) < 0).any():
            return np.flatnonzero((self.ids == doc_id) & ~self.null).tolist()
        a, b = np.searchsorted(self.ids[first:], [doc_id, doc_id + 1]) + first
        return list(range(int(a), int(b)))


def open_uri(uri: str, mode: str):
    """A binary stream on any store that Arrow knows, for a path or URI."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if mode == "r":
        return store.open_input_file(path)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path)


MANIFEST = "shard long, path string, n_docs long, n_tokens long"


def write_token_shards(
    docs: DataFrame,
    out_uri: str,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
    order_by: list[str] | None = None,
    level: int = 1,
    shard_bytes: int = 256 << 20,
) -> DataFrame:
    """Encode whole texts and write them as shards; returns the manifest (one row a shard).

    Rows are range-partitioned and sorted by id (or by order_by), one shard for each partition of
    about shard_bytes of text at most, so shards follow each other in that order. A file name holds the attempt that wrote it and
    only the manifest, committed by Spark, says which files count: a lost or repeated task
    leaves at most a file that nothing refers to.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = text_or_empty(text_col)
    keys = [F.col(f"`{c}`").asc_nulls_first() for c in (order_by or [id_col])]
    rows = (
        docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(order_by or [id_col])])
        .withColumn("tie", F.xxhash64("text"))
    )
    keys = [F.col(f"k{i}").asc_nulls_first() for i in range(len(keys))] + [F.col("tie")]
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    shards = -(-int(size) // shard_bytes)
    ranged = rows.repartitionByRange(shards, *keys) if shards > int(spark.conf.get("spark.sql.shuffle.partitions")) else rows.repartitionByRange(*keys)
    rows = ranged.sortWithinPartitions(*keys).select("doc_id", "text")
    end = struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = writer = out = None
        n_docs = n_tokens = 0
        shard = TaskContext.get().partitionId()
        path = f"{out_uri}/shard-{shard:06d}-{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}.ids"
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if writer is None:
                encoder, out = encoder_for(tokenizer_path), open_uri(path, "w")
                writer = ShardWriter(out, level)
            for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = encoder.ids(body.as_py()) + end
                writer.add(doc_id, raw)
                n_docs, n_tokens = n_docs + 1, n_tokens + len(raw) // 4
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict(
                {"shard": pa.array([shard], pa.int64()), "path": [path], "n_docs": pa.array([n_docs], pa.int64()), "n_tokens": pa.array([n_tokens], pa.int64())}
            )

    rows.mapInArrow(write, MANIFEST).write.parquet(f"{out_uri}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{out_uri}/manifest")


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_token_shards(manifest: DataFrame, batch_docs: int = 5000) -> DataFrame:
    """One row a document from the files: doc_id, start, n_tokens and CRC-32 of its ids."""
    spark = manifest.sparkSession
    # the manifest has one row a shard, never one a document
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, start in zip(batch["path"], batch["start"], strict=True):
                with open_uri(path, "r") as file:
                    shard, rows = ShardReader(file), []
                    for k in range(len(shard)):
                        raw = shard.raw(k)
                        rows.append((None if shard.null[k] else int(shard.ids[k]), start, len(raw) // 4, zlib.crc32(raw)))
                        start += len(raw) // 4
                        if len(rows) >= batch_docs:
                            yield _frame(rows)
                            rows = []
                    if rows:
                        yield _frame(rows)

    return starts.select("path", "start", "shard").repartition(parts, "shard").mapInPandas(read, READ)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
    return out.astype({"doc_id": "Int64"})


def read_documents(manifest: DataFrame, doc_ids: list[int]) -> dict[int, list[np.ndarray]]:
    """Ids of the asked documents alone, by the index and seek table of each shard."""
    found: dict[int, list[np.ndarray]] = {d: [] for d in doc_ids}
    for row in manifest.orderBy("shard").toLocalIterator():
        with open_uri(row["path"], "r") as file:
            shard = ShardReader(file)
            for d in doc_ids:
                found[d] += [np.frombuffer(shard.raw(k), "<u4") for k in shard.find(d)]
    return found


def token_table(spark: SparkSession, docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write docs as shards below the shared folder and read them back."""
    return read_token_shards(write_token_shards(docs, scratch(spark, "tokens"), tokenizer_path, **options))

"""Token ids in files: one array of ids for many documents, their bounds as Elias-Fano sequences.

A file is Parquet; each of its rows is a block, and a block's bytes are

    header   magic, bytes of an id, documents without a key, first key, documents, ids
    keys     Elias-Fano sequence of the keys above the first one (null keys come before them)
    ends     Elias-Fano sequence of the number of ids up to the end of each document
    ids      little-endian, two bytes each where the vocabulary allows

Blocks of one shard follow each other, and shards are in ascending order of keys; the place of a
shard's first id is kept once for each shard. Encoding splits texts where the vocabulary's own
pattern always splits them, so each worker has the library merge a piece it has met before only once.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import scratch, tokens, words

VOCABULARY, END = "byte_bpe_50k.json", 0
#: A block ends after so many ids or documents; a longer document is a block of its own.
BLOCK_IDS, BLOCK_DOCS = 1 << 20, 1 << 16
#: Bytes of ids that one task sorts and writes.
SHARD_BYTES = 64 << 20
#: Ids hardly shrink by the default codec.
COMPRESSION = "zstd"
#: Every so many ones of the upper bits have their place kept.
SAMPLED = 256
_MAGIC = b"LLEF1\0"
_HEADER = struct.Struct("<6sHIqIQ")
_SEQUENCE = struct.Struct("<IBQ")


@dataclass
class EliasFano:
    """A non-decreasing sequence of whole numbers below 2^64: lower bits as they are, upper bits as gaps in unary."""

    n: int
    low_bits: int
    low: np.ndarray
    high: np.ndarray
    samples: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max((top // n).bit_length() - 1, 0) if n else 0
        lower = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")[:, :low_bits]
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        upper = np.zeros(n + (top >> low_bits) + 1, np.uint8)
        upper[places] = 1
        return cls(n, low_bits, np.packbits(lower.ravel(), bitorder="little"), np.packbits(upper, bitorder="little"), places[::SAMPLED].astype("<u4"))

    def to_bytes(self) -> bytes:
        return _SEQUENCE.pack(self.n, self.low_bits, len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def read(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        """The sequence whose bytes begin here, and where they end."""
        n, low_bits, high = _SEQUENCE.unpack_from(data, at)
        at += _SEQUENCE.size
        sizes = [(n * low_bits + 7) // 8, high, 4 * -(-n // SAMPLED)]
        parts = []
        for size in sizes:
            parts.append(np.frombuffer(data, np.uint8, size, at))
            at += size
        return cls(n, low_bits, parts[0], parts[1], parts[2].view("<u4")), at

    def _place(self, i: int) -> int:
        """The place of one number i among the upper bits: from the sample before it, byte by byte."""
        place = int(self.samples[i // SAMPLED])
        left, byte = i % SAMPLED, place >> 3
        now = int(self.high[byte]) >> (place & 7) << (place & 7)
        while left >= (ones := now.bit_count()):
            left, byte = left - ones, byte + 1
            now = int(self.high[byte])
        for _ in range(left):
            now &= now - 1
        return 8 * byte + (now & -now).bit_length() - 1

    def select(self, i: int) -> int:
        """Number i of the sequence, without decoding the others."""
        start = i * self.low_bits
        field = int.from_bytes(self.low[start >> 3 : (start + self.low_bits + 7) >> 3].tobytes(), "little") >> (start & 7)
        return (self._place(i) - i) << self.low_bits | field & ((1 << self.low_bits) - 1)

    def first_at_least(self, value: int) -> int:
        """How many numbers are less than the value."""
        low, high = 0, self.n
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if self.select(middle) < value else (low, middle)
        return low

    def values(self) -> np.ndarray:
        """The whole sequence."""
        upper = np.flatnonzero(np.unpackbits(self.high, bitorder="little")) - np.arange(self.n)
        bits = np.zeros((self.n, 64), np.uint8)
        bits[:, : self.low_bits] = np.unpackbits(self.low, bitorder="little", count=self.n * self.low_bits).reshape(self.n, self.low_bits)
        return (upper.astype(np.uint64) << np.uint64(self.low_bits)) | np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


class Block:
    """One block of a token file, read in place."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        magic, width, self.nulls, self.first, self.n_docs, self.n_ids = _HEADER.unpack_from(view)
        if magic != _MAGIC:
            raise ValueError("not a block of token ids")
        self.keys, at = EliasFano.read(view, _HEADER.size)
        self.ends, at = EliasFano.read(view, at)
        self.ids = np.frombuffer(view, f"<u{width}", self.n_ids, at)

    @staticmethod
    def pack(keys: list[int | None], counts: list[int], ids: bytes, width: int) -> bytes:
        """keys: nulls first, then ascending."""
        known = [k for k in keys if k is not None]
        first = known[0] if known else 0
        above = np.array([k - first for k in known], np.uint64)
        header = _HEADER.pack(_MAGIC, width, len(keys) - len(known), first, len(keys), len(ids) // width)
        return header + EliasFano.of(above).to_bytes() + EliasFano.of(np.cumsum(np.array(counts, np.int64))).to_bytes() + ids

    def key(self, i: int) -> int | None:
        return None if i < self.nulls else self.first + self.keys.select(i - self.nulls)

    def bounds(self, i: int) -> tuple[int, int]:
        """Where the ids of document i begin and end."""
        return self.ends.select(i - 1) if i else 0, self.ends.select(i)

    def find(self, key: int) -> range:
        """The documents with this key."""
        if key < self.first:
            return range(0)
        return range(self.nulls + self.keys.first_at_least(key - self.first), self.nulls + self.keys.first_at_least(key - self.first + 1))

    def all_keys(self) -> list[int | None]:
        return [None] * self.nulls + [self.first + k for k in self.keys.values().tolist()]

    def all_ends(self) -> np.ndarray:
        return self.ends.values().astype(np.int64)


@lru_cache
def _byte_letters() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


#: Bytes of a space and letters, ASCII's and those of Latin-1, which the vocabulary's pattern takes as one piece.
_WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: Marks that end a run of letters; "|" is none here, so that a special string stays whole.
_MARK = np.zeros(256, bool)
_MARK[[b for b in (*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), 0x7B, 0x7D, 0x7E)]] = True


def _wide_space(data: np.ndarray) -> np.ndarray:
    """Whether a white-space character beyond ASCII ends at each byte."""
    out = np.zeros(len(data), bool)
    if len(data) > 1:
        out[1:] = (data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0))
    if len(data) > 2:
        a, b, c = data[:-2], data[1:-1], data[2:]
        general = (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
        out[2:] |= general | ((a == 0xE2) & (b == 0x81) & (c == 0x9F)) | ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
    return out


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of pieces that the vocabulary encodes one by one, and for each row the number of pieces before it.

    The pattern lets no token reach from other characters into white space, nor from letters into marks,
    and looks ahead only within white space. A piece is white space and what follows it up to the next.
    """
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    space = ~words.SPACE[data]
    edge = np.zeros(len(data), bool)
    edge[1:] = space[1:] & ~space[:-1]
    wide = _wide_space(data) if (data >= 0x80).any() else None
    if wide is not None:
        edge[1:] &= ~wide[:-1]
    letter = _LETTER[data]
    if wide is not None:
        letter = letter.copy()
        letter[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    edge[1:] |= letter[:-1] & _MARK[data[1:]]
    edge[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(edge)
    return starts, np.append(starts[1:], len(data)), np.searchsorted(starts, offsets)


class Encoder:
    """Ids of texts; one for each worker and vocabulary. It remembers pieces up to a bound."""

    def __init__(self, path: str):
        self.library = tokens.library(path)
        self.keys, self.first, self.size = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.pool, self.filled = np.empty(1 << 16, np.uint32), 0

    @property
    def width(self) -> int:
        return 2 if self.library.get_vocab_size() <= 1 << 16 else 4

    def merged(self, raw: list[bytes]) -> list[list[int]]:
        """The library's ids of each piece; plain words go to its merges without the pattern."""
        letters, merges = _byte_letters(), self.library.model.tokenize
        out: list[list[int] | None] = [[t.id for t in merges(piece.decode("latin-1").translate(letters))] if _WORD.fullmatch(piece) else None for piece in raw]
        rest = [i for i, found in enumerate(out) if found is None]
        for i, found in zip(rest, self.library.encode_batch_fast([raw[i].decode() for i in rest], add_special_tokens=False), strict=True):
            out[i] = found.ids
        return out

    def _remember(self, keys: np.ndarray, raw: list[bytes]) -> None:
        ids = self.merged(raw)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for own in ids for i in own), np.uint32, int(size.sum()))
        while self.filled + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        self.pool[self.filled : self.filled + len(flat)] = flat
        into = np.searchsorted(self.keys, keys)
        self.first = np.insert(self.first, into, self.filled + np.cumsum(size) - size)
        self.size = np.insert(self.size, into, size)
        self.keys = np.insert(self.keys, into, keys)
        self.filled += len(flat)

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a chunk's texts, and for each text the number of ids before it (one more entry than texts)."""
        starts, ends, bounds = pieces(data, offsets)
        keys, at, back = np.unique(words.hashes(data, starts, ends, False), return_index=True, return_inverse=True)
        new = np.flatnonzero(~np.isin(keys, self.keys, assume_unique=True))
        if len(new):
            if len(self.keys) + len(new) > tokens.REMEMBERED and len(self.keys):
                self.keys, self.first, self.size, self.filled = self.keys[:0], self.first[:0], self.size[:0], 0
                new = np.arange(len(keys))
            raw = data.tobytes()
            self._remember(keys[new], [raw[s:e] for s, e in zip(starts[at[new]].tolist(), ends[at[new]].tolist(), strict=True)])
        found = np.searchsorted(self.keys, keys)[back]
        first, size = self.first[found], self.size[found]
        total = np.concatenate([[0], np.cumsum(size)])
        return self.pool[np.repeat(first - total[:-1], size) + np.arange(total[-1])], total[bounds]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _encoded(vocabulary: str, end: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            for low, high, data, offsets in words.chunks(batch.column(1)):
                ids, bounds = own.ids(data, offsets)
                edges = bounds + np.arange(len(bounds))
                ids = np.insert(ids, bounds[1:], end).astype(f"<u{own.width}")
                column = pa.Array.from_buffers(pa.binary(), high - low, [None, pa.py_buffer((edges * own.width).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(np.diff(edges), pa.int64()), column], ["key", "n", "ids"])

    return encode


def _blocks(width: int):
    """Blocks of the sorted documents of one shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[int | None] = []
        counts: list[int] = []
        ids: list[bytes] = []
        shard, block, before, held = 0, 0, 0, 0

        def done() -> pa.RecordBatch:
            nonlocal block, before, held
            row = {"shard": [shard], "block": [block], "before": [before], "n_docs": [len(keys)], "n_ids": [held], "bytes": [Block.pack(keys, counts, b"".join(ids), width)]}
            block, before, held = block + 1, before + held, 0
            for own in (keys, counts, ids):
                own.clear()
            return pa.RecordBatch.from_pydict(row, _BLOCK)

        for batch in batches:
            for shard, key, n, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if keys and (held + n > BLOCK_IDS or len(keys) >= BLOCK_DOCS):
                    yield done()
                keys.append(key)
                counts.append(n)
                ids.append(own)
                held += n
        if keys:
            yield done()

    return run


_BLOCK = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("bytes", pa.binary())])
_BLOCK_TYPES = "shard int, block int, before long, n_docs long, n_ids long, bytes binary"


def write_tokens(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", vocabulary: str | None = None, end: int = END) -> None:
    """Write the ids of all whole texts, each followed by `end`, in ascending order of keys, to token files at path.

    path: a new folder that all executors reach. Keys are whole numbers; null keys come first. Null and empty
    texts are the one id `end`. Rows of one key follow each other, each a document of its own. Other columns are
    left out. An empty table gives files without documents. Texts are encoded once and stored before ids are dealt
    to shards by ranges of keys (and, within a key, of content and row), so that no key fills a task.
    """
    spark, vocabulary = docs.sparkSession, vocabulary or tokens.vocabulary_path(VOCABULARY)
    scratch.text_batches(spark)
    width = encoder(vocabulary).width
    coded = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(words.frugal(_encoded(vocabulary, end)), "key long, n long, ids binary")
    coded = scratch.stored(coded.withColumn("tie", F.xxhash64("ids")).withColumn("row", F.monotonically_increasing_id()), "token-ids", COMPRESSION)
    total = coded.agg(F.sum("n")).first()[0] or 0
    order = [F.col("key").asc_nulls_first(), F.col("tie").asc(), F.col("row").asc()]
    shards = max(scratch.shuffle_partitions(spark), -(-total * width // SHARD_BYTES))
    dealt = coded.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    blocks = dealt.select(F.spark_partition_id().alias("shard"), "key", "n", "ids").mapInArrow(words.frugal(_blocks(width)), _BLOCK_TYPES)
    blocks.write.parquet(f"{path}/blocks", compression=COMPRESSION)
    sizes = sorted((r["shard"], r["n"]) for r in spark.read.parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())  # a row a shard
    starts = np.cumsum([0] + [n for _, n in sizes]).tolist()
    spark.createDataFrame([(shard, start) for (shard, _), start in zip(sizes, starts, strict=False)], "shard int, shard_start long").coalesce(1).write.parquet(f"{path}/shards")


def _documents(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block, start = Block(batch.column(1)[k].as_py()), batch.column(0)[k].as_py()
                ends, whole = block.all_ends(), block.ids.astype("<u4")
                begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                own = [pa.array(block.all_keys(), pa.int64()), pa.array(start + begins, pa.int64()), pa.array(ends - begins, pa.int64())]
                if with_ids:
                    own.append(pa.ListArray.from_arrays(pa.array(np.append(begins, block.n_ids), pa.int32()), pa.array(whole.astype(np.int32))))
                else:
                    own.append(pa.array([zlib.crc32(whole[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)], pa.int64()))
                yield pa.RecordBatch.from_arrays(own, ["doc_id", "start", "n_tokens", "ids" if with_ids else "ids_crc32"])

    return run


def _read(spark: SparkSession, path: str, with_ids: bool) -> DataFrame:
    scratch.text_batches(spark)
    shards = spark.read.schema("shard int, shard_start long").parquet(f"{path}/shards")
    blocks = spark.read.schema(_BLOCK_TYPES).parquet(f"{path}/blocks").join(F.broadcast(shards), "shard")  # a row a shard
    placed = blocks.select((F.col("shard_start") + F.col("before")).alias("start"), "bytes")
    return placed.mapInArrow(words.frugal(_documents(with_ids)), f"doc_id long, start long, n_tokens long, {'ids array<int>' if with_ids else 'ids_crc32 long'}")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids of every document in the files."""
    return _read(spark, path, True)


def read_check_sums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, and the check sum of each document's ids as little-endian unsigned 32-bit numbers."""
    return _read(spark, path, False)


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token files and read back."""
    path = scratch.new_path(spark, "token-files")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_check_sums(spark, path)

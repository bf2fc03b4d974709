"""Packing of token sequences: non-negative least squares over the histogram of piece lengths.

A document's ids are cut into full windows and a rest. The histogram of rest lengths has at most one
bin a length, whatever the size of the corpus. Shallow combinations of lengths that fill a window are
its candidate patterns; non-negative least squares says how often to repeat each. Rounded down, they
leave a few pieces, which are packed greedily; where nothing fits a gap, a piece is cut for it. Pieces
take their places by rank within their length, counted over salted groups.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm import scratch, tokens, words

#: About so many pieces of one length are ranked in one group, so that a length that many share is no single task's.
GROUP = 512
#: Candidate combinations for least squares of each depth, the commonest lengths first, and its rounds.
COMBINATIONS, ROUNDS = 20_000, 200

#: (length of the piece, first rank, rank after the last, start within the piece, length, first sequence, offset).
Slot = tuple[int, int, int, int, int, int, int]


def combinations(histogram: np.ndarray, window: int, most: int = COMBINATIONS) -> list[tuple[int, ...]]:
    """Combinations of one to four present lengths that fill the window exactly.

    Not all of them: of three lengths those around the commonest, of four the commonest pairs of each two sums, at most
    about `most` of each. Pieces that no combination takes are packed greedily.
    """
    present = [int(n) for n in np.flatnonzero(histogram)]
    have = set(present)
    common = sorted(present, key=lambda n: (-histogram[n], n))
    out: set[tuple[int, ...]] = {(window,)} & {(n,) for n in present}
    out |= {(a, window - a) for a in present if 2 * a >= window and window - a in have}
    found: set[tuple[int, ...]] = set()
    for middle in common:  # and a pair of any lengths around it
        left = window - middle
        found |= {tuple(sorted((middle, a, left - a), reverse=True)) for a in present if 2 * a >= left and left - a in have}
        if len(found) >= most:
            break
    lengths, each = np.array(present, np.int64), max(1, math.isqrt(2 * most // window))

    def pairs(total: int) -> list[tuple[int, int]]:
        """Pairs of lengths of this sum, the commonest first."""
        high = lengths[(2 * lengths >= total) & (lengths < total)]
        high = high[histogram[total - high] > 0]
        order = np.argsort(-np.minimum(histogram[high], histogram[total - high]), kind="stable")[:each]
        return [(int(n), total - int(n)) for n in high[order]]

    for total in range(2, window // 2 + 1):
        if one := pairs(total):
            found |= {tuple(sorted(a + b, reverse=True)) for a in one for b in pairs(window - total)}
    out |= found
    return sorted(out, reverse=True)


def repeat_counts(histogram: np.ndarray, patterns: list[tuple[int, ...]], rounds: int = ROUNDS) -> np.ndarray:
    """x >= 0 with a small |Ax - h|^2, A being the patterns' uses of each length; multiplicative updates."""
    if not patterns:
        return np.empty(0)
    at = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    length = np.fromiter((n for p in patterns for n in p), np.int64)
    goal = np.bincount(at, histogram[length], len(patterns))
    x = np.bincount(at, histogram[length] / np.maximum(np.bincount(length, minlength=len(histogram))[length], 1), len(patterns)) / np.bincount(at)
    for _ in range(rounds):
        made = np.bincount(length, x[at], len(histogram))
        x *= goal / np.maximum(np.bincount(at, made[length], len(patterns)), 1e-12)
    return x


class Stock:
    """What is left of each length: runs of ranks, and the starts of pieces that have been cut."""

    def __init__(self, histogram: np.ndarray):
        self.lots: dict[int, list[list[int]]] = {int(n): [[int(n), 0, int(histogram[n]), 0]] for n in np.flatnonzero(histogram)}
        self.count = {n: lots[0][2] for n, lots in self.lots.items()}

    def take(self, length: int, n: int) -> list[tuple[int, int, int, int]]:
        """(piece length, first rank, rank after the last, start) of n pieces of this length."""
        out, lots = [], self.lots[length]
        self.count[length] -= n
        while n:
            source, low, high, start = lots[-1]
            used = min(n, high - low)
            out.append((source, low, low + used, start))
            lots[-1][1] += used
            n -= used
            if lots[-1][1] == high:
                lots.pop()
        if not self.count[length]:
            del self.count[length]
        return out

    def put(self, length: int, lots: list[tuple[int, int, int, int]]) -> None:
        for source, low, high, start in lots:
            self.lots.setdefault(length, []).append([source, low, high, start])
            self.count[length] = self.count.get(length, 0) + high - low


def plan(histogram: np.ndarray, window: int) -> list[Slot]:
    """Where every piece goes; as long as the patterns are many, not as the pieces are."""
    stock, slots, sequence = Stock(histogram), [], 0

    def place(parts: list[tuple[int, int | None]], times: int) -> None:
        """times sequences of (length, cut): a piece is laid down up to its cut, and the rest goes back."""
        nonlocal sequence
        offset = 0
        for length, cut in parts:
            taken, first = stock.take(length, times), sequence
            for source, low, high, start in taken:
                slots.append((source, low, high, start, cut or length, first, offset))
                first += high - low
            if cut:
                stock.put(length - cut, [(s, low, high, start + cut) for s, low, high, start in taken])
            offset += cut or length
        sequence += times

    patterns = combinations(histogram, window)
    wanted = np.floor(repeat_counts(histogram.astype(float), patterns) + 1e-6).astype(np.int64)
    for i in np.argsort(-wanted, kind="stable"):
        uses = {n: patterns[i].count(n) for n in patterns[i]}
        times = min(int(wanted[i]), *(stock.count.get(n, 0) // k for n, k in uses.items()))
        if times > 0:
            place([(n, None) for n in patterns[i]], times)
    while stock.count:
        parts, uses, left = [], Counter(), window
        lengths = sorted(stock.count)
        while left and (k := bisect_right(lengths, left)):
            length = lengths[k - 1]
            fits = min(stock.count[length] - uses[length], left // length)
            if not fits:
                lengths.pop(k - 1)
                continue
            parts += [(length, None)] * fits
            uses[length] += fits
            left -= fits * length
        spare = [n for n in stock.count if n > left and stock.count[n] > uses[n]] if left else []
        if spare:
            length = max(spare, key=lambda n: (stock.count[n] - uses[n], n))
            parts.append((length, left))
            uses[length] += 1
        elif left:
            break
        place(parts, min(stock.count[n] // k for n, k in uses.items()))
    _tail(stock, slots, sequence)
    return slots


def _tail(stock: Stock, slots: list[Slot], sequence: int) -> None:
    """What is left fills no window: cut it into sequences whose lengths are powers of two, so that none is padded."""
    rest = [(n, lot) for n in sorted(stock.count, reverse=True) for lot in stock.take(n, stock.count[n])]
    pieces = [(source, rank, start, n) for n, (source, low, high, start) in rest for rank in range(low, high)]
    total, offset = sum(p[3] for p in pieces), 0
    sizes = [1 << bit for bit in reversed(range(total.bit_length())) if total >> bit & 1]
    for source, rank, start, left in pieces:
        while left:
            length = min(left, sizes[0] - offset)
            slots.append((source, rank, rank + 1, start, length, sequence, offset))
            start, left, offset = start + length, left - length, offset + length
            if offset == sizes[0]:
                sizes.pop(0)
                sequence, offset = sequence + 1, 0


def _encoded(vocabulary: str, end: int, window: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(vocabulary)
        for batch in batches:
            for low, high, data, offsets in words.chunks(batch.column(1)):
                ids, bounds = encoder.ids(data, offsets)
                sizes = np.diff(bounds) + 1
                ids = np.insert(ids, bounds[1:], end).astype("<u4")
                counts = -(-sizes // window)
                row = np.repeat(np.arange(high - low), counts)
                start = (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)) * window
                length = np.minimum(sizes[row] - start, window)
                edges = np.concatenate([[0], np.cumsum(length)]) * 4
                column = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low).take(pa.array(row)), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(sizes[row], pa.int64()), column],
                    ["doc_id", "start", "length", "doc_tokens", "ids"],
                )

    return encode


def _placed(slots: list[Slot]):
    by_length: dict[int, list[Slot]] = defaultdict(list)
    for slot in slots:
        by_length[slot[0]].append(slot)
    lookup = {}
    for length, own in by_length.items():
        edges = sorted({edge for slot in own for edge in slot[1:3]})
        inside: list[list[Slot]] = [[] for _ in edges]
        for slot in own:
            for k in range(bisect_right(edges, slot[1]) - 1, bisect_right(edges, slot[2] - 1)):
                inside[k].append(slot)
        lookup[length] = (edges, inside)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, start, size, sequence, offset, ids = [], [], [], [], [], []
            begins, lengths, ranks, binary = batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(5).to_pylist(), batch.column(4)
            for i, (begin, length, rank) in enumerate(zip(begins, lengths, ranks, strict=True)):
                edges, inside = lookup[length]
                whole = binary[i].as_buffer()
                for _, low, _, inner, part, first, at in inside[bisect_right(edges, rank) - 1]:
                    rows.append(i)
                    start.append(begin + inner)
                    size.append(part)
                    sequence.append(first + rank - low)
                    offset.append(at)
                    ids.append(whole.slice(4 * inner, 4 * part))
            rows = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array([x.to_pybytes() for x in ids], pa.binary()), batch.column(3).take(rows), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

    return place


def pack(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = 4096, end: int = 2, vocabulary: str | None = None) -> DataFrame:
    """Pieces of documents, packed: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    A document is its ids and then `end`; start is the piece's place in it, ids its ids as little-endian
    unsigned 32-bit numbers, offset its place in the sequence. Sequences hold `window` ids and have no gap;
    the last ones, fewer than 13 for 4096, are powers of two. Null and empty texts are the one id `end`.
    Rows with a null or a repeated key are documents of their own. Other columns are left out. An empty
    table gives an empty table.
    """
    spark = docs.sparkSession
    scratch.text_batches(spark)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length int, doc_tokens long, ids binary"
    pieces = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(words.frugal(_encoded(vocabulary or tokens.vocabulary_path(), end, window)), schema)
    pieces = scratch.stored(pieces, "pieces")
    histogram = np.zeros(window + 1, np.int64)
    for row in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():  # a row a length, at most `window`
        histogram[row["length"]] = row["n"]
    salts = spark.createDataFrame([(int(n), int(-(-histogram[n] // GROUP))) for n in np.flatnonzero(histogram)], "length int, salts int")
    # at most `window` rows are broadcast
    pieces = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.col("salts")).cast("int"))
    groups = pieces.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "doc_tokens", F.xxhash64("ids"))
    ranked = pieces.withColumn("own", F.row_number().over(own) - 1).join(groups, ["length", "salt"])
    ranked = ranked.select("doc_id", "start", "length", "doc_tokens", "ids", (F.col("before") + F.col("own")).alias("rank"))
    return ranked.mapInArrow(words.frugal(_placed(plan(histogram, window))), f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 ids, with the check sum of each piece's ids."""
    return digests(pack(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

"""Exact repeats across documents, found by fixed-block anchors.

Two documents that share `window` words share, inside them, a block of one document's own division into
non-overlapping blocks of (window + 1) / 2 words. Those blocks are the index; every rolling run of as
many words probes it. Runs that the index holds and that two documents have are anchors; the windows
around an anchor are its extensions, and the smallest document with each window is found exactly, by
64-bit hashes. A word goes when a window over it also begins in a document with a smaller id; maximal
repeats are unions of such windows.

What several documents of one batch share is settled there and sent on once, so that a passage in a
third of all documents is at most one entry a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import packets, scratch, words

WINDOW = 13
#: Words that a task gathers before it sends them on; bounds its memory only.
GATHERED = 1 << 19
#: Texts that a task unpacks at a time, and parts in which it goes through a partition's numbers.
UNPACKED, PARTS = 256, 4
#: What a row is; what is told about texts comes before them.
PROBE, ANCHOR, CANDIDATE, REMOVED, TEXT = range(5)
_FINGERPRINT, _ALIGNED, _SHARED = np.uint64((1 << 30) - 1), np.uint32(1 << 30), np.uint32(1 << 31)


def _home(docs: np.ndarray, partitions: int) -> np.ndarray:
    """The partition to which everything about a document goes."""
    return (words.mix(docs.astype(np.uint64)) >> np.uint64(33)).astype(np.int64) % partitions


def _key(docs: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    return words.mix(docs.astype(np.uint64)) + numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _within(known: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Which of the numbers are in a sorted array."""
    if not len(known):
        return np.zeros(len(asked), bool)
    return known[np.minimum(np.searchsorted(known, asked), len(known) - 1)] == asked


def _groups(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal numbers together, and where each of them begins."""
    order = np.argsort(numbers, kind="stable")
    ordered = numbers[order]
    return order, np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(order) else order


def _hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, bounds = words.spans(data, offsets)
    return starts, ends, bounds, words.hashes(data, starts, ends, False)


def _probes(partitions: int, window: int):
    block = (window + 1) // 2

    def settle(numbers: np.ndarray, docs: np.ndarray, aligned: np.ndarray) -> Iterator[pa.RecordBatch]:
        order, begin = _groups(numbers)
        if not len(order):
            return
        numbers, docs, aligned = numbers[order], docs[order], aligned[order]
        low, high = np.minimum.reduceat(docs, begin), np.maximum.reduceat(docs, begin)
        shared, index = low != high, np.maximum.reduceat(aligned, begin)
        entry = (numbers[begin] & _FINGERPRINT).astype(np.uint32) | np.where(index, _ALIGNED, np.uint32(0)) | np.where(shared, _SHARED, np.uint32(0))
        target = (numbers[begin] >> np.uint64(32)).astype(np.int64) % partitions
        # the documents' ids are needed only where the entry is one document's
        yield packets.packed(target, PROBE, np.where(shared, 0, low), entry)
        mine = np.repeat(shared, np.diff(np.append(begin, len(numbers))))
        if mine.any():
            yield packets.packed(_home(docs[mine], partitions), ANCHOR, docs[mine], (numbers[mine] & _FINGERPRINT).astype(np.uint32))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for low, _, data, offsets in words.chunks(batch.column(1)):
                _, _, bounds, found = _hashed(data, offsets)
                at = words.whole_runs(bounds, block)
                row = np.searchsorted(bounds, at, "right") - 1
                long = (np.diff(bounds) >= window)[row]
                at, row = at[long], row[long]
                held.append((words.runs(found, block)[at], keys[low + row], (at - bounds[row]) % block == 0))
                if sum(len(x[0]) for x in held) >= GATHERED:
                    yield from settle(*map(np.concatenate, zip(*held, strict=True)))
                    held = []
        if held:
            yield from settle(*map(np.concatenate, zip(*held, strict=True)))

    return probe


def _anchors(partitions: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            held += packets.rows_of(batch, PROBE)
            yield packets.only(batch, ANCHOR)
        docs, entries = packets.unpacked(held, np.uint32)
        del held
        for part in range(PARTS):
            mine = (entries & np.uint32(_FINGERPRINT)) % np.uint32(PARTS) == part
            yield from settle(docs[mine], entries[mine])

    def settle(docs: np.ndarray, entries: np.ndarray) -> Iterator[pa.RecordBatch]:
        fingerprint = entries & np.uint32(_FINGERPRINT)
        order, begin = _groups(fingerprint)
        if not len(order):
            return
        docs, entries, fingerprint = docs[order], entries[order], fingerprint[order]
        one = (entries & _SHARED) == 0
        most = np.iinfo(np.int64)
        several = np.minimum.reduceat(np.where(one, docs, most.max), begin) < np.maximum.reduceat(np.where(one, docs, most.min), begin)
        anchor = (several | ~np.minimum.reduceat(one, begin)) & np.maximum.reduceat((entries & _ALIGNED) > 0, begin)
        told = np.repeat(anchor, np.diff(np.append(begin, len(entries)))) & one
        if told.any():
            yield packets.packed(_home(docs[told], partitions), ANCHOR, docs[told], fingerprint[told])

    return find


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray]]:
    """(rows, texts, ids) of the rows of a batch that carry a text, some at a time."""
    names, unpack = batch.schema.names, zstandard.ZstdDecompressor().decompress
    whole = packets.only(batch, TEXT)
    for low in range(0, whole.num_rows, UNPACKED):
        rows = whole.slice(low, UNPACKED)
        texts = [None if x is None else unpack(x) for x in rows.column(names.index("packed")).to_pylist()]
        yield rows, pa.array(texts, pa.binary()), rows.column(names.index("id")).fill_null(0).to_numpy(zero_copy_only=False)


def _candidates(partitions: int, window: int):
    block = (window + 1) // 2

    def settle(numbers: np.ndarray, docs: np.ndarray) -> Iterator[pa.RecordBatch]:
        order, begin = _groups(numbers)
        if not len(order):
            return
        numbers, docs = numbers[order], docs[order]
        low = np.minimum.reduceat(docs, begin)
        later = docs > np.repeat(low, np.diff(np.append(begin, len(numbers))))
        yield packets.packed((numbers[begin] >> np.uint64(20)).astype(np.int64) % partitions, CANDIDATE, low, numbers[begin])
        if later.any():
            yield packets.packed(_home(docs[later], partitions), REMOVED, docs[later], numbers[later])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: list = []
        known, held = None, []
        for batch in batches:
            told += packets.rows_of(batch, ANCHOR)
            for low, data, offsets, ids in ((low, data, offsets, ids) for _, texts, ids in _texts(batch) for low, _, data, offsets in words.chunks(texts)):
                if known is None:  # packets came first
                    known = np.unique(_key(*packets.unpacked(told, np.uint32)))
                    told = []
                _, _, bounds, found = _hashed(data, offsets)
                at = words.whole_runs(bounds, block)
                row = np.searchsorted(bounds, at, "right") - 1
                hit = np.zeros(len(found) + 1, np.int64)
                hit[at + 1] = _within(known, _key(ids[low + row], words.runs(found, block)[at] & _FINGERPRINT))
                hit = np.cumsum(hit)
                at = words.whole_runs(bounds, window)
                at = at[hit[at + window - block + 1] > hit[at]]
                held.append((words.runs(found, window)[at], ids[low + np.searchsorted(bounds, at, "right") - 1]))
                if sum(len(x[0]) for x in held) >= GATHERED:
                    yield from settle(*map(np.concatenate, zip(*held, strict=True)))
                    held = []
        if held:
            yield from settle(*map(np.concatenate, zip(*held, strict=True)))

    return windows


def _later(partitions: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            held += packets.rows_of(batch, CANDIDATE)
            yield packets.only(batch, REMOVED)
        docs, numbers = packets.unpacked(held, np.uint64)
        del held
        order, begin = _groups(numbers)
        if not len(order):
            return
        docs, numbers = docs[order], numbers[order]
        later = docs > np.repeat(np.minimum.reduceat(docs, begin), np.diff(np.append(begin, len(numbers))))
        if later.any():
            yield packets.packed(_home(docs[later], partitions), REMOVED, docs[later], numbers[later])

    return find


def _cut(window: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: list = []
        known = None
        for batch in batches:
            told += packets.rows_of(batch, REMOVED)
            for rows, texts, ids in _texts(batch):
                if known is None:
                    known = np.unique(_key(*packets.unpacked(told, np.uint64)))
                    told = []
                named = rows.column(rows.schema.names.index("named")).to_numpy(zero_copy_only=False)
                new, counts, removed = [], [], []
                for low, high, data, offsets in words.chunks(texts):
                    starts, ends, bounds, found = _hashed(data, offsets)
                    at = words.whole_runs(bounds, window)
                    row = np.searchsorted(bounds, at, "right") - 1
                    at = at[_within(known, _key(ids[low + row], words.runs(found, window)[at])) & named[low + row]]
                    change = np.zeros(len(found) + 1, np.int64)
                    np.add.at(change, at, 1)
                    np.add.at(change, at + window, -1)
                    gone = np.cumsum(change[:-1]) > 0
                    total = np.concatenate([[0], np.cumsum(gone)])[bounds]
                    counts.append(np.diff(bounds))
                    removed.append(np.diff(total))
                    raw = data.tobytes()
                    for i in range(high - low):
                        a, b = int(bounds[i]), int(bounds[i + 1])
                        if total[i] == total[i + 1]:
                            new.append(raw[offsets[i] : offsets[i + 1]])
                            continue
                        edge = np.flatnonzero(np.diff(gone[a:b].astype(np.int8), prepend=0, append=0))
                        kept, place = [], int(offsets[i])
                        for first, last in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                            kept.append(raw[place : starts[a + first]])
                            place = int(ends[a + last - 1])
                        new.append(b"".join([*kept, raw[place : offsets[i + 1]]]))
                flat = pa.array([x if valid else None for x, valid in zip(new, texts.is_valid().to_pylist(), strict=True)], pa.binary()).cast(pa.string())
                rest = rows.column(rows.schema.names.index("rest"))
                sizes = [pa.array(np.concatenate(x), pa.int64()) for x in (counts, removed)]
                yield pa.RecordBatch.from_arrays([flat, *sizes, rest], ["text", "n_words", "n_removed", "rest"])

    return cut


def _compressed(partitions: int):
    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            home = _home(batch.column(1).fill_null(0).to_numpy(zero_copy_only=False), partitions)
            home = np.where(batch.column(1).is_valid().to_numpy(zero_copy_only=False), home, np.arange(len(home)) % partitions)
            packed = pa.array([None if x is None else pack(x) for x in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(home, pa.int32()), packed, *batch.columns[1:]], ["target", "packed", "id", "rest"])

    return compress


def _with_texts(told: DataFrame, docs: DataFrame, text: str, key: str, rest: Column, partitions: int) -> DataFrame:
    """Texts and what is told about them, in the partition of their document; what is told stands first."""
    source = docs.select(F.col(text).alias("text"), F.col(key).cast("long").alias("id"), rest.alias("rest"))
    kind = source.schema["rest"].dataType.simpleString()
    texts = source.mapInArrow(words.frugal(_compressed(partitions)), f"target int, packed binary, id long, rest {kind}")
    texts = texts.withColumns({"kind": F.lit(TEXT), "named": F.col("id").isNotNull(), **{c: F.lit(None).cast("binary") for c in packets.COLUMNS[2:]}})
    whole = told.withColumns({c: F.lit(None).cast(texts.schema[c].dataType) for c in ("packed", "id", "rest", "named")}).unionByName(texts)
    return whole.repartitionById(partitions, F.col("target")).sortWithinPartitions("kind")


def without_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """docs with the words cut from `text` that repeat a document with a smaller id, and n_words and n_removed.

    Words are runs of other characters than ASCII white space, unchanged. White space around what is cut
    stays. n_words is the number of words before, n_removed of those cut. Ids are integers; rows with the
    same id are one document, so that neither takes words from the other. A row with a null id keeps all
    its words and takes none from others. Null texts stay null and have no words; shorter texts than a
    window stay whole. Columns of docs called n_words and n_removed are replaced, all others pass
    through. An empty table gives an empty table.

    A task holds the numbers of one shuffle partition; spark.sql.shuffle.partitions says how many there are.
    """
    partitions = scratch.shuffle_partitions(docs.sparkSession)
    scratch.text_batches(docs.sparkSession)
    docs = docs.drop("n_words", "n_removed")
    others = [c for c in docs.columns if c != text]
    known = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull())
    told = known.mapInArrow(words.frugal(_probes(partitions, window)), packets.SCHEMA)
    told = told.repartitionById(partitions, F.col("target")).mapInArrow(words.frugal(_anchors(partitions)), packets.SCHEMA)
    told = _with_texts(told, docs.where(F.col(key).isNotNull()), text, key, F.lit(None).cast("int"), partitions).mapInArrow(words.frugal(_candidates(partitions, window)), packets.SCHEMA)
    told = told.repartitionById(partitions, F.col("target")).mapInArrow(words.frugal(_later(partitions)), packets.SCHEMA)
    rest = F.struct(*[F.col(c) for c in others])
    kind = docs.select(rest.alias("rest")).schema["rest"].dataType.simpleString()
    out = _with_texts(told, docs, text, key, rest, partitions).mapInArrow(words.frugal(_cut(window)), f"text string, n_words long, n_removed long, rest {kind}")
    return out.select(*[F.col("text").alias(c) if c == text else F.col("rest")[c].alias(c) for c in docs.columns], "n_words", "n_removed")


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that repeat an earlier one, and a check sum of those kept."""
    cut = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    kept = F.btrim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x09-\x0D\x20]+", " "))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(kept, 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS m FROM win) WHERE m < doc_id),
gone AS (SELECT doc_id, list(DISTINCT k) AS g FROM (SELECT doc_id, unnest(range(i, i + 13)) AS k FROM late) GROUP BY doc_id),
n AS (SELECT d.doc_id, w, coalesce(g, []) AS g FROM d LEFT JOIN gone ON gone.doc_id = d.doc_id),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY k) AS t FROM (SELECT n.doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k FROM n) e
         WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id, unnest(g) AS k FROM gone) r WHERE r.doc_id = e.doc_id AND r.k = e.k) GROUP BY doc_id)
SELECT n.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(g) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM n LEFT JOIN kept ON kept.doc_id = n.doc_id
"""

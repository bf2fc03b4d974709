"""Benchmark decontamination with an FM-index over every shard of the training texts.

A shard is about a megabyte of whole texts within one task. Its words become symbols of the test
phrases' vocabulary; a run of them that is shorter than any phrase, and every other word, can hold no
phrase and stays out. Over the rest stands an FM-index: suffix order, last column as a wavelet matrix
for ranks, and every eighth suffix position. All phrases are searched backwards together, occurrences
are located by walking to the next sampled position, and overlapping ones merge into removal spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import scratch, words

#: Words of a test phrase, bytes of a shard, and every how many positions are kept for locating.
PHRASE, SHARD_BYTES, SAMPLED = 10, words.CHUNK_BYTES, 8
#: Bytes of items that are sent to the executors at a time; more items make more passes in the same stage.
BLOCK_BYTES = 1 << 24
SPANS = "array<struct<first_word:long,end_word:long,first_byte:long,end_byte:long>>"
_SPAN = pa.struct([(name, pa.int64()) for name in ("first_word", "end_word", "first_byte", "end_byte")])


class WaveletMatrix:
    """Ranks of symbols in a sequence, for many queries at once."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels, self.zeros = [], []
        for bit in reversed(range(bits)):
            ones = (symbols >> bit & 1).astype(bool)
            self.levels.append(np.concatenate([[0], np.cumsum(ones)]).astype(np.int32))
            self.zeros.append(len(symbols) - int(self.levels[-1][-1]))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often the symbol occurs before the end."""
        low, high = np.zeros_like(end), end.copy()
        for level, (ones, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = (symbol >> (len(self.levels) - 1 - level) & 1).astype(bool)
            low1, high1 = ones[low], ones[high]
            low = np.where(one, zeros + low1, low - low1)
            high = np.where(one, zeros + high1, high - high1)
        return high - low


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """The suffixes of a sequence of distinct ends, in order, by prefix doubling."""
    n, step = len(symbols), 1
    order = np.argsort(symbols, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(np.diff(symbols[order]) != 0)])
    while n and rank[order[-1]] < n - 1:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        step *= 2
    return order


class FMIndex:
    """Symbols 1 and up, with 0 after every run."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        ends = symbols == 0
        distinct = symbols + int(ends.sum())
        distinct[ends] = np.arange(ends.sum())  # so that no suffix reaches over the end of its run
        order = suffix_order(distinct)
        self.last = symbols[order - 1]
        self.tree = WaveletMatrix(self.last, max(1, alphabet.bit_length()))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=alphabet + 1))])
        self.sampled = np.where((order % SAMPLED == 0) | (self.last == 0), order, -1)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the suffixes that begin with each phrase; phrases are right-aligned rows of symbols."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.last), np.int64)
        for k in range(phrases.shape[1]):
            live = np.flatnonzero((lengths > k) & (low < high))
            if not len(live):
                break
            symbol = phrases[live, phrases.shape[1] - 1 - k]
            low[live] = self.before[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.tree.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The positions of these suffixes."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        while len(away := np.flatnonzero(self.sampled[rows] < 0)):
            symbol = self.last[rows[away]]
            rows[away] = self.before[symbol] + self.tree.rank(symbol, rows[away])
            steps[away] += 1
        return self.sampled[rows] + steps


@dataclass
class Phrases:
    """Test phrases as symbols, and the items that each occurs in."""

    vocabulary: np.ndarray
    maybe: np.ndarray
    symbols: np.ndarray
    lengths: np.ndarray
    phrase: np.ndarray
    item: np.ndarray
    names: list[str]

    @classmethod
    def of(cls, items: list[tuple[Any, str | None]], size: int = PHRASE) -> Phrases:
        data, offsets = words.buffer(pa.array([text for _, text in items], pa.string()))
        starts, ends, bounds = words.spans(data, offsets, words.ALNUM)
        found = words.hashes(data, starts, ends, True)
        vocabulary, symbol = np.unique(found, return_inverse=True)
        rows: dict[tuple[int, ...], set[int]] = {}
        for i in range(len(items)):
            own = (symbol[bounds[i] : bounds[i + 1]] + 1).tolist()
            for at in range(max(1, len(own) - size + 1) if own else 0):
                rows.setdefault(tuple(own[at : at + size]), set()).add(i)
        table = np.zeros((len(rows), size), np.int64)
        for k, row in enumerate(rows):
            table[k, size - len(row) :] = row
        pairs = [(k, i) for k, own in enumerate(rows.values()) for i in own]
        maybe = np.zeros(1 << 20, bool)
        maybe[(vocabulary >> np.uint64(44)).astype(np.int64)] = True
        phrase, item = (np.array([p[x] for p in pairs], np.int64) for x in (0, 1))
        return cls(vocabulary, maybe, table, (table > 0).sum(1), phrase, item, ["" if name is None else str(name) for name, _ in items])

    def symbols_of(self, found: np.ndarray) -> np.ndarray:
        """The symbol of each word, 0 for words that no phrase has."""
        out = np.zeros(len(found), np.int64)
        near = np.flatnonzero(self.maybe[(found >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, found[near]), len(self.vocabulary) - 1)
        out[near] = np.where(self.vocabulary[at] == found[near], at + 1, 0)
        return out


def occurrences(phrases: Phrases, symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, word at which it occurs) in a shard's words."""
    none = np.empty(0, np.int64)
    if not len(phrases.lengths) or not len(symbols):
        return none, none
    inside = symbols > 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = bounds[1:-1]
    edge = edge[edge < len(symbols)]
    first[edge] = inside[edge]
    run = np.cumsum(first)[inside] - 1
    if not len(run):
        return none, none
    size = np.bincount(run)
    kept = np.flatnonzero(inside)[size[run] >= phrases.lengths.min()]
    if not len(kept):
        return none, none
    run = run[size[run] >= phrases.lengths.min()]
    ends = np.flatnonzero(np.diff(run, append=-1) != 0) + 1
    text = np.insert(symbols[kept], ends, 0)
    place = np.insert(kept, ends, -1)
    index = FMIndex(text, len(phrases.vocabulary))
    low, high = index.search(phrases.symbols, phrases.lengths)
    found = np.repeat(np.arange(len(low)), high - low)
    rows = np.repeat(low - np.concatenate([[0], np.cumsum(high - low)[:-1]]), high - low) + np.arange(len(found))
    return found, place[index.locate(rows)]


def _without(texts: pa.Array, found: list[list[dict]]) -> pa.Array:
    """Texts cut at their spans; all of a text outside them stays as it is."""
    if not any(found):
        return texts
    new = texts.to_pylist()
    for i, own in enumerate(found):
        if own:
            raw, kept, at = new[i].encode(), [], 0
            for span in own:
                kept.append(raw[at : span["first_byte"]])
                at = span["end_byte"]
            new[i] = b"".join([*kept, raw[at:]]).decode()
    return pa.array(new, texts.type)


def _searched(text: int, spans: int, items: int, phrases: Phrases, cut: bool):
    def shard(column: pa.Array, low: int, high: int, data: np.ndarray, offsets: np.ndarray, old: pa.Array) -> tuple[list, list, np.ndarray]:
        starts, ends, bounds = words.spans(data, offsets, words.ALNUM)
        found, at = occurrences(phrases, phrases.symbols_of(words.hashes(data, starts, ends, True)), bounds)
        doc = np.searchsorted(bounds, at, "right") - 1
        hit = np.zeros(len(starts) + 1, np.int64)
        np.add.at(hit, at, 1)
        np.add.at(hit, at + phrases.lengths[found], -1)
        out_spans: list = [[] for _ in range(high - low)]
        out_items: list = [set() for _ in range(high - low)]
        before = old[1].slice(low, high - low).to_pylist() if old[1].null_count < len(old[1]) else [None] * (high - low)
        for i, had in enumerate(before):
            for span in had or ():
                hit[bounds[i] + span["first_word"]] += 1
                hit[bounds[i] + span["end_word"]] -= 1
        covered = np.cumsum(hit[:-1]) > 0
        if covered.any():
            change = np.diff(covered.astype(np.int8), prepend=0, append=0)
            change_at = np.concatenate([np.flatnonzero(change), bounds])  # a span ends with its document
            cuts = np.unique(change_at)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if a < len(covered) and covered[a]:
                    i = int(np.searchsorted(bounds, a, "right")) - 1
                    out_spans[i].append({"first_word": a - int(bounds[i]), "end_word": b - int(bounds[i]), "first_byte": int(starts[a] - offsets[i]), "end_byte": int(ends[b - 1] - offsets[i])})
        if len(found):
            order = np.argsort(phrases.phrase, kind="stable")
            per = np.bincount(phrases.phrase, minlength=len(phrases.lengths))
            begin = np.concatenate([[0], np.cumsum(per)])
            pairs = np.unique(doc * len(phrases.lengths) + found)
            for i, k in zip((pairs // len(phrases.lengths)).tolist(), (pairs % len(phrases.lengths)).tolist(), strict=True):
                out_items[i].update(phrases.item[order[begin[k] : begin[k + 1]]].tolist())
        named = [sorted({phrases.names[j] for j in own} | set(had or ())) for own, had in zip(out_items, old[2].slice(low, high - low).to_pylist(), strict=True)]
        return out_spans, named, np.diff(bounds)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new_spans, new_items, counts = [], [], []
            old = [None, batch.column(spans), batch.column(items)]
            for low, high, data, offsets in words.chunks(batch.column(text), SHARD_BYTES):
                a, b, c = shard(batch.column(text), low, high, data, offsets, old)
                new_spans += a
                new_items += b
                counts.append(c)
            columns = list(batch.columns)
            columns[spans] = pa.array(new_spans, pa.list_(_SPAN))
            if cut:
                columns[text] = _without(columns[text], new_spans)
            columns[items] = pa.array(new_items, pa.list_(pa.string()))
            columns[items + 1] = pa.array(np.concatenate(counts) if counts else [], pa.int64())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return search


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", size: int = PHRASE, cut: bool = False) -> DataFrame:
    """docs with n_words, spans (merged stretches of test phrases, by word and by byte of the text) and items.

    A phrase is `size` consecutive words of an item, or all words of a shorter one. Words are runs of
    ASCII letters and digits (capitals folded) and of all other characters. items are the item ids, as
    strings, in order, without repeats; a null id is "". Null and empty texts, of documents or items, have no words. Rows with
    null or repeated keys are searched like any other. Columns of docs with these three names are
    replaced. With `cut`, the texts come without their spans. Without items, or without documents, nothing is found. Any number of items is searched,
    `BLOCK_BYTES` of them at a time.
    """
    docs = docs.drop("spans", "items", "n_words")
    scratch.text_batches(docs.sparkSession)
    whole = docs.withColumns({"spans": F.lit(None).cast(SPANS), "items": F.lit(None).cast("array<string>"), "n_words": F.lit(0).cast("long")})
    names = whole.columns
    given = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("text")).where(F.length("text") > 0)
    volume = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-volume // BLOCK_BYTES))
    for block in range(blocks):
        # one block of items, of about BLOCK_BYTES
        rows = given.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()
        phrases = Phrases.of([(row["item"], row["text"]) for row in rows], size)
        whole = whole.mapInArrow(words.frugal(_searched(names.index(text), names.index("spans"), names.index("items"), phrases, cut and block == blocks - 1)), whole.schema)
    return whole


def n_hit() -> F.Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda total, span: total + span["end_word"] - span["first_word"])


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test phrases in every document, with a check sum of the items."""
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit() > 0).alias("contaminated"),
    )


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
win AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM p))),
o AS (SELECT doc_id, i, p.n, item FROM win JOIN p ON p.n = win.n AND p.s = win.s),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM o) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM o) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""

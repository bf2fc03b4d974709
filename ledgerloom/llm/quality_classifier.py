"""Quality by a factorisation machine over hashed words, structure and metadata.

A text's features are its words, hashed into buckets and weighed by the root of their share, and some
statistics of its shape. Every pair of features interacts by the product of two low-rank vectors; the
sum over all pairs is half the square of the sum less the sum of squares, so a text is scored in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import words
from ledgerloom.llm.labelled import labelled, remainder

#: Labelled rows to learn from, at most about; word buckets (a power of two); rank of the interactions.
SAMPLE_ROWS, BUCKETS, RANK = 8_000, 1 << 12, 8
EPOCHS, BATCH, RATE, SHRINK = 12, 128, 0.08, 1e-4
SHAPE = ("words", "characters", "letters", "capitals", "digits", "symbols", "bars", "exclamations", "stutter", "distinct", "word_length", "lines", "same_lines", "n_chars")


@dataclass
class Machine:
    """Bias, weights and vectors of BUCKETS words and then of the shape's statistics; how these are scaled."""

    bias: float
    weights: np.ndarray
    vectors: np.ndarray
    centre: np.ndarray
    spread: np.ndarray


def _share(data: np.ndarray, offsets: np.ndarray, characters: bytes) -> np.ndarray:
    kind = np.zeros(256, bool)
    kind[list(characters)] = True
    total = np.concatenate([[0], np.cumsum(kind[data])])
    return np.diff(total[offsets])


def described(data: np.ndarray, offsets: np.ndarray, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of the words of a chunk, and its rows' shapes."""
    starts, ends, bounds = words.spans(data, offsets)
    found = words.hashes(data, starts, ends, True)
    row, count = words.rows_of(bounds), np.diff(bounds).astype(float)
    key, times = np.unique(row * BUCKETS + (found >> np.uint64(52)).astype(np.int64) % BUCKETS, return_counts=True)
    of = key // BUCKETS
    value = np.sqrt(times / np.maximum(count[of], 1))
    again = np.zeros(len(found) + 1, np.int64)
    if len(found) > 1:
        again[2:] = np.cumsum((found[1:] == found[:-1]) & (row[1:] == row[:-1]))
    most = np.maximum(count, 1)
    size = np.maximum(np.diff(offsets), 1)
    inside = np.concatenate([[0], np.cumsum(ends - starts)])
    line = np.ones(256, bool)
    line[10] = False
    line_starts, line_ends, lines = words.spans(data, offsets, line)
    line_keys = np.unique(np.stack([words.rows_of(lines).astype(np.uint64), words.hashes(data, line_starts, line_ends, False)]), axis=1)[0] if len(line_starts) else np.empty(0, np.uint64)
    n_lines = np.diff(lines)
    distinct_lines = np.bincount(line_keys.astype(np.int64), minlength=len(count))
    small, big = bytes(range(97, 123)), bytes(range(65, 91))
    shape = np.column_stack(
        [
            np.log1p(count),
            np.log1p(np.diff(offsets)),
            _share(data, offsets, small + big + bytes(range(128, 256))) / size,
            _share(data, offsets, big) / size,
            _share(data, offsets, b"0123456789") / size,
            np.minimum(_share(data, offsets, b"#*$%&<>@^~") / most, 2),
            np.minimum(_share(data, offsets, b"|") / most, 2),
            np.minimum(_share(data, offsets, b"!") / most, 2),
            np.diff(again[bounds]) / most,
            np.bincount(of, minlength=len(count)) / most,
            np.minimum(np.diff(inside[bounds]) / most, 40),
            np.log1p(n_lines),
            (n_lines - distinct_lines) / np.maximum(n_lines, 1),
            np.log1p(np.maximum(n_chars, 0)),
        ]
    )
    return of, key % BUCKETS, value, shape


def _n_chars(column: pa.Array) -> np.ndarray:
    return column.fill_null(0).to_numpy(zero_copy_only=False)


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        meta = _n_chars(batch.column(1))
        for low, high, data, offsets in words.chunks(batch.column(0)):
            row, bucket, value, shape = described(data, offsets, meta[low:high])
            edge = np.searchsorted(row, np.arange(high - low + 1))
            columns = [[x[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)] for x in (bucket.astype(np.uint16), value.astype(np.float32))]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.binary()) for c in columns], pa.array([x.tobytes() for x in shape], pa.binary()), batch.column(2).slice(low, high - low)], ["buckets", "numbers", "shape", "label"])


def train(rows: DataFrame, seed: int = 5) -> Machine:
    """A machine from (text, n_chars, label), by stochastic gradients of the logistic loss with adaptive steps."""
    got = rows.select("text", "n_chars", "label").mapInArrow(words.frugal(_examples), "buckets binary, numbers binary, shape binary, label int").toPandas()  # a bounded sample's hashed words
    rng = np.random.default_rng(seed)
    size = BUCKETS + len(SHAPE)
    machine = Machine(0.0, np.zeros(size), rng.normal(0, 0.02, (size, RANK)), np.zeros(len(SHAPE)), np.ones(len(SHAPE)))
    y = got["label"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        machine.bias = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        return machine
    got, y = (x[np.lexsort((got["shape"], got["numbers"], got["buckets"]))] if x is y else x.iloc[np.lexsort((got["shape"], got["numbers"], got["buckets"]))] for x in (got, y))
    shape = np.stack([np.frombuffer(x) for x in got["shape"]])
    machine.centre, machine.spread = shape.mean(0), np.maximum(shape.std(0), 1e-3)
    shape = np.clip((shape - machine.centre) / machine.spread, -4, 4)
    buckets = [np.frombuffer(x, np.uint16).astype(np.int64) for x in got["buckets"]]
    numbers = [np.frombuffer(x, np.float32) for x in got["numbers"]]
    squares_w, squares_v, square_b = np.full(size, 1e-2), np.full((size, RANK), 1e-2), 1e-2
    tail = np.arange(BUCKETS, size)
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for low in range(0, len(y), BATCH):
            mine = order[low : low + BATCH]
            column = np.concatenate([np.concatenate([buckets[i], tail]) for i in mine])
            value = np.concatenate([np.concatenate([numbers[i], shape[i] / 4]) for i in mine])
            lengths = np.array([len(buckets[i]) + len(tail) for i in mine])
            begin = np.cumsum(lengths) - lengths
            at = np.repeat(np.arange(len(mine)), lengths)
            z, sums = _sum(machine, column, value, begin)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[mine]) / len(mine)
            slope = error[at] * value
            used, back = np.unique(column, return_inverse=True)
            step_w = np.bincount(back, slope) + SHRINK * machine.weights[used]
            pull = slope[:, None] * (sums[at] - machine.vectors[column] * value[:, None])
            step_v = np.stack([np.bincount(back, pull[:, k]) for k in range(RANK)], 1) + SHRINK * machine.vectors[used]
            squares_w[used] += step_w**2
            squares_v[used] += step_v**2
            square_b += error.sum() ** 2
            machine.weights[used] -= RATE * step_w / np.sqrt(squares_w[used])
            machine.vectors[used] -= RATE * step_v / np.sqrt(squares_v[used])
            machine.bias -= RATE * error.sum() / np.sqrt(square_b)
    return machine


def _sum(machine: Machine, column: np.ndarray, value: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(score before the logistic function, sum of the vectors) of each row; every row has features."""
    pulled = machine.vectors[column] * value[:, None]
    sums = np.add.reduceat(pulled, begin)
    squares = np.add.reduceat(pulled**2, begin)
    return machine.bias + np.add.reduceat(machine.weights[column] * value, begin) + (sums**2 - squares).sum(1) / 2, sums


def _scored(machine: Machine):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = np.arange(BUCKETS, len(machine.weights))
        for batch in batches:
            meta, out = _n_chars(batch.column(2)), []
            for low, high, data, offsets in words.chunks(batch.column(1)):
                row, bucket, value, shape = described(data, offsets, meta[low:high])
                shape = np.clip((shape - machine.centre) / machine.spread, -4, 4) / 4
                n = high - low
                order = np.argsort(np.concatenate([row, np.repeat(np.arange(n), len(tail))]), kind="stable")
                column = np.concatenate([bucket, np.tile(tail, n)])[order]
                lengths = np.bincount(row, minlength=n) + len(tail)
                z, _ = _sum(machine, column, np.concatenate([value, shape.ravel()])[order], np.cumsum(lengths) - lengths)
                out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else [], pa.float64())], ["key", "score"])

    return score


def _with_metadata(docs: DataFrame) -> F.Column:
    return F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(0.0)


def quality(docs: DataFrame, machine: Machine, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score (0 to 1, higher: better) of every row, from the whole text and n_chars, if there is one.

    Null and empty texts have a shape of zeros and get its score; a null n_chars counts as 0. Rows with null
    or repeated keys are scored one by one; other columns are left out. An empty table gives an empty table.
    """
    kind = docs.schema[key].dataType.simpleString()
    given = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), _with_metadata(docs).alias("n_chars"))
    return given.mapInArrow(words.frugal(_scored(machine)), f"key {kind}, score double").withColumnRenamed("key", key)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; rows whose id has remainder 1 are held out."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held = remainder("doc_id", 3) == 1
    rows = labelled(docs.select("doc_id", F.struct("text", _with_metadata(docs).alias("n_chars")).alias("text")), labels, "quality", ~held, SAMPLE_ROWS)
    machine = train(rows.select("text.text", "text.n_chars", "label"))
    out = quality(docs, machine)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

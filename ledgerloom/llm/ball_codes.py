"""Vector codes by ball k-means: each part of a vector is replaced by its codebook's nearest entry.

An entry and the parts that it holds are a ball. Only entries whose half distance is within a ball's
radius are its neighbours; a part nearer to its entry than half the way to the nearest neighbour is in
the ball's stable core and needs no further distance; another one lies in a ring between two half
distances and is held against the neighbours up to that ring only. All of it is decided in whole
numbers, so the codes are those of comparing every part with every entry.

A round is one pass over a stored table (parts as packed integers, and their codes). Tasks send what
changed: sums and counts of the parts that moved, and radii, one row for each entry of each codebook.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm import scratch, words

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Labels of more rows than this share of the table get their sums by broadcast: there can be no more than 1 / SHARE such.
SHARE = 0.001
_FAR = np.iinfo(np.int64).max


@dataclass
class Codebooks:
    """entries[part, entry, position]; neighbours of each entry by distance, and a quarter of the squared distances, rounded up."""

    entries: np.ndarray
    order: np.ndarray
    quarter: np.ndarray

    @classmethod
    def of(cls, entries: np.ndarray, radius: np.ndarray | None = None) -> Codebooks:
        """radius[part, entry]: no part of that ball is farther from its entry; None: not known yet."""
        parts, size, _ = entries.shape
        square = ((entries[:, :, None, :] - entries[:, None, :, :]) ** 2).sum(-1)
        square[:, np.arange(size), np.arange(size)] = _FAR
        order = np.argsort(square, axis=-1, kind="stable")[:, :, : max(size - 1, 0)]
        gap = np.take_along_axis(square, order, -1)
        quarter = gap // 4 + (gap % 4 > 0)
        if radius is not None:
            quarter[quarter > radius[:, :, None] ** 2] = _FAR
        return cls(entries, order, quarter)

    def assign(self, parts: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, squared distances) of parts[row, part, position] that were in the balls `codes`."""
        best, least = codes.copy(), np.empty(codes.shape, np.int64)
        for p in range(parts.shape[1]):
            x, own = parts[:, p], codes[:, p]
            distance = ((x - self.entries[p][own]) ** 2).sum(1)
            index = own.copy()
            ring = np.zeros(len(own), np.int64)
            for entry in np.unique(own):
                inside = own == entry
                ring[inside] = np.searchsorted(self.quarter[p, entry], distance[inside], "right")
            for k in range(int(ring.max(initial=0))):
                rows = np.flatnonzero(ring > k)
                other = self.order[p, own[rows], k]
                there = ((x[rows] - self.entries[p][other]) ** 2).sum(1)
                nearer = (there < distance[rows]) | ((there == distance[rows]) & (other < index[rows]))
                rows = rows[nearer]
                distance[rows], index[rows] = there[nearer], other[nearer]
            best[:, p], least[:, p] = index, distance
        return best, least


def _parts(column: pa.Array, width: int, limit: int) -> np.ndarray:
    """Integers of a column of number lists, [row, part, position]; what a list lacks is 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.asarray(column.value_lengths(), np.int64)
    values = np.asarray(column.flatten(), np.float64)
    out = np.zeros((len(size), PARTS * width), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)] = np.clip(np.floor(values * SCALE), -limit, limit).astype(np.int64)
    return out.reshape(len(size), PARTS, width)


def _binary(values: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    values = np.ascontiguousarray(values)
    size = values.nbytes // len(values) if len(values) else 0
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer((np.arange(len(values) + 1) * size).astype(np.int32)), pa.py_buffer(values.tobytes())])


def _round(books: Codebooks, dtype: str, limit: int, first: bool, last: bool):
    """A task's work in one round: rows (id, label, parts, code), then its changes by entry. The last round gives codes and errors only."""
    count, size, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((count, size), np.int64)
        reach = np.full((count, size), -1, np.int64)
        total = np.zeros((count, size, width), np.int64)
        kinds: list[pa.DataType] = []
        for batch in batches:
            rows = batch.num_rows
            kinds = [batch.schema.field(k).type for k in (0, 1)]
            if not rows:
                continue
            if first:
                parts, old = _parts(batch.column(2), width, limit), np.zeros((rows, count), np.uint8)
            else:
                parts = words.buffer(batch.column(2))[0].view(dtype).reshape(rows, count, width).astype(np.int64)
                old = words.buffer(batch.column(3))[0].reshape(rows, count)
            new, distance = books.assign(parts, old)
            if last:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _binary(new), pa.array(distance.sum(1), pa.int64())], ["key", "label", "code", "error"])
                continue
            moved = np.ones(new.shape, bool) if first else new != old
            for p in range(count):
                at = np.flatnonzero(moved[:, p])
                np.add.at(n[p], new[at, p], 1)
                np.add.at(total[p], new[at, p], parts[at, p])
                if not first:
                    np.subtract.at(n[p], old[at, p], 1)
                    np.subtract.at(total[p], old[at, p], parts[at, p])
                np.maximum.at(reach[p], new[:, p], distance[:, p])
            empty = [pa.nulls(rows, t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _binary(parts.astype(dtype)), _binary(new), *empty], _ROUND)
        if kinds and not last:
            own = count * size
            flat = pa.ListArray.from_arrays(pa.array(np.arange(own + 1) * width, pa.int32()), pa.array(total.ravel()))
            nothing = [pa.nulls(own, t) for t in (*kinds, pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*nothing, pa.array(np.arange(own), pa.int32()), pa.array(n.ravel()), pa.array(reach.ravel()), flat], _ROUND)

    return run


_ROUND = ["key", "label", "parts", "code", "slot", "n", "reach", "total"]


def _usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


@dataclass
class Codes:
    """rows (key, label, code, error) of the kept vectors, and the codebooks, entries[part, entry, position]."""

    rows: DataFrame
    entries: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", entries: int = ENTRIES, rounds: int = ROUNDS) -> Codes:
    """Codes of all usable vectors: one byte for each of 8 equal parts, the index of its codebook's nearest entry.

    Vectors that are null or hold a null or non-finite component are left out. Components become
    floor(4096 * x). Codebooks start with the parts of the smallest keys (null keys last; rows of one key
    by their vectors); ties of distance go to the lower index. Vectors shorter than the longest one, or a
    length that 8 does not divide, are filled up with zeros. So that squared distances fit into 64 bits,
    components are limited to 2^30 divided by the root of the padded length (2^27 for 64 components, where
    |x| is 32768). Repeated rows and keys are rows of their own; other columns are left out. An empty table
    gives an empty table and empty codebooks.
    """
    clean = vectors.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector")).where(_usable(F.col("vector")))
    size, most = clean.agg(F.max(F.size("vector")), F.max(F.array_max(F.transform("vector", F.abs)))).first()
    width = -(-(size or 0) // PARTS)
    limit = isqrt(2**60 // max(PARTS * width, 1))
    dtype = "<i2" if (most or 0.0) * SCALE < 2**15 - 1 else "<i4"
    start = clean.orderBy(F.col("key").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    book = _parts(pa.array([r["vector"] for r in start], pa.list_(pa.float64())), width, limit).transpose(1, 0, 2).copy()
    kind = {f.name: f.dataType.simpleString() for f in clean.schema.fields}
    schema = f"key {kind['key']}, label {kind['label']}, parts binary, code binary, slot int, n long, reach long, total array<long>"
    rows, books = clean, Codebooks.of(book)
    counts, sums = np.zeros(book.shape[:2], object), np.zeros(book.shape, object)
    for k in range(rounds if start else 0):
        table = scratch.stored(rows.mapInArrow(words.frugal(_round(books, dtype, limit, k == 0, False)), schema), "codes")
        rows = table.where(F.col("slot").isNull()).select("key", "label", "parts", "code")
        change = table.where(F.col("slot").isNotNull()).groupBy("slot").agg(F.sum("n").alias("n"), F.max("reach").alias("reach"), *[F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)])
        reach = np.zeros(book.shape[:2], object)
        for row in change.collect():  # a row an entry
            p, e = divmod(row["slot"], book.shape[1])
            counts[p, e] += row["n"]
            sums[p, e] += np.array([int(row[f"s{i}"]) for i in range(width)], object)
            reach[p, e] = max(row["reach"], 0)
        after = books.entries.copy()
        for p, e in np.argwhere(counts > 0):
            after[p, e] = sums[p, e] // counts[p, e]
        shift = ((after - books.entries) ** 2).sum(-1)
        radius = np.array([[isqrt(int(r)) + isqrt(int(s)) + 2 for r, s in zip(*both, strict=True)] for both in zip(reach, shift, strict=True)], np.int64)
        stands = not shift.any()
        books = Codebooks.of(after, np.minimum(radius, 2**31))
        if stands:  # entries that stand still keep every part where it is
            break
    first = rows is clean
    out = rows.mapInArrow(words.frugal(_round(books, dtype, limit, first, True)), f"key {kind['key']}, label {kind['label']}, code binary, error long")
    return Codes(scratch.stored(out, "coded"), books.entries)


def with_label_error(rows: DataFrame, share: float = SHARE) -> DataFrame:
    """rows with label_error, the sum of error over equal labels (nulls together); null where it exceeds 64 bits.

    Labels of many rows, of which there are few, are broadcast; the others are joined on the label.
    """
    totals = scratch.stored(rows.groupBy("label").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("n")), "label-errors")
    bound = max(int(share * (totals.agg(F.sum("n")).first()[0] or 0)), 1)
    hot = totals.where(F.col("n") > bound).select(F.col("label").alias("l"), "label_error")
    rest = totals.where(F.col("n") <= bound).select(F.col("label").alias("l"), "label_error")
    same = F.col("label").eqNullSafe(F.col("l"))
    columns = [*rows.columns, "label_error"]
    some = rows.join(F.broadcast(hot), same).select(*columns)
    return some.unionAll(rows.join(F.broadcast(hot), same, "left_anti").join(rest, same).select(*columns))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes, errors and codebooks of all embeddings."""
    codes = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    out = with_label_error(codes.rows)
    return out.select(F.col("key").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codes.digest()).alias("codebooks_sha256"))


def _sql(rounds: int) -> str:
    floored = "(({0}) - ((({0}) % ({1})) + ({1})) % ({1})) // ({1})".format
    steps = [
        """kept AS MATERIALIZED (SELECT vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        """cells AS MATERIALIZED (SELECT vec_id, (i - 1) // (n // 8) AS part, (i - 1) % (n // 8) AS pos, floor(4096 * x::DOUBLE)::BIGINT AS q
  FROM (SELECT vec_id, len(embedding) AS n, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM kept))""",
        f"""book0 AS MATERIALIZED (SELECT part, entry, pos, q FROM cells
  JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {ENTRIES}) USING (vec_id))""",
    ]
    for k in range(rounds + 1):
        steps.append(f"""near{k} AS MATERIALIZED (SELECT vec_id, part, min(struct_pack(d := d, entry := entry)) AS best
  FROM (SELECT c.vec_id, c.part, b.entry, sum((c.q - b.q) * (c.q - b.q))::BIGINT AS d
    FROM cells c JOIN book{k} b ON c.part = b.part AND c.pos = b.pos GROUP BY ALL) GROUP BY ALL)""")
        if k < rounds:
            steps.append(f"""book{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.pos, coalesce({floored("s.total", "s.n")}, b.q) AS q FROM book{k} b
  LEFT JOIN (SELECT c.part, n.best.entry AS entry, c.pos, sum(c.q)::BIGINT AS total, count(*)::BIGINT AS n
    FROM cells c JOIN near{k} n ON c.vec_id = n.vec_id AND c.part = n.part GROUP BY ALL) s
  ON b.part = s.part AND b.entry = s.entry AND b.pos = s.pos)""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(q::VARCHAR, ',' ORDER BY part, entry, pos)) FROM book{rounds}) AS codebooks_sha256
FROM (SELECT vec_id, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM near{rounds} GROUP BY vec_id) JOIN kept USING (vec_id)"""


OP11_SQL = _sql(ROUNDS)

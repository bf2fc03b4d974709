"""Many small (document, number) pairs as few rows: what goes to one partition travels as one packet.

A packet holds the documents, how many numbers each has, and the numbers, as little-endian buffers.
A number of a few bytes then costs those bytes, not a row's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

COLUMNS = ["target", "kind", "docs", "sizes", "numbers"]
SCHEMA = "target int, kind int, docs binary, sizes binary, numbers binary"


def packed(target: np.ndarray, kind: int, docs: np.ndarray, numbers: np.ndarray) -> pa.RecordBatch:
    """One packet for each target; pairs keep their order within a document and target."""
    order = np.lexsort((docs, target))
    target, docs, numbers = target[order], docs[order], numbers[order]
    edge = np.flatnonzero(np.diff(target, prepend=-1) != 0)
    rows: list[tuple] = []
    for low, high in zip(edge.tolist(), [*edge[1:].tolist(), len(target)], strict=True):
        own = docs[low:high]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        rows.append((int(target[low]), own[first].tobytes(), np.diff(np.append(first, high - low)).astype(np.int32).tobytes(), numbers[low:high].tobytes()))
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([kind] * len(rows), pa.int32()), *[pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3)]],
        COLUMNS,
    )


def unpacked(rows: list[tuple[bytes, bytes, bytes]], dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """(documents, numbers), a pair at each place."""
    docs = np.frombuffer(b"".join(r[0] for r in rows), np.int64)
    sizes = np.frombuffer(b"".join(r[1] for r in rows), np.int32)
    return np.repeat(docs, sizes), np.frombuffer(b"".join(r[2] for r in rows), dtype)


def rows_of(batch: pa.RecordBatch, kind: int) -> list[tuple[bytes, bytes, bytes]]:
    names = batch.schema.names
    at = [names.index(name) for name in COLUMNS[1:]]
    kinds = batch.column(at[0]).to_pylist()
    return [tuple(batch.column(k)[i].as_py() for k in at[1:]) for i, own in enumerate(kinds) if own == kind]


def only(batch: pa.RecordBatch, kind: int) -> pa.RecordBatch:
    return batch.filter(pc.equal(batch.column(batch.schema.names.index("kind")), kind))

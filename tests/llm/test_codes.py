"""Vector codes against a plain version that compares every part with every entry, in Python's whole numbers."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import ball_codes

FOLDER = "/root/testdata/sf0.001"


def plain(rows, entries=16, rounds=6, limit=10**9):
    """([(id, code, error, label_error)], digest) of [(id, vector, label)] with vectors of one length."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = -(-max((len(r[1]) for r in rows), default=0) // 8)
    whole = [[max(-limit, min(limit, math.floor(4096 * x))) for x in r[1]] + [0] * (8 * width - len(r[1])) for r in rows]
    parts = [[v[p * width : (p + 1) * width] for p in range(8)] for v in whole]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:entries]
    book = [[list(parts[i][p]) for i in first] for p in range(8)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, entry, strict=True)), e) for e, entry in enumerate(book[p]))

    for _ in range(rounds):
        for p in range(8):
            held = defaultdict(list)
            for own in parts:
                held[nearest(p, own[p])[1]].append(own[p])
            for e, members in held.items():
                book[p][e] = [sum(column) // len(members) for column in zip(*members, strict=True)]
    found = [[nearest(p, own[p]) for p in range(8)] for own in parts]
    errors = [sum(d for d, _ in own) for own in found]
    by_label = defaultdict(int)
    for r, error in zip(rows, errors, strict=True):
        by_label[r[2]] += error
    digest = hashlib.sha256(",".join(str(x) for p in book for e in p for x in e).encode()).hexdigest()
    return [(r[0], "".join(f"{e:02x}" for _, e in own), error, by_label[r[2]]) for r, own, error in zip(rows, found, errors, strict=True)], digest


def coded(frame, **options):
    codes = ball_codes.compress(frame, **options)
    return [(r["key"], r["code"].hex(), r["error"], r["label_error"]) for r in ball_codes.with_label_error(codes.rows).collect()], codes.digest()


def ordered(rows):
    return sorted(rows, key=str)


def test_whole_table(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    want, digest = plain(rows)
    got = ball_codes.op11_vector_codes(spark, FOLDER).collect()
    assert ordered((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got) == ordered(want)
    assert {r["codebooks_sha256"] for r in got} == {digest}


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=16)], None if i % 3 == 0 else "a" if i % 3 == 1 else f"b{i}") for i in range(60)]
    rows += [(3, rows[3][1], "a"), (4, rows[5][1], None), (None, rows[6][1], "a"), (None, None, "a"), (70, None, None), (71, [None] + [0.0] * 15, "a")]
    rows += [(72, [nan] + [0.0] * 15, "a"), (73, [inf] * 16, None), (-1, [0.0] * 16, "a"), (-1, [0.0] * 16, "a"), (-2, [0.0] * 16, ""), (74, [1.0, -2.0, 3.5], "short"), (75, [], "none")]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, label string, code string, error string")
    want, digest = plain(rows)
    got, found = coded(frame)
    assert ordered(got) == ordered(want) and found == digest
    got, found = coded(frame.limit(0))
    assert got == [] and found == hashlib.sha256(b"").hexdigest()
    assert coded(frame.where("embedding is null"))[0] == []


def test_few_rows_and_large_components(spark):
    rows = [(1, [9e30, -9e30, 0.5], 1), (2, [0.1, 0.2, 0.3], 1), (3, [20_000.0, -20_000.0, 1e5], None)]
    frame = spark.createDataFrame(rows, "vec_id int, embedding array<float>, label int")
    want, digest = plain([(r["vec_id"], r["embedding"], r["label"]) for r in frame.collect()], limit=math.isqrt(2**60 // 8))
    got, found = coded(frame)
    assert ordered(got) == ordered(want) and found == digest


@pytest.mark.parametrize("share", [0.0, 1.0])
def test_label_errors_do_not_depend_on_what_is_hot(spark, share):
    rows = spark.createDataFrame([(i, None if i % 2 else i % 6, b"", i) for i in range(30)], "key int, label int, code binary, error long")
    got = {(r["label"], r["label_error"]) for r in ball_codes.with_label_error(rows, share).collect()}
    assert got == {(None, 225), (0, 60), (2, 70), (4, 80)}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(-6, 6), min_size=8, max_size=8), min_size=1, max_size=40), st.lists(st.lists(st.integers(-6, 6), min_size=8, max_size=8), min_size=1, max_size=9), st.data())
def test_rings_and_cores_lose_no_nearer_entry(rows, entries, data):
    """Any start, any valid radius: the codes are those of comparing with all entries, ties to the lower index."""
    parts, books = np.array(rows, np.int64)[:, None, :], np.array(entries, np.int64)[None]
    start = np.array(data.draw(st.lists(st.integers(0, len(entries) - 1), min_size=len(rows), max_size=len(rows))), np.uint8)[:, None]
    square = ((parts - books) ** 2).sum(-1)
    own = square[np.arange(len(rows)), start[:, 0]]
    radius = np.array([[math.isqrt(int(own[start[:, 0] == e].max(initial=0))) + 1 for e in range(len(entries))]], np.int64)
    for known in (None, radius):
        codes, least = ball_codes.Codebooks.of(books, known).assign(parts, start)
        assert codes[:, 0].tolist() == square.argmin(1).tolist() and least[:, 0].tolist() == square.min(1).tolist()

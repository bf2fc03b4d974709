import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import packing, scratch, token_counts, tokens, words

FOLDER = "/root/testdata/sf0.001"


def expected(texts):
    return [e.ids for e in tokens.library(tokens.vocabulary_path()).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text("aB '<|>endoftx\n\t\x1c ́é1!", max_size=60)), max_size=6))
def test_ids_are_the_librarys(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts] + ["x<|endoftext|>y <|EndOfText|> It's"]
    ids, bounds = tokens.encoder(tokens.vocabulary_path()).ids(*words.buffer(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == expected(texts)


def test_counts(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = token_counts.op10_token_counts(spark, FOLDER).collect()
    want = dict(zip(texts, map(len, expected(texts.values())), strict=True))
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == want
    assert all(r["n_bytes"] == len((texts[r["doc_id"]] or "").encode()) and r["over_limit"] == (r["n_tokens"] > 2048) for r in rows)


def test_cache_takes_only_misses(spark, odd_docs, no_docs):
    path = scratch.new_path(spark, "cache")
    first = token_counts.token_counts(odd_docs, path).collect()
    stored = spark.read.parquet(path).count()
    assert stored == len({" ".join((r["text"] or "").split()).lower() if "<|" not in (r["text"] or "") else r["text"] for r in first})
    again = token_counts.token_counts(odd_docs, path)
    assert sorted(map(str, again.collect())) == sorted(map(str, first)) and spark.read.parquet(path).count() == stored
    assert len(first) == odd_docs.count() and again.columns == [*[c for c in odd_docs.columns if c != "n_tokens"], "n_tokens"] or set(again.columns) == set(odd_docs.columns)
    assert [r["n_tokens"] for r in first] and {r["doc_id"]: r["n_tokens"] for r in first}[3] == 0
    assert token_counts.token_counts(no_docs, path).count() == 0


def check_packed(pieces, ids, window):
    """Every id in one piece; sequences gapless, full but for powers of two."""
    whole, sequences = {}, {}
    for p in pieces:
        whole.setdefault(p["doc_id"], []).append(p)
        sequences.setdefault(p["sequence_id"], []).append(p)
    for key, own in whole.items():
        own.sort(key=lambda p: p["start"])
        assert [p["start"] for p in own] == [0, *np.cumsum([p["length"] for p in own])[:-1]]
        assert b"".join(p["ids"] for p in own) == np.array(ids[key], "<u4").tobytes() and own[0]["doc_tokens"] == len(ids[key])
    assert set(whole) == set(ids)
    for own in sequences.values():
        own.sort(key=lambda p: p["offset"])
        sizes = [p["length"] for p in own]
        assert [p["offset"] for p in own] == [0, *np.cumsum(sizes)[:-1]]
        assert sum(sizes) == window or (sum(sizes) < window and sum(sizes).bit_count() == 1)


def test_packing_round_trip(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = {key: [*own, 2] for key, own in zip(texts, expected(texts.values()), strict=True)}
    for window in (256, 4096):
        check_packed([r.asDict() for r in packing.pack(docs, window=window).collect()], ids, window)
    for r in packing.op9_packing(spark, FOLDER).collect():
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes())


def test_packing_odd_rows(spark, odd_docs, no_docs):
    pieces = packing.pack(odd_docs).collect()
    assert sum(p["length"] for p in pieces) == sum(len(x) + 1 for x in expected([r["text"] for r in odd_docs.collect()]))
    assert packing.pack(no_docs).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), max_size=12))
def test_plan_places_every_rank_once(counts):
    histogram = np.zeros(65, np.int64)
    for length, n in counts.items():
        histogram[length] = n
    used, sequences = {}, {}
    for source, low, high, start, length, first, offset in packing.plan(histogram, 64):
        for k, rank in enumerate(range(low, high)):
            used.setdefault((source, rank), []).append((start, length))
            sequences.setdefault(first + k, []).append((offset, length))
    assert len(used) == histogram.sum()
    for (source, _), parts in used.items():
        parts.sort()
        assert [p[0] for p in parts] == [0, *np.cumsum([p[1] for p in parts])[:-1]] and sum(p[1] for p in parts) == source
    for parts in sequences.values():
        total = sum(p[1] for p in parts)
        assert total == 64 or total.bit_count() == 1


def test_least_squares_repeats_what_the_histogram_has():
    histogram = np.zeros(65)
    histogram[[40, 24, 32]] = [100, 100, 60]
    patterns = packing.combinations(histogram, 64)
    assert (40, 24) in patterns and (32, 32) in patterns
    found = dict(zip(patterns, packing.repeat_counts(histogram, patterns), strict=True))
    assert abs(found[40, 24] - 100) < 1 and abs(found[32, 32] - 30) < 1


def test_four_different_lengths_make_a_pattern():
    histogram = np.zeros(65, np.int64)
    histogram[[5, 9, 20, 30]] = 7  # only all four together fill a window
    assert packing.combinations(histogram, 64) == [(30, 20, 9, 5)]
    assert packing.repeat_counts(histogram.astype(float), [(30, 20, 9, 5)]).round(3).tolist() == [7.0]


def test_stored_counts_are_taken_by_the_query(spark, tmp_path):
    from ledgerloom.llm import token_counts, tokens

    cache, folder = str(tmp_path / "cache"), "/root/testdata/sf0.001"
    first = sorted(map(tuple, token_counts.op10_token_counts(spark, folder, cache).collect()))
    stored = token_counts.read_cache(spark, cache, tokens.version(tokens.vocabulary_path())).count()
    size = spark.read.parquet(cache).count()
    assert sorted(map(tuple, token_counts.op10_token_counts(spark, folder, cache).collect())) == first
    assert stored == size == spark.read.parquet(cache).count()

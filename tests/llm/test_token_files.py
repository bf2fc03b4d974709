"""Token files: ids against the library, round trips, and select against plain lists."""

import zlib

import numpy as np
import pyarrow as pa
from hypothesis import example, given, settings
from hypothesis import strategies as st

from ledgerloom.llm import scratch, token_files, tokens, words

FOLDER = "/root/testdata/sf0.001"
PATH = tokens.vocabulary_path(token_files.VOCABULARY)


def expected(texts):
    return [e.ids for e in tokens.library(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


ODD = "aB '\"<|endoftext|>\n\t\r\x0b\x0c\x1c\x1d\x1f\x85\xa0éÉ×÷—  　 ᠎﻿1²٣.,!-_你ʼ`{}~\x00"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.text(ODD, max_size=40), st.lists(st.sampled_from(["'s", "'LL", " x", "  ", "<|endoftext|>", "don't", "\xa0", "\n", ".", "É", "12", "　 "]), max_size=12).map("".join)), max_size=6))
@example(["abc\xa0\n word", "\xa0 \xa0 x", "x<|endoftext|>  y", "a<|endoftext", "it's 'sabc '", " \n", "x   y"])
def test_ids_are_the_librarys(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    ids, bounds = token_files.encoder(PATH).ids(*words.buffer(pa.array(texts, pa.string())))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == expected(texts)


def test_pieces_that_no_longer_fit_are_forgotten(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 20)
    own = token_files.Encoder(PATH)
    for k in range(30):
        texts = [f"word{k} of many, {k * 7} others {chr(97 + k % 26)} again"] * 2
        ids, bounds = own.ids(*words.buffer(pa.array(texts)))
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == expected(texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 40), st.integers(0, 2**64 - 1)), max_size=700), st.integers(0, 2**64 - 1))
@example([0] * 600, 0)
@example(list(range(2000)), 1999)
@example([2**64 - 1] * 300, 2**64 - 1)
def test_elias_fano(values, probe):
    values.sort()
    kept = token_files.EliasFano.of(np.array(values, np.uint64))
    raw = b"xyz" + kept.to_bytes() + b"rest"
    read, end = token_files.EliasFano.read(memoryview(raw), 3)
    assert end == len(raw) - 4 and read.values().tolist() == values
    assert [read.select(i) for i in range(len(values))] == values
    assert read.first_at_least(probe) == sum(v < probe for v in values)


def test_space_is_near_the_least():
    rng = np.random.default_rng(3)
    ends = np.cumsum(rng.integers(1, 800, 60_000))
    bits = 8 * len(token_files.EliasFano.of(ends).to_bytes()) / len(ends)
    assert bits < 2 + np.log2(ends[-1] / len(ends)) + 0.5  # the least is about log2 of the mean gap and 1.44


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1), st.integers(0, 5)), st.lists(st.integers(0, 65535), min_size=1, max_size=5)), min_size=1, max_size=40), st.integers(0, 5))
def test_block(docs, probe):
    docs.sort(key=lambda d: (d[0] is not None, d[0] or 0))
    keys, ids = [d[0] for d in docs], [i for d in docs for i in d[1]]
    block = token_files.Block(token_files.Block.pack(keys, [len(d[1]) for d in docs], np.array(ids, "<u2").tobytes(), 2))
    assert block.all_keys() == keys == [block.key(i) for i in range(len(docs))] and block.ids.tolist() == ids
    assert [block.ids[slice(*block.bounds(i))].tolist() for i in range(len(docs))] == [d[1] for d in docs]
    assert list(block.find(probe)) == [i for i, key in enumerate(keys) if key == probe]


def in_order(rows):
    """The documents by their places, which must be gapless."""
    rows = sorted(rows, key=lambda r: r["start"])
    assert [r["start"] for r in rows] == np.cumsum([0] + [r["n_tokens"] for r in rows]).tolist()[:-1]
    keys = [r["doc_id"] for r in rows]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    return rows


def test_whole_table(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    ids = {key: [*own, 0] for key, own in zip(texts, expected(texts.values()), strict=True)}
    rows = in_order(token_files.op12_token_files(spark, FOLDER).collect())
    assert [r["doc_id"] for r in rows] == sorted(ids)
    assert all(r["n_tokens"] == len(ids[r["doc_id"]]) and r["ids_crc32"] == zlib.crc32(np.array(ids[r["doc_id"]], "<u4")) for r in rows)


def test_odd_rows(spark, odd_docs, no_docs, monkeypatch):
    many = odd_docs.unionByName(odd_docs.sparkSession.range(3000).selectExpr("12 AS doc_id", "CASE WHEN id % 3 = 0 THEN 'same' ELSE 'row ' || id END AS text"), allowMissingColumns=True)
    many = many.unionByName(spark.createDataFrame([(13, "x" * 3_000_000 + " " + "many words, of one text " * 200_000), (-5, "below zero")], "doc_id long, text string"), allowMissingColumns=True)
    path = scratch.new_path(spark, "files")
    token_files.write_tokens(many, path)
    rows = in_order(token_files.read_tokens(spark, path).collect())
    texts = [(r["doc_id"], r["text"]) for r in many.collect()]
    want = [(key, (*own, 0)) for (key, _), own in zip(texts, expected([t for _, t in texts]), strict=True)]
    assert sorted(((r["doc_id"], tuple(r["ids"])) for r in rows), key=str) == sorted(want, key=str)
    empty = scratch.new_path(spark, "files")
    token_files.write_tokens(no_docs, empty)
    assert token_files.read_tokens(spark, empty).count() == 0 == token_files.read_check_sums(spark, empty).count()

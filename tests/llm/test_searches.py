import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import decontamination, jaccard_join, quality_rules, repeats
from ledgerloom.llm.components import components
from ledgerloom.llm.queries import ORACLES, QUERIES
from tests.llm import brute
from tools.compare import TABLES, bag

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    import duckdb

    df = QUERIES[name](spark, FOLDER)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    cur = con.execute(ORACLES[name])
    assert bag(df.columns, [tuple(r) for r in df.collect()]) == bag([d[0] for d in cur.description], cur.fetchall())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=30), min_size=1, max_size=5), st.lists(st.integers(1, 4), min_size=1, max_size=4))
def test_fm_index_finds_every_occurrence(runs, phrase):
    text = np.array([x for run in runs for x in [*run, 0]], np.int64)
    index = decontamination.FMIndex(text, 4)
    table = np.zeros((1, 6), np.int64)
    table[0, 6 - len(phrase) :] = phrase
    low, high = index.search(table, np.array([len(phrase)]))
    found = sorted(index.locate(np.arange(low[0], high[0])).tolist())
    assert found == [i for i in range(len(text)) if text[i : i + len(phrase)].tolist() == phrase]


ITEMS = [(1, "small birds look on from a tall old tree and more words here"), (2, "ÉTÉ ß"), (3, None), (4, ""), (None, "quick brown"), (5, "small birds look on from a tall old tree and more words here")]


def test_contamination_of_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    texts = [r["text"] for r in odd_docs.collect()]
    docs = odd_docs
    found = decontamination.contamination(docs, items)
    got = found.collect()
    for row, text in zip(sorted(got, key=lambda r: str((r["doc_id"], r["text"]))), sorted(zip([r["doc_id"] for r in docs.collect()], texts, strict=True), key=str), strict=True):
        n, hit, names = brute.contamination([text[1]], ITEMS)[0]
        assert (row["n_words"], sum(s["end_word"] - s["first_word"] for s in row["spans"]), row["items"]) == (n, len(hit), names)
    assert decontamination.contamination(no_docs, items).count() == 0
    assert {tuple(r["items"]) for r in decontamination.contamination(docs, items.limit(0)).collect()} == {()}
    cut = {r["doc_id"]: r["text"] for r in decontamination.contamination(docs, items, cut=True).collect()}
    assert cut[1] == "the  fox jumps over the lazy dog while nine small birds look on from a tall old tree" and cut[3] is None and cut[4] == ""


def test_many_items_in_blocks(spark, odd_docs, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    whole = sorted(map(str, decontamination.contamination(odd_docs, items).collect()))
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 40)
    assert sorted(map(str, decontamination.contamination(odd_docs, items).collect())) == whole


def test_repeats_of_odd_rows(spark, odd_docs, no_docs):
    named = {r["doc_id"]: r["text"] for r in odd_docs.collect() if r["doc_id"] is not None}
    want = brute.without_repeats(named.items())
    rows = repeats.without_repeats(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        if r["doc_id"] is None:
            assert r["n_removed"] == 0
        else:
            n, kept = want[r["doc_id"]]
            assert (r["n_words"], r["n_removed"], (r["text"] or "").split()) == (n, n - len(kept), kept)
    assert {r["doc_id"]: r["text"] for r in rows}[3] is None
    assert set(repeats.without_repeats(odd_docs).columns) == {*odd_docs.columns, "n_words", "n_removed"}
    assert repeats.without_repeats(no_docs).count() == 0


def test_repeats_through_another_document(spark):
    """A window shared with a later reference than the block's first one still goes."""
    a, b, c = [" ".join(f"{p}{i}" for i in range(30)) for p in "abc"]
    shared = " ".join(f"s{i}" for i in range(13))
    part = " ".join(f"s{i}" for i in range(7))
    docs = [(1, f"{a} {part} {a[::-1]}"), (2, f"{b} x {shared} y"), (3, f"q {shared} z {c}"), (4, f"{shared} {shared}")]
    want = brute.without_repeats(docs)
    for window in (13,):
        for r in repeats.without_repeats(spark.createDataFrame(docs, "doc_id long, text string"), window=window).collect():
            assert (r["text"] or "").split() == want[r["doc_id"]][1]


def test_jaccard_classes(spark, odd_docs, no_docs):
    rows = jaccard_join.linked(odd_docs).collect()
    want = brute.classes({r["doc_id"]: r["text"] for r in odd_docs.collect() if r["doc_id"] is not None}.items())
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert r["component_id"] == (None if r["doc_id"] is None else want[r["doc_id"]])
    assert {r["doc_id"]: r["n_shingles"] for r in rows}[3] == 0 and {r["doc_id"]: r["n_shingles"] for r in rows}[7] == 1
    assert jaccard_join.linked(no_docs).count() == 0


def test_jaccard_classes_of_documents(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    want = brute.classes(docs)
    rows = jaccard_join.op1_jaccard_join(spark, "/root/testdata/sf0.01").collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == want


def test_jaccard_at_the_threshold(spark):
    """Pairs that are just similar enough, and just not, over many sizes, with chains between them."""
    docs, key = [], 0
    for n in (5, 8, 11, 19, 40, 90, 300):
        base = [f"n{n}w{i}" for i in range(n)]
        for drop in range(0, max(1, n // 3), max(1, n // 12)):
            docs.append((key, " ".join(base[drop:])))
            docs.append((key + 1, " ".join(base[: n - drop] + [f"z{key}"])))
            key += 2
    rows = jaccard_join.linked(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == brute.classes(docs)


def test_second_round_links_what_hubs_do_not(spark, monkeypatch):
    """Many texts around one passage: signatures of the passage alone have a foreign hub."""
    passage = [f"p{i}" for i in range(40)]
    docs = [(i, " ".join([f"d{i // 2}x{j}" for j in range(30)] + passage + ([f"d{i}"] if i % 2 else []))) for i in range(60)]
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    rows = jaccard_join.linked(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == brute.classes(docs)


def test_band_plans_miss_nothing():
    """Differences and common shingles fall into the parts of one first-level partition at random; all but one part must stay whole, and hold something."""
    draw = np.random.default_rng(7)
    for band in range(2, 18):
        partitions, taken, times = jaccard_join.band_plan(band)
        largest, level = 2 ** (band + 1) - 1, jaccard_join.LEVEL
        differ = math.ceil(50 * largest / 175)
        inside = [1 / (level * partitions)] * level + [1 - 1 / partitions]
        hit = draw.multinomial(differ, inside, 200_000)[:, :level] > 0
        held = draw.multinomial(int(largest - differ / 2), inside, 200_000)[:, :level] > 0
        agree = np.mean([any(not hit[k][subset].any() and held[k][subset].any() for subset in ([0, 1], [0, 2], [1, 2])) for k in range(20_000)])
        assert (1 - agree) ** (taken * times) < 1e-9, band  # 1e-11 by the plan; the draw is off by a little


def test_pairs_at_the_threshold_share_a_signature():
    draw = np.random.default_rng(11)
    for n in (4, 7, 8, 15, 16, 40, 130, 300, 1100):
        for _ in range(40):
            swapped = (25 * n) // 175  # the most that may differ on either side
            base = draw.integers(1, 2**63, n + swapped, dtype=np.uint64)
            sets = [np.sort(base[:n]), np.sort(base[swapped:])]
            numbers, ids = jaccard_join.signatures(np.concatenate(sets), np.array([0, n, 2 * n]), np.array([1, 2]))
            assert set(numbers[ids == 1].tolist()) & set(numbers[ids == 2].tolist())


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(1, k) for k in range(2, 60)] + [(3, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{k: 1 for k in range(1, 60)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_quality_rules_on_odd_rows(spark, odd_docs, no_docs):
    rows = quality_rules.quality_rules(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[3]["n_words"] == by[4]["n_words"] == by[5]["n_words"] == 0 and by[3]["base_failed"] and not by[3]["kept"]
    assert by[1]["n_words"] == 20 and by[1]["kept"] and not by[9]["kept"]  # shouting
    assert quality_rules.quality_rules(no_docs).count() == 0


def test_rule_order_does_not_change_the_verdict(spark, odd_docs):
    rules = quality_rules.default_rules()
    a, b = (sorted(map(str, quality_rules.quality_rules(odd_docs, rules=r).collect())) for r in (rules, rules[::-1]))
    assert a == b


def test_the_check_sum_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")

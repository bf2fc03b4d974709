import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from ledgerloom.llm import clause_grammar, labelled, language_id, mixing, quality_classifier, scratch, toxicity, words
from ledgerloom.llm.queries import QUERIES
from tests.llm import brute

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def held_out(rows, truth):
    y = np.array([truth[r["doc_id"]] for r in rows if r["held_out"] and r["doc_id"] in truth])
    s = np.array([r["score"] for r in rows if r["held_out"] and r["doc_id"] in truth])
    order = np.argsort(np.argsort(s))
    ones = y.sum()
    area = (order[y == 1].sum() + ones - ones * (ones + 1) / 2) / max(1, ones * (len(y) - ones))
    return ((s >= 0.5) == y).mean(), area


@pytest.mark.parametrize(("name", "label", "modulus", "rest", "accuracy", "area"), [("op2_toxicity", "toxic", 5, 0, 0.9, 0.75), ("op4_quality_classifier", "quality", 3, 1, 0.95, 0.95)])
def test_held_out_accuracy(spark, name, label, modulus, rest, accuracy, area):
    rows = QUERIES[name](spark, MORE).collect()
    truth = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{MORE}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{MORE}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == rest) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    got = held_out(rows, truth)
    assert got[0] >= accuracy and got[1] >= area


@pytest.fixture(scope="module")
def odd_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (9, 0, 1), (8, 1, 0), (3, 0, None), (None, 1, 1), (2, 1, 0), (2, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")


def test_classifiers_take_odd_rows(spark, odd_docs, no_docs, odd_labels):
    from pyspark.sql import functions as F

    for docs in (odd_docs, no_docs):
        rows = labelled.labelled(docs, odd_labels, "toxic", F.lit(True), 100)
        scored = toxicity.toxicity(docs, toxicity.learn(rows)).collect()
        assert len(scored) == docs.count() and all(0 <= r["score"] <= 1 for r in scored)
        rows = labelled.labelled(docs, odd_labels, "quality", F.lit(True), 100).withColumn("n_chars", F.lit(1.0))
        scored = quality_classifier.quality(docs, quality_classifier.train(rows)).collect()
        assert len(scored) == docs.count() and all(0 <= r["score"] <= 1 for r in scored)


def test_clause_automaton():
    insult, target, negation, report = [(k, kind, 1.0) for k, kind in enumerate((clause_grammar.INSULT, clause_grammar.TARGET, clause_grammar.NEGATION, clause_grammar.REPORT))]
    plain = toxicity.clause_weight([insult])
    at = lambda place, x: (place, *x[1:])
    assert toxicity.clause_weight([at(0, target), at(2, insult)]) > plain
    assert toxicity.clause_weight([at(0, negation), at(2, insult)]) < plain
    assert toxicity.clause_weight([at(0, negation), at(9, insult)]) == plain
    assert toxicity.clause_weight([at(0, report), at(2, insult)]) < plain
    assert toxicity.clause_weight([at(0, insult), at(2, report)]) == toxicity.clause_weight([at(0, report), at(2, insult)])
    assert toxicity.clause_weight([(0, toxicity.THREAT, 1.0)]) == 0 < toxicity.clause_weight([(0, toxicity.THREAT, 1.0), at(1, target)])


def test_contractions_deny_in_raw_text():
    texts = ["you are an idiot", "you are not an idiot", "you aren't an idiot", "you aren\u2019t an idiot", "you AREN'T an idiot", "you arent an idiot", "you aren 't an idiot", "l'idiot", "l\u2019idiot", "idiot", "you aren'", "t idiot"]
    weight = toxicity.features(clause_grammar.lexicon(), pa.array(texts))[:, 1].tolist()
    stated, denied = weight[:2]
    assert denied < stated and weight[2:6] == [denied] * 4 and weight[6] == stated
    assert weight[7] == weight[8] == weight[9] == weight[11] > 0 == weight[10]


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    n = 6
    machine = quality_classifier.Machine(0.3, rng.normal(size=n), rng.normal(size=(n, 3)), np.zeros(1), np.ones(1))
    x = rng.normal(size=n)
    z, _ = quality_classifier._sum(machine, np.arange(n), x, np.array([0]))
    pairs = sum(machine.vectors[i] @ machine.vectors[j] * x[i] * x[j] for i in range(n) for j in range(i))
    assert math.isclose(z[0], 0.3 + machine.weights @ x + pairs)


def test_languages(spark, odd_docs, no_docs):
    docs = spark.read.parquet(f"{MORE}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    model = language_id.learn_text(docs)
    # without what is declared, half the rows from text and source alone
    found = language_id.identify(docs, model, docs["text"], language_id.F.lit(None), docs["source"], language_id.F.lit(None), language_id.F.lit(None)).collect()
    assert np.mean([r["language"] == truth[r["doc_id"]] for r in found]) > 0.97
    assert np.mean([r["accepted"] for r in found]) > 0.97
    odd = {r["doc_id"]: r for r in language_id.identify_documents(odd_docs, model).collect()}
    assert not odd[3]["accepted"] and not odd[4]["accepted"] and odd[5]["language"] == "und"
    assert language_id.identify_documents(no_docs, model).count() == 0
    pages = QUERIES["language_of_pages"](spark, MORE).collect()
    assert len(pages) == spark.read.parquet(f"{MORE}/pages.parquet").count() and np.mean([r["language"] == r["declared"] for r in pages]) > 0.97


def test_priors_and_declarations_decide_where_texts_do_not(spark):
    model = language_id.learn_text(spark.read.parquet(f"{MORE}/documents.parquet"))
    texts = {r["lang"]: r["text"] for r in spark.read.parquet(f"{MORE}/documents.parquet").where("length(text) > 300").collect()}
    rows = [(i, texts["fr"], "h1", "fr") for i in range(40)] + [(i, texts["de"], "h2", "de") for i in range(40, 80)] + [(90, "a", "h1", None), (91, "a", "h2", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, said string")
    c = language_id.F.col
    found = {r["doc_id"]: r["language"] for r in language_id.identify(docs, model, c("text"), c("said"), c("host"), c("host"), c("host")).collect()}
    assert (found[90], found[91]) == ("fr", "de")


def plainly(model, rows):
    """Languages by one row after the other: (text, declared, host) -> (language, posterior)."""
    names, width = [*model.languages, language_id.UND], len(model.languages) + 1
    batch = pa.RecordBatch.from_pydict({"text": pa.array([r[0] for r in rows], pa.string()), "rest": pa.array(range(len(rows)))})
    likely, letters = zip(*[(x["likelihood"], x["letters"]) for out in language_id._likely(model)(iter([batch])) for x in out.to_pylist()], strict=True)
    start = np.array([math.log((1 - language_id.UNKNOWN) / (width - 1))] * (width - 1) + [math.log(language_id.UNKNOWN)])
    softmax = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    shown = [softmax(np.array(x) + start) if n else np.zeros(width) for x, n in zip(likely, letters, strict=True)]
    keys = [(r[1] or "", r[2] or "") for r in rows]
    total = sum(shown)
    overall = (total + np.exp(start)) / (total.sum() + 1)
    prior = {}
    for host in {k[1] for k in keys}:
        seen = sum(x for x, k in zip(shown, keys, strict=True) if k[1] == host)
        prior[host] = overall
        for _ in range(3):  # suffix, domain and host are the same here
            prior[host] = (seen + language_id.STRENGTH * prior[host]) / (seen.sum() + language_id.STRENGTH)
    given = np.array([sum((x for x, k in zip(shown, keys, strict=True) if k[0] == name), np.zeros(width)) for name in [*names, ""]]) + language_id.UNSEEN
    said = np.log(given / given.sum(0))
    said[-1] = 0
    out = []
    for x, n, (declared, host) in zip(likely, letters, keys, strict=True):
        fused = softmax(np.array(x) + np.log(prior[host]) + said[[*names, ""].index(declared if declared in names else "")])
        out.append((names[int(fused.argmax())], fused.max()) if n else (language_id.UND, 0.0))
    return out


def test_languages_row_for_row_with_hot_and_empty_hosts(spark, monkeypatch):
    c = language_id.F.col
    learnt = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language_id.learn_text(learnt)
    # one host has most rows, many of them without text
    rows = [(r["text"], r["lang"] if i % 3 else None, "big" if i % 4 else f"h{i % 7}") for i, r in enumerate(learnt.collect())]
    rows += [("", "en", "big")] * 40 + [(None, None, "mute")] * 10 + [("a", None, "big"), ("b c", "fr", None)]
    want = plainly(model, rows)
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, said string, host string")
    docs = docs.withColumn("extra", language_id.F.create_map(language_id.F.lit("a"), c("doc_id")))
    for parts in (0, 4, 1000):
        monkeypatch.setattr(language_id, "PARTS", parts)
        got = sorted(language_id.identify(docs, model, c("text"), c("said"), c("host"), c("host"), c("host")).collect(), key=lambda r: r["doc_id"])
        assert [r["doc_id"] for r in got] == list(range(len(rows)))
        assert [r["language"] for r in got] == [w[0] for w in want]
        assert np.allclose([r["posterior"] for r in got], [w[1] for w in want], atol=1e-6)


def test_scores_and_base(spark):
    rows = QUERIES["op3_context_mixing"](spark, SMALL).collect()
    texts = {r["doc_id"]: [*brute.SPACED.findall((r["text"] or "").translate(brute.FOLD)), "\n"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    held = {key: zlib.crc32(str(key).encode()) % 5 == 1 for key in texts}
    count = Counter(w for key, own in texts.items() if not held[key] for w in own)
    total, distinct = sum(count.values()), len(count)
    assert len(rows) == len(texts)
    for r in rows:
        own = texts[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(own), sum(count[w] > 0 for w in own), total)
        assert math.isclose(r["base_score"], sum(math.log10((count[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in own), rel_tol=1e-9)
        assert r["score"] < 0 and r["bits_per_byte"] > 0


def test_mixing_is_a_distribution():
    """The costs of all continuations of a prefix add up to one: every byte has a code word and both bits share a decision."""
    rng = np.random.default_rng(1)
    code = mixing.Code(rng.integers(0, 1000, 256))
    counts = [rng.integers(0, 50, (1 << (18 - f), 2)).astype(np.int32) for f in mixing.FEWER]
    model = mixing.Model(code, np.zeros((mixing.BUCKETS, mixing.DIALECTS), np.float32), 18, [mixing.stretched(c) for c in counts], [mixing.met(c) for c in counts[2:]], [], np.empty(0))
    mixing.learn_weights(model, counts, ["some words to learn from", "and some more words"])
    total = 0.0
    for byte in (b for b in range(256) if b not in range(65, 91)):  # capitals are folded
        data = np.frombuffer(b"ab" + bytes([byte]), np.uint8)
        made = mixing.spelt(code, data, np.array([0]), np.array([3]), np.array([1]))
        cost = model.bit_costs(made)
        lengths = code.lengths[[ord("a"), ord("b"), byte, 32]]
        total += 2 ** cost[lengths[:2].sum() : lengths[:3].sum()].sum()
    capitals = 2.0 ** -30
    assert 0.5 < total < 1 + 1e-6 + capitals


def test_context_counts_pass_32_bits(monkeypatch):
    """Sums of tasks are whole beyond 32 bits, and a task sends its counts on before they are full."""
    import zstandard

    pack, unpack = zstandard.ZstdCompressor().compress, zstandard.ZstdDecompressor().decompress

    def total(batches):
        out = Counter()
        for batch in batches:
            for k, at, own in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                own = mixing._unpacked(own, unpack)
                for i in np.flatnonzero(own):
                    out[k, at + int(i)] += int(own[i])
        return out

    block = mixing._packed(np.array([2**31 - 1, 2**30]), pack)
    given = pa.RecordBatch.from_arrays([pa.array([0, 0, 0], pa.int32()), pa.array([0, 0, 0], pa.int64()), pa.array([block] * 3, pa.binary())], ["predictor", "at", "counts"])
    assert total(mixing._summed(iter([given]))) == {(0, 0): 3 * (2**31 - 1), (0, 1): 3 * 2**30}
    texts = [pa.RecordBatch.from_arrays([pa.array([f"one word and another {i}", "aaaa"])], ["text"]) for i in range(5)]
    tally = mixing._tallied(mixing.Code(np.ones(256, np.int64)), np.zeros((mixing.BUCKETS, mixing.DIALECTS), np.float32), 18)
    whole = list(tally(iter(texts)))
    monkeypatch.setattr(mixing, "FULL", 40)
    parts = list(tally(iter(texts)))
    assert len(parts) > len(whole) and total(parts) == total(whole)


def test_tables_grow_with_the_corpus():
    assert [mixing.table_bits(n) for n in (0, 1 << 20, 1 << 24, 1 << 25, 1 << 26)] == [18, 18, 20, 21, 22]


def test_order_of_words_counts(spark):
    """A text whose words follow one another as in the training texts is likelier than the same words shuffled."""
    rng = np.random.default_rng(3)
    vocabulary = ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(40)]
    texts = [" ".join(vocabulary[(start + i) % 40] for i in range(40)) for start in rng.integers(0, 40, 100)]
    shuffled = " ".join(rng.permutation(vocabulary).tolist())
    docs = spark.createDataFrame([*enumerate(texts), (1000, " ".join(vocabulary)), (1001, shuffled)], "doc_id long, text string")
    scores = {r["doc_id"]: r["score"] for r in mixing.score(docs, docs["doc_id"] < 1000).collect()}
    assert scores[1000] > 0.6 * scores[1001]


def test_own_words_become_cheaper():
    found = words.mix(np.array([1, 2, 1, 1, 3], np.uint64))
    cost = np.full(5, -10.0)
    once = mixing.document_costs(cost, found, np.array([0, 5]), 100.0)
    assert once[0] > mixing.document_costs(cost, words.mix(np.arange(5, dtype=np.uint64)), np.array([0, 5]), 100.0)[0]


def test_mixing_takes_odd_rows(spark, odd_docs, no_docs):
    from pyspark.sql import functions as F

    rows = mixing.score(odd_docs, F.col("source") == "a").collect()
    assert len(rows) == odd_docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[3]["n_tokens"] == by[4]["n_tokens"] == 1 and by[1]["n_tokens"] == 21
    assert mixing.score(no_docs, F.lit(True)).count() == 0
    nothing = mixing.score(odd_docs, F.lit(False)).collect()
    assert len(nothing) == odd_docs.count() and all(r["train_tokens"] == 0 and r["n_known"] == 0 for r in nothing)


def test_pipeline_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    # every document has a language here
    classes = brute.classes(docs)
    kept = [(key, text) for key, text in docs if classes[key] == key]
    cut = {key: own for key, own in brute.without_repeats(kept).items() if own[1] or not own[0]}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = scratch.stored(stage(spark, table, SMALL), name)
        assert new.columns == table.columns
        rows = {r["doc_id"]: r["text"] for r in new.collect()}
        if name == "near_duplicates":
            assert rows == dict(kept)
        elif name == "repeated_passages":
            assert {key: brute.SPACED.findall(text or "") for key, text in rows.items()} == {key: own[1] for key, own in cut.items()}
        elif name == "benchmark_passages":
            before = {r["doc_id"]: r["text"] for r in table.collect()}
            for key, (n, hit, _) in zip(before, brute.contamination(before.values(), items), strict=True):
                own = brute.ALNUM.findall((before[key] or "").translate(brute.FOLD))
                left = [w for i, w in enumerate(own) if i not in hit]
                assert (key in rows) == (bool(left) or not n)
                if key in rows:
                    assert brute.ALNUM.findall((rows[key] or "").translate(brute.FOLD)) == left
        else:
            assert rows == dict(docs)
        table = new
    packed = corpus_pipeline.run(spark, SMALL).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in table.select("doc_id").collect()}


def test_pipeline_stages_take_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SMALL)
            assert name == "packing" or out.columns == docs.columns
            assert out.count() <= docs.count() or name == "packing"


def test_chunks_and_spans():
    column = pa.array(["a b", None, "", " c", "dé"])
    data, offsets = words.buffer(column)
    starts, ends, bounds = words.spans(data, offsets)
    assert [bytes(data[s:e]).decode() for s, e in zip(starts, ends, strict=True)] == ["a", "b", "c", "dé"] and bounds.tolist() == [0, 2, 2, 2, 3, 4]
    assert [(low, high) for low, high, _, _ in words.chunks(column, 3)] == [(0, 3), (3, 4), (4, 5)]

"""The grammar of toxic clauses against a version that reads one word after the other."""

import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import clause_grammar as grammar
from ledgerloom.llm import labelled, toxicity, words
from ledgerloom.llm.queries import QUERIES
from tests.llm.brute import ALNUM, FOLD

MORE = "/root/testdata/sf0.01"
TEXTS = [
    "you piece of trash", "a piece of cake, trash", "he is a waste of space", "watch your back", "Watch. your back, you", "they will hunt down you",
    "'you idiot', he said", "he said: idiot", "he said. idiot", "no longer an idiot", "no longer quite such an idiot", "far from stupid", "far. from stupid",
    "by no means worthless", "anything but a clown", "piece of piece of trash", "according to you idiots, moron", "people like idiots", "d'après lui, idiot",
    "isn't trash", "isn’t trash", "isn '' t trash", "isnt trash", "waste of space waste of space", "kill; you", "kill you", "the kill", "", " ", None,
    "shut up, moron! no, you are not an idiot; never", "they are not not an idiot", "idiot\nsaid", "ta gueule vous", "IDIOT Said", "all of them idiots", "all of it idiots",
    "not " * 5 + "idiot", "you " * 5000 + "idiot", "no one two three idiot", "no one two idiot", "zzyx", "you zzyx", "zzyxes", "qqword", "qqwording you",
]


def key_of(word, size=None, tag=0):
    raw = np.frombuffer(word.encode()[:size], np.uint8)
    return int(words.hashes(raw, np.array([0]), np.array([len(raw)]), True)[0] & ~np.uint64(3)) | tag


def parsed(text):
    """[(word, whether an apostrophe alone parts it from the one before, clause)]"""
    text = (text or "").replace("’", "'").translate(FOLD)
    out, end, clause = [], 0, 0
    for m in ALNUM.finditer(text):
        clause += sum(c in ".!?;\n" for c in text[end : m.start()])
        out.append((m.group(), bool(out) and text[end : m.start()] == "'", clause))
        end = m.end()
    return out


PHRASES = [([(w, j) for w, j, _ in parsed(form)], kind) for kind, seeds in grammar.SEEDS.items() for own in seeds.split(", ") for form in (own, own.replace("'", ""))]


def plainly(text, learnt):
    """(clauses' weight, heaviest clause, clauses that match, words) of a text, word by word."""
    said, symbols, i = parsed(text), {}, 0
    single = {phrase[0][0]: kind for phrase, kind in PHRASES if len(phrase) == 1}
    while i < len(said):
        best = (0, None)
        for phrase, kind in PHRASES:
            n = len(phrase)
            if n > max(1, best[0]) and i + n <= len(said) and said[i + n - 1][2] == said[i][2]:
                if all(said[i + k][0] == w and (k == 0 or said[i + k][1] >= j) for k, (w, j) in enumerate(phrase)):
                    best = (n, (kind, 1.0))
        if not best[0]:
            word = said[i][0]
            found = learnt.get(key_of(word)) or ((single[word], 1.0) if word in single else None)
            for size in toxicity.STEMS:
                if len(word.encode()) > size:
                    stem = learnt.get(key_of(word, size, 1))
                    if stem and (found is None or stem[1] > found[1]):
                        found = stem
            best = (1, found)
        i += best[0]
        if best[1]:
            symbols.setdefault(said[i - 1][2], []).append((i - 1, *best[1]))
    total, heaviest, matching = 0.0, 0.0, 0
    for clause in symbols.values():
        aimed, told = (any(kind == k for _, kind, _ in clause) for k in (grammar.TARGET, grammar.REPORT))
        weight = 0.0
        for place, kind, own in clause:
            if kind == grammar.INSULT or (kind == grammar.THREAT and aimed):
                denied = any(k == grammar.NEGATION and 0 < place - p <= grammar.REACH for p, k, _ in clause)
                weight += own * (grammar.ADDRESSED if aimed else 1) * (grammar.DENIED if denied else 1) * (grammar.REPORTED if told else 1)
        total, heaviest, matching = total + weight, max(heaviest, weight), matching + (weight > 0)
    return [1.0, *(math.log1p(x) for x in (total, heaviest, matching, len(said)))]


LEARNT = {key_of("zzyx"): (grammar.THREAT, 2.0), key_of("zzyxe", 5, 1): (grammar.INSULT, 3.0), key_of("qqwo", 4, 1): (grammar.INSULT, 2.5), key_of("qqwor", 5, 1): (grammar.INSULT, 2.5), key_of("moron"): (grammar.INSULT, 4.0)}


@pytest.mark.parametrize("learnt", [{}, LEARNT], ids=["seeds", "learnt"])
def test_clauses_by_word(spark, learnt):
    texts = TEXTS + [r["text"] for r in spark.read.parquet(f"{MORE}/documents.parquet").limit(150).collect()]
    if learnt:  # seeds strewn over real texts
        seeds = [s for group in grammar.SEEDS.values() for s in group.split(", ")]
        for n, text in enumerate(texts[-60:]):
            said = (text or "").split(" ")
            texts.append(" ".join(w if (7 * n + 3 * k) % 5 else seeds[(11 * n + k) % len(seeds)] for k, w in enumerate(said[:400])))
    got = toxicity.features(grammar.lexicon(learnt), pa.array(texts, pa.string()))
    want = np.array([plainly(t, learnt) for t in texts])
    assert np.allclose(got, want, rtol=1e-12, atol=1e-12), [t for t, a, b in zip(texts, got, want, strict=True) if not np.allclose(a, b)][:3]
    assert (got[:, 1] > 0).sum() > 20


def test_phrases_negation_and_reports():
    weight = dict(zip(TEXTS, toxicity.features(grammar.lexicon(), pa.array(TEXTS))[:, 1], strict=True))
    assert weight["you piece of trash"] == weight["kill you"] > 0 == weight["watch your back"]  # one insult or threat; "your" is part of the phrase
    assert weight["by no means worthless"] < weight["he said: idiot"] < weight["he said. idiot"] == weight["idiot\nsaid"]
    assert weight["'you idiot', he said"] == weight["he said: idiot"] > weight["far from stupid"]
    assert weight["no one two idiot"] < weight["no one two three idiot"] and weight["kill; you"] == weight["the kill"] == 0


def test_composition_is_the_product():
    """Each state of the composed table stands for one of each part, and exactly one guess is accepted for any clause."""
    rng = np.random.default_rng(5)
    for n in range(1, 60):
        place, kind = np.cumsum(rng.integers(1, 6, n)), rng.integers(0, 6, n)
        step, _, final, skip = grammar.CLAUSE.padded
        ends = []
        for state in grammar.CLAUSE.starts:
            for k in range(n):
                state = step[skip[min(place[k] - place[k - 1] - 1, grammar.REACH + 1)][state] if k else state, kind[k]]
            ends.append(bool(final[state]))
        assert sum(ends) == 1


def test_long_texts():
    word = "x" * 10_000_000
    clause = "idiot not " * 200_000  # 2 MB in one clause
    got = toxicity.features(grammar.lexicon(), pa.array([word, clause, "idiot. " * 1_000_000 + "you", "idiot"]))
    assert got[0].tolist() == [1, 0, 0, 0, math.log1p(1)]
    assert math.isclose(got[1, 1], math.log1p(1 + 199_999 * grammar.DENIED)) and got[1, 3] == math.log1p(1)
    assert math.isclose(got[2, 1], math.log1p(1_000_000)) and math.isclose(got[2, 2], math.log1p(1)) and got[2, 3] == math.log1p(1_000_000)


def test_every_entry_that_passes_is_learnt(spark):
    """Lexicons of halves and of all rows as counted one row after the other; threats are words that tell only where somebody is addressed."""
    rows = [(f"blargh{i % 5} you stay", 1, i % 2) for i in range(60)] + [(f"quiet{i % 9} words stay. you go", 0, i % 2) for i in range(300)]
    rows += [("you fleem now", 1, i % 2) for i in range(20)] + [("a fleem. you go", 0, i % 2) for i in range(40)] + [(None, 0, 0), ("", 1, 1)]
    got = toxicity.learn_lexicons(spark.createDataFrame(rows, "text string, label int, half int"))
    for lexicon, halves in zip(got, [(0,), (1,), (0, 1)], strict=True):
        own = [(t, y) for t, y, h in rows if h in halves]
        sizes = [sum(y == k for _, y in own) for k in (0, 1)]
        counts = {}
        for text, y in own:
            said = parsed(text)
            aimed = {c for w, _, c in said if w in ("you",)}
            keys = {key_of(w) for w, _, _ in said} | {key_of(w, n, 1) for w, _, _ in said for n in toxicity.STEMS if len(w.encode()) > n} | {key_of(w, None, 2) for w, _, c in said if c in aimed}
            for key in keys:
                counts.setdefault(key, [0, 0])[y] += 1
        odds = lambda c, t: math.log((t + 0.5) / (sizes[1] + 1)) - math.log((c + 0.5) / (sizes[0] + 1)) - math.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
        passing = {k: odds(c, t) for k, (c, t) in counts.items() if t >= toxicity.SUPPORT and odds(c, t) >= toxicity.ODDS}
        want = grammar.lexicon(toxicity._entries(passing))
        assert lexicon.arcs.tolist() == want.arcs.tolist()
        at = lexicon.follow(lexicon.arcs)
        assert lexicon.kinds[at].tolist() == want.kinds[want.follow(want.arcs)].tolist() and np.allclose(lexicon.weights[at], want.weights[want.follow(want.arcs)])
    final = {k: (int(want.kinds[s]), float(want.weights[s])) for k, s in zip(want.arcs.tolist(), want.to.tolist(), strict=True)}
    assert final[key_of("fleem")][0] == grammar.THREAT and final[key_of("blargh", 6, 1)][0] == grammar.INSULT


def test_scores_by_row(spark):
    """The query's scores are the logistic function of the plain features, and toxic rows are found: never to say toxic would fail."""
    docs, labels = (spark.read.parquet(f"{MORE}/{t}.parquet") for t in ("documents", "labels"))
    rows = QUERIES["op2_toxicity"](spark, MORE).collect()
    model = toxicity.learn(labelled.labelled(docs, labels, "toxic", ~(labelled.remainder("doc_id", 5) == 0), toxicity.SAMPLE_ROWS))
    lexicon = model.lexicon
    learnt = {k: (int(lexicon.kinds[s]), float(lexicon.weights[s])) for k, s in zip(lexicon.arcs.tolist(), lexicon.to.tolist(), strict=True) if k & 3 < 2 and lexicon.kinds[s] != grammar.OTHER}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in rows[::7]:
        z = float(np.dot(plainly(texts[r["doc_id"]], learnt), model.coefficients))
        assert math.isclose(r["score"], 1 / (1 + math.exp(-z)), rel_tol=1e-9)
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    toxic = [r["predicted"] for r in rows if truth.get(r["doc_id"]) == 1 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    clean = [r["predicted"] for r in rows if truth.get(r["doc_id"]) == 0 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert toxic and sum(toxic) * 2 >= len(toxic) and sum(clean) * 20 <= len(clean)

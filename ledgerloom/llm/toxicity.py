"""Toxicity by a weighted finite-state grammar over clauses.

A lexicon transducer reads words as classes: insults (phrases, words and stems), threats, targets, negation
and reported speech; transducers for address, report and denial, composed into one, weigh what it matches
in each clause (`clause_grammar`). Insults are learnt from labelled rows, and threats too: words that tell
toxic rows only where their clause addresses somebody. The score is a logistic function of what the clauses
weigh, fitted to rows that the lexicon they are read with has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import clause_grammar, scratch, words
from ledgerloom.llm.clause_grammar import INSULT, TARGET, THREAT, Lexicon
from ledgerloom.llm.labelled import labelled, remainder

#: Labelled rows to learn from, at most about; bytes of a stem.
SAMPLE_ROWS = 20_000
STEMS = range(3, 11)
#: Toxic rows that an entry must have been seen in, and its least log odds, less one standard error.
SUPPORT, ODDS = 4, 2.5


@dataclass
class Grammar:
    """The lexicon and the score's coefficients."""

    lexicon: Lexicon
    coefficients: np.ndarray


def _aimed(seeds: Lexicon, text: clause_grammar.Text) -> np.ndarray:
    """The words in clauses with a target."""
    place, kind, _ = seeds.match(text, range(0))
    every = np.arange(len(text.keys))
    return every[np.isin(text.clause(every), text.clause(place[kind == TARGET]))]


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, rows with it by half and label) of a task's labelled texts; keys of words, stems, and words in addressed clauses."""
    seeds = clause_grammar.lexicon()
    for batch in batches:
        cell = 2 * batch.column(2).to_numpy(zero_copy_only=False) + batch.column(1).to_numpy(zero_copy_only=False)
        for low, _, data, offsets in words.chunks(batch.column(0)):
            text = clause_grammar.read(data, offsets)
            row = words.rows_of(text.bounds)
            stems, aimed = list(text.stems(STEMS)), _aimed(seeds, text)
            keys = np.concatenate([text.keys, *[k for _, k in stems], text.keys[aimed] | clause_grammar.AIMED])
            rows = np.concatenate([row, *[row[at] for at, _ in stems], row[aimed]])
            order = np.lexsort((rows, keys))
            keys, rows = keys[order], rows[order]
            first = np.ones(len(keys), bool)
            first[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
            keys, own = keys[first], cell[low + rows[first]]
            if not len(keys):
                continue
            begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            counts = [pa.array(np.add.reduceat((own == k).astype(np.int64), begin)) for k in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(keys[begin].view(np.int64)), *counts], ["key", *CELLS])


#: Rows by half and label.
CELLS = ["clean0", "toxic0", "clean1", "toxic1"]


def _odds(clean: Column, toxic: Column, all_clean: int, all_toxic: int) -> Column:
    """Log odds less one standard error, null for entries that do not pass."""
    odds = F.log((toxic + 0.5) / (all_toxic + 1)) - F.log((clean + 0.5) / (all_clean + 1)) - F.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
    return F.when((toxic >= SUPPORT) & (odds >= ODDS), odds)


def _entries(found: dict[int, float]) -> dict[int, tuple[int, float]]:
    """Class and weight of all that pass: words and stems are insults; words that pass only where somebody is addressed, threats."""
    out = {key: (INSULT, odds) for key, odds in found.items() if key & 3 != int(clause_grammar.AIMED)}
    for key, odds in found.items():
        if key & 3 == int(clause_grammar.AIMED):
            out.setdefault(key & ~3, (THREAT, odds))
    return out


def learn_lexicons(rows: DataFrame) -> list[Lexicon]:
    """Lexicons from (text, label, half): from rows of half 0, of half 1, and of both; one pass over the texts.

    Every entry that passes is taken. They come from a sample of bounded rows, each with SUPPORT toxic ones.
    """
    sizes = [0] * 4
    for r in rows.groupBy("half", "label").agg(F.count("*").alias("n")).collect():
        sizes[2 * r["half"] + r["label"]] = r["n"]
    seen = rows.select("text", "label", "half").mapInArrow(words.frugal(_seen), "key long, " + ", ".join(f"{c} long" for c in CELLS)).groupBy("key").agg(*[F.sum(c).alias(c) for c in CELLS])
    c = [F.col(x) for x in CELLS]
    cuts = [(c[0], c[1], sizes[0], sizes[1]), (c[2], c[3], sizes[2], sizes[3]), (c[0] + c[2], c[1] + c[3], sizes[0] + sizes[2], sizes[1] + sizes[3])]
    best = seen.select("key", *[_odds(*cut).alias(f"odds{k}") for k, cut in enumerate(cuts)]).where("coalesce(odds0, odds1, odds2) is not null")
    found = [(r["key"] % 2**64, r) for r in best.collect()]
    learnt = [{key: r[f"odds{k}"] for key, r in found if r[f"odds{k}"] is not None} if cut[2] and cut[3] else {} for k, cut in enumerate(cuts)]
    return [clause_grammar.lexicon(_entries(x)) for x in learnt]


def clause_weight(symbols: list[tuple[int, int, float]]) -> float:
    """The weight of a clause of (place, class, weight) from left to right."""
    place, kind, weight = (np.array(x) for x in zip(*symbols, strict=True))
    return float(clause_grammar.CLAUSE.weigh(np.array([0, len(place)]), place, kind, weight)[0])


def features(lexicon: Lexicon, column: pa.Array) -> np.ndarray:
    """For each text: 1, the weight of its clauses, that of the heaviest one, how many match, and its words, as logarithms."""
    out = np.zeros((len(column), 5))
    out[:, 0] = 1
    for low, high, data, offsets in words.chunks(column):
        text = clause_grammar.read(data, offsets)
        out[low:high, 4] = np.diff(text.bounds)
        place, kind, weight = lexicon.match(text, STEMS)
        if not len(place):
            continue
        clause = text.clause(place)
        begin = np.flatnonzero(np.concatenate([[True], clause[1:] != clause[:-1]]))
        # clauses without an insult or a threat weigh nothing
        heavy = np.repeat(np.logical_or.reduceat((kind == INSULT) | (kind == THREAT), begin), np.diff(np.append(begin, len(place))))
        place, kind, weight, clause = place[heavy], kind[heavy], weight[heavy], clause[heavy]
        if not len(place):
            continue
        begin = np.flatnonzero(np.concatenate([[True], clause[1:] != clause[:-1]]))
        total = clause_grammar.CLAUSE.weigh(np.append(begin, len(place)), place, kind, weight)
        row = low + np.searchsorted(text.bounds, place[begin], "right") - 1
        np.add.at(out[:, 1], row, total)
        np.maximum.at(out[:, 2], row, total)
        np.add.at(out[:, 3], row, total > 0)
    out[:, 1:] = np.log1p(out[:, 1:])
    return out


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Logistic regression by Newton steps; without both labels, the constant of their share."""
    b = np.zeros(x.shape[1])
    if not len(y):
        return b
    b[0] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    if y.min() == y.max():
        return b
    keep = np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        b = b + np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + keep, x.T @ (y - p) - keep @ b)
    return b


def _measured(lexicons: list[Lexicon]):
    """What each row is by the lexicon of the other half."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            half = batch.column(2).to_numpy(zero_copy_only=False)
            x = np.where((half == 0)[:, None], features(lexicons[1], batch.column(0)), features(lexicons[0], batch.column(0)))
            yield pa.RecordBatch.from_arrays([*[pa.array(x[:, k]) for k in (1, 2, 3, 4)], batch.column(1)], ["a", "b", "c", "d", "label"])

    return measure


def learn(rows: DataFrame) -> Grammar:
    """A grammar from (text, label, half): the lexicon from all rows, the coefficients from rows that each half's lexicon has not seen.

    The rows, a bounded sample, are stored once, as they are read for the lexicons and for the coefficients.
    """
    rows = scratch.stored(rows.select("text", "label", "half"), "labelled")
    first, second, both = learn_lexicons(rows)
    seen = rows.mapInArrow(words.frugal(_measured([first, second])), "a double, b double, c double, d double, label int").toPandas()  # four numbers a row of the bounded sample
    x = np.column_stack([np.ones(len(seen)), seen[["a", "b", "c", "d"]].to_numpy(float)])
    return Grammar(both, fit(x, seen["label"].to_numpy(float)))


def _scored(grammar: Grammar):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = np.clip(features(grammar.lexicon, batch.column(1)) @ grammar.coefficients, -30, 30)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-z)))], ["key", "score"])

    return score


def toxicity(docs: DataFrame, grammar: Grammar, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score (0 to 1, higher: more likely toxic) of every row, from the whole text alone.

    Null and empty texts match no clause and get the score of such a text. Rows with null or repeated keys
    are scored one by one; other columns are left out. An empty table gives an empty table.
    """
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(words.frugal(_scored(grammar)), f"key {kind}, score double").withColumnRenamed("key", key)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; rows whose id has remainder 0 are held out."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held = remainder("doc_id", 5) == 0
    grammar = learn(labelled(docs, labels, "toxic", ~held, SAMPLE_ROWS))
    out = toxicity(docs, grammar)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

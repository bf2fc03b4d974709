"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Counts that every document gets come first. The rules behind them are timed, and their rejections
counted, on a sample; the cascade then asks them in the order of rejections per second, and a document
that one rule rejects is not put to the others. The order decides the cost, never the verdict.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import scratch

WINDOW = 8
#: Rows of the sample, about; the sample decides the order of rules only.
SAMPLE_ROWS = 2000
_SPACE = r"[\x09-\x0D\x20]"


@dataclass(frozen=True)
class Rule:
    """reject: over the columns `text` (never null) and `words` and the counts of counted()."""

    name: str
    reject: Column


def default_rules() -> list[Rule]:
    letters = F.length("text") - F.length(F.regexp_replace("text", "[A-Za-z]", ""))
    capitals = F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    marks = F.length("text") - F.length(F.translate("text", "!", ""))
    pairs = F.size(F.filter("words", lambda word, i: (i > 0) & (F.get("words", i - 1) == word)))
    return [
        Rule("symbols", 10 * F.col("n_symbols") > F.col("n_words")),
        Rule("word_length", (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words"))),
        Rule("same_lines", 2 * F.col("n_dup_lines") > F.col("n_lines")),
        Rule("capitals", 2 * capitals > letters),
        Rule("exclamations", 2 * marks > F.col("n_words")),
        Rule("stutter", 5 * pairs > F.col("n_words")),
    ]


def counted(texts: DataFrame) -> DataFrame:
    """texts(text) with words and the counts. Each step stands in a projection of its own, so that none is computed twice."""
    n = F.size("words")
    out = texts.withColumn("text", F.coalesce("text", F.lit("")))
    out = out.withColumn("words", F.filter(F.split("text", _SPACE + "+"), lambda word: word != "")).withColumn("lines", F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x09-\x0D\x20]")))
    out = out.select(
        "*",
        n.cast("long").alias("n_words"),
        F.length(F.translate("text", "\t\n\x0b\x0c\r ", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda word: F.xxhash64(word)).alias("hashes"),
    ).drop("lines")
    window = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(WINDOW)]))
    out = out.withColumn("windows", F.when(n >= WINDOW, window)).drop("hashes")
    # windows that occur twice stand side by side once sorted; only texts that have some are sorted
    placed = F.sort_array(F.transform("windows", lambda window, i: F.struct(window.alias("window"), i.alias("place"))))
    out = out.withColumn("sorted", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), placed)).drop("windows")
    twice = F.filter("sorted", lambda x, i: (x["window"] == F.get("sorted", i - 1)["window"]) | (x["window"] == F.get("sorted", i + 1)["window"]))
    out = out.withColumn("places", F.sort_array(F.transform(twice, lambda x: x["place"]))).drop("sorted")
    covered = F.transform("places", lambda place, i: F.least(F.lit(WINDOW), F.coalesce(F.get("places", i + 1) - place, F.lit(WINDOW))))
    covered = F.aggregate(covered, F.lit(0).cast("long"), lambda total, x: total + x)
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("places")
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def ordered(texts: DataFrame, rules: list[Rule], rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per second on a sample of texts(text) of about so many rows; ties keep their order."""
    total = texts.count()
    if not total:
        return list(rules)
    # stored before it is filtered: a filter on counts would move below the steps that they are made in, and repeat them
    sample = scratch.stored(counted(texts.sample(min(1.0, rows / total), seed=7).repartition(1)), "rule-sample").where(~F.col("base_failed"))
    sample.agg(F.count("*")).collect()  # opens the files once, before anything is timed
    rates = []
    for rule in rules:
        begun = time.perf_counter()
        rejected = sample.agg(F.count_if(F.coalesce(rule.reject, F.lit(False)))).first()[0]
        rates.append(rejected / (time.perf_counter() - begun))
    return [rule for _, _, rule in sorted(zip([-rate for rate in rates], range(len(rules)), rules, strict=True), key=lambda x: x[:2])]


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept of every row.

    Words are runs of other characters than ASCII white space. n_repeat_words counts the words of 8-word
    windows that occur twice or more, the first included. kept is false where the base fails or a rule
    rejects. Null and empty texts have no words and fail. Rows with null or repeated keys count one by
    one; other columns are left out. An empty table gives an empty table.
    """
    texts = docs.select(F.col(text).alias("text"))
    cascade = F.lit(False)
    for rule in reversed(ordered(texts, default_rules() if rules is None else rules)):
        cascade = F.when(F.coalesce(rule.reject, F.lit(False)), F.lit(True)).otherwise(cascade)
    out = counted(docs.select(F.col(key).alias("key"), F.col(text).alias("text")))
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(~cascade)
    return out.select(F.col("key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS s FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
c AS (
  SELECT w.doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(rep.n, 0) AS n_repeat_words, len(regexp_extract_all(text, '[A-Za-z]')) AS letters, len(regexp_extract_all(text, '[A-Z]')) AS capitals,
         len(regexp_extract_all(text, '!')) AS marks, len(list_filter(range(2, len(words) + 1), lambda j: words[j] = words[j - 1])) AS pairs
  FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 2 * n_dup_lines > n_lines
            OR 2 * capitals > letters OR 2 * marks > n_words OR 5 * pairs > n_words) AS kept
FROM f
"""

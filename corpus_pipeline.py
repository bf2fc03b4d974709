"""The corpus pipeline: language, near duplicates, repeated passages, benchmark passages, packing.

Every stage takes what the one before it kept and returns it as it goes on; the last returns packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import scratch
from ledgerloom.llm.decontamination import contamination, n_hit
from ledgerloom.llm.jaccard_join import linked
from ledgerloom.llm.language_id import identify_documents, learn_text
from ledgerloom.llm.packing import digests, pack
from ledgerloom.llm.repeats import without_repeats


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: those with text in one of the languages of the corpus."""
    return identify_documents(docs, learn_text(docs)).where("accepted").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id. Rows without an id stay, and of rows with one id that stays, all."""
    dropped = linked(docs.select("doc_id", "text")).where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that repeat an earlier document; what has no words left goes, n_chars follows the text."""
    cut = without_repeats(docs)
    return _shortened(cut.where((F.col("n_words") > F.col("n_removed")) | (F.col("n_removed") == 0)), docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; what has no words left goes, n_chars follows the text."""
    cut = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), cut=True)
    return _shortened(cut.where((F.size("spans") == 0) | (n_hit() < F.col("n_words"))), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts in sequences of 4096 ids."""
    return digests(pack(docs))


def _shortened(cut: DataFrame, docs: DataFrame) -> DataFrame:
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("packing", packing),
]

#: The stages on likelihoods and on token ids have no SQL; tests/llm hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Labelled rows to learn from: a bounded sample, chosen by hash, joined to whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import scratch


def remainder(key: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def labelled(docs: DataFrame, labels: DataFrame, label: str, learns: Column, rows: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(text, label, half) of about `rows` rows that may be learnt from, or of all if they are fewer.

    learns: over the labels' key. The same rows come at every run; half (0 or 1) splits them at random.
    What is joined is no longer than the sample, so it may be sent to every task.
    """
    scratch.text_batches(docs.sparkSession)
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & learns).select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).distinct()
    total = known.count()
    draw = F.pmod(F.xxhash64("key", F.lit(11)), F.lit(1_000_000))
    if total > rows:
        known = known.where(draw < int(1_000_000 * rows / total))
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return texts.join(F.broadcast(known), "key").select("text", "label", F.pmod(F.xxhash64("key", F.lit(12)), F.lit(2)).cast("int").alias("half"))

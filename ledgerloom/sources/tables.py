"""Ledger files with a known dialect, and the union of the tables of one document."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

_SEPARATOR = {"csv": ",", "tsv": "\t"}


def read_ledger(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """``.csv`` or ``.tsv`` with a header. Without a schema all columns are text, which the
    ledger contract parses; no pass over the data is spent on guessing types."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix not in _SEPARATOR:
        raise ValueError(f"Formato de arquivo não suportado: .{suffix} (use .csv ou .tsv)")
    reader = spark.read.option("header", True).option("sep", _SEPARATOR[suffix])
    return (reader.schema(schema) if schema else reader).csv(path)


def read_texts(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """Extracted document texts, one row per file (``doc_id`` is the path)."""
    found = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True)
    return found.selectExpr("_metadata.file_path AS doc_id", "_metadata.file_name AS nome", "value AS texto")


def combine_tables(tables: Sequence[DataFrame]) -> DataFrame:
    """All rows of several tables; columns that a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)

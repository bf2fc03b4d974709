"""Structural cleaning of raw rows: keys, ``linha`` (row number) and text cells."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.text import clean_cell, strip
from ledgerloom.operators.columns import empty_columns, is_useless
from ledgerloom.operators.ranking import ranked


def is_blank_row(cells: Sequence[str]) -> Column:
    blank = [F.coalesce(strip(F.col(c).cast("string")) == "", F.lit(True)) for c in cells]
    return reduce(lambda a, b: a & b, blank)


def drop_blank_rows(df: DataFrame, cells: Sequence[str]) -> DataFrame:
    return df.filter(~is_blank_row(cells))


def drop_repeated_rows(df: DataFrame, by: Sequence[str], cells: Sequence[str]) -> DataFrame:
    """First row of each set of equal rows. Copies are combined before the shuffle, so any
    number of them costs one row per task."""
    return df.groupBy(*by, *cells).agg(F.min("linha").alias("linha"))


def clean_cells(df: DataFrame, cells: Sequence[str]) -> DataFrame:
    text = [c for c in cells if isinstance(df.schema[c].dataType, T.StringType)]
    return df.withColumns({c: clean_cell(F.col(c)) for c in text})


def removal_counts(df: DataFrame, by: Sequence[str], cells: Sequence[str]) -> DataFrame:
    """Per key: blank rows and repeated rows that cleaning takes away."""
    groups = df.groupBy(*by, *cells).agg(F.count(F.lit(1)).alias("_n"))
    blank = is_blank_row(cells)
    return groups.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(blank, F.col("_n"))), F.lit(0)).alias("linhas_vazias"),
        F.coalesce(F.sum(F.when(~blank, F.col("_n") - 1)), F.lit(0)).alias("duplicatas"),
    )


def column_counts(filled: DataFrame, by: Sequence[str], cells: Sequence[str]) -> DataFrame:
    """Per key: columns without any value, and the names of useless ones that have some. A column that
    other keys fill may be empty in one of them."""
    holds = {c: F.count(c) > 0 for c in cells}
    empty = reduce(lambda a, b: a + b, [F.when(holds[c], 0).otherwise(1) for c in cells], F.lit(0))
    useless = F.array_compact(F.array(*[F.when(holds[c], F.lit(c)) for c in cells if is_useless(c)])) if any(map(is_useless, cells)) else F.array()
    return filled.groupBy(*by).agg(empty.alias("colunas_vazias"), useless.cast("array<string>").alias("inuteis"))


def removal_warnings(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """The counts as warning sentences, one row each."""
    says = lambda c, text: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(text)))
    names = F.concat(F.lit("Colunas sem utilidade removidas: ['"), F.array_join("inuteis", "', '"), F.lit("']"))
    rows = [
        says("linhas_vazias", " linhas vazias removidas."),
        says("colunas_vazias", " colunas vazias removidas."),
        F.when(F.size("inuteis") > 0, names),
        says("duplicatas", " duplicatas removidas."),
    ]
    said = counts.select(*by, F.explode_outer(F.array_compact(F.array(*rows))).alias("mensagem"))
    return said.filter(F.col("mensagem").isNotNull())


@dataclass(frozen=True)
class Cleaned:
    linhas: DataFrame
    avisos: DataFrame


def clean(df: DataFrame, by: Sequence[str]) -> Cleaned:
    """Blank rows, empty and useless columns, repeated rows, then the cells, in this order."""
    by = list(by)
    cells = [c for c in df.columns if c not in by and c != "linha"]
    filled = drop_blank_rows(df, cells)
    empty = empty_columns(filled, cells)
    useless = [c for c in cells if c not in empty and is_useless(c)]
    kept = [c for c in cells if c not in empty and c not in useless]
    rows = drop_repeated_rows(filled.select(*by, "linha", *kept), by, kept)
    removed, columns = removal_counts(df.select(*by, *kept), by, kept), column_counts(filled, by, cells)
    warnings = removal_warnings(removed.join(columns, by, "left") if by else removed.crossJoin(columns), by)
    return Cleaned(clean_cells(rows, kept), warnings)


def renumber(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Dense row numbers 1..n per key, in the old order."""
    return ranked(df.withColumnRenamed("linha", "_linha"), by, [F.asc("_linha")], position="linha").drop("_linha")

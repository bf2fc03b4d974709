"""Writers. A large key is written by many tasks and a small one by few files."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def safe_name(text: str, fallback: str = "periodo") -> str:
    """Label as part of a file name."""
    return re.sub(r"[^\w\-]+", "_", text.strip()) or fallback


def safe_name_column(c):
    name = F.regexp_replace(F.trim(c.cast("string")), r"(?U)[^\w\-]+", "_")
    return F.when(name != "", name).otherwise(F.lit("periodo"))


#: Report lines of one file.
LINES_PER_FILE = 1_000_000


def _gathered(df: DataFrame, by: Sequence[str], *order) -> DataFrame:
    """Rows dealt by key with the sizes that the shuffle itself counts: adaptive execution splits a large key
    over several tasks and joins small ones. The input is evaluated once, nothing is sampled or stored."""
    keys = [F.col(k) for k in by]
    return df.hint("rebalance", *keys).sortWithinPartitions(*keys, *order)


def write_records(df: DataFrame, path: str, by: Sequence[str], mode: str = "errorifexists") -> None:
    """Parquet, one folder per key, so that later reads prune by key."""
    rest = [c for c in df.columns if c not in by][:1]
    _gathered(df, by, *[F.col(c) for c in rest]).write.mode(mode).partitionBy(*by).parquet(path)


def write_lines(lines: DataFrame, path: str, by: Sequence[str], mode: str = "errorifexists", lines_per_file: int = LINES_PER_FILE) -> None:
    """Report lines (``linha`` from 1, ``texto``) as UTF-8 text, one folder per key and one below it for each
    run of lines (``parte``). The files of a key, read in the order of their paths, are the report.

    The number of a line says which run it is in, so a long report is written by many tasks and nothing has to
    be counted or stored first.
    """
    part = F.lpad(F.floor((F.col("linha") - 1) / lines_per_file).cast("string"), 9, "0")
    named = lines.withColumns({**{k: safe_name_column(F.col(k)) for k in by}, "parte": part})
    keys = [F.col(k) for k in (*by, "parte")]
    laid = named.repartition(*keys).sortWithinPartitions(*keys, "linha")
    laid.select(*keys, F.col("texto").alias("value")).write.mode(mode).partitionBy(*by, "parte").text(path)


def write_json_lines(records: DataFrame, path: str, by: Sequence[str], mode: str = "errorifexists") -> None:
    """JSON records, one folder per key and section."""
    keys = [*by, "secao"]
    laid = _gathered(records, keys, F.col("json"))
    laid.select(*keys, F.col("json").alias("value")).write.mode(mode).partitionBy(*keys).text(path)

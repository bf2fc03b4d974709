"""Column names of uploaded tables."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import bind, strip, upper_key
from ledgerloom.vocab import COLUMN_ALIASES, USELESS_COLUMN_PATTERNS


def name_key(name: str) -> str:
    """Upper-case key of one column name, on the driver."""
    text = unicodedata.normalize("NFKD", " ".join(str(name).split()))
    return "".join(c for c in text if not unicodedata.combining(c)).upper()


def standard_name(name: str, aliases: Mapping[str, Sequence[str]] = COLUMN_ALIASES, legacy: bool = False) -> str:
    """Standard name whose alias is inside the name, in dictionary order, else snake case.

    Names that are standard already stay as they are; with ``legacy`` they too go through
    the aliases, where ``saldo_anterior`` meets ``saldo`` and becomes ``saldo_atual``.
    """
    if not legacy and name.strip().lower() in aliases:
        return name.strip().lower()
    key = name_key(name)
    for standard, words in aliases.items():
        if any(name_key(w) in key for w in words):
            return standard
    return key.lower().replace(" ", "_")


def standard_name_column(name: Column, aliases: Mapping[str, Sequence[str]] = COLUMN_ALIASES) -> Column:
    """The same for names that are data: the header cells of a file."""

    def by_alias(key: Column) -> Column:
        result = F
        for standard, words in aliases.items():
            result = result.when(key.rlike("|".join(re.escape(name_key(w)) for w in words)), F.lit(standard))
        return result.otherwise(F.replace(F.lower(key), F.lit(" "), F.lit("_")))

    own = F.lower(strip(name))
    return F.when(own.isin(*aliases), own).otherwise(bind(upper_key(name), by_alias))


def is_useless(name: str) -> bool:
    return any(re.search(p, name) for p in USELESS_COLUMN_PATTERNS)


def is_useless_column(name: Column) -> Column:
    return name.rlike("|".join(f"(?:{p})" for p in USELESS_COLUMN_PATTERNS))


def rename_by_alias(df: DataFrame, keep: Sequence[str] = (), legacy: bool = False) -> DataFrame:
    """Standard names for all columns but ``keep``; of equal names the first stays."""
    names = [c if c in keep else standard_name(c, legacy=legacy) for c in df.columns]
    first = [i for i, n in enumerate(names) if n not in names[:i]]
    positional = df.toDF(*[f"_{i}" for i in range(len(names))])
    return positional.select(*[F.col(f"_{i}").alias(names[i]) for i in first])


def drop_useless(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if is_useless(c)])


def empty_columns(df: DataFrame, cells: Sequence[str]) -> list[str]:
    """Columns without any value, from one counting pass."""
    counts = df.agg(*[F.count(c).alias(c) for c in cells]).first()
    return [c for c in cells if counts[c] == 0]

"""Display labels."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.dates import br_date
from ledgerloom.vocab import ABC_LABEL, NATURE_LABEL, NO_PERIOD_LABEL, SEVERITY_LABEL, SITUATION_LABEL


def label(c: Column, table: dict[str, str]) -> Column:
    result = F
    for key, text in table.items():
        result = result.when(c == key, F.lit(text))
    return result.otherwise(F.upper(c))


def nature_label(c: Column) -> Column:
    return label(c, NATURE_LABEL)


def abc_label(c: Column) -> Column:
    return label(c, ABC_LABEL)


def situation_label(c: Column) -> Column:
    return label(c, SITUATION_LABEL)


def severity_label(c: Column) -> Column:
    return label(c, SEVERITY_LABEL)


def period_label(start: Column, end: Column) -> Column:
    return F.when(
        start.isNotNull() & end.isNotNull(), F.concat(br_date(start), F.lit(" a "), br_date(end))
    ).otherwise(F.lit(NO_PERIOD_LABEL))


def liquidity_label(ratio: Column) -> Column:
    return F.when(ratio >= 1.5, "saudável").when(ratio >= 1, "apertada").when(ratio.isNotNull(), "crítica")


def supplier_status(previous: Column, current: Column) -> Column:
    return (
        F.when((previous == 0) & (current > 0), "Novo")
        .when((current == 0) & (previous > 0), "Descontinuado")
        .otherwise("Ativo")
    )


def fill(template: str, **values: Column) -> Column:
    """Text of a template whose ``{name}`` marks are replaced by columns."""
    parts = []
    for piece in re.split(r"(\{\w+\})", template):
        if piece.startswith("{") and piece[1:-1] in values:
            parts.append(values[piece[1:-1]].cast("string"))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)

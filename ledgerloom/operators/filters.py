"""Choosing, correcting and listing ledger rows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.money import MONEY
from ledgerloom.vocab import ENTRY_TYPES, STANDARD_CATEGORIES

EDITABLE = ("categoria", "tipo", "valor")
Choice = Iterable[str] | DataFrame | None


def choose(ledger: DataFrame, column: str, choice: Choice) -> DataFrame:
    """Rows whose column is among the choice: a short list, or a table of any size."""
    if choice is None:
        return ledger
    if isinstance(choice, DataFrame):
        return ledger.join(choice.select(column).distinct(), column, "left_semi")
    return ledger.filter(F.col(column).isin(*choice))


def filter_ledger(
    ledger: DataFrame, months: Choice = None, categories: Choice = None, suppliers: Choice = None
) -> DataFrame:
    """Current rows of the chosen months (``mes_ano``), categories and suppliers. Budget and
    history stay unfiltered."""
    return choose(choose(choose(ledger, "mes_ano", months), "categoria", categories), "fornecedor", suppliers)


def apply_corrections(ledger: DataFrame, fixes: DataFrame, key: Sequence[str]) -> DataFrame:
    """Overwrites category, type and value where ``fixes`` has a value for the row; all other
    columns are locked. A negative value or an unknown type is not taken."""
    value = F.col("f.valor").try_cast(MONEY) if "valor" in fixes.columns else F.lit(None)
    accepted = {
        "categoria": F.col("f.categoria") if "categoria" in fixes.columns else F.lit(None),
        "tipo": F.when(F.col("f.tipo").isin(*ENTRY_TYPES), F.col("f.tipo")) if "tipo" in fixes.columns else F.lit(None),
        "valor": F.when(value >= 0, value) if "valor" in fixes.columns else value,
    }
    rows, changes = ledger.alias("r"), fixes.alias("f")
    on = [F.col(f"r.{k}").eqNullSafe(F.col(f"f.{k}")) for k in key]
    out = [
        F.coalesce(accepted[c], F.col(f"r.{c}")).cast(ledger.schema[c].dataType).alias(c) if c in EDITABLE else F.col(f"r.{c}")
        for c in ledger.columns
    ]
    return rows.join(changes, on, "left").select(*out)


def filter_options(ledger: DataFrame, columns: Sequence[str] = ("mes_ano", "categoria", "fornecedor")) -> DataFrame:
    """Distinct values of each filter column, one row each, from one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("campo"), F.col(c).alias("valor")) for c in columns])
    return ledger.select(F.explode(pairs).alias("o")).select("o.*").distinct()


def category_options(ledger: DataFrame) -> DataFrame:
    """Categories in use and the standard ones."""
    standard = ledger.sparkSession.createDataFrame([(c,) for c in STANDARD_CATEGORIES], "categoria string")
    return ledger.select("categoria").union(standard).distinct()


__all__ = ["apply_corrections", "category_options", "choose", "filter_ledger", "filter_options"]

"""Ledger and budget contracts: normalise, check, split or refuse."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.dates import month_key, parse_entry_date
from ledgerloom.functions.money import as_money
from ledgerloom.functions.text import category_key, strip
from ledgerloom.vocab import BUDGET_REQUIRED, ENTRY_TYPES, LEDGER_REQUIRED

BAD_DATE = "DATA_INVALIDA"
BAD_VALUE = "VALOR_INVALIDO"
NEGATIVE = "VALOR_NEGATIVO"
BAD_TYPE = "TIPO_INVALIDO"
BAD_LIMIT = "LIMITE_INVALIDO"


class ContractError(ValueError):
    """The input does not follow the contract of the analysis. Where single values are at fault,
    ``valores`` is the table of them, lazy and whole."""

    def __init__(self, message: str, valores: DataFrame | None = None):
        super().__init__(message)
        self.valores = valores


def _is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def require_columns(df: DataFrame, required: Sequence[str], what: str) -> None:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ContractError(f"Colunas obrigatórias ausentes em {what}: {missing}; esperado {list(required)}.")


def _number(df: DataFrame, name: str) -> Column:
    c = F.col(name)
    return as_money(strip(c)) if _is_text(df, name) else as_money(c)


def _category(df: DataFrame, name: str = "categoria") -> Column:
    return category_key(F.col(name)) if _is_text(df, name) else F.lit("outros")


def _party(df: DataFrame, name: str) -> Column:
    return strip(F.coalesce(F.col(name).cast("string"), F.lit("nao informado")))


def check_ledger(df: DataFrame) -> DataFrame:
    """Normalised ledger rows with the codes of what is wrong in ``violacoes``. Lazy."""
    require_columns(df, LEDGER_REQUIRED, "lançamentos")
    date = parse_entry_date(F.col("data")) if _is_text(df, "data") else F.col("data").cast("date")
    if "tipo" in df.columns:
        kind = F.lower(strip(F.coalesce(F.col("tipo").cast("string"), F.lit("despesa"))))
    else:
        kind = F.lit("despesa")
    rewritten = {
        "categoria": _category(df),
        "data": date,
        "valor": _number(df, "valor"),
        "fornecedor": _party(df, "fornecedor"),
        "tipo": kind,
    }
    if "produto" in df.columns:
        rewritten["produto"] = _party(df, "produto")
    value = F.col("valor")
    problems = F.array_compact(
        F.array(
            F.when(F.col("data").isNull(), F.lit(BAD_DATE)),
            F.when(value.isNull(), F.lit(BAD_VALUE)).when(value < 0, F.lit(NEGATIVE)),
            F.when(~F.col("tipo").isin(*ENTRY_TYPES), F.lit(BAD_TYPE)),
        )
    )
    return df.withColumns(rewritten).withColumn("violacoes", problems)


def valid_rows(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("violacoes") == 0).drop("violacoes")


def rejected_rows(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("violacoes") > 0)


def violation_counts(checked: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    # the outer form: the plain one adds a filter on the array's size, which repeats the parsing
    return (
        checked.select(*by, F.explode_outer("violacoes").alias("violacao"))
        .where(F.col("violacao").isNotNull())
        .groupBy(*by, "violacao")
        .agg(F.count(F.lit(1)).alias("linhas"))
    )


def wrong_types(checked: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The words in ``tipo`` that are neither of the two, and how many rows have each."""
    bad = checked.filter(F.array_contains("violacoes", BAD_TYPE))
    return bad.groupBy(*by, "tipo").agg(F.count(F.lit(1)).alias("linhas"))


def validate_ledger(df: DataFrame, mode: str = "fail") -> DataFrame:
    """Normalised ledger. ``fail`` counts the violations in a pass of its own, before any work, and
    refuses the whole input; ``quarantine`` stays lazy and leaves the bad rows to :func:`rejected_rows`."""
    checked = check_ledger(df)
    if mode == "quarantine":
        return valid_rows(checked)
    has = lambda code: F.count_if(F.array_contains("violacoes", code)).alias(code)
    found = checked.agg(
        F.count(F.lit(1)).alias("linhas"), has(BAD_DATE), has(BAD_VALUE), has(NEGATIVE), has(BAD_TYPE)
    ).first()
    if found["linhas"] == 0:
        raise ContractError("Lançamentos vazios ou não informados.")
    if found[BAD_DATE]:
        raise ContractError(f"{found[BAD_DATE]} linha(s) com data inválida na coluna 'data'.")
    if found[BAD_VALUE]:
        raise ContractError(f"{found[BAD_VALUE]} linha(s) com valor não numérico na coluna 'valor'.")
    if found[NEGATIVE]:
        raise ContractError(f"{found[NEGATIVE]} linha(s) com valores negativos na coluna 'valor'.")
    if found[BAD_TYPE]:
        raise ContractError(
            f"{found[BAD_TYPE]} linha(s) com valor inválido na coluna 'tipo'; esperado um de {ENTRY_TYPES}.", wrong_types(checked)
        )
    return checked.drop("violacoes")


def validate_budget(df: DataFrame, by: Sequence[str] = (), mode: str = "fail") -> DataFrame:
    """Limit per category; a category written twice is added up."""
    require_columns(df, BUDGET_REQUIRED, "orçamento")
    rows = df.withColumns({"categoria": _category(df), "limite": _number(df, "limite")})
    if mode == "fail":
        found = rows.agg(
            F.count(F.lit(1)).alias("linhas"), F.count_if(F.col("limite").isNull()).alias("ruins")
        ).first()
        if found["linhas"] == 0:
            raise ContractError("Orçamento vazio ou não informado.")
        if found["ruins"]:
            raise ContractError("Coluna 'limite' do orçamento contém valores não numéricos.")
    return (
        rows.filter(F.col("limite").isNotNull())
        .groupBy(*by, "categoria")
        .agg(F.sum("limite").alias("limite"))
    )


def complete_ledger(df: DataFrame) -> DataFrame:
    """Rows as the review screen wants them: typed date, month key, default type."""
    require_columns(df, LEDGER_REQUIRED, "lançamentos")
    date = parse_entry_date(F.col("data")) if _is_text(df, "data") else F.col("data").cast("date")
    out = df.withColumn("data", date).withColumn("mes_ano", month_key(F.col("data")))
    return out if "tipo" in df.columns else out.withColumn("tipo", F.lit("despesa"))

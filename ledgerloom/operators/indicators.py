"""Balance indicators from account rows: keys, ``seq``, ``descricao``, ``saldo_atual``."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.labels import liquidity_label
from ledgerloom.functions.text import upper_collapsed
from ledgerloom.vocab import INDICATOR_TERMS


def _has_all(description: Column, terms: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [description.contains(t.upper()) for t in terms])


def first_balance(terms: Sequence[str], description: Column | None = None) -> Column:
    """Aggregate: balance of the first account whose description has all the terms."""
    text = upper_collapsed(F.col("descricao")) if description is None else description
    return F.min_by(F.col("saldo_atual"), F.when(_has_all(text, terms), F.col("seq")))


def account_balance(accounts: DataFrame, by: Sequence[str], *terms: str) -> DataFrame:
    """Balance of the first matching account per key, 0 where there is none."""
    return accounts.groupBy(*by).agg(F.coalesce(first_balance(terms), F.lit(0)).alias("saldo"))


def base_indicators(accounts: DataFrame, by: Sequence[str]) -> DataFrame:
    """The seven base figures in one aggregation; a zero falls to the next set of terms."""
    text = F.col("_texto")
    columns = []
    for name, choices in INDICATOR_TERMS.items():
        found = [F.nullif(first_balance(terms, text), F.lit(0)) for terms in choices]
        columns.append(F.coalesce(*found, F.lit(0)).cast("decimal(18,2)").alias(name))
    return accounts.withColumn("_texto", upper_collapsed(F.col("descricao"))).groupBy(*by).agg(*columns)


def derived_indicators(base: DataFrame) -> DataFrame:
    """Working capital, liquidity, debt, margin and cash share; null where the base is zero."""
    ratio = lambda a, b: F.when(F.col(b) != 0, F.col(a).cast("double") / F.col(b).cast("double"))
    current = ratio("ativo_circulante", "passivo_circulante")
    return base.withColumns(
        {
            "capital_de_giro": F.col("ativo_circulante") - F.col("passivo_circulante"),
            "liquidez_corrente": current,
            "grau_endividamento": ratio("passivo_circulante", "patrimonio_liquido") * 100,
            "margem_liquida": ratio("resultado_liquido", "receita_bruta") * 100,
            "participacao_caixa_no_ativo": ratio("caixa", "ativo_circulante") * 100,
            "rotulo_liquidez": liquidity_label(current),
        }
    )

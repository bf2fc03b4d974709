"""Advice on alerts: whom to talk to, what to do, what it may save."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.money import currency, signed
from ledgerloom.operators.results import alert_sort_key, expenses_only, severity_order
from ledgerloom.vocab import ACTION_PREFIX, ACTIONS


def top_supplier(ledger: DataFrame, by: Sequence[str]) -> DataFrame:
    """Supplier with the largest spend of each category; equal totals go by name."""
    rows = expenses_only(ledger) if "tipo" in ledger.columns else ledger
    totals = rows.groupBy(*by, "categoria", "fornecedor").agg(F.sum("valor").alias("total"))
    return totals.groupBy(*by, "categoria").agg(
        F.min_by("fornecedor", F.struct(-F.col("total"), F.col("fornecedor"))).alias("fornecedor_principal")
    )


def action_text(category: Column, level: Column) -> Column:
    prefix = F
    for s, text in ACTION_PREFIX.items():
        prefix = prefix.when(level == s, F.lit(text))
    actions = F
    for name, texts in ACTIONS.items():
        actions = actions.when(category == name, F.lit(" | ".join(texts)))
    return F.concat_ws(" | ", prefix, actions.otherwise(F.lit(" | ".join(ACTIONS["outros"]))))


def saving(current: Column, reference: Column) -> Column:
    return F.greatest(current - reference, F.lit(0).cast("decimal(28,2)"))


def recommendations(found: DataFrame, by: Sequence[str], ledger: DataFrame | None = None) -> DataFrame:
    """One line per alert: supplier, category, severity, action and estimated saving."""
    by = list(by)
    own = F.when(F.col("fornecedor") != "", F.col("fornecedor"))
    if ledger is None:
        rows = found
        supplier = F.coalesce(own, F.col("categoria"))
    else:
        rows = found.join(top_supplier(ledger, by), [*by, "categoria"], "left")
        supplier = F.coalesce(
            own, F.when(F.col("fornecedor_principal") != "", F.col("fornecedor_principal")), F.col("categoria")
        )
    return rows.select(
        *by,
        supplier.alias("fornecedor"),
        "categoria",
        "severidade",
        action_text(F.col("categoria"), F.col("severidade")).alias("acao_recomendada"),
        saving(F.col("valor_atual"), F.col("valor_referencia")).alias("economia_estimada"),
        severity_order(F.col("severidade")).alias("ordem_severidade"),
    )


def total_saving(advice: DataFrame, by: Sequence[str]) -> DataFrame:
    return advice.groupBy(*by).agg(F.sum("economia_estimada").alias("economia_total"))


def suggestions(found: DataFrame, by: Sequence[str]) -> DataFrame:
    """Report lines for grave alerts, the gravest one of each category."""
    row = F.struct(
        "ordem_severidade", "variacao_percentual", "ordem_base", "valor_atual", "valor_referencia"
    )
    order = F.struct(F.col("ordem_severidade"), -F.col("variacao_percentual"), F.col("ordem_base"))
    first = (
        found.filter(F.col("severidade").isin("alta", "critica"))
        .groupBy(*by, "categoria")
        .agg(F.min_by(row, order).alias("_a"))
        .select(*by, "categoria", "_a.*")
    )
    text = F.concat(
        F.lit("   - Rever contratos/fornecedores da categoria '"), F.col("categoria"), F.lit("': gasto "),
        signed(F.col("variacao_percentual"), 1), F.lit("% acima do esperado ("),
        currency(F.col("valor_atual")), F.lit(" vs "), currency(F.col("valor_referencia")), F.lit(")."),
    )
    return first.withColumn("texto", text)


__all__ = [
    "action_text", "alert_sort_key", "recommendations", "saving", "suggestions", "top_supplier", "total_saving",
]

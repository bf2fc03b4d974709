"""Profit and loss, variations, alerts and summary cards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.money import fixed, round_exact, signed
from ledgerloom.operators.ranking import ranked
from ledgerloom.vocab import ALERT_KIND, ALERT_PHRASE, DEFAULT_THRESHOLDS, SEVERITIES

BASES = ("orcamento", "historico")


def expenses_only(ledger: DataFrame) -> DataFrame:
    return ledger.filter(F.col("tipo") == "despesa")


def profit_and_loss(ledger: DataFrame, by: Sequence[str]) -> DataFrame:
    side = lambda kind: F.coalesce(F.sum(F.when(F.col("tipo") == kind, F.col("valor"))), F.lit(0))
    sums = ledger.groupBy(*by).agg(
        side("receita").alias("receita_total"), side("despesa").alias("despesa_total")
    )
    result = F.col("receita_total") - F.col("despesa_total")
    margin = result.cast("double") / F.col("receita_total").cast("double") * 100
    return sums.select(
        *by,
        "receita_total",
        "despesa_total",
        result.alias("resultado"),
        F.when(result > 0, "lucro").when(result < 0, "prejuizo").otherwise("equilibrio").alias("situacao"),
        F.when(F.col("receita_total") > 0, round_exact(margin)).alias("margem_percentual"),
    )


def spend_by_category(ledger: DataFrame, by: Sequence[str]) -> DataFrame:
    """Spend of the expense rows. Categories without expenses stay, with a null spend, so that
    the keys of the ledger survive a ledger that holds revenue only."""
    return ledger.groupBy(*by, "categoria").agg(
        F.sum(F.when(F.col("tipo") == "despesa", F.col("valor"))).alias("gasto")
    )


def variation_columns(current: Column, reference: Column) -> list[Column]:
    cur, ref = current.cast("double"), reference.cast("double")
    change = cur - ref
    percent = F.when(ref > 0, change / ref * 100).when(cur > 0, F.lit(100.0)).otherwise(F.lit(0.0))
    return [
        current.alias("valor_atual"),
        reference.alias("valor_referencia"),
        (current - reference).alias("variacao_absoluta"),
        round_exact(percent).alias("variacao_percentual"),
    ]


def variations(
    ledger: DataFrame, by: Sequence[str], budget: DataFrame | None = None, history: DataFrame | None = None
) -> DataFrame | None:
    """Spend against budget and against history, one row per key, category and base.

    ``budget`` holds one limit per key and category; ``history`` is a ledger whose key
    columns name the period it is the reference of. None when there is nothing to compare.
    """
    limits = None
    if budget is not None:
        limits = budget.select(*by, "categoria", F.col("limite").alias("gasto"))
    before = spend_by_category(history, by) if history is not None else None
    return compare_spend(spend_by_category(ledger, by), by, limits, before)


def compare_spend(
    spend: DataFrame, by: Sequence[str], limits: DataFrame | None = None, before: DataFrame | None = None
) -> DataFrame | None:
    """Variations from spend tables that are already totalled per key and category."""
    by = list(by)
    sides = [(base, side) for base, side in zip(BASES, (limits, before)) if side is not None]
    if not sides:
        return None
    own, given = F.col("gasto").alias("atual"), F.col("gasto").alias("referencia")
    none = F.lit(None).cast("decimal(28,2)")
    bases = F.explode(F.array(*[F.lit(base) for base, _ in sides])).alias("base_comparacao")
    rows = spend.select(*by, "categoria", bases, own, none.alias("referencia"), F.lit(True).alias("_do_atual"))
    for base, side in sides:
        rows = rows.unionAll(side.select(*by, "categoria", F.lit(base), none.alias("atual"), given, F.lit(False)))
    # one row per key, category and base; both sides must know the key. A key holds a row a category.
    key = Window.partitionBy(*by, "base_comparacao")
    for name in by:
        rows = rows.filter(F.col(name).isNotNull())
    both = rows.groupBy(*by, "categoria", "base_comparacao").agg(
        F.max("atual").alias("atual"), F.max("referencia").alias("referencia"),
        F.max("_do_atual").alias("_a"), F.min("_do_atual").alias("_r"),
    )
    if by:
        both = both.withColumns({"_a": F.max("_a").over(key), "_r": F.min("_r").over(key)}).filter(F.col("_a") & ~F.col("_r"))
    zero = F.lit(0).cast("decimal(28,2)")
    return both.filter(F.col("atual").isNotNull() | F.col("referencia").isNotNull()).select(
        *by,
        "categoria",
        *variation_columns(F.coalesce("atual", zero), F.coalesce("referencia", zero)),
        "base_comparacao",
    )


def base_order(c: Column) -> Column:
    return F.when(c == "orcamento", 0).otherwise(1)


def check_thresholds(thresholds: Mapping[str, float]) -> dict[str, float]:
    if set(thresholds) != set(SEVERITIES):
        raise ValueError(f"limiares deve conter exatamente as chaves {SEVERITIES}")
    values = [float(thresholds[s]) for s in SEVERITIES]
    if values != sorted(values):
        raise ValueError("limiares deve ser crescente: baixa, media, alta, critica")
    return dict(zip(SEVERITIES, values))


def severity(percent: Column, thresholds: Mapping[str, float] = DEFAULT_THRESHOLDS) -> Column:
    """Highest level whose threshold is reached; null below the lowest."""
    limits = check_thresholds(thresholds)
    result = F
    for level in reversed(SEVERITIES):
        result = result.when(percent >= limits[level], F.lit(level))
    return result


def severity_order(c: Column) -> Column:
    result = F
    for i, level in enumerate(reversed(SEVERITIES)):
        result = result.when(c == level, F.lit(i))
    return result


def alerts(changes: DataFrame, thresholds: Mapping[str, float] = DEFAULT_THRESHOLDS) -> DataFrame:
    """One alert per variation at or above the lowest threshold."""
    base = F.col("base_comparacao")
    is_budget = base == "orcamento"
    message = F.concat(
        F.lit("Categoria '"), F.col("categoria"), F.lit("' "),
        F.when(is_budget, ALERT_PHRASE["orcamento"]).otherwise(ALERT_PHRASE["historico"]),
        F.lit(": R$ "), fixed(F.col("valor_atual"), 2),
        F.lit(" vs R$ "), fixed(F.col("valor_referencia"), 2),
        F.lit(" ("), signed(F.col("variacao_percentual"), 1), F.lit("%)."),
    )
    return (
        changes.withColumn("severidade", severity(F.col("variacao_percentual"), thresholds))
        .filter(F.col("severidade").isNotNull())
        .withColumns(
            {
                "tipo": F.when(is_budget, ALERT_KIND["orcamento"]).otherwise(ALERT_KIND["historico"]),
                "mensagem": message,
                "fornecedor": F.lit(None).cast("string"),
                "ordem_severidade": severity_order(F.col("severidade")),
                "ordem_base": base_order(base),
            }
        )
    )


def alert_sort_key() -> list[Column]:
    return [
        F.asc("ordem_severidade"), F.desc("variacao_percentual"), F.asc("ordem_base"), F.asc("categoria"),
    ]


def ordered_alerts(found: DataFrame, by: Sequence[str]) -> DataFrame:
    """Alerts numbered from the gravest."""
    return ranked(found, by, alert_sort_key(), position="ordem")


def alert_table(found: DataFrame, by: Sequence[str]) -> DataFrame:
    return found.select(*by, "categoria", "severidade", "mensagem")


def biggest_increase(changes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Largest positive change; equal ones go to the budget base, then by category."""
    order = F.struct(-F.col("variacao_percentual"), base_order(F.col("base_comparacao")), F.col("categoria"))
    row = F.struct("categoria", "variacao_percentual", "valor_atual", "valor_referencia")
    return (
        changes.filter(F.col("variacao_percentual") > 0)
        .groupBy(*by)
        .agg(F.min_by(row, order).alias("maior_aumento"))
    )


def severity_counts(found: DataFrame, by: Sequence[str]) -> DataFrame:
    counts = [F.count_if(F.col("severidade") == s).alias(f"alertas_{s}") for s in SEVERITIES]
    return found.groupBy(*by).agg(F.count(F.lit(1)).alias("numero_alertas"), *counts)


def summary(
    ledger: DataFrame, by: Sequence[str], changes: DataFrame | None = None, found: DataFrame | None = None
) -> DataFrame:
    """Cards: total spend, rows, biggest increase and alerts per severity. The ledger may come
    summed, with the number of rows behind each of its own in ``quantidade``."""
    by = list(by)
    is_expense = F.col("tipo") == "despesa"
    many = F.count_if(is_expense)
    if "quantidade" in ledger.columns:
        many = F.coalesce(F.sum(F.when(is_expense, F.col("quantidade"))), F.lit(0))
    cards = ledger.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(is_expense, F.col("valor"))), F.lit(0)).alias("gasto_total"),
        many.alias("quantidade_lancamentos"),
    )
    names = ["numero_alertas", *[f"alertas_{s}" for s in SEVERITIES]]
    if changes is None or found is None:
        empty = "struct<categoria:string,variacao_percentual:double,valor_atual:decimal(28,2),valor_referencia:decimal(28,2)>"
        return cards.withColumns(
            {"maior_aumento": F.lit(None).cast(empty), **{n: F.lit(0).cast("bigint") for n in names}}
        )
    top, counts = biggest_increase(changes, by), severity_counts(found, by)
    if by:
        cards = cards.join(top, by, "left").join(counts, by, "left")
    else:  # one row on each side
        cards = cards.join(top, F.lit(True), "left").join(counts, F.lit(True), "left")
    return cards.withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in names})

"""Supplier ranking, ABC classes, concentration, categories and period comparison.

Supplier rows: key columns, ``seq``, ``nome``, ``saldo_anterior``, ``debito``, ``credito``,
``saldo_em_aberto``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.classify import supplier_category
from ledgerloom.functions.labels import supplier_status
from ledgerloom.functions.text import short_name, strip
from ledgerloom.operators.ranking import ranked, share_of, top_rows

MOVEMENT = "movimentacao_periodo"


def with_movement(suppliers: DataFrame) -> DataFrame:
    """Adds the period movement and the spend category."""
    return suppliers.withColumns(
        {MOVEMENT: F.col("debito") + F.col("credito"), "categoria": supplier_category(F.col("nome"))}
    )


def _order() -> list[Column]:
    return [F.desc(MOVEMENT), F.asc("seq")]


def abc_ranking(suppliers: DataFrame, by: Sequence[str]) -> DataFrame:
    """Position, share, cumulative share and ABC class of every supplier.

    The class limits are compared on exact sums, so no rounding moves a supplier across.
    """
    placed = ranked(
        with_movement(suppliers), by, _order(), position="ranking", running="_run", measure=MOVEMENT, total="_all"
    )
    reached = lambda limit: F.col("_run") * 100 <= F.col("_all") * limit
    return placed.withColumns(
        {
            "nome_curto": short_name(F.col("nome")),
            "percentual_do_total": share_of(F.col(MOVEMENT), F.col("_all")),
            "percentual_acumulado": share_of(F.col("_run"), F.col("_all")),
            "classe_abc": F.when(reached(80) | (F.col("ranking") == 1), "A").when(reached(95), "B").otherwise("C"),
        }
    ).drop("_run", "_all")


def supplier_totals(suppliers: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per key: suppliers, movement, open balance and the concentration index."""
    move = F.col(MOVEMENT).cast("decimal(18,2)")
    whole = F.sum(MOVEMENT)
    squares = F.sum((move * move).cast("decimal(38,4)"))
    index = squares.cast("double") / (whole.cast("double") * whole.cast("double")) * 10000
    return (
        with_movement(suppliers)
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("quantidade_fornecedores"),
            whole.alias("total_movimentado"),
            F.sum("saldo_em_aberto").alias("total_saldo_em_aberto"),
            F.when(whole != 0, index).otherwise(F.lit(0.0)).alias("indice_hhi"),
        )
    )


def concentration(suppliers: DataFrame, by: Sequence[str]) -> DataFrame:
    """Totals plus the largest supplier and the three largest together.

    Only three rows per key are kept before the shuffle; no full ranking is needed.
    """
    by = list(by)
    totals = supplier_totals(suppliers, by)
    moved = with_movement(suppliers).select(*by, "nome", MOVEMENT, "seq")
    leaders = (
        top_rows(moved, by, _order(), 3, "_p")
        .groupBy(*by)
        .agg(
            F.sum(MOVEMENT).alias("_top3"),
            F.max(F.when(F.col("_p") == 1, F.col(MOVEMENT))).alias("_top1"),
            F.max(F.when(F.col("_p") == 1, short_name(F.col("nome")))).alias("maior_fornecedor"),
            F.concat_ws(
                ", ",
                *[F.max(F.when(F.col("_p") == i, short_name(F.col("nome")))) for i in (1, 2, 3)],
            ).alias("tres_maiores"),
        )
    )
    joined = totals.join(leaders, by) if by else totals.crossJoin(leaders)
    whole = F.col("total_movimentado")
    return joined.withColumns(
        {
            "maior_fornecedor_percentual": share_of(F.col("_top1"), whole),
            "top_3_percentual": share_of(F.col("_top3"), whole),
        }
    ).drop("_top1", "_top3")


def category_summary(suppliers: DataFrame, by: Sequence[str]) -> DataFrame:
    """Movement, supplier count and share of each category (a fixed, short list per key)."""
    totals = with_movement(suppliers).groupBy(*by, "categoria").agg(
        F.sum(MOVEMENT).alias("total"), F.count(F.lit(1)).alias("quantidade_fornecedores")
    )
    whole = F.sum("total").over(Window.partitionBy(*by))
    return totals.withColumn("percentual_do_total", share_of(F.col("total"), whole))


def category_members(suppliers: DataFrame, by: Sequence[str]) -> DataFrame:
    """The suppliers behind each category, one row each, in any number."""
    return with_movement(suppliers).select(*by, "categoria", "nome", short_name(F.col("nome")).alias("nome_curto"), MOVEMENT, "seq")


def totals_rollup(suppliers: DataFrame, by: Sequence[str]) -> DataFrame:
    """Supplier table with a total row per key, and one over all keys."""
    sums = ["saldo_anterior", "debito", "credito", "saldo_em_aberto", MOVEMENT]
    return (
        with_movement(suppliers)
        .rollup(*by, "nome")
        .agg(*[F.sum(c).alias(c) for c in sums], F.grouping_id().alias("nivel"))
        .withColumn("nome", F.when(F.col("nivel") > 0, "TOTAL").otherwise(F.col("nome")))
    )


def last_two_periods(rows: DataFrame, company: str, period: str) -> DataFrame:
    """The latest period of each company and the one before it (``ordem`` 1 and 2)."""
    periods = rows.select(company, period).distinct()
    return top_rows(periods, [company], [F.desc(period)], 2, "ordem")


def _by_name(suppliers: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """One row per name. Of equal names the one lowest in the ranking counts."""
    lowest = F.struct(-F.col(MOVEMENT), F.col("seq"))
    return (
        with_movement(suppliers)
        .groupBy(*by, F.upper(strip(F.col("nome"))).alias("_nome"))
        .agg(F.max_by(F.struct("nome", "categoria", F.col(MOVEMENT).alias("valor")), lowest).alias(value))
    )


def _changes(both: DataFrame, by: Sequence[str]) -> DataFrame:
    """Change from ``_a`` to ``_b`` of each supplier; either may be null."""
    zero = F.lit(0).cast("decimal(28,2)")
    old, new = F.coalesce(F.col("_a.valor"), zero), F.coalesce(F.col("_b.valor"), zero)
    change = new - old
    return both.select(
        *by,
        F.coalesce("_b.nome", "_a.nome").alias("nome"),
        F.coalesce("_b.categoria", "_a.categoria").alias("categoria"),
        old.alias("valor_periodo_anterior"),
        new.alias("valor_periodo_atual"),
        change.alias("variacao_absoluta"),
        F.when(old != 0, change.cast("double") / old.cast("double") * 100).alias("variacao_percentual"),
        supplier_status(old, new).alias("situacao"),
    )


def compare_periods(previous: DataFrame, current: DataFrame, by: Sequence[str]) -> DataFrame:
    """Change of each supplier between two periods, new and ended ones included."""
    before, now = _by_name(previous, by, "_a"), _by_name(current, by, "_b")
    return _changes(before.join(now, [*by, "_nome"], "full_outer"), by)


def compare_latest(suppliers: DataFrame, company: str, period: str) -> DataFrame:
    """:func:`compare_periods` on the last two periods of every company.

    The rows are read once and summed by supplier and period, each map task for itself first, so a large
    company or supplier is no single task's. A supplier keeps its own last two periods: those of the
    company are among them wherever the supplier has any rows in these. What is joined is one row a supplier
    with one row a company.
    """
    values = _by_name(suppliers, [company, period], "_v")
    own = F.sort_array(F.collect_list(F.struct(F.col(period).alias("p"), F.col("_v").alias("v"))), asc=False)
    latest = values.groupBy(company, "_nome").agg(F.slice(own, 1, 2).alias("_p"))
    ends = latest.select(company, F.explode("_p.p").alias("p")).groupBy(company).agg(F.sort_array(F.collect_set("p"), asc=False).alias("_fim"))
    at = lambda k: F.get(F.filter("_p", lambda x: x["p"] == F.get(F.col("_fim"), F.lit(k))), F.lit(0))["v"]
    both = latest.join(ends, company).select(company, at(1).alias("_a"), at(0).alias("_b"))
    return _changes(both.filter(F.col("_a").isNotNull() | F.col("_b").isNotNull()), [company])


def changed_only(changes: DataFrame) -> DataFrame:
    return changes.filter(F.col("variacao_absoluta") != 0)

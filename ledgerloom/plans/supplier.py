"""Supplier analysis of every document or company-period at once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import bind, has_any, upper_collapsed
from ledgerloom.operators import suppliers as s
from ledgerloom.operators.headers import supplier_header
from ledgerloom.operators.indicators import base_indicators, derived_indicators
from ledgerloom.operators.layouts import item_rows, money, supplier_accounts
from ledgerloom.operators.rules import Facts, advise
from ledgerloom.vocab import SECTION_END_WORDS, SECTION_WORD


@dataclass(frozen=True)
class SupplierAnalysis:
    by: list[str]
    fornecedores: DataFrame
    contas: DataFrame
    indicadores: DataFrame
    concentracao: DataFrame
    categorias: DataFrame
    recomendacoes: DataFrame

    @property
    def ranking(self) -> DataFrame:
        """Ranking with ABC classes. Reading this lays the rows out in order, which runs a job."""
        return s.abc_ranking(self.fornecedores, self.by)


def supplier_analysis(
    accounts: DataFrame, suppliers: DataFrame, by: Sequence[str] = ("doc_id",), changes: DataFrame | None = None
) -> SupplierAnalysis:
    """Indicators from the accounts, concentration and categories from the suppliers, advice
    from both; ``changes`` (see ``compare_periods``) adds the advice on period changes."""
    by = list(by)
    indicators = derived_indicators(base_indicators(accounts, by))
    shares = s.concentration(suppliers, by)
    categories = s.category_summary(suppliers, by)
    facts = Facts(
        documents=None,
        concentration=shares,
        categories=categories,
        members=s.category_members(suppliers, by),
        indicators=indicators,
        changes=changes,
    )
    return SupplierAnalysis(by, suppliers, accounts, indicators, shares, categories, advise(facts, by))


def read_supplier_documents(docs: DataFrame) -> DataFrame:
    """Supplier-report text to one row per document: header, ``contas`` and ``fornecedores``."""
    text = F.col("texto")
    read = bind(
        supplier_accounts(text),
        lambda accounts: F.struct(accounts.alias("contas"), supplier_section(accounts).alias("fornecedores")),
    )
    return docs.withColumns({**supplier_header(text), "_lido": read}).select("*", "_lido.*").drop("_lido")


def supplier_section(accounts: Column) -> Column:
    """Accounts below the last supplier heading, up to the next group of the chart.

    Any account with the heading word counts as a heading, also a supplier of that name.
    """
    places = lambda names, test: F.transform(names, lambda n, i: F.when(test(n, i), i))
    is_heading = lambda n: n.contains(SECTION_WORD)

    def below(names: Column, heading: Column) -> Column:
        stop = F.array_min(places(names, lambda n, i: (i > heading) & has_any(n, SECTION_END_WORDS)))
        return bind(
            F.coalesce(stop, F.size(names)),
            lambda end: F.filter(
                accounts, lambda c, i: (i > heading) & (i < end) & ~is_heading(F.get(names, i))
            ),
        )

    return bind(
        F.transform(accounts, lambda c: upper_collapsed(c["descricao"])),
        lambda names: bind(
            F.array_max(places(names, lambda n, i: is_heading(n))),
            lambda heading: F.when(heading.isNotNull(), below(names, heading)).otherwise(F.slice(accounts, 1, 0)),
        ),
    )


def account_rows(documents: DataFrame, by: Sequence[str]) -> DataFrame:
    rows = item_rows(documents, by, F.col("contas")).select(*by, "c.*")
    return rows.withColumns({a: money(F.col(a)) for a in ("saldo_anterior", "debito", "credito", "saldo_atual")})


def supplier_rows(documents: DataFrame, by: Sequence[str]) -> DataFrame:
    c = F.col("c")
    return item_rows(documents, by, F.col("fornecedores")).select(
        *by,
        c["seq"].alias("seq"),
        c["codigo"].alias("codigo"),
        c["descricao"].alias("nome"),
        money(c["saldo_anterior"]).alias("saldo_anterior"),
        money(c["debito"]).alias("debito"),
        money(c["credito"]).alias("credito"),
        money(c["saldo_atual"]).alias("saldo_em_aberto"),
    )

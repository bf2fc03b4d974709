"""Supplier analytics: ranking, concentration, categories, indicators, advice, comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import labels
from ledgerloom.operators import indicators as ind
from ledgerloom.operators import rules
from ledgerloom.operators import suppliers as s
from ledgerloom.operators.ranking import top_rows
from registry.inputs import documents, supplier_ledger
from ledgerloom.plans.supplier import account_rows, read_supplier_documents, supplier_analysis, supplier_rows
from ledgerloom.session import ensure_checkpoint_dir
from registry.common import BY, LEDGER, plain
from registry.docs_sql import SUPPLIERS

DOC = ["doc_id"]


def _stored_ledger(spark, folder):
    """The ledger summed by supplier, read once and stored."""
    ensure_checkpoint_dir(spark)
    return supplier_ledger(spark, folder).checkpoint()


def supplier_abc(spark, folder):
    found = s.abc_ranking(supplier_ledger(spark, folder), BY)
    return plain(
        found, *BY, "ranking", "nome", "nome_curto", "categoria", "movimentacao_periodo", "percentual_do_total",
        "percentual_acumulado", "classe_abc",
    )


def supplier_totals(spark, folder):
    return plain(s.supplier_totals(supplier_ledger(spark, folder), BY))


def supplier_concentration(spark, folder):
    return plain(s.concentration(_stored_ledger(spark, folder), BY))


def category_summary(spark, folder):
    return plain(s.category_summary(supplier_ledger(spark, folder), BY))


def category_members(spark, folder):
    return plain(s.category_members(supplier_ledger(spark, folder), BY).drop("seq"))


def totals_rollup(spark, folder):
    return plain(s.totals_rollup(supplier_ledger(spark, folder), BY))


def last_two_periods(spark, folder):
    return s.last_two_periods(supplier_ledger(spark, folder), "empresa", "periodo")


def supplier_period_change(spark, folder):
    return plain(s.compare_latest(_stored_ledger(spark, folder), "empresa", "periodo"))


def chart_top_suppliers(spark, folder):
    moved = s.with_movement(supplier_ledger(spark, folder))
    top = top_rows(moved, BY, [F.desc("movimentacao_periodo"), F.asc("seq")], 10)
    return plain(top, *BY, "posicao", "nome", "movimentacao_periodo")


def chart_changes(spark, folder):
    """Ten largest rises of each company, unchanged suppliers left out."""
    changed = s.changed_only(s.compare_latest(supplier_ledger(spark, folder), "empresa", "periodo"))
    top = top_rows(changed, ["empresa"], [F.desc("variacao_absoluta"), F.asc("nome")], 10)
    return plain(top, "empresa", "posicao", "nome", "variacao_absoluta")


def chart_categories(spark, folder):
    from ledgerloom.functions.money import currency_round, fixed

    found = s.category_summary(supplier_ledger(spark, folder), BY)
    text = F.concat(F.col("categoria"), F.lit(" ("), fixed(F.col("percentual_do_total"), 1), F.lit("%)"))
    return plain(found.select(*BY, text.alias("rotulo"), "total", currency_round(F.col("total")).alias("valor")))


def period_advice(spark, folder):
    """Advice on new, risen and fallen suppliers of every company."""
    changes = s.compare_latest(supplier_ledger(spark, folder), "empresa", "periodo")
    facts = rules.Facts(None, None, None, None, None, changes)
    return rules.period_changes(facts, ["empresa"]).select("empresa", "titulo", "descricao", "prioridade", "regra")


_LEDGER_RULES = (
    rules.single_supplier, rules.top_three, rules.high_index, rules.few_suppliers, rules.dominant_category,
    rules.merge_category, rules.no_suppliers, rules.good_practice,
)


def _ledger_facts(spark, folder):
    """What the rules look at, by company and year: the ledger is summed by supplier once and stored."""
    rows = _stored_ledger(spark, folder)
    return rules.Facts(
        documents=rows.select(*BY).distinct(), concentration=s.concentration(rows, BY),
        categories=s.category_summary(rows, BY), members=s.category_members(rows, BY), indicators=None,
    )


def ledger_advice(spark, folder):
    """Concentration and category advice of every company and year."""
    advice = rules.advise(_ledger_facts(spark, folder), BY, _LEDGER_RULES)
    return advice.select(*BY, "titulo", "descricao", "prioridade", "categoria", "regra")


def advice_names(spark, folder):
    """The suppliers behind the advice to merge a category."""
    return rules.merge_names(_ledger_facts(spark, folder), BY)


def advice_order(spark, folder):
    """The advice of every company and year in reading order."""
    advice = rules.ordered_advice(rules.advise(_ledger_facts(spark, folder), BY, _LEDGER_RULES), BY)
    return advice.select(*BY, "titulo", "regra", "ordem")


def _read(spark, folder):
    """Accounts and suppliers of the documents as stored tables, parsed once."""
    ensure_checkpoint_dir(spark)
    read = read_supplier_documents(documents(spark, folder)).select("doc_id", "contas", "fornecedores").checkpoint()
    return account_rows(read, DOC), supplier_rows(read, DOC)


def supplier_header(spark, folder):
    read = read_supplier_documents(documents(spark, folder))
    period = labels.period_label(F.col("periodo_inicio"), F.col("periodo_fim"))
    return plain(read.select("doc_id", "nome", "cnpj", "periodo_inicio", "periodo_fim", period.alias("periodo")))


def supplier_lines(spark, folder):
    rows = account_rows(read_supplier_documents(documents(spark, folder)), DOC)
    return plain(rows, "doc_id", "seq", "codigo", "descricao", "saldo_anterior", "debito", "credito", "saldo_atual", "natureza")


def supplier_section(spark, folder):
    return plain(supplier_rows(read_supplier_documents(documents(spark, folder)), DOC))


def account_lookup(spark, folder):
    rows = account_rows(read_supplier_documents(documents(spark, folder)), DOC)
    return plain(ind.account_balance(rows, DOC, "CAIXA", "GERAL"))


def indicators(spark, folder):
    rows = account_rows(read_supplier_documents(documents(spark, folder)), DOC)
    return plain(ind.base_indicators(rows, DOC))


def indicators_derived(spark, folder):
    rows = account_rows(read_supplier_documents(documents(spark, folder)), DOC)
    found = ind.derived_indicators(ind.base_indicators(rows, DOC))
    return plain(
        found, "doc_id", "capital_de_giro", "liquidez_corrente", "grau_endividamento", "margem_liquida",
        "participacao_caixa_no_ativo", "rotulo_liquidez",
    )


def advice_rules(spark, folder):
    accounts, suppliers = _read(spark, folder)
    found = supplier_analysis(accounts, suppliers, DOC).recomendacoes
    return found.select("doc_id", "titulo", "descricao", "prioridade", "categoria", "peso", "regra")


QUERIES = {
    "supplier_abc": supplier_abc,
    "supplier_totals": supplier_totals,
    "supplier_concentration": supplier_concentration,
    "category_summary": category_summary,
    "category_members": category_members,
    "totals_rollup": totals_rollup,
    "last_two_periods": last_two_periods,
    "supplier_period_change": supplier_period_change,
    "chart_top_suppliers": chart_top_suppliers,
    "chart_changes": chart_changes,
    "chart_categories": chart_categories,
    "period_advice": period_advice,
    "ledger_advice": ledger_advice,
    "advice_names": advice_names,
    "advice_order": advice_order,
    "supplier_header": supplier_header,
    "supplier_lines": supplier_lines,
    "supplier_section": supplier_section,
    "account_lookup": account_lookup,
    "indicators": indicators,
    "indicators_derived": indicators_derived,
    "advice_rules": advice_rules,
}

from registry.suppliers_sql import SQL  # noqa: E402,F401

"""Ledger analysis: results, rankings, variations, alerts and advice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import ensure_checkpoint_dir
from ledgerloom.operators import advice, contract, ranking, results
from registry.inputs import budget_from, next_year, raw_ledger
from registry.common import BY, FULL, LEDGER, SPEND, VARIATIONS, plain


def _slim(spark, folder, *columns) -> DataFrame:
    """Ledger for operators that need no supplier: its table is left out of the join."""
    wanted = {"empresa", "periodo", "data", "tipo", "categoria", "valor", *columns}
    rows = raw_ledger(spark, folder, wanted)
    if "fornecedor" not in wanted:
        rows = rows.withColumn("fornecedor", F.lit("nao informado"))
    return contract.validate_ledger(rows, mode="quarantine")


def _summed(spark, folder, *columns) -> DataFrame:
    """The ledger summed by key and category, and by what else is asked for: read once and stored,
    it serves every side of a comparison."""
    ensure_checkpoint_dir(spark)
    rows = _slim(spark, folder, *columns)
    return rows.groupBy(*BY, "tipo", "categoria", *columns).agg(
        F.sum("valor").cast("decimal(28,2)").alias("valor"), F.count(F.lit(1)).alias("quantidade")
    ).checkpoint()


def _changes(spark, folder) -> DataFrame:
    return _compare(_summed(spark, folder))


def _compare(rows: DataFrame) -> DataFrame:
    spend = results.spend_by_category(rows, BY)
    return results.compare_spend(spend, BY, budget_from(spend), next_year(spend))


def _alerts(spark, folder) -> DataFrame:
    return results.alerts(_changes(spark, folder))


def budget_alerts(spark: SparkSession, folder: str) -> DataFrame:
    spend = results.spend_by_category(_summed(spark, folder), BY)
    found = results.alerts(results.compare_spend(spend, BY, limits=budget_from(spend)))
    return plain(
        found, *BY, "categoria", "severidade", "valor_atual", "valor_referencia", "variacao_percentual", "mensagem"
    )


def pnl(spark, folder):
    rows = raw_ledger(spark, folder, {"empresa", "periodo", "data", "tipo", "valor"})
    return plain(results.profit_and_loss(rows, BY))


def ranking_categoria(spark, folder):
    return plain(ranking.spend_ranking(results.expenses_only(_slim(spark, folder)), BY, "categoria"))


def ranking_fornecedor(spark, folder):
    rows = results.expenses_only(_slim(spark, folder, "fornecedor"))
    return plain(ranking.spend_ranking(rows, BY, "fornecedor"))


def ranking_produto(spark, folder):
    rows = results.expenses_only(_slim(spark, folder, "produto"))
    return plain(ranking.spend_ranking(rows, BY, "produto"))


def ranking_all(spark, folder):
    rows = results.expenses_only(_slim(spark, folder, "fornecedor", "produto"))
    return plain(ranking.all_rankings(rows, BY, ["categoria", "fornecedor", "produto"]))


def top_fornecedores(spark, folder):
    rows = results.expenses_only(_slim(spark, folder, "fornecedor"))
    totals = ranking.spend_totals(rows, BY, "fornecedor")
    return plain(ranking.top_rows(totals, BY, [F.desc("total"), F.asc("fornecedor")], 5))


def spend_by_category(spark, folder):
    return plain(ranking.spend_totals(results.expenses_only(_slim(spark, folder)), BY, "categoria"))


_CHANGE_COLUMNS = [
    *BY, "categoria", "valor_atual", "valor_referencia", "variacao_absoluta", "variacao_percentual", "base_comparacao",
]


def variation_budget(spark, folder):
    spend = results.spend_by_category(_summed(spark, folder), BY)
    return plain(results.compare_spend(spend, BY, limits=budget_from(spend)), *_CHANGE_COLUMNS)


def variation_history(spark, folder):
    spend = results.spend_by_category(_summed(spark, folder), BY)
    return plain(results.compare_spend(spend, BY, before=next_year(spend)), *_CHANGE_COLUMNS)


def alerts(spark, folder):
    return plain(
        _alerts(spark, folder), *BY, "categoria", "tipo", "severidade", "valor_atual", "valor_referencia",
        "variacao_percentual", "mensagem",
    )


def alert_order(spark, folder):
    return plain(results.ordered_alerts(_alerts(spark, folder), BY), *BY, "ordem", "categoria", "severidade", "tipo")


def alert_table(spark, folder):
    return results.alert_table(_alerts(spark, folder), BY)


def biggest_increase(spark, folder):
    found = results.biggest_increase(_changes(spark, folder), BY)
    return plain(found.select(*BY, "maior_aumento.*"))


def severity_counts(spark, folder):
    return results.severity_counts(_alerts(spark, folder), BY)


def summary_cards(spark, folder):
    rows = _summed(spark, folder)
    changes = _compare(rows)
    cards = results.summary(rows, BY, changes, results.alerts(changes))
    return plain(
        cards.select(
            *BY, "gasto_total", "quantidade_lancamentos",
            F.col("maior_aumento.categoria").alias("maior_aumento_categoria"),
            F.col("maior_aumento.variacao_percentual").alias("maior_aumento_percentual"),
            "numero_alertas", "alertas_baixa", "alertas_media", "alertas_alta", "alertas_critica",
        )
    )


def top_supplier(spark, folder):
    return advice.top_supplier(_slim(spark, folder, "fornecedor"), BY)


def recommendations(spark, folder):
    rows = _summed(spark, folder, "fornecedor")
    found = results.alerts(_compare(rows))
    return plain(advice.recommendations(found, BY, rows))


def savings_total(spark, folder):
    return plain(advice.total_saving(advice.recommendations(_alerts(spark, folder), BY), BY))


def report_suggestions(spark, folder):
    return advice.suggestions(_alerts(spark, folder), BY).select(*BY, "categoria", "texto")


QUERIES = {
    "budget_alerts": budget_alerts,
    "pnl": pnl,
    "ranking_categoria": ranking_categoria,
    "ranking_fornecedor": ranking_fornecedor,
    "ranking_produto": ranking_produto,
    "ranking_all": ranking_all,
    "top_fornecedores": top_fornecedores,
    "spend_by_category": spend_by_category,
    "variation_budget": variation_budget,
    "variation_history": variation_history,
    "alerts": alerts,
    "alert_order": alert_order,
    "alert_table": alert_table,
    "biggest_increase": biggest_increase,
    "severity_counts": severity_counts,
    "summary_cards": summary_cards,
    "top_supplier": top_supplier,
    "recommendations": recommendations,
    "savings_total": savings_total,
    "report_suggestions": report_suggestions,
}


def _ranking_sql(dimension: str) -> str:
    return f"""WITH {LEDGER}, t AS (
  SELECT empresa, periodo, {dimension}, sum(valor) AS total, count(valor) AS quantidade
  FROM ledger WHERE tipo = 'despesa' GROUP BY ALL)
SELECT empresa, periodo, {dimension},
  row_number() OVER (PARTITION BY empresa, periodo ORDER BY total DESC, {dimension}) AS posicao,
  CAST(total AS DOUBLE) AS total, quantidade,
  round_even(CAST(total AS DOUBLE) / CAST(sum(total) OVER (PARTITION BY empresa, periodo) AS DOUBLE) * 100 * 100, 0) / 100
    AS percentual_do_total
FROM t"""


_CHANGES_SQL = "empresa, periodo, categoria, valor_atual, valor_referencia, variacao_absoluta, variacao_percentual, base_comparacao"

_ACTIONS_SQL = """
actions(categoria, acao) AS (VALUES
  ('mercadorias', 'Cotar preços com pelo menos 2-3 fornecedores alternativos. | Negociar prazos de pagamento e descontos por volume com o fornecedor atual.'),
  ('energia', 'Avaliar migração para mercado livre de energia ou fontes alternativas. | Auditar consumo e identificar equipamentos ineficientes.'),
  ('aluguel', 'Renegociar valor de locação ou avaliar espaços alternativos.'),
  ('folha', 'Revisar estrutura de cargos, horas extras e benefícios.'),
  ('transporte', 'Cotar frete com transportadoras alternativas. | Avaliar consolidação de cargas para reduzir custo por entrega.'),
  ('servicos', 'Revisar contrato de prestação de serviço e buscar propostas concorrentes.')),
prefixes(severidade, prefixo) AS (VALUES
  ('critica', 'PRIORIDADE CRÍTICA: ação imediata recomendada. | '),
  ('alta', 'PRIORIDADE ALTA: ação imediata recomendada. | '),
  ('media', 'Prioridade média: monitorar de perto no próximo período. | '))"""

_TOP_SQL = """
top AS (
  SELECT empresa, periodo, categoria, fornecedor AS fornecedor_principal
  FROM (SELECT empresa, periodo, categoria, fornecedor, sum(valor) AS total
        FROM ledger WHERE tipo = 'despesa' GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY empresa, periodo, categoria ORDER BY total DESC, fornecedor) = 1)"""

BRL = "replace(replace(replace(format('{{:,.2f}}', {0}), ',', '_'), '.', ','), '_', '.')"

SQL = {
    "budget_alerts": f"""{FULL} SELECT empresa, periodo, categoria, severidade, valor_atual, valor_referencia,
  variacao_percentual, mensagem FROM alerts WHERE base_comparacao = 'orcamento'""",
    "pnl": f"""WITH {LEDGER}, s AS (SELECT empresa, periodo,
    sum(CASE WHEN tipo = 'receita' THEN valor ELSE 0 END) AS r, sum(CASE WHEN tipo = 'despesa' THEN valor ELSE 0 END) AS d
  FROM ledger GROUP BY ALL)
SELECT empresa, periodo, CAST(r AS DOUBLE) AS receita_total, CAST(d AS DOUBLE) AS despesa_total,
  CAST(r - d AS DOUBLE) AS resultado,
  CASE WHEN r > d THEN 'lucro' WHEN r < d THEN 'prejuizo' ELSE 'equilibrio' END AS situacao,
  CASE WHEN r > 0 THEN CAST(printf('%.2f', CAST(r - d AS DOUBLE) / CAST(r AS DOUBLE) * 100) AS DOUBLE) END AS margem_percentual
FROM s""",
    "ranking_categoria": _ranking_sql("categoria"),
    "ranking_fornecedor": _ranking_sql("fornecedor"),
    "ranking_produto": _ranking_sql("produto"),
    "ranking_all": f"""WITH {LEDGER}, u AS (
  SELECT empresa, periodo, 'categoria' AS dimensao, categoria AS nome, valor FROM ledger WHERE tipo = 'despesa'
  UNION ALL SELECT empresa, periodo, 'fornecedor', fornecedor, valor FROM ledger WHERE tipo = 'despesa'
  UNION ALL SELECT empresa, periodo, 'produto', produto, valor FROM ledger WHERE tipo = 'despesa'),
t AS (SELECT empresa, periodo, dimensao, nome, sum(valor) AS total, count(valor) AS quantidade FROM u GROUP BY ALL)
SELECT empresa, periodo, dimensao, nome,
  row_number() OVER (PARTITION BY empresa, periodo, dimensao ORDER BY total DESC, nome) AS posicao,
  CAST(total AS DOUBLE) AS total, quantidade,
  round_even(CAST(total AS DOUBLE) / CAST(sum(total) OVER (PARTITION BY empresa, periodo, dimensao) AS DOUBLE) * 100 * 100, 0) / 100
    AS percentual_do_total
FROM t""",
    "top_fornecedores": f"""WITH {LEDGER}, t AS (
  SELECT empresa, periodo, fornecedor, sum(valor) AS total, count(valor) AS quantidade
  FROM ledger WHERE tipo = 'despesa' GROUP BY ALL)
SELECT empresa, periodo, fornecedor, CAST(total AS DOUBLE) AS total, quantidade, posicao FROM (
  SELECT *, row_number() OVER (PARTITION BY empresa, periodo ORDER BY total DESC, fornecedor) AS posicao FROM t)
WHERE posicao <= 5""",
    "spend_by_category": f"""WITH {LEDGER} SELECT empresa, periodo, categoria, CAST(sum(valor) AS DOUBLE) AS total,
  count(*) AS quantidade FROM ledger WHERE tipo = 'despesa' GROUP BY ALL""",
    "variation_budget": f"WITH {LEDGER}, {SPEND}, {VARIATIONS} SELECT {_CHANGES_SQL} FROM variations WHERE base_comparacao = 'orcamento'",
    "variation_history": f"WITH {LEDGER}, {SPEND}, {VARIATIONS} SELECT {_CHANGES_SQL} FROM variations WHERE base_comparacao = 'historico'",
    "alerts": f"""{FULL} SELECT empresa, periodo, categoria, tipo, severidade, valor_atual, valor_referencia,
  variacao_percentual, mensagem FROM alerts""",
    "alert_order": f"""{FULL} SELECT empresa, periodo, categoria, severidade, tipo, row_number() OVER (
  PARTITION BY empresa, periodo ORDER BY ordem_severidade, variacao_percentual DESC, ordem_base, categoria) AS ordem
FROM alerts""",
    "alert_table": f"{FULL} SELECT empresa, periodo, categoria, severidade, mensagem FROM alerts",
    "biggest_increase": f"""{FULL} SELECT empresa, periodo, categoria, variacao_percentual, valor_atual, valor_referencia
FROM variations WHERE variacao_percentual > 0 QUALIFY row_number() OVER (PARTITION BY empresa, periodo
  ORDER BY variacao_percentual DESC, base_comparacao DESC, categoria) = 1""",
    "severity_counts": f"""{FULL} SELECT empresa, periodo, count(*) AS numero_alertas,
  count(*) FILTER (severidade = 'baixa') AS alertas_baixa, count(*) FILTER (severidade = 'media') AS alertas_media,
  count(*) FILTER (severidade = 'alta') AS alertas_alta, count(*) FILTER (severidade = 'critica') AS alertas_critica
FROM alerts GROUP BY ALL""",
    "summary_cards": f"""{FULL}, g AS (
  SELECT empresa, periodo, sum(CASE WHEN tipo = 'despesa' THEN valor ELSE 0 END) AS gasto,
         count(*) FILTER (tipo = 'despesa') AS n FROM ledger GROUP BY ALL),
b AS (SELECT * FROM variations WHERE variacao_percentual > 0 QUALIFY row_number() OVER (PARTITION BY empresa, periodo
  ORDER BY variacao_percentual DESC, base_comparacao DESC, categoria) = 1),
a AS (SELECT empresa, periodo, count(*) AS n, count(*) FILTER (severidade = 'baixa') AS n1,
  count(*) FILTER (severidade = 'media') AS n2, count(*) FILTER (severidade = 'alta') AS n3,
  count(*) FILTER (severidade = 'critica') AS n4 FROM alerts GROUP BY ALL)
SELECT g.empresa, g.periodo, CAST(gasto AS DOUBLE) AS gasto_total, g.n AS quantidade_lancamentos,
  b.categoria AS maior_aumento_categoria, b.variacao_percentual AS maior_aumento_percentual,
  coalesce(a.n, 0) AS numero_alertas, coalesce(n1, 0) AS alertas_baixa, coalesce(n2, 0) AS alertas_media,
  coalesce(n3, 0) AS alertas_alta, coalesce(n4, 0) AS alertas_critica
FROM g LEFT JOIN b USING (empresa, periodo) LEFT JOIN a USING (empresa, periodo)""",
    "top_supplier": f"WITH {LEDGER}, {_TOP_SQL} SELECT * FROM top",
    "recommendations": f"""{FULL}, {_TOP_SQL}, {_ACTIONS_SQL}
SELECT a.empresa, a.periodo, fornecedor_principal AS fornecedor, a.categoria, a.severidade,
  coalesce(prefixo, '') || acao AS acao_recomendada,
  CAST(greatest(atual - ref, 0) AS DOUBLE) AS economia_estimada, ordem_severidade
FROM alerts a JOIN top USING (empresa, periodo, categoria) JOIN actions USING (categoria)
LEFT JOIN prefixes ON prefixes.severidade = a.severidade""",
    "savings_total": f"""{FULL} SELECT empresa, periodo, CAST(sum(greatest(atual - ref, 0)) AS DOUBLE) AS economia_total
FROM alerts GROUP BY ALL""",
    "report_suggestions": f"""{FULL} SELECT empresa, periodo, categoria,
  '   - Rever contratos/fornecedores da categoria ''' || categoria || ''': gasto ' || printf('%+.1f', variacao_percentual)
  || '% acima do esperado (R$ ' || {BRL.format('valor_atual')} || ' vs R$ ' || {BRL.format('valor_referencia')} || ').' AS texto
FROM alerts WHERE severidade IN ('alta', 'critica') QUALIFY row_number() OVER (PARTITION BY empresa, periodo, categoria
  ORDER BY ordem_severidade, variacao_percentual DESC, ordem_base) = 1""",
}

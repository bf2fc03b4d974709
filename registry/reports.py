"""Contract checks, filters, corrections, reports and JSON bundles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions.money import as_money
from ledgerloom import vocab
from ledgerloom.operators import contract, filters, reports, results
from ledgerloom.plans.analysis import Analysis
from registry.inputs import budget_from, documents, next_year, raw_ledger, table, uploads
from ledgerloom.plans.supplier import account_rows, read_supplier_documents, supplier_analysis, supplier_rows
from ledgerloom.plans.upload import prepare
from ledgerloom.session import ensure_checkpoint_dir, stored
from registry.common import BY, FULL, LEDGER, plain
from registry.reports_sql import BUNDLE, DATASET, supplier_report
from registry.suppliers_sql import IND, SQL as SUPPLIER_SQL, _DOC_CON, _DOC_RULES


def _dirty_ledger(spark, folder):
    """Sales lines as a ledger file full of mistakes."""
    line = table(spark, folder, "lineitem")
    n, day = F.col("l_linenumber"), F.col("l_shipdate").cast("date")
    return line.select(
        F.col("l_returnflag").alias("empresa"),
        F.when(n == 1, F.date_format(day, "MM/dd/yyyy")).when(n == 2, F.date_format(day, "yyyy-MM-dd HH:mm:ss"))
        .when(n == 7, F.lit("31/31/2020")).otherwise(F.date_format(day, "yyyy-MM-dd")).alias("data"),
        F.when(F.col("l_linestatus") == "F", " RECEITA ").when(n == 4, "Investimento").alias("tipo"),
        F.lit(" Mercadorias").alias("categoria"),
        F.when(n == 3, None).otherwise(F.concat(F.lit(" Fornecedor "), F.col("l_suppkey").cast("string"))).alias("fornecedor"),
        F.when(n == 6, F.lit("abc")).when(n == 5, F.concat(F.lit("-"), as_money(F.col("l_extendedprice")).cast("string")))
        .otherwise(as_money(F.col("l_extendedprice")).cast("string")).alias("valor"),
    )


def contract_violations(spark, folder):
    return contract.violation_counts(contract.check_ledger(_dirty_ledger(spark, folder)), ["empresa"])


def contract_valid(spark, folder):
    rows = contract.valid_rows(contract.check_ledger(_dirty_ledger(spark, folder)))
    return plain(
        rows.groupBy("empresa", "tipo", "categoria", "fornecedor").agg(
            F.sum("valor").alias("valor"), F.min("data").alias("de"), F.max("data").alias("ate"), F.count("*").alias("linhas")
        )
    )


def contract_rejected(spark, folder):
    rows = contract.rejected_rows(contract.check_ledger(_dirty_ledger(spark, folder)))
    return rows.groupBy("empresa", F.array_join("violacoes", ",").alias("violacoes")).agg(F.count("*").alias("linhas"))


def budget_contract(spark, folder):
    """Limits written twice under spellings of one category."""
    orders = table(spark, folder, "orders")
    rows = orders.select(
        F.col("o_custkey").alias("empresa"),
        F.when(F.col("o_orderstatus") == "F", " Serviços").when(F.col("o_orderstatus") == "O", "SERVICOS ").otherwise("").alias("categoria"),
        as_money(F.col("o_totalprice")).cast("string").alias("limite"),
    )
    return plain(contract.validate_budget(rows, ["empresa"], mode="quarantine"))


def ledger_completion(spark, folder):
    rows = _dirty_ledger(spark, folder).drop("tipo")
    done = contract.complete_ledger(rows)
    return done.groupBy("mes_ano", "tipo").agg(F.count("*").alias("linhas"))


def _months(rows):
    return rows.withColumn("mes_ano", F.date_format("data", "yyyy-MM"))


def ledger_filter(spark, folder):
    rows = _months(contract.validate_ledger(raw_ledger(spark, folder), "quarantine"))
    chosen = table(spark, folder, "supplier").filter(F.col("s_acctbal") > 0).select(F.col("s_name").alias("fornecedor"))
    kept = filters.filter_ledger(rows, ["1998-01", "1998-02", "1998-03"], ["energia", "folha"], chosen)
    return plain(kept.groupBy("empresa", "mes_ano", "categoria").agg(F.sum("valor").alias("valor"), F.count("*").alias("linhas")))


def filter_options(spark, folder):
    rows = _months(contract.validate_ledger(raw_ledger(spark, folder), "quarantine"))
    return filters.filter_options(rows)


def category_options(spark, folder):
    return filters.category_options(contract.validate_ledger(raw_ledger(spark, folder), "quarantine"))


def corrections(spark, folder):
    orders = table(spark, folder, "orders")
    p = F.col("o_orderpriority")
    rows = orders.select(
        "o_orderkey", F.col("o_orderstatus").alias("descricao"), F.lit("outros").alias("categoria"), F.lit("despesa").alias("tipo"),
        as_money(F.col("o_totalprice")).alias("valor"),
    )
    fixes = orders.select(
        "o_orderkey", F.when(p == "1-URGENT", "impostos").alias("categoria"),
        F.when(p == "2-HIGH", "receita").when(p == "3-MEDIUM", "outra").alias("tipo"),
        F.when(p == "4-NOT SPECIFIED", F.lit("10.50")).when(p == "5-LOW", F.lit("-1")).cast("decimal(18,2)").alias("valor"),
        F.lit("x").alias("descricao"),
    )
    return plain(filters.apply_corrections(rows, fixes, ["o_orderkey"]))


def _analysis(spark, folder) -> Analysis:
    """The full analysis, with budget and history from the year before."""
    ensure_checkpoint_dir(spark)
    wanted = ("empresa", "periodo", "data", "tipo", "categoria", "fornecedor", "valor")
    # a stored ledger: the report reads it for every section, and would join it anew each time
    rows = contract.validate_ledger(raw_ledger(spark, folder, wanted), "quarantine").checkpoint()
    spend = results.spend_by_category(rows, BY)
    changes = results.compare_spend(spend, BY, budget_from(spend), next_year(spend))
    found = results.alerts(changes)
    return Analysis(BY, rows, results.profit_and_loss(rows, BY), results.summary(rows, BY, changes, found), changes, found)


def report_lines(spark, folder):
    return reports.analysis_report(_analysis(spark, folder), "01/01/2030 00:00")


def bundle_json(spark, folder):
    return reports.json_lines(_analysis(spark, folder))


def dataset_json(spark, folder):
    return reports.dataset_lines(prepare(uploads(spark, folder)).typed())


def _supplier_analysis(spark, folder):
    read = stored(read_supplier_documents(documents(spark, folder)).drop("texto"), "supplier-documents")
    found = supplier_analysis(account_rows(read, ["doc_id"]), supplier_rows(read, ["doc_id"]), ["doc_id"])
    return found, read.select("doc_id", "nome", "cnpj", "periodo_inicio", "periodo_fim")


def supplier_report_lines(spark, folder):
    found, headers = _supplier_analysis(spark, folder)
    return reports.supplier_report(found, headers.join(found.indicadores.select("doc_id"), "doc_id").withColumn("arquivo", F.concat(F.lit("balancete_"), "doc_id", F.lit(".txt"))))


def executive_summary(spark, folder):
    found, _ = _supplier_analysis(spark, folder)
    return reports.executive_summary(found)


QUERIES = {
    "contract_violations": contract_violations,
    "contract_valid": contract_valid,
    "contract_rejected": contract_rejected,
    "budget_contract": budget_contract,
    "ledger_completion": ledger_completion,
    "ledger_filter": ledger_filter,
    "filter_options": filter_options,
    "category_options": category_options,
    "corrections": corrections,
    "report_lines": report_lines,
    "bundle_json": bundle_json,
    "dataset_json": dataset_json,
    "supplier_report_lines": supplier_report_lines,
    "executive_summary": executive_summary,
}

_DIRTY = """d AS (SELECT l_returnflag AS empresa, l_linenumber AS n, l_linestatus AS st, CAST(l_shipdate AS DATE) AS dia,
  CAST(l_extendedprice AS DECIMAL(18,2)) AS v, CASE WHEN l_linenumber = 3 THEN 'nao informado' ELSE 'Fornecedor ' || l_suppkey END AS fornecedor FROM lineitem)"""
_BAD_TYPE = "(st <> 'F' AND n = 4)"


def _brl(x: str) -> str:
    return f"'R$ ' || replace(replace(replace(format('{{:,.2f}}', {x}), ',', '_'), '.', ','), '_', '.')"


def _top_lines(dimension: str) -> str:
    return f"""SELECT empresa, periodo, 3 AS secao, '   ' || pos || '. ' || {dimension} || ': ' || {_brl('CAST(total AS DOUBLE)')} || ' ('
    || printf('%.1f', round_even(CAST(total AS DOUBLE) / CAST(tudo AS DOUBLE) * 100 * 100, 0) / 100) || '% do total)' AS texto FROM (
  SELECT *, row_number() OVER (PARTITION BY empresa, periodo ORDER BY total DESC, {dimension}) AS pos, sum(total) OVER (PARTITION BY empresa, periodo) AS tudo
  FROM (SELECT empresa, periodo, {dimension}, sum(valor) AS total FROM ledger WHERE tipo = 'despesa' GROUP BY ALL)) WHERE pos <= 5"""


_LABEL = "CASE severidade WHEN 'critica' THEN 'CRÍTICA' WHEN 'alta' THEN 'ALTA' WHEN 'media' THEN 'MÉDIA' ELSE 'BAIXA' END"
_EMPTY_LINE = " UNION ALL ".join(f"SELECT empresa, periodo, {s}, '' FROM g" for s in (0, 1, 2, 3, 4, 5))

REPORT = f"""{FULL}, g AS (SELECT empresa, periodo, sum(CASE WHEN tipo = 'receita' THEN valor ELSE 0 END) AS r,
    sum(CASE WHEN tipo = 'despesa' THEN valor ELSE 0 END) AS d, count(*) FILTER (tipo = 'despesa') AS n FROM ledger GROUP BY ALL),
b AS (SELECT * FROM variations WHERE variacao_percentual > 0 QUALIFY row_number() OVER (PARTITION BY empresa, periodo
  ORDER BY variacao_percentual DESC, base_comparacao DESC, categoria) = 1),
a AS (SELECT empresa, periodo, count(*) AS n, count(*) FILTER (severidade = 'baixa') AS n1, count(*) FILTER (severidade = 'media') AS n2,
  count(*) FILTER (severidade = 'alta') AS n3, count(*) FILTER (severidade = 'critica') AS n4 FROM alerts GROUP BY ALL),
h AS (SELECT *, 'RELATÓRIO DE ANÁLISE FINANCEIRA — ' || empresa || ' ' || periodo AS titulo FROM g),
sug AS (SELECT * FROM alerts WHERE severidade IN ('alta', 'critica') QUALIFY row_number() OVER (PARTITION BY empresa, periodo, categoria
  ORDER BY ordem_severidade, variacao_percentual DESC, ordem_base) = 1),
linhas AS (
  SELECT empresa, periodo, 0 AS secao, repeat('=', length(titulo)) AS texto FROM h UNION ALL SELECT empresa, periodo, 0, repeat('=', length(titulo)) FROM h
  UNION ALL SELECT empresa, periodo, 0, titulo FROM h UNION ALL SELECT empresa, periodo, 0, 'Gerado em 01/01/2030 00:00' FROM h
  UNION ALL {_EMPTY_LINE}
  UNION ALL SELECT empresa, periodo, 1, '1. RESULTADO DO PERÍODO' FROM g
  UNION ALL SELECT empresa, periodo, 1, '   Situação: ' || CASE WHEN r > d THEN 'LUCRO' WHEN r < d THEN 'PREJUÍZO' ELSE 'EQUILÍBRIO (receita = despesa)' END FROM g
  UNION ALL SELECT empresa, periodo, 1, '   Receita total: ' || {_brl('CAST(r AS DOUBLE)')} FROM g
  UNION ALL SELECT empresa, periodo, 1, '   Despesa total: ' || {_brl('CAST(d AS DOUBLE)')} FROM g
  UNION ALL SELECT empresa, periodo, 1, '   Resultado do período: ' || {_brl('CAST(r - d AS DOUBLE)')} FROM g
  UNION ALL SELECT empresa, periodo, 1, '   Margem: ' || printf('%.1f', CAST(printf('%.2f', CAST(r - d AS DOUBLE) / CAST(r AS DOUBLE) * 100) AS DOUBLE)) || '%' FROM g WHERE r > 0
  UNION ALL SELECT empresa, periodo, 2, '2. RESUMO DE GASTOS' FROM g
  UNION ALL SELECT empresa, periodo, 2, '   Gasto total analisado: ' || {_brl('CAST(d AS DOUBLE)')} FROM g
  UNION ALL SELECT empresa, periodo, 2, '   Lançamentos de despesa analisados: ' || n FROM g
  UNION ALL SELECT g.empresa, g.periodo, 2, CASE WHEN b.categoria IS NULL THEN '   Nenhum aumento de gasto identificado no período.' ELSE
    '   Maior aumento de gasto: categoria ''' || b.categoria || ''' (' || printf('%+.1f', variacao_percentual) || '%, de ' || {_brl('valor_referencia')}
    || ' para ' || {_brl('valor_atual')} || ')' END FROM g LEFT JOIN b USING (empresa, periodo)
  UNION ALL SELECT g.empresa, g.periodo, 2, '   Alertas gerados: ' || coalesce(a.n, 0) || ' (crítica: ' || coalesce(n4, 0) || ', alta: ' || coalesce(n3, 0)
    || ', média: ' || coalesce(n2, 0) || ', baixa: ' || coalesce(n1, 0) || ')' FROM g LEFT JOIN a USING (empresa, periodo)
  UNION ALL SELECT empresa, periodo, 3, '3. ONDE A EMPRESA GASTA MAIS' FROM g
  UNION ALL SELECT empresa, periodo, 3, CASE WHEN n > 0 THEN '   Por categoria:' ELSE '   Sem lançamentos de despesa para ranquear neste período.' END FROM g
  UNION ALL SELECT empresa, periodo, 3, '   Por fornecedor:' FROM g WHERE n > 0
  UNION ALL ({_top_lines('categoria')}) UNION ALL ({_top_lines('fornecedor')})
  UNION ALL SELECT empresa, periodo, 4, '4. ALERTAS DE GASTOS' FROM g
  UNION ALL SELECT g.empresa, g.periodo, 4, '   Nenhum alerta identificado neste período.' FROM g ANTI JOIN a USING (empresa, periodo)
  UNION ALL SELECT empresa, periodo, 4, '   [' || {_LABEL} || '] ' || mensagem FROM alerts
  UNION ALL SELECT empresa, periodo, 5, '5. ONDE A EMPRESA PODE ECONOMIZAR' FROM g
  UNION ALL SELECT empresa, periodo, 5, '   - Rever contratos/fornecedores da categoria ''' || categoria || ''': gasto ' || printf('%+.1f', variacao_percentual)
    || '% acima do esperado (' || {_brl('valor_atual')} || ' vs ' || {_brl('valor_referencia')} || ').' FROM sug
  UNION ALL SELECT g.empresa, g.periodo, 5, '   Nenhuma categoria com desvio grave o suficiente para ação imediata neste período.' FROM g ANTI JOIN sug USING (empresa, periodo)
  UNION ALL SELECT empresa, periodo, 5, '   (Recomendações preliminares baseadas nos alertas. Sugestões de fornecedores' FROM g
  UNION ALL SELECT empresa, periodo, 5, '   alternativos e estimativa de economia são geradas pelo módulo de fornecedores.)' FROM g)"""


# The place of each line in its section, told from its beginning; alerts and suggestions have keys of their own
_PLACES = {
    0: (("RELATÓRIO", 2), ("Gerado", 4), ("", 5)),
    1: (("1.", 1), ("   Situação", 2), ("   Receita", 3), ("   Despesa", 4), ("   Resultado", 5), ("   Margem", 6), ("", 7)),
    2: (("2.", 1), ("   Gasto", 2), ("   Lançamentos", 3), ("   Maior", 4), ("   Nenhum", 4), ("   Alertas", 5), ("", 6)),
    3: (("3.", 1), ("   Sem", 2), ("   Por categoria", 3), ("   Por fornecedor", 20), ("   ", 10), ("", 40)),
    4: (("4.", 1), ("   Nenhum", 2), ("   [", 10), ("", 20)),
    5: (("5.", 1), ("   Nenhuma", 10), ("   -", 20), ("   (", 30), ("   alternativos", 31), ("", 32)),
}
_PLACE = " ".join(f"WHEN secao = {n} AND starts_with(texto, '{t}') THEN {k}" for n, rows in _PLACES.items() for t, k in rows)
_TOP_CATEGORY = "regexp_matches(texto, '^   [0-9]+[.] (" + "|".join([*(name for name, _ in vocab.LEDGER_CATEGORY_WORDS), "outros"]) + "): ')"
_KEY = "row_number() OVER (PARTITION BY empresa, periodo ORDER BY ordem_severidade, variacao_percentual DESC, ordem_base, categoria) AS k"

NUMBERED = f"""{REPORT},
teclas AS (
  SELECT empresa, periodo, 4 AS secao, '   [' || {_LABEL} || '] ' || mensagem AS texto, {_KEY} FROM alerts
  UNION ALL SELECT empresa, periodo, 5, '   - Rever contratos/fornecedores da categoria ''' || categoria || ''': gasto ' || printf('%+.1f', variacao_percentual)
    || '% acima do esperado (' || {_brl('valor_atual')} || ' vs ' || {_brl('valor_referencia')} || ').', {_KEY} FROM sug
  UNION ALL SELECT DISTINCT empresa, periodo, 3, texto, CAST(regexp_extract(texto, '^   ([0-9]+)[.]', 1) AS BIGINT) FROM linhas
    WHERE secao = 3 AND regexp_matches(texto, '^   [0-9]+[.]')),
postas AS (SELECT l.*, coalesce(k, 0) AS k, CASE WHEN secao = 0 AND starts_with(texto, '=')
    THEN 2 * row_number() OVER (PARTITION BY empresa, periodo, secao, texto) - 1
    WHEN secao = 3 AND regexp_matches(texto, '^   [0-9]+[.]') AND NOT {_TOP_CATEGORY} THEN 30 {_PLACE} END AS lugar
  FROM linhas l LEFT JOIN teclas USING (empresa, periodo, secao, texto))"""


def report_text(spark, folder):
    """The report lines without their numbers."""
    return report_lines(spark, folder).drop("linha")


QUERIES["report_text"] = report_text

SQL = {
    "contract_violations": f"""WITH {_DIRTY} SELECT empresa, violacao, count(*) AS linhas FROM (
  SELECT empresa, 'DATA_INVALIDA' AS violacao FROM d WHERE n = 7 UNION ALL SELECT empresa, 'VALOR_INVALIDO' FROM d WHERE n = 6
  UNION ALL SELECT empresa, 'VALOR_NEGATIVO' FROM d WHERE n = 5 AND v > 0 UNION ALL SELECT empresa, 'TIPO_INVALIDO' FROM d WHERE {_BAD_TYPE}) GROUP BY ALL""",
    "contract_valid": f"""WITH {_DIRTY} SELECT empresa, CASE WHEN st = 'F' THEN 'receita' ELSE 'despesa' END AS tipo, 'mercadorias' AS categoria, fornecedor,
  CAST(sum(v) AS DOUBLE) AS valor, strftime(min(dia), '%Y-%m-%d') AS de, strftime(max(dia), '%Y-%m-%d') AS ate, count(*) AS linhas
FROM d WHERE n NOT IN (5, 6, 7) AND NOT {_BAD_TYPE} GROUP BY ALL""",
    "contract_rejected": f"""WITH {_DIRTY} SELECT empresa, CASE WHEN n = 7 THEN 'DATA_INVALIDA' WHEN n = 6 THEN 'VALOR_INVALIDO' WHEN n = 5 THEN 'VALOR_NEGATIVO'
  ELSE 'TIPO_INVALIDO' END AS violacoes, count(*) AS linhas FROM d WHERE n IN (5, 6, 7) OR {_BAD_TYPE} GROUP BY ALL""",
    "budget_contract": """SELECT o_custkey AS empresa, CASE WHEN o_orderstatus IN ('F', 'O') THEN 'servicos' ELSE 'outros' END AS categoria,
  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS limite FROM orders GROUP BY ALL""",
    "ledger_completion": f"""WITH {_DIRTY} SELECT CASE WHEN n <> 7 THEN strftime(dia, '%Y-%m') END AS mes_ano, 'despesa' AS tipo, count(*) AS linhas FROM d GROUP BY ALL""",
    "ledger_filter": f"""WITH {LEDGER} SELECT empresa, strftime(data, '%Y-%m') AS mes_ano, categoria, CAST(sum(valor) AS DOUBLE) AS valor, count(*) AS linhas FROM ledger
WHERE strftime(data, '%Y-%m') IN ('1998-01', '1998-02', '1998-03') AND categoria IN ('energia', 'folha')
  AND fornecedor IN (SELECT s_name FROM supplier WHERE s_acctbal > 0) GROUP BY ALL""",
    "filter_options": f"""WITH {LEDGER} SELECT DISTINCT 'mes_ano' AS campo, strftime(data, '%Y-%m') AS valor FROM ledger
UNION ALL SELECT DISTINCT 'categoria', categoria FROM ledger UNION ALL SELECT DISTINCT 'fornecedor', fornecedor FROM ledger""",
    "category_options": f"""WITH {LEDGER} SELECT categoria FROM ledger UNION SELECT unnest(['mercadorias', 'energia', 'aluguel', 'folha', 'transporte',
  'servicos', 'impostos', 'outros'])""",
    "corrections": """SELECT o_orderkey, o_orderstatus AS descricao, CASE WHEN o_orderpriority = '1-URGENT' THEN 'impostos' ELSE 'outros' END AS categoria,
  CASE WHEN o_orderpriority = '2-HIGH' THEN 'receita' ELSE 'despesa' END AS tipo,
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 10.5 ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) END AS valor FROM orders""",
    "report_lines": f"{NUMBERED} SELECT empresa, periodo, secao, row_number() OVER (PARTITION BY empresa, periodo ORDER BY secao, lugar, k) AS linha, texto FROM postas",
    "bundle_json": BUNDLE,
    "dataset_json": DATASET,
    "supplier_report_lines": supplier_report(SUPPLIER_SQL["supplier_header"]),
    "report_text": f"{REPORT} SELECT empresa, periodo, secao, texto FROM linhas",
    "executive_summary": f"""{IND}{_DOC_CON}, adv AS (SELECT doc_id, count(*) AS n FROM ({_DOC_RULES}) GROUP BY ALL),
ct AS (SELECT f.doc_id, CAST(sum(mov) / 100 AS DOUBLE) AS total, CAST(sum(atual) / 100 AS DOUBLE) AS aberto FROM f GROUP BY ALL),
all_figures AS (SELECT base.*, ind.* EXCLUDE (doc_id, caixa, passivo_circulante), con.n AS q, p1, p3, hhi, total, aberto, adv.n AS recs
  FROM base JOIN ind USING (doc_id) LEFT JOIN con USING (doc_id) LEFT JOIN ct USING (doc_id) LEFT JOIN adv USING (doc_id))
SELECT doc_id, ordem, rotulo, valor FROM (
  {' UNION ALL '.join(f"SELECT doc_id, {i} AS ordem, '{n}' AS rotulo, CAST({c} AS DOUBLE) AS valor FROM all_figures" for i, (n, c) in enumerate([
    ('Ativo Circulante', 'ativo_circulante'), ('Passivo Circulante', 'passivo_circulante'), ('Caixa Disponível', 'caixa'), ('Estoque', 'estoque'),
    ('Patrimônio Líquido', 'patrimonio_liquido'), ('Receita Bruta do Período', 'receita_bruta'), ('Capital de Giro', 'capital_de_giro'),
    ('Liquidez Corrente', 'liquidez_corrente'), ('Margem Líquida', 'margem_liquida / 100'), ('Quantidade de fornecedores', 'coalesce(q, 0)'),
    ('Total movimentado no período', 'coalesce(total, 0)'), ('Saldo em aberto (a pagar)', 'coalesce(aberto, 0)'),
    ('Maior fornecedor (% do total)', 'coalesce(p1, 0) / 100'), ('Top 3 fornecedores (% do total)', 'coalesce(p3, 0) / 100'),
    ('Índice de concentração (HHI)', 'coalesce(hhi, 0)'), ('Recomendações geradas', 'coalesce(recs, 0)')]))}) WHERE valor IS NOT NULL""",
}

"""SQL for the supplier queries."""

from __future__ import annotations

from ledgerloom.messages import NAMES_ELSEWHERE, RULES
from registry.inputs import TRADES
from registry.common import LEDGER
from registry.docs_sql import SUPPLIERS

_TRADE_LIST = "[" + ", ".join(f"'{t}'" for t in TRADES) + "]"

# category of each trade, in the order of TRADES
_TRADE_CATEGORY = {
    "INFORMATICA": "Tecnologia / TI",
    "ADVOCACIA": "Contabilidade / Jurídico / Consultoria",
    "EDITORA": "Assinaturas / Publicações / Informação",
    "PAPELARIA": "Material de Escritório / Papelaria",
    "LOGISTICA": "Logística / Transporte",
    "PADARIA": "Alimentação",
    "ENGENHARIA": "Construção / Manutenção / Engenharia",
    "PUBLICIDADE": "Marketing / Publicidade",
    "CLINICA": "Saúde / Segurança do Trabalho",
    "SANEAMENTO": "Energia / Utilidades",
    "LIMPEZA": "Serviços Gerais / Terceirizados",
}
CATEGORY = (
    "CASE WHEN regexp_matches(nome, '^[0-9]{5,} ') THEN 'Prestador Pessoa Física / Autônomo' "
    + " ".join(f"WHEN contains(nome, '{t}') THEN '{c}'" for t, c in _TRADE_CATEGORY.items())
    + " ELSE 'Outros / Não classificado' END"
)
SHORT = "CASE WHEN length(nome) <= 38 THEN nome ELSE rtrim(substr(nome, 1, 35)) || '...' END"

SUP = f"""WITH {LEDGER}, soma AS (
  SELECT empresa, periodo, CAST(regexp_extract(fornecedor, '([0-9]+)$', 1) AS BIGINT) AS seq, fornecedor,
    CAST(sum(CASE WHEN tipo = 'despesa' THEN valor ELSE 0 END) AS DECIMAL(18,2)) AS credito,
    CAST(sum(CASE WHEN tipo = 'receita' THEN valor ELSE 0 END) AS DECIMAL(18,2)) AS debito
  FROM ledger GROUP BY ALL),
sup0 AS (SELECT empresa, periodo, seq, debito AS saldo_anterior, debito, credito, credito AS saldo_em_aberto,
    debito + credito AS mov,
    CASE WHEN seq % 14 = 13 THEN CAST(seq + 100000 AS VARCHAR) || ' MARIA DE SOUZA'
         ELSE upper(fornecedor) || ' ' || {_TRADE_LIST}[seq % {len(TRADES)} + 1] END AS nome FROM soma),
sup AS (SELECT *, {CATEGORY} AS categoria, {SHORT} AS nome_curto FROM sup0),
tot AS (SELECT empresa, periodo, count(*) AS n, sum(mov) AS total, sum(saldo_em_aberto) AS aberto,
    sum(CAST(mov AS DECIMAL(18,2)) * CAST(mov AS DECIMAL(18,2))) AS quad FROM sup GROUP BY ALL),
rk AS (SELECT *, row_number() OVER w AS ranking, sum(mov) OVER (PARTITION BY empresa, periodo ORDER BY mov DESC, seq
    ROWS UNBOUNDED PRECEDING) AS run FROM sup WINDOW w AS (PARTITION BY empresa, periodo ORDER BY mov DESC, seq)),
con AS (SELECT t.*, CAST(quad AS DOUBLE) / (CAST(total AS DOUBLE) * CAST(total AS DOUBLE)) * 10000 AS hhi,
    CAST(m1 AS DOUBLE) / CAST(total AS DOUBLE) * 100 AS p1, CAST(m3 AS DOUBLE) / CAST(total AS DOUBLE) * 100 AS p3, n1, n3
  FROM tot t JOIN (SELECT empresa, periodo, max(mov) AS m1, sum(mov) AS m3, max(CASE WHEN ranking = 1 THEN nome_curto END) AS n1,
    string_agg(nome_curto, ', ' ORDER BY ranking) AS n3 FROM rk WHERE ranking <= 3 GROUP BY ALL) USING (empresa, periodo)),
cat AS (SELECT empresa, periodo, categoria, sum(mov) AS total, count(*) AS quantidade_fornecedores FROM sup GROUP BY ALL),
catp AS (SELECT *, CAST(total AS DOUBLE) / CAST(sum(total) OVER (PARTITION BY empresa, periodo) AS DOUBLE) * 100 AS pct FROM cat)"""

PERIODS = """, per AS (SELECT empresa, periodo, row_number() OVER (PARTITION BY empresa ORDER BY periodo DESC) AS ordem
  FROM (SELECT DISTINCT empresa, periodo FROM sup)),
nm AS (SELECT s.empresa, ordem, upper(trim(nome)) AS chave, nome, categoria, mov FROM sup s JOIN per USING (empresa, periodo)
  WHERE ordem <= 2 QUALIFY row_number() OVER (PARTITION BY s.empresa, ordem, upper(trim(nome)) ORDER BY mov, seq DESC) = 1),
chg AS (SELECT coalesce(b.empresa, a.empresa) AS empresa, coalesce(b.nome, a.nome) AS nome, coalesce(b.categoria, a.categoria) AS categoria,
    coalesce(a.mov, 0) AS ant, coalesce(b.mov, 0) AS atu
  FROM (SELECT * FROM nm WHERE ordem = 2) a FULL OUTER JOIN (SELECT * FROM nm WHERE ordem = 1) b
    ON a.empresa = b.empresa AND a.chave = b.chave),
var AS (SELECT *, CASE WHEN ant <> 0 THEN CAST(atu - ant AS DOUBLE) / CAST(ant AS DOUBLE) * 100 END AS pct,
    CASE WHEN ant = 0 AND atu > 0 THEN 'Novo' WHEN atu = 0 AND ant > 0 THEN 'Descontinuado' ELSE 'Ativo' END AS situacao FROM chg)"""


def _brl(x: str) -> str:
    return f"'R$ ' || replace(replace(replace(format('{{:,.2f}}', {x}), ',', '_'), '.', ','), '_', '.')"


def _fill(text: str, **values: str) -> str:
    out = "'" + text.replace("'", "''") + "'"
    for name, value in values.items():
        out = out.replace("{" + name + "}", f"' || {value} || '")
    return out


def _rule(number: int, keys: str, source: str, order: str = "0", **values: str) -> str:
    priority, subject, title, text = RULES[number]
    return (
        f"SELECT {keys}, {_fill(title, **values)} AS titulo, {_fill(text, **values)} AS descricao, "
        f"'{priority}' AS prioridade, '{subject}' AS categoria, "
        f"{({'Alta': 0, 'Média': 1, 'Baixa': 2})[priority]} AS peso, {number} AS regra, CAST({order} AS DOUBLE) AS na_regra FROM {source}"
    )


def _concentration_rules(keys: str, con: str, cat: str, everyone: str) -> list[str]:
    key_list = keys
    top = f"(SELECT * FROM {cat} QUALIFY row_number() OVER (PARTITION BY {key_list} ORDER BY total DESC, categoria) = 1)"
    return [
        _rule(1, keys, f"{con} WHERE p1 >= 40", nome="n1", percentual="printf('%.1f', p1)"),
        _rule(2, keys, f"{con} WHERE n >= 3 AND p3 >= 70", nomes="n3", percentual="printf('%.1f', p3)"),
        _rule(3, keys, f"{con} WHERE hhi > 2500 AND n >= 2", hhi="format('{:,.0f}', hhi)"),
        _rule(4, keys, f"{con} WHERE n BETWEEN 1 AND 3", quantidade="CAST(n AS VARCHAR)"),
        _rule(5, keys, f"{top} WHERE pct >= 50 AND NOT starts_with(categoria, 'Outros')", categoria="categoria",
              percentual="printf('%.1f', pct)", quantidade="CAST(quantidade_fornecedores AS VARCHAR)"),
        _rule(6, keys, f"{cat} WHERE quantidade_fornecedores >= 2 AND NOT starts_with(categoria, 'Outros')",
              categoria="categoria", quantidade="CAST(quantidade_fornecedores AS VARCHAR)", nomes=f"'{NAMES_ELSEWHERE}'", order="-total",
              total=_brl("CAST(total AS DOUBLE)")),
        _rule(12, keys, f"{everyone} e WHERE NOT EXISTS (SELECT 1 FROM {con} c WHERE "
              + " AND ".join(f"c.{k.strip()} = e.{k.strip()}" for k in keys.split(",")) + ")"),
        _rule(13, keys, con),
    ]


_PERIOD_RULES = " UNION ALL ".join([
    _rule(14, "empresa", "var WHERE situacao = 'Novo'", nome="nome", atual=_brl("CAST(atu AS DOUBLE)")),
    _rule(15, "empresa", "var WHERE situacao <> 'Novo' AND pct >= 40", nome="nome", percentual="printf('%.0f', abs(pct))",
          atual=_brl("CAST(atu AS DOUBLE)"), anterior=_brl("CAST(ant AS DOUBLE)")),
    _rule(16, "empresa", "var WHERE situacao <> 'Novo' AND pct <= -40", nome="nome", percentual="printf('%.0f', abs(pct))",
          atual=_brl("CAST(atu AS DOUBLE)"), anterior=_brl("CAST(ant AS DOUBLE)")),
])

IND = f"""WITH {SUPPLIERS},
base AS (SELECT doc_id,
    CAST(coalesce(min_by(atual, seq) FILTER (contains(nome, 'ATIVO') AND contains(nome, 'CIRCULANTE')), 0) / 100 AS DOUBLE) AS ativo_circulante,
    CAST(coalesce(min_by(atual, seq) FILTER (contains(nome, 'PASSIVO') AND contains(nome, 'CIRCULANTE')), 0) / 100 AS DOUBLE) AS passivo_circulante,
    CAST(coalesce(min_by(atual, seq) FILTER (contains(nome, 'CAIXA') AND contains(nome, 'GERAL')), 0) / 100 AS DOUBLE) AS caixa,
    CAST(coalesce(min_by(atual, seq) FILTER (contains(nome, 'ESTOQUE')), 0) / 100 AS DOUBLE) AS estoque,
    CAST(coalesce(min_by(atual, seq) FILTER (contains(nome, 'PATRIMONIO') AND contains(nome, 'LIQUIDO')), 0) / 100 AS DOUBLE) AS patrimonio_liquido,
    CAST(coalesce(min_by(atual, seq) FILTER (contains(nome, 'RECEITA') AND contains(nome, 'BRUTA')), 0) / 100 AS DOUBLE) AS receita_bruta,
    CAST(coalesce(min_by(atual, seq) FILTER (contains(nome, 'RESULTADO') AND contains(nome, 'BRUTO')), 0) / 100 AS DOUBLE) AS resultado_liquido
  FROM conta GROUP BY ALL),
ind AS (SELECT doc_id, caixa, passivo_circulante,
    CAST(CAST(ativo_circulante AS DECIMAL(18,2)) - CAST(passivo_circulante AS DECIMAL(18,2)) AS DOUBLE) AS capital_de_giro,
    CASE WHEN passivo_circulante <> 0 THEN ativo_circulante / passivo_circulante END AS liquidez_corrente,
    CASE WHEN patrimonio_liquido <> 0 THEN passivo_circulante / patrimonio_liquido * 100 END AS grau_endividamento,
    CASE WHEN receita_bruta <> 0 THEN resultado_liquido / receita_bruta * 100 END AS margem_liquida,
    CASE WHEN ativo_circulante <> 0 THEN caixa / ativo_circulante * 100 END AS participacao_caixa_no_ativo FROM base)"""

_DOC_CON = f""", f AS (SELECT *, debito + credito AS mov, {CATEGORY} AS categoria, {SHORT} AS nome_curto FROM forn),
con AS (SELECT doc_id, n, m1 / total * 100 AS p1, m3 / total * 100 AS p3, n1, n3, quad / (total * total) * 10000 AS hhi FROM (
  SELECT doc_id, count(*) AS n, CAST(sum(mov) / 100 AS DOUBLE) AS total, CAST(max(mov) / 100 AS DOUBLE) AS m1,
    CAST(sum(mov) / 100 AS DOUBLE) AS m3, CAST(CAST(sum(CAST(mov AS HUGEINT) * mov) AS DOUBLE) / 10000 AS DOUBLE) AS quad,
    first(nome_curto ORDER BY mov DESC, seq) AS n1, string_agg(nome_curto, ', ' ORDER BY mov DESC, seq) AS n3 FROM f GROUP BY ALL)),
cat AS (SELECT doc_id, categoria, CAST(sum(mov) / 100 AS DOUBLE) AS total, count(*) AS quantidade_fornecedores FROM f GROUP BY ALL),
catp AS (SELECT *, total / CAST(sum(CAST(total AS DECIMAL(18,2))) OVER (PARTITION BY doc_id) AS DOUBLE) * 100 AS pct FROM cat)"""

_DOC_RULES = " UNION ALL ".join(
    _concentration_rules("doc_id", "con", "catp", "base")
    + [
        _rule(7, "doc_id", "ind WHERE liquidez_corrente < 1", liquidez="printf('%.2f', liquidez_corrente)"),
        _rule(8, "doc_id", "ind WHERE caixa > 0 AND passivo_circulante > 0 AND caixa / passivo_circulante >= 10", caixa=_brl("caixa"),
              razao="printf('%.0f', caixa / passivo_circulante)", passivo=_brl("passivo_circulante")),
        _rule(9, "doc_id", "ind WHERE capital_de_giro < 0", capital=_brl("abs(capital_de_giro)")),
        _rule(10, "doc_id", "ind WHERE margem_liquida >= 90", margem="printf('%.1f', margem_liquida)"),
        _rule(11, "doc_id", "ind WHERE margem_liquida < 5", margem="printf('%.1f', margem_liquida)"),
    ]
)

_D = "CAST({0} AS DOUBLE)".format
_HEADED = "tipo_doc NOT IN ('vazio', 'prosa')"
_KEY = "lpad(CAST(o_custkey AS VARCHAR), 8, '0')"

SQL = {
    "supplier_abc": f"""{SUP} SELECT empresa, periodo, ranking, nome, nome_curto, categoria, {_D('mov')} AS movimentacao_periodo,
  {_D('mov')} / {_D('total')} * 100 AS percentual_do_total, {_D('run')} / {_D('total')} * 100 AS percentual_acumulado,
  CASE WHEN run * 100 <= total * 80 OR ranking = 1 THEN 'A' WHEN run * 100 <= total * 95 THEN 'B' ELSE 'C' END AS classe_abc
FROM rk JOIN tot USING (empresa, periodo)""",
    "supplier_totals": f"""{SUP} SELECT empresa, periodo, n AS quantidade_fornecedores, {_D('total')} AS total_movimentado,
  {_D('aberto')} AS total_saldo_em_aberto, hhi AS indice_hhi FROM con""",
    "supplier_concentration": f"""{SUP} SELECT empresa, periodo, n AS quantidade_fornecedores, {_D('total')} AS total_movimentado,
  {_D('aberto')} AS total_saldo_em_aberto, hhi AS indice_hhi, n1 AS maior_fornecedor, n3 AS tres_maiores,
  p1 AS maior_fornecedor_percentual, p3 AS top_3_percentual FROM con""",
    "category_summary": f"""{SUP} SELECT empresa, periodo, categoria, {_D('total')} AS total, quantidade_fornecedores,
  pct AS percentual_do_total FROM catp""",
    "category_members": f"{SUP} SELECT empresa, periodo, categoria, nome, nome_curto, {_D('mov')} AS movimentacao_periodo FROM sup",
    "totals_rollup": f"""{SUP} SELECT empresa, periodo, CASE WHEN nivel > 0 THEN 'TOTAL' ELSE nome END AS nome,
  {_D('sum_a')} AS saldo_anterior, {_D('sum_d')} AS debito, {_D('sum_c')} AS credito, {_D('sum_s')} AS saldo_em_aberto,
  {_D('sum_m')} AS movimentacao_periodo, nivel FROM (
  SELECT empresa, periodo, nome, grouping(empresa, periodo, nome) AS nivel, sum(saldo_anterior) AS sum_a, sum(debito) AS sum_d,
    sum(credito) AS sum_c, sum(saldo_em_aberto) AS sum_s, sum(mov) AS sum_m FROM sup GROUP BY ROLLUP (empresa, periodo, nome))""",
    "last_two_periods": f"{SUP}{PERIODS} SELECT empresa, periodo, ordem FROM per WHERE ordem <= 2",
    "supplier_period_change": f"""{SUP}{PERIODS} SELECT empresa, nome, categoria, {_D('ant')} AS valor_periodo_anterior,
  {_D('atu')} AS valor_periodo_atual, {_D('atu - ant')} AS variacao_absoluta, pct AS variacao_percentual, situacao FROM var""",
    "chart_top_suppliers": f"""{SUP} SELECT empresa, periodo, ranking AS posicao, nome, {_D('mov')} AS movimentacao_periodo
FROM rk WHERE ranking <= 10""",
    "chart_changes": f"""{SUP}{PERIODS} SELECT empresa, posicao, nome, {_D('atu - ant')} AS variacao_absoluta FROM (
  SELECT *, row_number() OVER (PARTITION BY empresa ORDER BY atu - ant DESC, nome) AS posicao FROM var WHERE atu <> ant)
WHERE posicao <= 10""",
    "chart_categories": f"""{SUP} SELECT empresa, periodo, categoria || ' (' || printf('%.1f', pct) || '%)' AS rotulo, {_D('total')} AS total,
  'R$ ' || replace(format('{{:,.0f}}', {_D('total')}), ',', '.') AS valor FROM catp""",
    "period_advice": f"{SUP}{PERIODS} SELECT empresa, titulo, descricao, prioridade, regra FROM ({_PERIOD_RULES})",
    "ledger_advice": f"""{SUP} SELECT empresa, periodo, titulo, descricao, prioridade, categoria, regra FROM (
  {' UNION ALL '.join(_concentration_rules('empresa, periodo', 'con', 'catp', 'tot'))})""",
    "advice_names": f"""{SUP} SELECT empresa, periodo, 6 AS regra, categoria, row_number() OVER (PARTITION BY empresa, periodo, categoria
    ORDER BY mov DESC, seq) AS posicao, nome_curto AS nome FROM sup WHERE NOT starts_with(categoria, 'Outros')
  QUALIFY count(*) OVER (PARTITION BY empresa, periodo, categoria) >= 2""",
    "advice_order": f"""{SUP} SELECT empresa, periodo, titulo, regra, row_number() OVER (PARTITION BY empresa, periodo
    ORDER BY peso, least(regra, 14), na_regra, titulo) AS ordem
  FROM ({' UNION ALL '.join(_concentration_rules('empresa, periodo', 'con', 'catp', 'tot'))})""",
    "supplier_header": f"""WITH {SUPPLIERS} SELECT doc_id,
  CASE WHEN {_HEADED} THEN 'Cliente ' || {_KEY} || ' S.A.' ELSE 'Empresa não identificada' END AS nome,
  CASE WHEN {_HEADED} THEN substr({_KEY}, 1, 2) || '.' || substr({_KEY}, 3, 3) || '.' || substr({_KEY}, 6, 3) || '/0001-95' ELSE '' END AS cnpj,
  CASE WHEN {_HEADED} THEN strftime(dia, '%Y') || '-01-01' END AS periodo_inicio,
  CASE WHEN {_HEADED} THEN strftime(dia, '%Y-%m-%d') END AS periodo_fim,
  CASE WHEN {_HEADED} THEN '01/01/' || strftime(dia, '%Y') || ' a ' || strftime(dia, '%d/%m/%Y') ELSE 'Período não identificado' END AS periodo
FROM doc""",
    "supplier_lines": f"""WITH {SUPPLIERS} SELECT doc_id, seq, CAST(numero AS VARCHAR) AS codigo, nome AS descricao,
  CAST(ant / 100 AS DOUBLE) AS saldo_anterior, CAST(debito / 100 AS DOUBLE) AS debito, CAST(credito / 100 AS DOUBLE) AS credito,
  CAST(atual / 100 AS DOUBLE) AS saldo_atual, nat AS natureza FROM conta""",
    "supplier_section": f"""WITH {SUPPLIERS} SELECT doc_id, seq, codigo, nome, CAST(ant / 100 AS DOUBLE) AS saldo_anterior,
  CAST(debito / 100 AS DOUBLE) AS debito, CAST(credito / 100 AS DOUBLE) AS credito, CAST(atual / 100 AS DOUBLE) AS saldo_em_aberto FROM forn""",
    "account_lookup": f"{IND} SELECT doc_id, caixa AS saldo FROM base",
    "indicators": f"{IND} SELECT * FROM base",
    "indicators_derived": f"""{IND} SELECT doc_id, capital_de_giro, liquidez_corrente, grau_endividamento, margem_liquida,
  participacao_caixa_no_ativo, CASE WHEN liquidez_corrente >= 1.5 THEN 'saudável' WHEN liquidez_corrente >= 1 THEN 'apertada'
  WHEN liquidez_corrente IS NOT NULL THEN 'crítica' END AS rotulo_liquidez FROM ind""",
    "advice_rules": f"{IND}{_DOC_CON} SELECT doc_id, titulo, descricao, prioridade, categoria, peso, regra FROM ({_DOC_RULES})",
}

"""SQL that states, without any parsing, what the derived documents contain."""

from __future__ import annotations

from ledgerloom import vocab
from registry.inputs import TRADES, _CHART, _HAS_RESULT, _HAS_SUPPLIERS, _SHARES


def _sql(text: str) -> str:
    return text.replace(" DIV ", " // ")


_TRADE_LIST = "[" + ", ".join(f"'{t}'" for t in TRADES) + "]"


def _row(number: int, code: str, name: str, nature: str, previous: str, amount: str, when: str) -> str:
    title = name if name.startswith("nome_") else f"'{name}'"
    before = _sql(previous) if nature == "D" else f"CASE WHEN o_orderstatus = 'P' THEN {_sql(previous)} ELSE 0 END"
    amount = _sql(amount.format(s=_HAS_SUPPLIERS))
    extra = "CASE WHEN tipo_doc = 'quebrado' THEN 100 ELSE 0 END" if name.startswith("ESTOQUE DE") else "0"
    return f"""SELECT doc_id, o_orderstatus, tipo_doc, dia, {number} AS numero, '{code}' AS classe, {title} AS nome,
  '{nature}' AS nat, {before} AS ant, ({amount}) - ({before}) AS mov, ({amount}) + {extra} AS atual
  FROM doc WHERE {_sql(when)} AND tipo_doc NOT IN ('vazio', 'prosa', 'layout')"""


DOC = f"""
doc AS (
  SELECT *,
    capital + CASE WHEN {_HAS_SUPPLIERS} THEN forn_um + forn_dois + t ELSE 0 END
      - (estoque + imobilizado + CASE WHEN {_HAS_RESULT} THEN icms + frete + energia + salarios + materia ELSE 0 END) AS caixa,
    CASE WHEN tipo_doc = 'desbalanceado' THEN 500 ELSE 0 END AS sobra,
    'ALFA ' || {_TRADE_LIST}[o_custkey % {len(TRADES)} + 1] || ' LTDA' AS nome_um,
    'BETA ' || {_TRADE_LIST}[(o_custkey + 5) % {len(TRADES)} + 1] || ' EIRELI' AS nome_dois
  FROM (
    SELECT *, {', '.join(f'{_sql(v)} AS {k}' for k, v in _SHARES.items())}
    FROM (
      SELECT o_orderkey AS doc_id, o_custkey, o_orderstatus, CAST(o_orderdate AS DATE) AS dia,
        CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS t,
        CASE o_orderpriority
          WHEN '2-HIGH' THEN 'a_pagar'
          WHEN '4-NOT SPECIFIED' THEN CASE WHEN day(o_orderdate) <= 2 THEN 'vazio' ELSE 'patrimonial' END
          WHEN '3-MEDIUM' THEN CASE WHEN day(o_orderdate) <= 3 THEN 'quebrado' WHEN day(o_orderdate) <= 6 THEN 'desbalanceado'
                                    WHEN day(o_orderdate) <= 9 THEN 'layout' WHEN day(o_orderdate) <= 12 THEN 'prosa'
                                    ELSE 'completo' END
          ELSE 'completo' END AS tipo_doc
      FROM orders)))"""

ACCOUNTS = f"""{DOC},
acc0 AS ({' UNION ALL '.join(_row(i, *r) for i, r in enumerate(_CHART, start=1))}),
acc AS (
  SELECT *, CAST(5 + row_number() OVER (PARTITION BY doc_id ORDER BY numero) AS INTEGER) AS seq,
    CASE o_orderstatus WHEN 'F' THEN 'reverso' WHEN 'O' THEN 'natural' ELSE 'classificado' END AS layout,
    CASE WHEN nat = 'D' THEN mov ELSE 0 END AS debito, CASE WHEN nat = 'C' THEN mov ELSE 0 END AS credito
  FROM acc0)"""

LEAVES = f"""{ACCOUNTS},
cima AS MATERIALIZED (SELECT doc_id, classe, array_to_string(partes[1:k], '.') AS acima
  FROM (SELECT doc_id, classe, partes, unnest(range(1, len(partes))) AS k
        FROM (SELECT DISTINCT doc_id, classe, string_split(classe, '.') AS partes FROM acc))),
pais AS MATERIALIZED (SELECT DISTINCT doc_id, acima AS classe FROM cima),
leaf AS MATERIALIZED (SELECT * FROM acc ANTI JOIN pais USING (doc_id, classe)),
above AS MATERIALIZED (SELECT c.doc_id, c.classe, string_agg(a.nome, ' > ' ORDER BY length(a.classe)) AS caminho
  FROM cima c JOIN acc a ON a.doc_id = c.doc_id AND a.classe = c.acima GROUP BY ALL),
folha AS MATERIALIZED (SELECT l.*, coalesce(caminho, '') AS caminho FROM leaf l LEFT JOIN above USING (doc_id, classe))"""


def _either(words) -> str:
    return "|".join(words)


CATEGORY = (
    "CASE " + " ".join(f"WHEN regexp_matches(texto, '{_either(words)}') THEN '{name}'" for name, words in vocab.LEDGER_CATEGORY_WORDS) + " ELSE 'outros' END"
)
_EXPENSE = _either(vocab.EXPENSE_WORDS)
_REVENUE = vocab.REVENUE_PATTERN.removeprefix("(?U)")

ENTRIES = f"""{LEAVES},
tipada AS (
  SELECT *, CASE
      WHEN regexp_matches(own, 'estoque inicial|estoque final') THEN NULL
      WHEN regexp_matches(up, '{_EXPENSE}') THEN CASE WHEN nat = 'D' THEN 'despesa resultado' END
      WHEN regexp_matches(up, '{_REVENUE}')
        OR regexp_matches(own, '{_REVENUE}')
        THEN CASE WHEN starts_with(nome, '(-)') THEN CASE WHEN nat = 'D' THEN 'despesa resultado' END
                  WHEN nat = 'C' THEN 'receita resultado' END
      WHEN contains(up, 'fornecedor') THEN 'despesa fornecedor_pagavel' END AS tipo_origem,
    own || ' ' || up AS texto
  FROM (SELECT *, lower(strip_accents(nome)) AS own, lower(strip_accents(replace(caminho, ' > ', ' '))) AS up
        FROM folha WHERE tipo_doc <> 'quebrado')),
entrada AS (
  SELECT doc_id, tipo_doc, dia, numero, nome, caminho, atual, split_part(tipo_origem, ' ', 1) AS tipo,
    split_part(tipo_origem, ' ', 2) AS origem, {CATEGORY} AS categoria
  FROM tipada WHERE tipo_origem IS NOT NULL
  QUALIFY NOT (tipo_origem = 'despesa fornecedor_pagavel'
    AND coalesce(max(tipo_origem = 'despesa resultado') OVER (PARTITION BY doc_id), false)))"""

STATUS = """CASE tipo_doc WHEN 'vazio' THEN 'NOT_ACCOUNTING' WHEN 'prosa' THEN 'NOT_ACCOUNTING'
  WHEN 'layout' THEN 'UNKNOWN_LAYOUT' WHEN 'quebrado' THEN 'NOT_RECONCILED' WHEN 'desbalanceado' THEN 'NOT_BALANCED'
  WHEN 'patrimonial' THEN 'EMPTY' ELSE 'OK' END"""

SUPPLIERS = f"""{ACCOUNTS},
conta AS (SELECT * FROM acc WHERE layout = 'natural'),
forn AS (SELECT doc_id, seq, CAST(numero AS VARCHAR) AS codigo, nome, ant, debito, credito, atual
  FROM conta WHERE classe IN ('2.1.1.01', '2.1.1.02'))"""

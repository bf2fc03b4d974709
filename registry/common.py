"""What the registered queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BY = ["empresa", "periodo"]


def plain(df: DataFrame, *columns: str) -> DataFrame:
    """Money as double and dates as ISO text, so that both engines hand over the same types."""
    names = columns or df.columns
    kinds = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for name in names:
        c = F.col(name)
        if isinstance(kinds[name], T.DecimalType):
            c = c.cast("double")
        elif isinstance(kinds[name], (T.DateType, T.TimestampType)):
            c = F.date_format(c, "yyyy-MM-dd")
        out.append(c.alias(name))
    return df.select(*out)


LEDGER = """
ledger AS (
  SELECT c_mktsegment AS empresa, CAST(year(l_shipdate) AS INTEGER) AS periodo,
         CAST(l_shipdate AS DATE) AS data,
         CASE WHEN l_returnflag = 'R' THEN 'receita' ELSE 'despesa' END AS tipo,
         CASE p_type WHEN 'STANDARD' THEN 'mercadorias' WHEN 'SMALL' THEN 'energia'
              WHEN 'MEDIUM' THEN 'aluguel' WHEN 'LARGE' THEN 'folha'
              WHEN 'ECONOMY' THEN 'transporte' WHEN 'PROMO' THEN 'servicos' END AS categoria,
         s_name AS fornecedor, p_name AS produto,
         CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,2)) AS valor
  FROM lineitem
  JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
)"""

SPEND = """
spend AS (
  SELECT empresa, periodo, categoria, CAST(sum(valor) AS DECIMAL(18,2)) AS gasto
  FROM ledger WHERE tipo = 'despesa' GROUP BY ALL
),
chaves AS (SELECT DISTINCT empresa, periodo FROM ledger),
budget AS (
  SELECT empresa, periodo + 1 AS periodo, categoria,
         CAST(gasto * CASE categoria WHEN 'mercadorias' THEN CAST(0.95 AS DECIMAL(4,2))
           WHEN 'energia' THEN CAST(0.80 AS DECIMAL(4,2)) WHEN 'aluguel' THEN CAST(1.05 AS DECIMAL(4,2))
           WHEN 'folha' THEN CAST(0.70 AS DECIMAL(4,2)) WHEN 'transporte' THEN CAST(0.60 AS DECIMAL(4,2))
           WHEN 'servicos' THEN CAST(0.90 AS DECIMAL(4,2)) END AS DECIMAL(18,2)) AS referencia
  FROM spend
),
history AS (SELECT empresa, periodo + 1 AS periodo, categoria, gasto AS referencia FROM spend)"""


def _variation(base: str, table: str) -> str:
    return f"""
  SELECT empresa, periodo, categoria, atual, ref,
         CAST(atual AS DOUBLE) AS valor_atual, CAST(ref AS DOUBLE) AS valor_referencia,
         CAST(atual - ref AS DOUBLE) AS variacao_absoluta,
         CAST(printf('%.2f', CASE WHEN ref > 0
              THEN (CAST(atual AS DOUBLE) - CAST(ref AS DOUBLE)) / CAST(ref AS DOUBLE) * 100
              WHEN atual > 0 THEN 100.0 ELSE 0.0 END) AS DOUBLE) AS variacao_percentual,
         '{base}' AS base_comparacao
  FROM (
    SELECT coalesce(s.empresa, r.empresa) AS empresa, coalesce(s.periodo, r.periodo) AS periodo,
           coalesce(s.categoria, r.categoria) AS categoria,
           coalesce(gasto, 0) AS atual, coalesce(referencia, 0) AS ref
    FROM spend s FULL OUTER JOIN {table} r
      ON s.empresa = r.empresa AND s.periodo = r.periodo AND s.categoria = r.categoria
  )
  WHERE (empresa, periodo) IN (SELECT (empresa, periodo) FROM chaves)
    AND (empresa, periodo) IN (SELECT (empresa, periodo + 1) FROM chaves)"""


VARIATIONS = f"""
variations AS ({_variation('orcamento', 'budget')}
  UNION ALL {_variation('historico', 'history')}
)"""

ALERTS = """
alerts AS (
  SELECT *, CASE severidade WHEN 'critica' THEN 0 WHEN 'alta' THEN 1 WHEN 'media' THEN 2 ELSE 3 END AS ordem_severidade,
         CASE base_comparacao WHEN 'orcamento' THEN 0 ELSE 1 END AS ordem_base,
         CASE base_comparacao WHEN 'orcamento' THEN 'estouro_orcamento' ELSE 'variacao_historica' END AS tipo,
         'Categoria ''' || categoria || ''' '
           || CASE base_comparacao WHEN 'orcamento' THEN 'estourou o orçamento'
                   ELSE 'aumentou frente ao período anterior' END
           || ': R$ ' || printf('%.2f', valor_atual) || ' vs R$ ' || printf('%.2f', valor_referencia)
           || ' (' || printf('%+.1f', variacao_percentual) || '%).' AS mensagem
  FROM (
    SELECT *, CASE WHEN variacao_percentual >= 50 THEN 'critica' WHEN variacao_percentual >= 35 THEN 'alta'
                   WHEN variacao_percentual >= 20 THEN 'media' WHEN variacao_percentual >= 10 THEN 'baixa' END AS severidade
    FROM variations)
  WHERE severidade IS NOT NULL
)"""

FULL = f"WITH {LEDGER}, {SPEND}, {VARIATIONS}, {ALERTS}"

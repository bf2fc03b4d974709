"""Trial-balance documents: parsing, hierarchy, classification, status."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions.dates import period_end
from ledgerloom.operators import headers, hierarchy
from ledgerloom.operators.layouts import KNOWN_LAYOUTS, item_rows, measures_of, money
from ledgerloom.operators.results import profit_and_loss
from registry.inputs import documents
from ledgerloom.plans.trial_balance import build_trees, classify_documents, parse_documents, read_trial_balance
from ledgerloom.session import stored
from registry.common import plain
from registry.docs_sql import ACCOUNTS, DOC, ENTRIES, LEAVES, STATUS

FALLBACK = "2000-01-01"


def _read(spark, folder):
    return read_trial_balance(documents(spark, folder), fallback_date=FALLBACK)


def doc_type(spark, folder):
    return documents(spark, folder).select("doc_id", headers.document_type(F.col("texto")).alias("tipo"))


def header_metadata(spark, folder):
    return documents(spark, folder).withColumns(headers.header_fields(F.col("texto"))).drop("texto")


def period_dates(spark, folder):
    return documents(spark, folder).select("doc_id", period_end(F.col("texto"), F.lit(FALLBACK)).alias("data"))


def text_sufficiency(spark, folder):
    return documents(spark, folder).select("doc_id", headers.too_little_text(F.col("texto")).cast("int").alias("precisa_ocr"))


def account_lines(spark, folder):
    parsed = parse_documents(documents(spark, folder))
    rows = item_rows(parsed, ["doc_id"], F.col("leitura.contas"))
    amounts = ("saldo_anterior", "debito", "credito", "saldo_atual")
    return plain(rows.select("doc_id", "c.*").withColumns({a: money(F.col(a)) for a in amounts}))


def layout_election(spark, folder):
    parsed = parse_documents(documents(spark, folder))
    return parsed.select("doc_id", F.col("leitura.layout").alias("layout"), F.size("leitura.contas").alias("contas"))


def reconciliation(spark, folder):
    """Accounts found and reconciled under every layout that found any."""
    measured = documents(spark, folder).select("doc_id", measures_of(F.col("texto"), KNOWN_LAYOUTS).alias("medidas"))
    tried = measured.select("doc_id", F.posexplode_outer("medidas").alias("layout_no", "m"))
    return tried.filter(F.col("m.contas") > 0).select("doc_id", "layout_no", "m.contas", "m.reconciliadas")


def doc_status(spark, folder):
    found = _read(spark, folder).status
    return found.select("doc_id", "status", "layout", "contas", F.col("precisa_ocr").cast("int").alias("precisa_ocr"))


def rejection_reason(spark, folder):
    return _read(spark, folder).status.filter(F.col("motivo").isNotNull()).select("doc_id", "motivo")


def hierarchy_method(spark, folder):
    parsed = parse_documents(documents(spark, folder))
    return parsed.select("doc_id", hierarchy.hierarchy_method(F.col("leitura.contas")).alias("metodo"))


def _account_table(spark, folder):
    """The accounts as a stored table: the joins on it read it several times, and each time
    would parse all texts again."""
    kept = _read(spark, folder).contas.select("doc_id", "seq", "classificacao", "descricao", "saldo_atual")
    return stored(kept, "accounts")


def leaves_by_class(spark, folder):
    found = hierarchy.leaves_by_class(_account_table(spark, folder), ["doc_id"])
    return plain(found.select("doc_id", "seq", "classificacao", "descricao", "saldo_atual"))


def ancestor_path(spark, folder):
    found = hierarchy.ancestor_paths(_account_table(spark, folder), ["doc_id"])
    path = hierarchy.account_path(F.col("ancestrais"), F.col("descricao"))
    return found.select("doc_id", "seq", "classificacao", path.alias("caminho"))


def leaves_by_value(spark, folder):
    found = _read(spark, folder).folhas.filter(F.col("classificacao").isNull())
    path = hierarchy.account_path(F.col("ancestrais"), F.col("descricao"))
    return plain(found.select("doc_id", "seq", "codigo", path.alias("caminho"), "saldo_atual", "natureza"))


def document_leaves(spark, folder):
    found = _read(spark, folder).folhas
    path = hierarchy.account_path(F.col("ancestrais"), F.col("descricao"))
    return plain(found.select("doc_id", "seq", path.alias("caminho"), "saldo_atual"))


def identity_check(spark, folder):
    done = _read(spark, folder).documentos.select(
        "doc_id", F.col("resultado.totais").alias("t"), F.size("leitura.contas").alias("n"), "leitura.falha"
    )
    kept = done.filter(F.col("falha").isNull() & (F.col("n") > 0))
    return plain(
        kept.select(
            "doc_id", money(F.col("t.devedor")).alias("devedor"), money(F.col("t.credor")).alias("credor"),
            hierarchy.is_balanced(F.col("t")).cast("int").alias("fecha"),
        )
    )


def classify_leaves(spark, folder):
    done = classify_documents(build_trees(parse_documents(documents(spark, folder), with_trees=True)))
    rows = item_rows(done, ["doc_id"], F.col("resultado.entradas"))
    return rows.select(
        "doc_id", "c.codigo", "c.descricao", F.col("c.entrada.tipo").alias("tipo"), F.col("c.entrada.origem").alias("origem")
    )


def trial_balance_ledger(spark, folder):
    return plain(_read(spark, folder).lancamentos)


def trial_balance_pnl(spark, folder):
    """From text to profit and loss of every document."""
    return plain(profit_and_loss(_read(spark, folder).lancamentos, ["doc_id"]))


QUERIES = {
    "doc_type": doc_type,
    "header_metadata": header_metadata,
    "period_end": period_dates,
    "text_sufficiency": text_sufficiency,
    "account_lines": account_lines,
    "layout_election": layout_election,
    "reconciliation": reconciliation,
    "doc_status": doc_status,
    "rejection_reason": rejection_reason,
    "hierarchy_method": hierarchy_method,
    "leaves_by_class": leaves_by_class,
    "ancestor_path": ancestor_path,
    "leaves_by_value": leaves_by_value,
    "document_leaves": document_leaves,
    "identity_check": identity_check,
    "classify_leaves": classify_leaves,
    "trial_balance_ledger": trial_balance_ledger,
    "trial_balance_pnl": trial_balance_pnl,
}

_HEADED = "tipo_doc NOT IN ('vazio', 'prosa')"
_DAY = "strftime(dia, '%d/%m/%Y')"
_CNPJ = "substr(lpad(CAST(o_custkey AS VARCHAR), 8, '0'), 1, 2) || '.' || substr(lpad(CAST(o_custkey AS VARCHAR), 8, '0'), 3, 3) || '.' || substr(lpad(CAST(o_custkey AS VARCHAR), 8, '0'), 6, 3) || '/0001-95'"

SQL = {
    "doc_type": f"WITH {DOC} SELECT doc_id, CASE WHEN {_HEADED} THEN 'BALANCETE' ELSE 'DESCONHECIDO' END AS tipo FROM doc",
    "header_metadata": f"""WITH {DOC} SELECT doc_id,
  CASE WHEN {_HEADED} THEN 'Cliente  ' || lpad(CAST(o_custkey AS VARCHAR), 8, '0') || ' S.A.  Folha: 0001' END AS empresa,
  CASE WHEN {_HEADED} THEN {_CNPJ} END AS cnpj,
  CASE WHEN {_HEADED} THEN '01/01/' || strftime(dia, '%Y') || ' - ' || {_DAY} END AS periodo,
  CASE WHEN {_HEADED} THEN {_DAY} END AS data_emissao, CAST(NULL AS VARCHAR) AS numero_livro,
  CASE WHEN {_HEADED} THEN '0001' END AS folha, CASE WHEN {_HEADED} THEN 'Razonete Contabil' END AS sistema_emissor
FROM doc""",
    "period_end": f"WITH {DOC} SELECT doc_id, CASE WHEN {_HEADED} THEN strftime(dia, '%Y-%m-%d') ELSE '{FALLBACK}' END AS data FROM doc",
    "text_sufficiency": f"WITH {DOC} SELECT doc_id, CASE WHEN tipo_doc = 'vazio' THEN 1 ELSE 0 END AS precisa_ocr FROM doc",
    "account_lines": f"""WITH {ACCOUNTS} SELECT doc_id, seq, CAST(numero AS VARCHAR) AS codigo,
  CASE WHEN layout = 'classificado' THEN classe END AS classificacao, nome AS descricao, CAST(ant / 100 AS DOUBLE) AS saldo_anterior,
  CASE WHEN layout = 'classificado' AND ant <> 0 THEN nat END AS natureza_anterior, CAST(debito / 100 AS DOUBLE) AS debito,
  CAST(credito / 100 AS DOUBLE) AS credito, CAST(atual / 100 AS DOUBLE) AS saldo_atual, nat AS natureza FROM acc""",
    "layout_election": f"""WITH {ACCOUNTS} SELECT doc_id, layout, coalesce(n, 0) AS contas FROM doc
  LEFT JOIN (SELECT doc_id, layout, count(*) AS n FROM acc GROUP BY ALL) USING (doc_id)""",
    "reconciliation": f"""WITH {ACCOUNTS} SELECT doc_id, CASE layout WHEN 'reverso' THEN 0 WHEN 'natural' THEN 1 ELSE 2 END AS layout_no,
  count(*) AS contas, count(*) FILTER (CASE nat WHEN 'D' THEN ant + debito - credito = atual
    ELSE (CASE WHEN layout = 'classificado' THEN ant ELSE -ant END) - debito + credito = atual END) AS reconciliadas FROM acc GROUP BY ALL""",
    "doc_status": f"""WITH {ACCOUNTS} SELECT doc_id, {STATUS} AS status, layout, coalesce(n, 0) AS contas,
  CASE WHEN tipo_doc = 'vazio' THEN 1 ELSE 0 END AS precisa_ocr FROM doc
  LEFT JOIN (SELECT doc_id, layout, count(*) AS n FROM acc GROUP BY ALL) USING (doc_id)""",
    "rejection_reason": f"""WITH {LEAVES}, soma AS (SELECT doc_id, sum(CASE WHEN nat = 'D' THEN atual ELSE 0 END) AS d,
    sum(CASE WHEN nat = 'C' THEN atual ELSE 0 END) AS c FROM folha GROUP BY ALL)
SELECT doc_id, CASE {STATUS}
  WHEN 'NOT_ACCOUNTING' THEN 'Nenhuma conta reconhecida e nenhum termo contábil no texto.'
  WHEN 'UNKNOWN_LAYOUT' THEN 'Documento identificado como BALANCETE, mas com layout de colunas desconhecido.'
  WHEN 'NOT_RECONCILED' THEN 'Conta ''4 ESTOQUE DE MERCADORIAS'' não reconcilia.'
  WHEN 'NOT_BALANCED' THEN 'Total devedor ' || printf('%.2f', d / 100) || ' não bate com o total credor ' || printf('%.2f', c / 100) || '.'
  WHEN 'EMPTY' THEN 'Nenhuma conta de receita ou despesa identificada.' END AS motivo
FROM doc LEFT JOIN soma USING (doc_id) WHERE {STATUS} <> 'OK'""",
    "hierarchy_method": f"""WITH {ACCOUNTS} SELECT doc_id, CASE layout WHEN 'classificado' THEN 'classe' WHEN 'reverso' THEN 'valor'
  WHEN 'natural' THEN 'valor' END AS metodo FROM doc LEFT JOIN (SELECT DISTINCT doc_id, layout FROM acc) USING (doc_id)""",
    "leaves_by_class": f"""WITH {LEAVES} SELECT doc_id, seq, classe AS classificacao, nome AS descricao,
  CAST(atual / 100 AS DOUBLE) AS saldo_atual FROM leaf WHERE layout = 'classificado'""",
    "ancestor_path": f"""WITH {LEAVES} SELECT doc_id, seq, classe AS classificacao, caminho || ' > ' || nome AS caminho
FROM folha WHERE layout = 'classificado'""",
    "leaves_by_value": f"""WITH {LEAVES} SELECT doc_id, seq, CAST(numero AS VARCHAR) AS codigo, caminho || ' > ' || nome AS caminho,
  CAST(atual / 100 AS DOUBLE) AS saldo_atual, nat AS natureza FROM folha WHERE layout <> 'classificado' AND tipo_doc <> 'quebrado'""",
    "document_leaves": f"""WITH {LEAVES} SELECT doc_id, seq, caminho || ' > ' || nome AS caminho,
  CAST(atual / 100 AS DOUBLE) AS saldo_atual FROM folha WHERE tipo_doc <> 'quebrado'""",
    "identity_check": f"""WITH {LEAVES}, s AS (SELECT doc_id, CAST(sum(CASE WHEN nat = 'D' THEN atual ELSE 0 END) AS BIGINT) AS d,
  CAST(sum(CASE WHEN nat = 'C' THEN atual ELSE 0 END) AS BIGINT) AS c FROM folha WHERE tipo_doc <> 'quebrado' GROUP BY ALL)
SELECT doc_id, CAST(d / 100 AS DOUBLE) AS devedor, CAST(c / 100 AS DOUBLE) AS credor, CASE WHEN abs(d - c) < 100 THEN 1 ELSE 0 END AS fecha FROM s""",
    "classify_leaves": f"WITH {ENTRIES} SELECT doc_id, CAST(numero AS VARCHAR) AS codigo, nome AS descricao, tipo, origem FROM entrada",
    "trial_balance_ledger": f"""WITH {ENTRIES} SELECT doc_id, strftime(dia, '%Y-%m-%d') AS data, tipo, categoria, nome AS fornecedor,
  CAST(atual / 100 AS DOUBLE) AS valor, caminho || ' > ' || nome AS descricao FROM entrada WHERE {STATUS} = 'OK'""",
    "trial_balance_pnl": f"""WITH {ENTRIES}, s AS (SELECT doc_id, CAST(sum(CASE WHEN tipo = 'receita' THEN atual ELSE 0 END) AS BIGINT) AS r,
  CAST(sum(CASE WHEN tipo = 'despesa' THEN atual ELSE 0 END) AS BIGINT) AS d FROM entrada WHERE {STATUS} = 'OK' GROUP BY ALL)
SELECT doc_id, CAST(r / 100 AS DOUBLE) AS receita_total, CAST(d / 100 AS DOUBLE) AS despesa_total, CAST((r - d) / 100 AS DOUBLE) AS resultado,
  CASE WHEN r > d THEN 'lucro' WHEN r < d THEN 'prejuizo' ELSE 'equilibrio' END AS situacao,
  CASE WHEN r > 0 THEN CAST(printf('%.2f', ((r - d) / 100) / (r / 100) * 100) AS DOUBLE) END AS margem_percentual FROM s""",
}

"""Statements, cleaning and column names over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import cleaning, columns, quality, statement, typing
from registry.inputs import documents, table
from registry.common import plain


def _part_text(spark, folder):
    """Part names and keys in the ways code and description stand together."""
    part = table(spark, folder, "part")
    name, key, kind = F.upper("p_name"), F.col("p_partkey").cast("string"), F.col("p_type")
    written = (
        F.when(kind == "STANDARD", F.concat(key, F.lit(" "), "p_name"))
        .when(kind == "SMALL", F.concat(name, F.lit(" "), key))
        .when(kind == "MEDIUM", F.concat(name, F.lit(" "), key, F.lit(" "), name))
        .when(kind == "LARGE", F.concat(F.lit("CAIXA"), key, F.lit(" CAIXA")))
        .when(kind == "ECONOMY", F.concat(F.lit("  "), name, F.lit("  ")))
        .otherwise(F.concat(key, F.lit("-"), name))
    )
    return part.select("p_partkey", written.alias("texto"))


def code_description(spark, folder):
    rows = _part_text(spark, folder)
    return rows.select("p_partkey", statement.split_code(F.col("texto")).alias("r")).select("p_partkey", "r.*")


def _statement_docs(spark, folder):
    part = table(spark, folder, "part")
    price = F.translate(F.format_number(F.col("p_retailprice").cast("decimal(18,2)"), 2), ",.", ".,")
    size = F.concat(F.col("p_size").cast("string"), F.lit(",50"))
    key = F.col("p_partkey").cast("string")
    text = F.concat(
        F.lit("Razao\n"), key, F.lit(" "), F.upper("p_name"), F.lit(" "), size, F.lit(" "), price, F.lit(" 0,00 ("), price, F.lit(")\n"),
        F.lit("TOTAL GERAL "), price, F.lit("\nx\n"), F.upper("p_name"), F.lit(" "), key,
    )
    return part.select("p_partkey", text.alias("texto"))


def statement_lines(spark, folder):
    return plain(statement.statement_lines(_statement_docs(spark, folder), ["p_partkey"]))


def statement_lines_legacy(spark, folder):
    return plain(statement.statement_lines(_statement_docs(spark, folder), ["p_partkey"], legacy_order=True))


def _raw_accounts(spark, folder):
    """Accounts as a table of loose text under the names a spreadsheet uses."""
    part = table(spark, folder, "part")
    price = F.translate(F.format_number(F.col("p_retailprice").cast("decimal(18,2)"), 2), ",.", ".,")
    kind = F.col("p_type")
    return part.select(
        F.col("p_partkey").alias("linha"),
        F.when(kind == "SMALL", "BALANCETE").when(kind == "LARGE", "DRE").otherwise("LIVRO_RAZAO").alias("document_type"),
        F.when(kind == "STANDARD", F.col("p_partkey").cast("string")).alias("Cód."),
        F.when(kind != "PROMO", F.concat(F.col("p_partkey").cast("string"), F.lit("  "), "p_name")).alias("Histórico"),
        F.concat(price, F.when(kind == "SMALL", "C").when(kind == "MEDIUM", "d").otherwise("")).alias("Saldo Ant."),
        F.lit("0,00").alias("Déb."),
        F.when(kind == "LARGE", "n/d").otherwise("1.000,00").alias("Créd."),
        F.when(kind == "ECONOMY", F.concat(F.lit("("), price, F.lit(")"))).otherwise(price).alias("Saldo Final"),
    )


def alias_rename(spark, folder):
    return columns.rename_by_alias(_raw_accounts(spark, folder), ["linha", "document_type"])


def standard_rows(spark, folder):
    named = columns.rename_by_alias(_raw_accounts(spark, folder), ["linha", "document_type"])
    return plain(statement.standard_rows(named, ["linha"]))


def layout_routing(spark, folder):
    named = columns.rename_by_alias(_raw_accounts(spark, folder), ["linha", "document_type"])
    return plain(statement.route(named, ["linha", "document_type"]))


def normalized_rows(spark, folder):
    raw = _raw_accounts(spark, folder).withColumn("Data", F.when(F.col("document_type") == "DRE", "30/02/2024").otherwise("29/02/2024"))
    done = typing.normalize(raw, ["linha", "document_type"])
    return plain(done.withColumn("erros", F.array_join(F.transform("erros", lambda e: F.concat_ws(":", e["coluna"], e["erro"], e["motivo"])), ";")))


def _raw_events(spark, folder):
    """Events as dirty rows: blanks, copies, control characters, a useless column."""
    events = table(spark, folder, "events")
    kind = F.col("event_type")
    return events.select(
        F.col("user_id").alias("doc_id"), F.col("event_id").alias("linha"),
        F.when(kind != "error", F.concat(F.lit(" "), kind, F.lit("\n\u0007  x "))).alias("historico"),
        F.when(kind == "error", F.lit(" ")).otherwise(F.floor(F.col("value") / 50).cast("string")).alias("valor"),
        F.lit(None).cast("string").alias("vazia"),
        F.lit("7").alias("Unnamed: 3"),
    )


def clean_rows(spark, folder):
    return cleaning.clean(_raw_events(spark, folder).drop("Unnamed: 3"), ["doc_id"]).linhas


def clean_warnings(spark, folder):
    return cleaning.clean(_raw_events(spark, folder).drop("vazia"), ["doc_id"]).avisos


def renumbered_rows(spark, folder):
    rows = cleaning.clean(_raw_events(spark, folder).drop("Unnamed: 3"), ["doc_id"]).linhas
    return cleaning.renumber(rows, ["doc_id"])


def table_quality(spark, folder):
    raw = _raw_events(spark, folder).select("doc_id", "linha", F.col("historico").alias("descricao"), F.col("valor"))
    typed = typing.normalize(raw, ["doc_id", "linha"])
    stats = quality.quality_statistics(typed, ["doc_id"], ["descricao", "valor"], "categoria_normalizada")
    return stats.withColumn("categorias_identificadas", F.array_join("categorias_identificadas", ","))


def text_columns(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", F.col("text").alias("texto"))
    cells = statement.text_columns(docs, ["doc_id"])
    return cells.groupBy("doc_id", "coluna").agg(
        F.count(F.lit(1)).alias("celulas"), F.sum(F.length("valor")).alias("letras"), F.max("valor").alias("maior")
    )


def sheet_preview(spark, folder):
    orders = table(spark, folder, "orders")
    return statement.sheet_preview(orders, ["o_custkey"], "o_orderkey", ["o_orderkey", "o_orderstatus", "o_orderpriority"], n=3)


QUERIES = {
    "code_description": code_description,
    "statement_lines": statement_lines,
    "statement_lines_legacy": statement_lines_legacy,
    "alias_rename": alias_rename,
    "standard_rows": standard_rows,
    "layout_routing": layout_routing,
    "normalized_rows": normalized_rows,
    "clean_rows": clean_rows,
    "clean_warnings": clean_warnings,
    "renumbered_rows": renumbered_rows,
    "table_quality": table_quality,
    "text_columns": text_columns,
    "sheet_preview": sheet_preview,
}

_RAW = """raw AS (SELECT p_partkey AS linha, p_type, CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DOUBLE) AS v, p_name,
  CASE p_type WHEN 'SMALL' THEN 'BALANCETE' WHEN 'LARGE' THEN 'DRE' ELSE 'LIVRO_RAZAO' END AS document_type,
  replace(replace(replace(format('{:,.2f}', CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DOUBLE)), ',', '_'), '.', ','), '_', '.') AS br FROM part)"""
_STANDARD = """CAST(linha AS VARCHAR) AS codigo,
  upper(CASE WHEN p_type = 'STANDARD' THEN linha || ' ' || p_name ELSE p_name END) AS descricao, v AS saldo_anterior, 0.0 AS debito,
  CASE WHEN p_type <> 'LARGE' THEN 1000.0 END AS credito, CASE WHEN p_type = 'ECONOMY' THEN -v ELSE v END AS saldo_atual,
  CASE WHEN p_type = 'SMALL' THEN 'C' WHEN p_type = 'MEDIUM' THEN 'D' WHEN p_type = 'ECONOMY' THEN 'C' ELSE 'D' END AS natureza"""
_EVENTS = """ev AS (SELECT user_id AS doc_id, event_id AS linha, event_type, CASE WHEN event_type <> 'error' THEN event_type || ' x' END AS historico,
  CASE WHEN event_type <> 'error' THEN CAST(CAST(floor(value / 50) AS BIGINT) AS VARCHAR) END AS valor FROM events),
uniq AS (SELECT doc_id, min(linha) AS linha, historico, valor, count(*) AS n FROM ev WHERE historico IS NOT NULL GROUP BY doc_id, historico, valor)"""

SQL = {
    "code_description": """SELECT p_partkey, CASE WHEN p_type IN ('STANDARD', 'SMALL', 'MEDIUM', 'LARGE') THEN CAST(p_partkey AS VARCHAR) END AS codigo,
  CASE p_type WHEN 'LARGE' THEN 'CAIXA' WHEN 'PROMO' THEN p_partkey || '-' || upper(p_name) ELSE upper(p_name) END AS descricao FROM part""",
    "statement_lines": f"""WITH {_RAW}, s AS (SELECT raw.*, p_size FROM raw JOIN part ON p_partkey = linha)
SELECT linha AS p_partkey, 2 AS linha, CAST(linha AS VARCHAR) AS codigo, upper(p_name) AS descricao, p_size + 0.5 AS saldo_anterior, v AS debito, 0.0 AS credito, -v AS saldo_atual FROM s
UNION ALL SELECT linha, 3, NULL, 'TOTAL GERAL', NULL, NULL, NULL, v FROM s
UNION ALL SELECT linha, 5, CAST(linha AS VARCHAR), upper(p_name), NULL, NULL, NULL, NULL FROM s""",
    "statement_lines_legacy": f"""WITH {_RAW}, s AS (SELECT raw.*, p_size FROM raw JOIN part ON p_partkey = linha)
SELECT linha AS p_partkey, 2 AS linha, CAST(linha AS VARCHAR) AS codigo, upper(p_name) || ' ' || p_size || ',50 ' || br || ' 0,00 (' || br || ')' AS descricao,
  CAST(NULL AS DOUBLE) AS saldo_anterior, CAST(NULL AS DOUBLE) AS debito, CAST(NULL AS DOUBLE) AS credito, CAST(NULL AS DOUBLE) AS saldo_atual FROM s
UNION ALL SELECT linha, 3, NULL, 'TOTAL GERAL', NULL, NULL, NULL, CAST(right(br, 1) AS DOUBLE) FROM s
UNION ALL SELECT linha, 5, CAST(linha AS VARCHAR), upper(p_name), NULL, NULL, NULL, NULL FROM s""",
    "alias_rename": f"""WITH {_RAW} SELECT linha, document_type, CASE WHEN p_type = 'STANDARD' THEN CAST(linha AS VARCHAR) END AS codigo,
  CASE WHEN p_type <> 'PROMO' THEN linha || '  ' || p_name END AS descricao,
  br || CASE p_type WHEN 'SMALL' THEN 'C' WHEN 'MEDIUM' THEN 'd' ELSE '' END AS saldo_anterior, '0,00' AS debito,
  CASE WHEN p_type = 'LARGE' THEN 'n/d' ELSE '1.000,00' END AS credito, CASE WHEN p_type = 'ECONOMY' THEN '(' || br || ')' ELSE br END AS saldo_atual FROM raw""",
    "standard_rows": f"WITH {_RAW} SELECT linha, {_STANDARD} FROM raw WHERE p_type <> 'PROMO'",
    "layout_routing": f"WITH {_RAW} SELECT linha, document_type, {_STANDARD} FROM raw WHERE p_type <> 'PROMO'",
    "normalized_rows": f"""WITH {_RAW} SELECT linha, document_type, CASE WHEN p_type = 'STANDARD' THEN CAST(linha AS VARCHAR) END AS codigo,
  CASE WHEN p_type <> 'PROMO' THEN linha || ' ' || upper(p_name) END AS descricao, v AS saldo_anterior, 0.0 AS debito,
  CASE WHEN p_type <> 'LARGE' THEN 1000.0 END AS credito, CASE WHEN p_type = 'ECONOMY' THEN -v ELSE v END AS saldo_atual,
  CASE WHEN document_type <> 'DRE' THEN '2024-02-29' END AS data,
  CASE WHEN p_type = 'LARGE' THEN 'credito:VALOR_INVALIDO:n/d;data:DATA_INVALIDA:30/02/2024' ELSE '' END AS erros,
  CASE WHEN p_type <> 'PROMO' THEN 'OUTROS' END AS categoria_normalizada FROM raw""",
    "clean_rows": f"WITH {_EVENTS} SELECT doc_id, linha, historico, valor FROM uniq",
    "clean_warnings": f"""WITH {_EVENTS} SELECT doc_id, count(*) || ' linhas vazias removidas.' AS mensagem FROM ev WHERE historico IS NULL GROUP BY doc_id
UNION ALL SELECT doc_id, sum(n - 1) || ' duplicatas removidas.' FROM uniq GROUP BY doc_id HAVING sum(n - 1) > 0
UNION ALL SELECT DISTINCT doc_id, 'Colunas sem utilidade removidas: [''Unnamed: 3'']' FROM ev""",
    "renumbered_rows": f"""WITH {_EVENTS} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY linha) AS linha, historico, valor FROM uniq""",
    "table_quality": f"""WITH {_EVENTS} SELECT doc_id, count(*) AS linhas_validas, 0 AS linhas_invalidas,
  count(*) FILTER (event_type = 'error') * 2 AS valores_ausentes, CASE WHEN bool_or(event_type <> 'error') THEN
  string_agg(DISTINCT CASE WHEN event_type <> 'error' THEN {{cat}} END, ',' ORDER BY CASE WHEN event_type <> 'error' THEN {{cat}} END) ELSE '' END AS categorias_identificadas FROM ev GROUP BY doc_id""",
    "text_columns": r"""WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS l FROM documents),
c AS (SELECT doc_id, CASE WHEN regexp_matches(l, '\s{2,}|\t') THEN regexp_split_to_array(l, '\s{2,}|\t') ELSE regexp_split_to_array(l, '\s+') END AS cs FROM l WHERE l <> ''),
x AS (SELECT doc_id, unnest(cs) AS valor, generate_subscripts(cs, 1) - 1 AS i FROM c)
SELECT doc_id, 'col_' || i AS coluna, count(*) AS celulas, CAST(sum(length(valor)) AS BIGINT) AS letras, max(valor) AS maior FROM x GROUP BY ALL""",
    "sheet_preview": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS a,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS z FROM orders)
SELECT o_custkey, 'o_orderkey o_orderstatus o_orderpriority' || chr(10) || string_agg(o_orderkey || ' ' || o_orderstatus || ' ' || o_orderpriority, chr(10) ORDER BY o_orderkey) AS texto
FROM r WHERE a <= 3 OR z <= 3 GROUP BY o_custkey""",
}
from registry.scalars import _words  # noqa: E402
from ledgerloom import vocab  # noqa: E402

SQL["table_quality"] = SQL["table_quality"].replace("{cat}", _words(vocab.UPLOAD_CATEGORY_WORDS, "historico", "OUTROS"))

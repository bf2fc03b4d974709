"""Files written and read again, united tables, and what users add to the registries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerloom.operators import layouts, rules, statement
from ledgerloom.operators import suppliers as s
from ledgerloom.plans.trial_balance import parse_documents
from ledgerloom.session import ensure_checkpoint_dir
from ledgerloom.sources import sinks, tables
from ledgerloom.vocab import BR_NUMBER
from registry.common import BY
from registry.docs_sql import ACCOUNTS
from registry.inputs import documents, supplier_ledger, table
from registry.reports import NUMBERED, report_lines

#: Small, so that the reports of the sample tables cover several files.
LINES_PER_FILE = 20


def _new_folder(spark, name: str) -> str:
    """A new folder below the one that all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def ledger_file(spark, folder):
    """Sales lines written as a ledger file and read with no schema."""
    path = _new_folder(spark, "ledger") + ".tsv"
    line = table(spark, folder, "lineitem")
    rows = line.select(
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("data"), F.lit("Peças, avulsas").alias("categoria"),
        F.concat(F.lit('Fornecedor "'), F.col("l_suppkey").cast("string"), F.lit('"')).alias("fornecedor"),
        F.col("l_quantity").cast("decimal(18,2)").alias("valor"),
    )
    rows.write.option("header", True).option("sep", "\t").csv(path)
    read = tables.read_ledger(spark, path)
    return read.groupBy("fornecedor", "categoria").agg(
        F.count("*").alias("linhas"), F.sum(F.col("valor").cast("decimal(18,2)")).cast("double").alias("valor"), F.min("data").alias("de"), F.max("data").alias("ate")
    )


def text_folder(spark, folder):
    """A text of every customer, each a file of its own folder, read whole."""
    path = _new_folder(spark, "texts")
    customer = table(spark, folder, "customer")
    texts = customer.select(
        F.col("c_nationkey").alias("pasta"), F.concat(F.col("c_name"), F.lit("\nação de "), F.col("c_mktsegment")).alias("value"),
    )
    texts.repartition("pasta").sortWithinPartitions("pasta", "value").write.partitionBy("pasta").text(path)
    read = tables.read_texts(spark, f"{path}/pasta=*")
    return read.select(F.regexp_extract("doc_id", r"pasta=(\d+)", 1).cast("int").alias("pasta"), "texto")


def united_tables(spark, folder):
    """Suppliers and customers as one table; what one of them lacks is null."""
    supplier = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("codigo"), F.col("s_name").alias("nome"), F.col("s_acctbal").alias("saldo"))
    customer = table(spark, folder, "customer").select(F.col("c_custkey").alias("codigo"), F.col("c_mktsegment").alias("segmento"), F.col("c_name").alias("nome"))
    return tables.combine_tables([supplier, customer])


def report_files(spark, folder):
    """The numbered report of every company and year, written as text files and read again, file by file."""
    path = _new_folder(spark, "reports")
    sinks.write_lines(report_lines(spark, folder).select(*BY, "linha", "texto"), path, BY, lines_per_file=LINES_PER_FILE)
    read = spark.read.schema("value string, empresa string, periodo string, parte string").text(path, wholetext=True)
    return read.select("empresa", F.col("periodo").cast("int").alias("periodo"), F.col("parte").cast("int").alias("parte"), F.col("value").alias("texto"))


def record_files(spark, folder):
    """Quantities by supplier in a folder for each return flag, of which one is read."""
    path = _new_folder(spark, "records")
    rows = table(spark, folder, "lineitem").groupBy(F.col("l_returnflag").alias("situacao"), "l_suppkey").agg(F.sum("l_quantity").alias("quantidade"))
    sinks.write_records(rows, path, ["situacao"])
    return spark.read.parquet(path).filter(F.col("situacao") == "R").select("situacao", "l_suppkey", "quantidade")


def json_files(spark, folder):
    """JSON records in a folder for each segment, read again and parsed."""
    path = _new_folder(spark, "json")
    customer = table(spark, folder, "customer")
    records = customer.select(
        F.col("c_nationkey").alias("empresa"), F.col("c_mktsegment").alias("secao"),
        F.to_json(F.struct(F.col("c_custkey").alias("codigo"), F.col("c_name").alias("nome"), F.struct(F.col("c_acctbal").alias("valor")).alias("saldo"))).alias("json"),
    )
    sinks.write_json_lines(records, path, ["empresa"])
    read = spark.read.schema("value string, empresa int, secao string").text(path)
    parsed = read.withColumn("r", F.from_json("value", "codigo long, nome string, saldo struct<valor: double>"))
    return parsed.select("empresa", "secao", "r.codigo", "r.nome", F.col("r.saldo.valor").alias("saldo"))


_BARS = layouts.Layout("barras", rf"^(\D+) \| ({BR_NUMBER}) \| ([DC])$", ("descricao", "atual", "natureza"))


def own_layout(spark, folder):
    """Documents read with one more layout than the known ones."""
    parsed = parse_documents(documents(spark, folder), [*layouts.KNOWN_LAYOUTS, _BARS])
    return parsed.select("doc_id", F.col("leitura.layout").alias("layout"), F.size("leitura.contas").alias("contas"))


def own_rule(spark, folder):
    """Advice of a user's rule next to a known one: companies and years whose suppliers are many."""
    rows = supplier_ledger(spark, folder)
    many = rules.Rule(4, lambda x: x("quantidade_fornecedores") > 3, lambda x: {"quantidade": x("quantidade_fornecedores") * 10})
    facts = rules.Facts(rows.select(*BY).distinct(), s.concentration(rows, BY), None, None, None)
    return rules.advise(facts, BY, [rules.good_practice, many]).select(*BY, "regra", F.regexp_extract("descricao", r"apenas (\d+)", 1).alias("quantidade"))


def own_strategy(spark, folder):
    """Rows of a document type that a user's strategy standardises, next to the generic one."""
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderstatus") == "F", "EXTRATO DE TESTE").otherwise("BALANCETE").alias("document_type"),
        F.col("o_orderkey").cast("string").alias("codigo"), F.lower("o_orderpriority").alias("descricao"),
    )
    statement.register_strategy("EXTRATO DE TESTE", _marked)
    try:
        return statement.route(orders, ["doc_id"]).select("doc_id", "codigo", "descricao")
    finally:
        statement.STRATEGIES.pop("EXTRATO DE TESTE")


def _marked(df, keep):
    return df.select(*keep, F.lit("x").alias("codigo"), F.concat(F.lit("* "), F.col("descricao")).alias("descricao"))


QUERIES = {
    "ledger_file": ledger_file,
    "text_folder": text_folder,
    "united_tables": united_tables,
    "report_files": report_files,
    "record_files": record_files,
    "json_files": json_files,
    "own_layout": own_layout,
    "own_rule": own_rule,
    "own_strategy": own_strategy,
}

SQL = {
    "ledger_file": """SELECT 'Fornecedor "' || l_suppkey || '"' AS fornecedor, 'Peças, avulsas' AS categoria, count(*) AS linhas,
  CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS valor, strftime(min(l_shipdate), '%Y-%m-%d') AS de, strftime(max(l_shipdate), '%Y-%m-%d') AS ate FROM lineitem GROUP BY ALL""",
    "text_folder": """SELECT c_nationkey AS pasta, string_agg(c_name || chr(10) || 'ação de ' || c_mktsegment || chr(10), '' ORDER BY c_name || chr(10) || 'ação de ' || c_mktsegment) AS texto
FROM customer GROUP BY ALL""",
    "united_tables": """SELECT s_suppkey AS codigo, s_name AS nome, s_acctbal AS saldo, NULL AS segmento FROM supplier
UNION ALL SELECT c_custkey, c_name, NULL, c_mktsegment FROM customer""",
    "report_files": f"""{NUMBERED}, todas AS (SELECT empresa, periodo, texto, row_number() OVER (PARTITION BY empresa, periodo ORDER BY secao, lugar, k) AS linha FROM postas)
SELECT empresa, periodo, CAST((linha - 1) // {LINES_PER_FILE} AS INTEGER) AS parte, string_agg(texto || chr(10), '' ORDER BY linha) AS texto FROM todas GROUP BY ALL""",
    "record_files": "SELECT l_returnflag AS situacao, l_suppkey, sum(l_quantity) AS quantidade FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL",
    "json_files": "SELECT c_nationkey AS empresa, c_mktsegment AS secao, c_custkey AS codigo, c_name AS nome, c_acctbal AS saldo FROM customer",
    "own_layout": f"""WITH {ACCOUNTS} SELECT doc_id, CASE WHEN tipo_doc = 'layout' THEN 'barras' ELSE layout END AS layout,
  CASE WHEN tipo_doc = 'layout' THEN 2 ELSE coalesce(n, 0) END AS contas FROM doc LEFT JOIN (SELECT doc_id, layout, count(*) AS n FROM acc GROUP BY ALL) USING (doc_id)""",
    "own_rule": """WITH c AS (SELECT c_mktsegment AS empresa, CAST(year(l_shipdate) AS INTEGER) AS periodo, count(DISTINCT l_suppkey) AS n FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT empresa, periodo, 13 AS regra, '' AS quantidade FROM c UNION ALL SELECT empresa, periodo, 4, CAST(n * 10 AS VARCHAR) FROM c WHERE n > 3""",
    "own_strategy": """SELECT o_orderkey AS doc_id, CASE WHEN o_orderstatus = 'F' THEN 'x' ELSE CAST(o_orderkey AS VARCHAR) END AS codigo,
  CASE WHEN o_orderstatus = 'F' THEN '* ' || lower(o_orderpriority) ELSE upper(o_orderpriority) END AS descricao FROM orders""",
}

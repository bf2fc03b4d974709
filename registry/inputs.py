"""Ledger, budget, documents and uploads derived from the sample tables.

The sample tables hold no ledger, so these views turn sales lines into one. Every view is
a narrow map or a key join over whole tables and grows with them.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry import texts

LEDGER_COLUMNS = ("empresa", "periodo", "data", "tipo", "categoria", "fornecedor", "produto", "valor")

# how a careless bookkeeper writes the six categories
_WRITTEN = {
    "STANDARD": "Mercadorias",
    "SMALL": " ENERGIA ",
    "MEDIUM": "Aluguel",
    "LARGE": "folha",
    "ECONOMY": "TRANSPORTE",
    "PROMO": "Serviços",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt to all tasks. The sample files are one row group, so one task would read all of them and
    parse every text made from them; tables of many row groups lose little by it, as these rows are short."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), key)


def raw_ledger(spark: SparkSession, folder: str, columns: Collection[str] = LEDGER_COLUMNS) -> DataFrame:
    """Sales lines as ledger rows. Only the tables behind the wanted columns are joined."""
    line = table(spark, folder, "lineitem")
    value = F.col("l_extendedprice").cast("decimal(18,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))
    made = {
        "periodo": F.year("l_shipdate"),
        "data": F.col("l_shipdate").cast("date"),
        "tipo": F.when(F.col("l_returnflag") == "R", "receita").otherwise("despesa"),
        "valor": value.cast("decimal(18,2)"),
    }
    rows = line
    if {"categoria", "produto"} & set(columns):
        part = table(spark, folder, "part").select("p_partkey", "p_type", "p_name")
        rows = rows.join(part, F.col("l_partkey") == F.col("p_partkey"))
        written = F
        for kind, text in _WRITTEN.items():
            written = written.when(F.col("p_type") == kind, F.lit(text))
        made |= {"categoria": written, "produto": F.col("p_name")}
    if "fornecedor" in columns:
        supplier = table(spark, folder, "supplier").select("s_suppkey", "s_name")
        rows = rows.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        made["fornecedor"] = F.col("s_name")
    if "empresa" in columns:
        orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
        customer = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
        owner = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        rows = rows.join(owner, F.col("l_orderkey") == F.col("o_orderkey"))
        made["empresa"] = F.col("c_mktsegment")
    return rows.select(*[made[c].alias(c) for c in LEDGER_COLUMNS if c in columns])


# share of last year's spend that each category may cost this year
BUDGET_SHARE = {
    "mercadorias": "0.95", "energia": "0.80", "aluguel": "1.05",
    "folha": "0.70", "transporte": "0.60", "servicos": "0.90",
}


def next_year(spend: DataFrame) -> DataFrame:
    """Spend of a year as the reference of the year after."""
    return spend.withColumn("periodo", F.col("periodo") + 1)


def budget_from(spend: DataFrame) -> DataFrame:
    """Limits of a year: the category spend of the year before, times the share."""
    share = F
    for category, text in BUDGET_SHARE.items():
        share = share.when(F.col("categoria") == category, F.lit(text).cast("decimal(4,2)"))
    limit = (F.col("gasto").cast("decimal(18,2)") * share).cast("decimal(18,2)")
    return next_year(spend).withColumn("gasto", limit)


# Names a supplier may carry, one for each spend category and two for none.
TRADES = (
    "INFORMATICA", "ADVOCACIA", "EDITORA", "PAPELARIA", "LOGISTICA", "PADARIA", "ENGENHARIA", "PUBLICIDADE",
    "CLINICA", "SANEAMENTO", "LIMPEZA", "COMERCIAL", "PARTICIPACOES",
)


def _trade(number) -> F.Column:
    return F.get(F.array(*[F.lit(t) for t in TRADES]), (number % len(TRADES)).cast("int"))


def supplier_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """What each company moved with each supplier in a year, as supplier accounts."""
    rows = raw_ledger(spark, folder, {"empresa", "periodo", "tipo", "valor", "fornecedor"})
    sums = rows.groupBy("empresa", "periodo", "fornecedor").agg(
        F.sum(F.when(F.col("tipo") == "despesa", F.col("valor")).otherwise(0)).cast("decimal(18,2)").alias("credito"),
        F.sum(F.when(F.col("tipo") == "receita", F.col("valor")).otherwise(0)).cast("decimal(18,2)").alias("debito"),
    )
    key = F.regexp_extract("fornecedor", r"(\d+)$", 1).cast("bigint")
    person = F.concat((key + 100000).cast("string"), F.lit(" MARIA DE SOUZA"))
    company = F.concat(F.upper("fornecedor"), F.lit(" "), _trade(key))
    return sums.select(
        "empresa", "periodo", key.alias("seq"),
        F.when(key % 14 == 13, person).otherwise(company).alias("nome"),
        F.col("debito").alias("saldo_anterior"), "debito", "credito", F.col("credito").alias("saldo_em_aberto"),
    )


# -- trial-balance documents, one per order --------------------------------------------
#
# An order is a small company: its total is the revenue, fixed shares of it are the other
# accounts, and cash closes the balance. Status decides the layout, priority and day decide
# what is wrong with the document. All of it is arithmetic inside the order's own row.

# amounts in cents from the order total `t`
_SHARES = {
    "capital": "t DIV 2",
    "forn_um": "t DIV 6",
    "forn_dois": "t DIV 9",
    "estoque": "CASE WHEN tipo_doc = 'a_pagar' THEN t DIV 20 ELSE t DIV 3 END",
    "imobilizado": "CASE WHEN tipo_doc = 'a_pagar' THEN t * 8 DIV 5 ELSE t DIV 10 END",
    "icms": "t DIV 10",
    "frete": "t DIV 20",
    "energia": "t DIV 25",
    "salarios": "t DIV 8",
    "materia": "t DIV 4",
}
_HAS_SUPPLIERS = "tipo_doc <> 'patrimonial'"
_HAS_RESULT = "tipo_doc IN ('completo', 'quebrado', 'desbalanceado')"

# class, description, nature, part of the previous balance, amount, when present
_CHART = (
    ("1", "ATIVO", "D", "caixa DIV 4", "caixa + estoque + imobilizado", "true"),
    ("1.1", "ATIVO CIRCULANTE", "D", "caixa DIV 4", "caixa + estoque", "true"),
    ("1.1.1", "CAIXA GERAL", "D", "caixa DIV 4", "caixa", "true"),
    ("1.1.2", "ESTOQUE DE MERCADORIAS", "D", "0", "estoque", "true"),
    ("1.2", "IMOBILIZADO", "D", "0", "imobilizado", "true"),
    ("2", "PASSIVO", "C", "0", "CASE WHEN {s} THEN forn_um + forn_dois ELSE 0 END + capital + sobra", "true"),
    ("2.1", "PASSIVO CIRCULANTE", "C", "0", "forn_um + forn_dois", _HAS_SUPPLIERS),
    ("2.1.1", "FORNECEDORES", "C", "0", "forn_um + forn_dois", _HAS_SUPPLIERS),
    ("2.1.1.01", "nome_um", "C", "0", "forn_um", _HAS_SUPPLIERS),
    ("2.1.1.02", "nome_dois", "C", "0", "forn_dois", _HAS_SUPPLIERS),
    ("2.2", "PATRIMONIO LIQUIDO", "C", "0", "capital + sobra", "true"),
    ("2.2.1", "CAPITAL SOCIAL", "C", "capital DIV 2", "capital + sobra", "true"),
    ("3", "RESULTADO BRUTO", "C", "0", "t", _HAS_SUPPLIERS),
    ("3.1", "RECEITA BRUTA", "C", "0", "t", _HAS_SUPPLIERS),
    ("3.1.1", "RECEITA DE VENDA DE MERCADORIAS", "C", "0", "t", _HAS_SUPPLIERS),
    ("4", "DESPESAS OPERACIONAIS", "D", "0", "frete + energia + salarios", _HAS_RESULT),
    ("4.1", "FRETES SOBRE VENDAS", "D", "0", "frete", _HAS_RESULT),
    ("4.2", "ENERGIA ELÉTRICA", "D", "0", "energia", _HAS_RESULT),
    ("4.3", "SALÁRIOS E ORDENADOS", "D", "0", "salarios", _HAS_RESULT),
    ("5", "CUSTOS DOS PRODUTOS VENDIDOS", "D", "0", "materia", _HAS_RESULT),
    ("5.1", "MATERIA PRIMA", "D", "0", "materia", _HAS_RESULT),
    ("5.2", "(-) ESTOQUE INICIAL", "D", "0", "t DIV 7", _HAS_RESULT + " AND o_orderstatus = 'P'"),
    ("5.3", "(+) ESTOQUE FINAL", "C", "0", "t DIV 7", _HAS_RESULT + " AND o_orderstatus = 'P'"),
    ("6", "DEDUCOES DA RECEITA BRUTA", "D", "0", "icms", _HAS_RESULT),
    ("6.1", "(-) ICMS SOBRE VENDAS", "D", "0", "icms", _HAS_RESULT),
)


def _br(cents: str) -> str:
    return f"translate(format_number(CAST({cents} AS DECIMAL(20,0)) * 0.01BD, 2), ',.', '.,')"


def order_companies(spark: SparkSession, folder: str, dealt: bool = False) -> DataFrame:
    """Orders with the kind of document and the account amounts they stand for. dealt: for texts to be parsed."""
    orders = table(spark, folder, "orders")
    if dealt:
        orders = spread(orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_totalprice", "o_orderpriority"), "o_orderkey")
    kind = F.expr(
        """CASE o_orderpriority
             WHEN '2-HIGH' THEN 'a_pagar'
             WHEN '4-NOT SPECIFIED' THEN CASE WHEN day(o_orderdate) <= 2 THEN 'vazio' ELSE 'patrimonial' END
             WHEN '3-MEDIUM' THEN CASE WHEN day(o_orderdate) <= 3 THEN 'quebrado'
                                       WHEN day(o_orderdate) <= 6 THEN 'desbalanceado'
                                       WHEN day(o_orderdate) <= 9 THEN 'layout'
                                       WHEN day(o_orderdate) <= 12 THEN 'prosa' ELSE 'completo' END
             ELSE 'completo' END"""
    )
    base = orders.select(
        F.col("o_orderkey").alias("doc_id"), "o_custkey", "o_orderstatus", F.col("o_orderdate").cast("date").alias("dia"),
        (F.col("o_totalprice").cast("decimal(18,2)") * 100).cast("bigint").alias("t"), kind.alias("tipo_doc"),
    )
    parts = base.withColumns({name: F.expr(text) for name, text in _SHARES.items()})
    credits = f"capital + CASE WHEN {_HAS_SUPPLIERS} THEN forn_um + forn_dois + t ELSE 0 END"
    debits = f"estoque + imobilizado + CASE WHEN {_HAS_RESULT} THEN icms + frete + energia + salarios + materia ELSE 0 END"
    return parts.withColumns(
        {
            "caixa": F.expr(f"{credits} - ({debits})"),
            "sobra": F.expr("CASE WHEN tipo_doc = 'desbalanceado' THEN 500L ELSE 0L END"),
            "nome_um": F.concat(F.lit("ALFA "), _trade(F.col("o_custkey")), F.lit(" LTDA")),
            "nome_dois": F.concat(F.lit("BETA "), _trade(F.col("o_custkey") + 5), F.lit(" EIRELI")),
        }
    )


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Trial-balance texts (``doc_id``, ``texto``), one per order."""
    companies = order_companies(spark, folder, dealt=True)
    rows = []
    for number, (code, name, nature, previous, amount, when) in enumerate(_CHART, start=1):
        amount = amount.format(s=_HAS_SUPPLIERS)
        title = name if name.startswith("nome_") else f"'{name}'"
        # only the layout with natures for both balances can show a previous credit balance
        before = previous if nature == "D" else f"CASE WHEN o_orderstatus = 'P' THEN {previous} ELSE 0 END"
        broken = "+ CASE WHEN tipo_doc = 'quebrado' THEN 100 ELSE 0 END" if name.startswith("ESTOQUE DE") else ""
        rows.append(
            f"""CASE WHEN {when} THEN named_struct('codigo', '{number}', 'classe', '{code}', 'nome', {title},
                'nat', '{nature}', 'ant', CAST({before} AS BIGINT), 'mov', CAST(({amount}) - ({before}) AS BIGINT),
                'atual', CAST({amount} {broken} AS BIGINT)) END"""
        )
    lines = F.expr(f"array_compact(array({', '.join(rows)}))")
    body = F.arrow_udf(texts.body, "string").asNondeterministic()(lines, F.col("o_orderstatus"))
    customer = F.lpad(F.col("o_custkey").cast("string"), 8, "0")
    head = F.concat(
        F.lit("BALANCETE DE VERIFICACAO\nEmpresa: Cliente  "), customer, F.lit(" S.A.  Folha: 0001\nC.N.P.J.: "),
        F.substring(customer, 1, 2), F.lit("."), F.substring(customer, 3, 3), F.lit("."),
        F.substring(customer, 6, 3), F.lit("/0001-95\nPeríodo: 01/01/"), F.date_format("dia", "yyyy"), F.lit(" - "),
        F.date_format("dia", "dd/MM/yyyy"), F.lit("\nEmitido em: "), F.date_format("dia", "dd/MM/yyyy"),
        F.lit("\nSistema: Razonete Contabil\n"),
    )
    text = (
        F.when(F.col("tipo_doc") == "vazio", "  .\n ")
        .when(F.col("tipo_doc") == "prosa", "Ata da reuniao: nada foi decidido sobre o orcamento de 1.000,00 reais.")
        .when(F.col("tipo_doc") == "layout", F.concat(head, F.lit("Caixa | 1.000,00 | D\nCapital | 1.000,00 | C")))
        .otherwise(F.concat(head, body))
    )
    return companies.select("doc_id", text.alias("texto"))


# -- uploaded files, one per order -----------------------------------------------------

_UPLOAD_HEADER = {
    "F": ("Cód.", "Histórico", "Vlr.", "Data Movimento", "Filial"),
    "O": ("codigo", "descricao", "valor", "data", "filial"),
    "P": ("COD", "Conta Contábil", "Montante", "DT", "Filial"),
}
_UPLOAD_SEPARATOR = {"F": ";", "O": ",", "P": "|"}


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    """Small delimited files (``doc_id``, ``nome``, ``content``), one per order, in three
    dialects and two encodings, with bad cells, a blank and a repeated row."""
    orders = table(spark, folder, "orders")
    cents = (F.col("o_totalprice").cast("decimal(18,2)") * 100).cast("bigint")
    rows = orders.select(
        F.col("o_orderkey").alias("doc_id"), "o_orderstatus", "o_orderpriority", F.col("o_orderdate").cast("date").alias("dia"),
        cents.alias("t"),
    )
    br = lambda text: F.expr(_br(text))
    day = F.date_format("dia", "dd/MM/yyyy")
    third = F.when(F.col("o_orderpriority") == "1-URGENT", "Balancete da sede").otherwise("Aluguel da sede")
    second = ("102", F.lit("Conta de luz  CPFL"), br("t DIV 10"), F.date_format("dia", "dd-MM-yyyy"), F.lit("matriz"))
    table_rows = [
        ("101", F.lit("Compra de mercadorias"), F.concat(F.lit("R$ "), br("t")), day, F.lit("matriz")),
        second,
        ("103", third, F.concat(F.lit("("), br("t DIV 5"), F.lit(")")), F.date_format("dia", "yyyy-MM-dd"), F.lit("loja")),
        second,
        ("", F.lit(""), F.lit(""), F.lit(""), F.lit(" ")),
        ("104", F.lit("Folha de pagamento"), F.lit("abc"), F.lit("31/02/2020"), F.lit("loja")),
        ("105", F.lit("Serviço avulso"), F.lit(""), F.lit(""), F.lit("")),
    ]
    rows = spread(rows, "doc_id")
    content = F
    for status, names in _UPLOAD_HEADER.items():
        sep = _UPLOAD_SEPARATOR[status]
        cell = (lambda c: F.concat(F.lit('"'), c, F.lit('"'))) if sep == "," else (lambda c: c)
        lines = [F.lit(sep.join(names))]
        lines += [
            F.concat_ws(sep, F.lit(code), name, cell(value), date, branch) for code, name, value, date, branch in table_rows
        ]
        content = content.when(F.col("o_orderstatus") == status, F.concat_ws("\r\n" if status == "P" else "\n", *lines))
    text = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit("  \n ")).otherwise(content)
    latin = F.col("o_orderpriority") == "5-LOW"
    name = F.concat(F.lit("envio_"), F.col("doc_id").cast("string"), F.when(F.col("o_orderpriority") == "2-HIGH", ".doc").otherwise(".CSV"))
    return rows.select("doc_id", name.alias("nome"), F.when(latin, F.encode(text, "ISO-8859-1")).otherwise(F.encode(text, "UTF-8")).alias("content"))

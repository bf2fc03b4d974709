"""Text keys, dates, money, classifiers and labels over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom import vocab
from ledgerloom.functions import classify, dates, labels, money, text
from ledgerloom.operators import results
from registry.inputs import table
from registry.common import plain

def _money_text(spark, folder):
    """Prices as people write them; the line number picks the way."""
    line = table(spark, folder, "lineitem")
    value = F.col("l_extendedprice").cast("decimal(18,2)")
    br = F.translate(F.format_number(value, 2), ",.", ".,")
    plain_text = value.cast("string")
    n = F.col("l_linenumber")
    written = (
        F.when(n == 1, F.concat(F.lit("R$ "), br)).when(n == 2, F.concat(F.lit("("), br, F.lit(")")))
        .when(n == 3, F.concat(br, F.lit("-"))).when(n == 4, F.concat(F.lit(" "), br, F.lit("C")))
        .when(n == 5, plain_text).when(n == 6, F.concat(F.lit("cerca de "), br)).otherwise("")
    )
    return line.select("l_orderkey", "l_linenumber", written.alias("texto"))


def _date_text(spark, folder):
    line = table(spark, folder, "lineitem")
    flag = F.concat("l_returnflag", "l_linestatus")
    day = F.col("l_shipdate").cast("date")
    written = F
    for name, shape in (("RO", "dd/MM/yyyy"), ("RF", "yyyy-MM-dd"), ("AO", "dd-MM-yyyy"), ("NO", "dd.MM.yyyy"), ("NF", "dd/MM/yy")):
        written = written.when(flag == name, F.date_format(day, shape))
    return line.select("l_orderkey", "l_linenumber", written.otherwise(F.date_format(day, "'31/02/'yyyy")).alias("texto"))


def text_keys(spark, folder):
    docs = table(spark, folder, "documents")
    c = F.col("text")
    return docs.select(
        "doc_id", F.md5(text.upper_key(c)).alias("chave_maiuscula"), F.md5(text.lower_key(c)).alias("chave_minuscula"),
        F.md5(text.clean_cell(c)).alias("celula"), F.md5(text.collapse(c)).alias("espacos"), text.short_name(c).alias("nome_curto"),
    )


def page_keys(spark, folder):
    pages = table(spark, folder, "pages")
    return pages.select("page_id", F.md5(text.lower_key(F.col("html"))).alias("chave"), F.md5(text.clean_cell(F.col("html"))).alias("celula"))


def category_key(spark, folder):
    rows = table(spark, folder, "conversations")
    return rows.select("conv_id", "turn", F.md5(text.category_key(F.col("text"))).alias("categoria"))


def parse_money(spark, folder):
    rows = _money_text(spark, folder)
    return plain(rows.withColumn("valor", money.parse_money(F.col("texto"))))


def nature_suffix(spark, folder):
    rows = _money_text(spark, folder)
    return rows.select("l_orderkey", "l_linenumber", "texto", money.nature_suffix(F.col("texto")).alias("natureza"))


def parse_date(spark, folder):
    rows = _date_text(spark, folder)
    return plain(rows.withColumn("data", dates.parse_date(F.col("texto"))))


def month_spend(spark, folder):
    """Lines and sums per month key."""
    line = table(spark, folder, "lineitem")
    value = F.col("l_extendedprice").cast("decimal(18,2)")
    return plain(line.groupBy(dates.month_key(F.col("l_shipdate")).alias("mes_ano")).agg(F.sum(value).alias("valor"), F.count("*").alias("linhas")))


def currency_text(spark, folder):
    orders = table(spark, folder, "orders")
    value = F.col("o_totalprice").cast("decimal(18,2)")
    return orders.select("o_orderkey", money.currency(value).alias("valor"), money.currency_round(value).alias("arredondado"))


def categorize_ledger(spark, folder):
    return table(spark, folder, "documents").select("doc_id", classify.ledger_category(F.col("text")).alias("categoria"))


def categorize_upload(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", classify.upload_category(F.col("text")).alias("categoria"),
        classify.upload_category(F.col("text"), whole_word=True).alias("palavra_inteira"),
    )


def categorize_supplier(spark, folder):
    return table(spark, folder, "conversations").select("conv_id", "turn", classify.supplier_category(F.col("text")).alias("categoria"))


def status_labels(spark, folder):
    orders = table(spark, folder, "orders")
    c, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    change = F.expr("o_totalprice / 100000 * 10").cast("double")
    return orders.select(
        "o_orderkey",
        labels.nature_label(F.when(c == "F", "D").otherwise("C")).alias("natureza"),
        labels.abc_label(F.when(c == "F", "A").when(c == "O", "B").otherwise("C")).alias("classe"),
        labels.severity_label(results.severity(change)).alias("severidade"),
        labels.situation_label(F.when(c == "F", "lucro").when(c == "O", "prejuizo").otherwise("equilibrio")).alias("situacao"),
        labels.period_label(F.when(p != "1-URGENT", F.col("o_orderdate").cast("date")), F.col("o_orderdate").cast("date")).alias("periodo"),
    )


QUERIES = {
    "text_keys": text_keys,
    "page_keys": page_keys,
    "category_key": category_key,
    "parse_money": parse_money,
    "nature_suffix": nature_suffix,
    "parse_date": parse_date,
    "month_spend": month_spend,
    "currency_text": currency_text,
    "categorize_ledger": categorize_ledger,
    "categorize_upload": categorize_upload,
    "categorize_supplier": categorize_supplier,
    "status_labels": status_labels,
}

_BR = "replace(replace(replace(format('{{:,.2f}}', {0}), ',', '_'), '.', ','), '_', '.')"
_MONEY_TEXT = f"""m AS (SELECT l_orderkey, l_linenumber, v, CASE l_linenumber WHEN 1 THEN 'R$ ' || br WHEN 2 THEN '(' || br || ')' WHEN 3 THEN br || '-'
  WHEN 4 THEN ' ' || br || 'C' WHEN 5 THEN printf('%.2f', v) WHEN 6 THEN 'cerca de ' || br ELSE '' END AS texto
  FROM (SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS v, {_BR.format('CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE)')} AS br FROM lineitem))"""
_FOLD = "strip_accents({0})".format
_SQUEEZE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))".format


def _words(groups, key: str, default: str, bound: bool = False) -> str:
    edge = r"\b" if bound else ""
    whens = " ".join(
        "WHEN regexp_matches({0}, '{2}({1}){2}') THEN '{3}'".format(key, "|".join(w.lower().replace(".", r"\.") if groups is not vocab.SUPPLIER_CATEGORY_WORDS else w for w in ws), edge, name)
        for name, ws in groups
    )
    return f"CASE {whens} ELSE '{default}' END"


SQL = {
    "text_keys": f"""SELECT doc_id, md5(upper(replace({_FOLD(_SQUEEZE('text'))}, 'ß', 'SS'))) AS chave_maiuscula,
  md5({_FOLD("lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))")}) AS chave_minuscula, md5({_SQUEEZE('text')}) AS celula, md5({_SQUEEZE('text')}) AS espacos,
  CASE WHEN length(n) <= 38 THEN n ELSE regexp_replace(substr(n, 1, 35), '\\s+$', '') || '...' END AS nome_curto
FROM (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS n FROM documents)""",
    "page_keys": f"""SELECT page_id, md5({_FOLD("lower(regexp_replace(html, '^\\s+|\\s+$', '', 'g'))")}) AS chave, md5({_SQUEEZE('html')}) AS celula FROM pages""",
    "category_key": f"""SELECT conv_id, turn, md5(coalesce(nullif({_FOLD("lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))")}, ''), 'outros')) AS categoria FROM conversations""",
    "parse_money": f"""WITH {_MONEY_TEXT} SELECT l_orderkey, l_linenumber, texto,
  CASE WHEN l_linenumber IN (1, 4, 5) THEN v WHEN l_linenumber IN (2, 3) THEN -v END AS valor FROM m""",
    "nature_suffix": f"WITH {_MONEY_TEXT} SELECT l_orderkey, l_linenumber, texto, CASE WHEN l_linenumber = 4 THEN 'C' END AS natureza FROM m",
    "parse_date": """SELECT l_orderkey, l_linenumber, CASE l_returnflag || l_linestatus WHEN 'RO' THEN strftime(l_shipdate, '%d/%m/%Y')
  WHEN 'RF' THEN strftime(l_shipdate, '%Y-%m-%d') WHEN 'AO' THEN strftime(l_shipdate, '%d-%m-%Y') WHEN 'NO' THEN strftime(l_shipdate, '%d.%m.%Y')
  WHEN 'NF' THEN strftime(l_shipdate, '%d/%m/%y') ELSE '31/02/' || strftime(l_shipdate, '%Y') END AS texto,
  CASE WHEN l_returnflag || l_linestatus <> 'AF' THEN strftime(l_shipdate, '%Y-%m-%d') END AS data FROM lineitem""",
    "month_spend": """SELECT strftime(l_shipdate, '%Y-%m') AS mes_ano, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS valor,
  count(*) AS linhas FROM lineitem GROUP BY 1""",
    "currency_text": f"""SELECT o_orderkey, 'R$ ' || {_BR.format('CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE)')} AS valor,
  'R$ ' || replace(format('{{:,.0f}}', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE)), ',', '.') AS arredondado FROM orders""",
    "categorize_ledger": f"""SELECT doc_id, {_words(vocab.LEDGER_CATEGORY_WORDS, 'k', 'outros')} AS categoria
FROM (SELECT doc_id, lower(strip_accents(text)) AS k FROM documents)""",
    "categorize_upload": f"""SELECT doc_id, {_words(vocab.UPLOAD_CATEGORY_WORDS, 'k', 'OUTROS')} AS categoria,
  {_words(vocab.UPLOAD_CATEGORY_WORDS, 'k', 'OUTROS', True)} AS palavra_inteira
FROM (SELECT doc_id, lower({_SQUEEZE('strip_accents(text)')}) AS k FROM documents)""",
    "categorize_supplier": f"""SELECT conv_id, turn, CASE WHEN regexp_matches(k, '^\\d{{5,}}\\s+[A-ZÀ-Ü][A-ZÀ-Ü\\s]+$') THEN 'Prestador Pessoa Física / Autônomo'
  ELSE {_words(vocab.SUPPLIER_CATEGORY_WORDS, 'k', 'Outros / Não classificado')} END AS categoria
FROM (SELECT conv_id, turn, upper({_SQUEEZE('text')}) AS k FROM conversations)""",
    "status_labels": """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Devedora' ELSE 'Credora' END AS natureza,
  CASE o_orderstatus WHEN 'F' THEN 'A — Alto impacto' WHEN 'O' THEN 'B — Impacto médio' ELSE 'C — Baixo impacto' END AS classe,
  CASE WHEN x >= 50 THEN 'CRÍTICA' WHEN x >= 35 THEN 'ALTA' WHEN x >= 20 THEN 'MÉDIA' WHEN x >= 10 THEN 'BAIXA' END AS severidade,
  CASE o_orderstatus WHEN 'F' THEN 'LUCRO' WHEN 'O' THEN 'PREJUÍZO' ELSE 'EQUILÍBRIO (receita = despesa)' END AS situacao,
  CASE WHEN o_orderpriority <> '1-URGENT' THEN strftime(o_orderdate, '%d/%m/%Y') || ' a ' || strftime(o_orderdate, '%d/%m/%Y')
    ELSE 'Período não identificado' END AS periodo
FROM (SELECT *, o_totalprice / 100000 * 10 AS x FROM orders)""",
}

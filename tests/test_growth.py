"""What keeps queries within limits on large tables: nothing gathered on the driver, texts read in one step."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import WORKSHOP_TEXT, shop_text
from ledgerloom.functions.classify import entry_type
from ledgerloom.functions.dates import period_end
from ledgerloom.operators import reading, tree
from ledgerloom.operators.hierarchy import ancestor_paths, leaves_by_class
from ledgerloom.operators.layouts import KNOWN_LAYOUTS
from ledgerloom.plans.trial_balance import build_trees, classify_documents, parse_documents, read_trial_balance
from ledgerloom.plans.upload import prepare


def used_plan(df):
    """The plan as it ran, after adaptive changes, and the rows."""
    rows = df.collect()
    return df._jdf.queryExecution().executedPlan().toString(), rows


def chart(spark, documents):
    """Four accounts a document; as they are exploded, their estimated size is that of the documents."""
    lines = F.array(*[
        F.struct(F.lit(i).alias("seq"), F.lit(c).alias("classificacao"), F.lit(d).alias("descricao"))
        for i, (c, d) in enumerate([("1", "ATIVO"), ("1.1", "CIRCULANTE"), ("1.1.1", "CAIXA"), ("1.2", "FROTA")])
    ])
    return spark.range(documents).select(F.col("id").alias("doc_id"), F.explode(lines).alias("c")).select("doc_id", "c.*")


@pytest.mark.parametrize("operator", [leaves_by_class, ancestor_paths])
def test_accounts_are_not_broadcast(spark, operator):
    plan, rows = used_plan(operator(chart(spark, 3), ["doc_id"]))
    assert sorted({r["classificacao"] for r in rows}) == ["1.1.1", "1.2"] and len(rows) == 6
    assert "Broadcast" not in plan


def test_texts_and_their_trees_are_read_in_one_step(spark):
    docs = spark.createDataFrame([(1, shop_text()), (2, WORKSHOP_TEXT), (3, None)], "doc_id int, texto string")
    found = read_trial_balance(docs)
    plan, rows = used_plan(found.lancamentos)
    assert plan.count("ArrowEvalPython") == 1
    assert {r["doc_id"] for r in rows} == {1, 2}
    # the same trees and entries from the steps taken one by one
    together = classify_documents(build_trees(parse_documents(docs, with_trees=True)))
    assert together.orderBy("doc_id").select("leitura", "resultado").collect() == found.documentos.orderBy("doc_id").select("leitura", "resultado").collect()


WORDS = [
    "RECEITA BRUTA", "(-) ICMS", " (-) VENDA", "DESPESA", "CUSTO", "ESTOQUE INICIAL", "FORNECEDORES", "SERVIÇOS", "PRESTADOS", "Salários",
    "REVENDA", "_VENDA", "ΣVENDA", "ªVENDA", "VENDAS – LOJA", "ﬁm FATURAMENTO", "DESPESÁ", "İtens de custo", "", " venda ", "\tCPV",
]


def test_kinds_are_those_of_the_columns(spark):
    leaves = [(own, above, side) for own in WORDS for above in ([], *[[w] for w in WORDS], ["SERVICO", "PRESTADO"], ["ATIVO", "SERVIÇOS", "PRESTADOS"]) for side in ("D", "C", None)]
    kinds = tree.kinds_of(pa.array([x[0] for x in leaves]), pa.array([x[1] for x in leaves], pa.list_(pa.string())), pa.array([x[2] for x in leaves], pa.string())).to_pylist()
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(leaves)], "i int, own string, above array<string>, side string")
    typed = rows.select("i", entry_type(F.col("own"), F.concat_ws(" ", "above"), F.col("side")).alias("e")).collect()
    names = {tree.NOTHING: None, tree.EXPENSE: ("despesa", "resultado"), tree.REVENUE: ("receita", "resultado"), tree.PAYABLE: ("despesa", "fornecedor_pagavel")}
    wrong = [(leaves[r.i], kinds[r.i], r.e) for r in typed if kinds[r.i] != tree.UNSURE and names[kinds[r.i]] != (tuple(r.e) if r.e else None)]
    assert not wrong
    assert 0 < kinds.count(tree.UNSURE) < len(kinds) / 2


@pytest.mark.parametrize("odd", ["", "É", "٣", " ", " ", "\x85"])
def test_narrow_classes_find_the_same(odd):
    lines = pa.array([f"12 CAIXA{odd} GERAL  1.000,00  2,00{odd}  3,00  1{odd}.004,00D{odd}", f"1,00D2,00{odd}3,00 4,00 7 X{odd}", f"7 1.2 3,00D4,00 5,00{odd} 6,00 N{odd} 8"])
    for layout in KNOWN_LAYOUTS:
        size = len(layout.groups)
        wide = reading.groups_of(lines, layout.pattern, size)
        if reading.is_narrow(lines):
            hit, groups = reading.groups_of(lines, layout.pattern, size, narrow=True)
            assert hit.tolist() == wide[0].tolist() and [g.to_pylist() for g in groups] == [g.to_pylist() for g in wide[1]]
    assert reading.is_narrow(lines) == (odd in ("", "É"))


def test_the_period_is_searched_once(spark):
    texts = spark.createDataFrame([("de 01/01/2025 - 31/03/2025 até 01/04/2025 - 30/06/2025",), ("31/03/2025",), ("",), (None,)], "texto string")
    plan, rows = used_plan(texts.select(period_end(F.col("texto"), F.lit("2000-01-01")).alias("fim"), period_end(F.col("texto")).alias("sem")))
    assert [tuple(r) for r in rows] == [("2025-03-31", "2025-03-31"), *[("2000-01-01", None)] * 3]
    assert plan.count("regexp_extract") == 2


def test_upload_summaries_hash_buffers_of_fixed_size(spark):
    text = "codigo;descricao;valor;filial\n1;Compra de aço;10,00;\n2;Conta de luz;x;norte\n"
    files = spark.createDataFrame([(1, "a.csv", text), (1, "b.csv", "descricao;valor\nAluguel;5,00\n"), (None, "c.csv", text), (2, "d.csv", "descricao;valor\n;\n")], "doc_id int, nome string, content string")
    found = prepare(files.withColumn("content", F.encode("content", "UTF-8")))
    plan, rows = used_plan(found.estatisticas)
    assert "ObjectHashAggregate" not in plan and "SortAggregate" not in plan
    told = {r.doc_id: (r.linhas_validas, r.linhas_invalidas, r.categorias_identificadas, r.valores_ausentes, float(r.total_gastos_fornecedores)) for r in rows}
    assert told == {1: (2, 1, ["ALUGUEL", "ENERGIA", "FORNECEDORES"], 3, 10.0), None: (1, 1, ["ENERGIA", "FORNECEDORES"], 2, 10.0), 2: (0, 0, [], 0, 0.0)}
    counts = {r.doc_id: (r.numero_registros, r.numero_colunas) for r in found.metadados.collect()}
    assert counts == {1: (3, 5), None: (2, 5), 2: (0, 0)}

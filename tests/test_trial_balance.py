import dataclasses
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import PERIOD, WORKSHOP_TEXT, moved, shop_text
from ledgerloom import read_trial_balance
from ledgerloom.functions.classify import entry_type, ledger_category
from ledgerloom.operators.hierarchy import ancestor_paths, leaves_by_class
from ledgerloom.operators.layouts import KNOWN_LAYOUTS, Layout, accounts_with, signed_lines
from ledgerloom.operators.tree import above_by_class, above_by_value


def read(spark, *texts, **kw):
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, texto string")
    return read_trial_balance(docs, **kw)


def status(found):
    return {r.doc_id: r.status for r in found.status.collect()}


@pytest.mark.parametrize("layout", ["reverso", "natural"])
def test_shop(spark, layout):
    found = read(spark, shop_text(layout))
    rows = found.lancamentos.collect()
    assert {r.fornecedor for r in rows} == {
        "TECELAGEM AURORA LTDA", "AVIAMENTOS SERRANA EIRELI", "RECEITA COM SERVICOS DE COSTURA",
    }
    total = lambda kind: float(sum(r.valor for r in rows if r.tipo == kind))
    assert (total("despesa"), total("receita")) == (9750.2, 51500.0)
    assert {str(r.data) for r in rows} == {"2025-12-31"}
    assert {r.categoria for r in rows if r.tipo == "despesa"} == {"mercadorias"}
    assert {r.categoria for r in rows if r.tipo == "receita"} == {"servicos"}
    assert found.status.first().layout == layout


def test_workshop(spark):
    rows = read(spark, WORKSHOP_TEXT).lancamentos.collect()
    assert {(r.fornecedor, r.tipo, float(r.valor)) for r in rows} == {
        ("VENDA DE PORTOES", "receita", 1800.0), ("FRETE ATE O CLIENTE", "despesa", 720.0), ("(-) ICMS DA VENDA", "despesa", 360.0),
    }


def test_each_document_has_its_own_fate(spark):
    line = lambda *row: moved("reverso", *row)
    broken = line(1, "ATIVO QUEBRADO", "D", 81000).replace("810,00", "810,07", 1)
    only_assets = "\n".join([line(1, "ATIVO", "D", 81000), line(2, "NUMERARIO", "D", 81000)])
    no_words = "um bilhete sobre o tempo de amanha"
    unknown = "BALANCETE em outra ordem: Numerario | 81"
    balanced = "\n".join([only_assets, line(3, "CAPITAL", "C", 81000)])
    shuffled = shop_text().split("\n")
    shuffled.append(shuffled.pop(3))  # the stock no longer follows its parent
    found = read(spark, shop_text(), broken, only_assets, no_words, unknown, balanced, "\n".join(shuffled), " . ")
    assert status(found) == {
        "0": "OK", "1": "NOT_RECONCILED", "2": "NOT_BALANCED", "3": "NOT_ACCOUNTING", "4": "UNKNOWN_LAYOUT", "5": "EMPTY",
        "6": "NOT_BALANCED", "7": "NOT_ACCOUNTING",
    }
    assert {r.doc_id for r in found.lancamentos.collect()} == {"0"}
    assert {r.doc_id for r in found.status.filter("precisa_ocr").collect()} == {"7"}


def test_many_documents_equal_each_alone(spark):
    both = read(spark, shop_text(), WORKSHOP_TEXT, shop_text("natural")).lancamentos.drop("doc_id")
    alone = [read(spark, t).lancamentos.drop("doc_id") for t in (shop_text(), WORKSHOP_TEXT, shop_text("natural"))]
    assert sorted(both.collect()) == sorted(r for a in alone for r in a.collect())


def test_resale_is_no_sale(spark):
    rows = [(1, "ATIVO", "D", 45000), (2, "MERCADORIAS PARA REVENDA", "D", 45000), (30, "PASSIVO", "C", 45000), (31, "FORNECEDORES", "C", 45000), (32, "ATACADO POLAR LTDA", "C", 45000)]
    text = "\n".join([PERIOD, *[moved("reverso", *row) for row in rows]])
    assert [r.fornecedor for r in read(spark, text).lancamentos.collect()] == ["ATACADO POLAR LTDA"]


def test_no_period(spark):
    text = shop_text().split("\n", 1)[1]
    assert {str(r.data) for r in read(spark, text, fallback_date="2024-05-06").lancamentos.collect()} == {"2024-05-06"}
    assert {r.data for r in read(spark, text).lancamentos.collect()} == {None}


def test_layout_election(spark):
    right = KNOWN_LAYOUTS[0]
    swapped = Layout("trocado", right.pattern, ("atual", "natureza", "debito", "credito", "anterior", "codigo", "descricao"))
    assert status(read(spark, shop_text(), layouts=[swapped, right])) == {"0": "OK"}
    never = Layout("nunca", "nao vai casar (.)", ("codigo",))
    assert status(read(spark, shop_text(), layouts=[never])) == {"0": "NOT_ACCOUNTING"}


def test_ungrouped_thousands(spark):
    found = read(spark, "1 ATIVO  0,00  1234567,00  0,00  1234567,00D")
    assert [float(r.saldo_atual) for r in found.contas.collect()] == [1234567.0]


@pytest.mark.parametrize(
    "text, category",
    [
        ("CONTA DE LUZ CPFL", "energia"), ("ENEL DISTRIBUICAO SP", "energia"), ("ALUGUEL DA SEDE ADMINISTRATIVA", "aluguel"),
        ("TAXA DE CONDOMINIO", "aluguel"), ("13O SALARIO", "folha"), ("FERIAS E ABONO PECUNIARIO", "folha"),
        ("PRO LABORE DOS SOCIOS", "folha"), ("PEDAGIO E ESTACIONAMENTO", "transporte"), ("SEGURO VEICULAR FROTA", "transporte"),
        ("HONORARIOS ADVOCATICIOS", "servicos"), ("ASSINATURA DE SOFTWARE DE GESTAO", "servicos"), ("ICMS A RECOLHER", "impostos"),
        ("DARF SIMPLES NACIONAL", "impostos"), ("IRPJ E CSLL", "impostos"), ("MATERIA PRIMA PARA PRODUCAO", "mercadorias"),
        ("CUSTO DA MERCADORIA VENDIDA - CMV", "mercadorias"), ("CONTA SEM NENHUMA PALAVRA CONHECIDA", "outros"),
    ],
)
def test_vocabulary(spark, text, category):
    assert spark.range(1).select(ledger_category(F.lit(text))).first()[0] == category


@pytest.mark.parametrize(
    "name, path, nature, kind",
    [
        ("(+) ESTOQUE FINAL", "CUSTOS DOS PRODUTOS VENDIDOS", "C", None),
        ("(-) ESTOQUE INICIAL", "CUSTOS DOS PRODUTOS VENDIDOS", "D", None),
        ("MATERIA PRIMA", "CUSTOS DOS PRODUTOS VENDIDOS", "D", "despesa"),
        ("SERVICOS PRESTADOS", "RECEITA DE SERVICOS", "D", None),
        ("SERVICOS PRESTADOS", "RECEITA DE SERVICOS", "C", "receita"),
        ("(-) Depreciações", "ATIVO", "C", None),
        ("FULANO", "PASSIVO FORNECEDORES", "C", "despesa"),
    ],
)
def test_entry_type(spark, name, path, nature, kind):
    got = spark.range(1).select(entry_type(F.lit(name), F.lit(path), F.lit(nature)).alias("e")).first().e
    assert (got.tipo if got else None) == kind


def brute_force_leaves(balances, natures):
    """Straight reading of the definition, by recursion."""

    def group(start, target, nature, above):
        total, i, found = 0, start, []
        while total < target:
            if i >= len(balances) or natures[i] != nature or total + balances[i] > target:
                return None
            inner = group(i + 1, balances[i], nature, above + [i])
            if inner is None:
                found.append((i, above))
                nxt = i + 1
            else:
                found += inner[0]
                nxt = inner[1]
            total += balances[i]
            i = nxt
        return found, i

    out, i = [], 0
    while i < len(balances):
        inner = group(i + 1, balances[i], natures[i], [i])
        if inner is None:
            out.append((i, []))
            i += 1
        else:
            out += inner[0]
            i = inner[1]
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.sampled_from("DC")), max_size=12))
def test_tree_by_value_matches_definition(accounts):
    balances, natures = [a for a, _ in accounts], [n for _, n in accounts]
    got = [(i, a) for i, a in enumerate(above_by_value(balances, natures)) if a is not None]
    assert got == brute_force_leaves(balances, natures)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=4), max_size=12))
def test_tree_by_class_matches_definition(paths):
    classes = [".".join(map(str, p)) for p in paths]
    got = above_by_class(classes)
    for c, above in zip(classes, got):
        child = any(o != c and o.startswith(c + ".") for o in classes)
        assert (above is None) == child
        if not child:
            parts = c.split(".")
            heads = [".".join(parts[:k]) for k in range(1, len(parts))]
            assert [classes[i] for i in above] == [h for h in heads if h in classes]


def test_class_joins_agree_with_the_documents(spark):
    twice = WORKSHOP_TEXT + "\n" + moved("classificado", 577, "RECEITA LIQUIDA", "C", 180000, classificacao="3.1")
    found = read(spark, twice)
    joined = ancestor_paths(found.contas, ["doc_id"]).select("seq", "ancestrais").collect()
    inside = found.folhas.select("seq", "ancestrais").collect()
    assert sorted(joined) == sorted(inside)
    assert leaves_by_class(found.contas, ["doc_id"]).count() == len(inside)


def plain_above(balances, natures):
    """Each run of following accounts gone through one by one."""
    n, end, above, groups = len(balances), [0] * len(balances), [None] * len(balances), []
    for i in reversed(range(n)):
        left, j = balances[i], i + 1
        while left > 0 and j < n and natures[j] == natures[i] and balances[j] <= left:
            left, j = left - balances[j], end[j] or j + 1
        if left == 0:
            end[i] = j
    for i in range(n):
        while groups and end[groups[-1]] <= i:
            groups.pop()
        if end[i]:
            groups.append(i)
        else:
            above[i] = list(groups)
    return above


def test_groups_by_balance_are_those_of_the_plain_search():
    draw = random.Random(5)
    for _ in range(5000):
        n, low, high = draw.randint(0, 14), draw.choice((0, 1, -2)), draw.choice((2, 4, 9))
        balances = [draw.randint(low, high) for _ in range(n)]
        natures = [draw.choice("DC") if draw.random() < 0.3 else "D" for _ in range(n)]
        assert above_by_value(balances, natures) == plain_above(balances, natures)


def test_accounts_that_never_sum_up_take_no_quadratic_time():
    n = 100_000
    start = time.perf_counter()
    found = above_by_value([2 * n - i for i in range(n)], ["D"] * n)
    assert time.perf_counter() - start < 5 and found == [[]] * n


def test_signature_lets_every_matching_line_through(spark):
    lines = [
        "1.000,00D0,0058000,0058.000,0012 CAIXA GERAL", "12 CAIXA # GERAL  1,00  2,00  3.000,00  4,00D ", "7 CAIXA\t1,00\u00a02,00 3,00 4,00C",
        "12 1.1.01 5,00D4,00C 3,00 2,00BANCOS", "12 1.1.01 5,00D4,00 3,00 2,00 9,99 BANCOS", "3 x,00 y 1,00", "8 A 1,00 2,00 3,00D", "nada", "1,00D2,003,004,00 5 X",
    ]
    frame = spark.createDataFrame([("\n".join(lines),)], "texto string")
    for layout in KNOWN_LAYOUTS:
        free = dataclasses.replace(layout, shape=None)
        with_shape, without = frame.select(accounts_with(signed_lines(F.col("texto")), layout), accounts_with(signed_lines(F.col("texto")), free)).first()
        assert with_shape == without and len(without) > 0

"""Lines, trees and texts of documents in Arrow batches."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from conftest import shop_text
from ledgerloom import read_trial_balance
from ledgerloom.operators import reading, tree
from ledgerloom.operators.headers import too_little_text
from ledgerloom.operators.layouts import KNOWN_LAYOUTS, Layout, measures_of, parse
from ledgerloom.vocab import MIN_TEXT_CHARS
from registry import texts

LINE = "7 CAIXA  1,00  2,00  0,00  3,00D"


def _read(spark, column, *rows):
    return [r[0] for r in spark.createDataFrame([(t,) for t in rows], "texto string").coalesce(1).select(column(F.col("texto"))).collect()]


def test_documents_are_read_in_batches_not_line_by_line(spark):
    docs = spark.createDataFrame([("a", shop_text())], "doc_id string, texto string")
    plan = read_trial_balance(docs).documentos.select("leitura", "resultado.folhas")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2 and "regexp_replace" not in plan and "lambdafunction" not in plan


def test_lines_of_all_kinds(spark):
    text = f"x\r\n{LINE}\r{LINE} \n\n\x85{LINE.replace(' ', chr(0xa0))}\x01\x1c8 \x01B 1,00 2,00 0,0\x010 3,00C"
    none, empty, found = _read(spark, lambda t: parse(t, KNOWN_LAYOUTS), None, "", text)
    assert none.contas is None and none.layout is None and [(m.contas, m.reconciliadas) for m in none.medidas] == [(None, None)] * 3
    assert empty.contas == [] and empty.layout is None and empty.falha is None
    assert [(a.seq, a.codigo, a.descricao, a.saldo_atual) for a in found.contas] == [(1, "7", "CAIXA", 300), (2, "7", "CAIXA", 300), (6, "7", "CAIXA", 300), (7, "8", "B", 300)]
    assert found.falha.seq == 7 and [(m.contas, m.reconciliadas) for m in found.medidas] == [(0, 0), (4, 3), (0, 0)]


def test_later_layouts_measure_nothing_after_a_perfect_one_unless_asked(spark):
    twice = [KNOWN_LAYOUTS[1], KNOWN_LAYOUTS[1]]
    tried = lambda r: [m.contas for m in r]
    assert [tried(r.medidas) for r in _read(spark, lambda t: parse(t, twice), LINE, LINE.replace("3,00D", "4,00D"))] == [[1, 0], [1, 1]]
    assert [tried(r) for r in _read(spark, lambda t: measures_of(t, twice), LINE)] == [[1, 1]]


def test_own_patterns_with_look_around_and_unicode(spark):
    own = [Layout("atras", r"(?<=: )(\w+) (?<valor>\d+,\d{2})(?!\d)", ("descricao", "atual")), Layout("sem", r"^(\S+)\s(\d+,\d{2})$", ("descricao", "atual"))]
    first, second, arabic = _read(spark, lambda t: parse(t, own), "a: ção 5,00 x", "ção 5,00", "b 5,00\nb ٥,00")
    assert (first.layout, first.contas[0].descricao, first.contas[0].saldo_atual) == ("atras", "ção", 500)
    assert (second.layout, second.contas[0].descricao, second.contas[0].natureza) == ("sem", "ção", "")
    assert [c.saldo_atual for c in arabic.contas] == [500, None]


def test_signature_still_refuses_numbers_run_together(spark):
    line = "1,23,45D1,001,001,007 X"
    free = [Layout("livre", KNOWN_LAYOUTS[0].pattern, KNOWN_LAYOUTS[0].groups)]
    assert _read(spark, lambda t: parse(t, KNOWN_LAYOUTS[:1]), line)[0].contas == [] and len(_read(spark, lambda t: parse(t, free), line)[0].contas) == 1


def test_amounts_that_are_no_eight_byte_numbers():
    given = ["1.234,56", "", " -5", "9" * 18, "9223372036854775807", "9223372036854775808", "0x1F", "٥", "+7"]
    assert reading.cents(pa.array(given)).to_pylist() == [123456, None, -5, 10**18 - 1, 2**63 - 1, None, None, None, 7]


def test_leaves_of_lists():
    account = lambda i, code, value: {"seq": i, "codigo": str(i), "classificacao": code, "descricao": f"n{i}", "saldo_atual": value, "natureza": "D"}
    lists = pa.array([None, [], [account(0, "1", 5), account(1, "1.1", 5)], [account(0, None, 5), account(1, None, 2), account(2, None, 3)]])
    found = tree.leaves_of(lists).to_pylist()
    assert found[:2] == [None, []] and [[(a["seq"], a["ancestrais"]) for a in f] for f in found[2:]] == [[(1, ["n0"])], [(1, ["n0"]), (2, ["n0"])]]


def test_written_amounts():
    draw = random.Random(3)
    cents = [0, None, 1, -1, 99, 100, -100, 99999, 100000, 2**63 - 1, *[draw.randint(-(10**n), 10**n) for n in range(1, 18) for _ in range(50)]]
    plain = lambda c: None if c is None else ("-" if c < 0 else "") + f"{abs(c) // 100:,}".replace(",", ".") + f",{abs(c) % 100:02d}"
    assert texts.br(pa.array(cents, pa.int64())).to_pylist() == [plain(c) for c in cents]


def test_little_text_is_told_by_all_of_it(spark):
    n = MIN_TEXT_CHARS
    rows = ["x" * n, "x" * (n - 1), " " * 9 * n + "x" * n, " " * 9 * n + "x" * (n - 1) + " ", None]
    assert _read(spark, too_little_text, *rows) == [False, True, False, True, True]

import random

import pytest
from pyspark.sql import functions as F

from conftest import WORKSHOP_TEXT, shop_text
from ledgerloom import prepare, read_supplier_documents, supplier_analysis
from ledgerloom.functions import money
from ledgerloom.functions.dates import parse_date, parse_entry_date
from ledgerloom.operators import cleaning, suppliers
from ledgerloom.operators.columns import rename_by_alias, standard_name
from ledgerloom.operators.ranking import ranked, top_rows
from ledgerloom.operators.reports import supplier_report, workbook_tables
from ledgerloom.operators.statement import STRATEGIES, register_strategy, route, split_code, standard_rows
from ledgerloom.plans.supplier import account_rows, supplier_rows
from ledgerloom.sources import files, sinks, tables
from ledgerloom.streaming import folder


def one(spark, c):
    return spark.range(1).select(c).first()[0]


@pytest.mark.parametrize(
    "text, value",
    [
        ("R$ 2.350,50", 2350.5), ("(250)", -250), ("-250", -250), ("250-", -250), ("92.553,10C", 92553.1), ("250D", 250),
        ("1.234", 1.234), ("1.234.567", 1234.567), ("250-D", 250), ("R$ (250)", 250), ("R$ -250", -250), ("abc", None), ("", None),
        ("1234,5", None), ("12,345.00", None),
    ],
)
def test_parse_money(spark, text, value):
    got = one(spark, money.parse_money(F.lit(text)))
    assert (None if got is None else float(got)) == value


@pytest.mark.parametrize(
    "text, value",
    [
        ("31/12/2025", "2025-12-31"), ("31-12-2025", "2025-12-31"), ("31.12.2025", "2025-12-31"), ("2025-12-31", "2025-12-31"),
        ("31/12/68", "2068-12-31"), ("31/12/69", "1969-12-31"), ("31/02/2025", None), ("12/31/2025", None), ("x", None),
    ],
)
def test_parse_date(spark, text, value):
    got = one(spark, parse_date(F.lit(text)))
    assert (None if got is None else str(got)) == value


@pytest.mark.parametrize(
    "text, value", [("03/04/2025", "2025-03-04"), ("31/04/2025", None), ("13/04/2025", "2025-04-13"), ("2025-04-13 10:00:00", "2025-04-13"), ("20250413", "2025-04-13")]
)
def test_parse_entry_date(spark, text, value):
    got = one(spark, parse_entry_date(F.lit(text)))
    assert (None if got is None else str(got)) == value


def test_rounding_matches_python(spark):
    values = [2.675, 0.125, 1.005, 12.25, 12.35, -0.04, 99.995, 1234567.125]
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    got = rows.select(money.round_exact(F.col("x")), money.signed(F.col("x"), 1)).collect()
    assert [r[0] for r in got] == [round(v, 2) for v in values]
    assert [r[1] for r in got] == [f"{v:+.1f}" for v in values]


def test_nature_suffix(spark):
    assert one(spark, money.nature_suffix(F.lit("92.553,10 c "))) == "C"
    assert one(spark, money.nature_suffix(F.lit("92.553,10"))) is None


@pytest.mark.parametrize(
    "text, code, name",
    [("4 CAIXA", "4", "CAIXA"), ("CAIXA4 CAIXA", "4", "CAIXA"), ("CAIXA 4 CAIXA", "4", "CAIXA"), ("Caixa 4", "4", "CAIXA"), ("caixa", None, "CAIXA")],
)
def test_split_code(spark, text, code, name):
    got = one(spark, split_code(F.lit(text)))
    assert (got.codigo, got.descricao) == (code, name)


def test_column_names():
    assert standard_name("Cód.") == "codigo"
    assert standard_name("saldo_anterior") == "saldo_anterior"
    assert standard_name("saldo_anterior", legacy=True) == "saldo_atual"
    assert standard_name("Filial Sul") == "filial_sul"


def test_rename_keeps_first(spark):
    df = spark.createDataFrame([("1", "a", "b")], ["Cod", "Nome", "Conta"])
    assert rename_by_alias(df).columns == ["codigo", "descricao"]


def test_ranked_on_a_hot_key(spark):
    """A third of all rows, ties included, in one key: numbers and sums equal brute force."""
    rng = random.Random(7)
    rows = [("hot" if i % 3 == 0 else f"k{i % 50}", rng.randint(1, 40), i) for i in range(6000)]
    df = spark.createDataFrame(rows, "k string, v bigint, id bigint").repartition(8)
    got = ranked(df, ["k"], [F.desc("v"), F.asc("id")], running="run", measure="v", total="all").collect()
    want = []
    for key in {r[0] for r in rows}:
        run, own = 0, sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2]))
        for n, (k, v, i) in enumerate(own, start=1):
            run += v
            want.append((k, v, i, n, run, sum(r[1] for r in own)))
    assert sorted(map(tuple, got)) == sorted(want)


def test_ranked_without_key_and_with_null_key(spark):
    df = spark.createDataFrame([(None, 3), (None, 5), ("a", 1)], "k string, v int")
    assert sorted((r.v, r.posicao) for r in ranked(df, [], [F.desc("v")]).collect()) == [(1, 3), (3, 2), (5, 1)]
    assert sorted((str(r.k), r.v, r.posicao) for r in ranked(df, ["k"], [F.desc("v")]).collect()) == [
        ("None", 3, 2), ("None", 5, 1), ("a", 1, 1),
    ]


def test_top_rows_are_cut_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    top = top_rows(df, ["k"], [F.desc("id")], 2)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert sorted((r.k, r.posicao, r.id) for r in top.collect()) == [(0, 1, 99), (0, 2, 96), (1, 1, 97), (1, 2, 94), (2, 1, 98), (2, 2, 95)]


SUPPLIERS = "doc string, seq int, nome string, saldo_anterior decimal(18,2), debito decimal(18,2), credito decimal(18,2), saldo_em_aberto decimal(18,2)"


def rows_of(spark, *named):
    from decimal import Decimal

    return spark.createDataFrame([(d, i, n, Decimal(0), Decimal(0), Decimal(v), Decimal(v)) for i, (d, n, v) in enumerate(named)], SUPPLIERS)


def test_abc(spark):
    df = rows_of(spark, ("x", "A", 80), ("x", "B", 10), ("x", "C", 5), ("x", "D", 5), ("y", "Only", 7), ("z", "Zero", 0))
    got = {(r.doc, r.nome): (r.ranking, r.classe_abc, r.percentual_acumulado) for r in suppliers.abc_ranking(df, ["doc"]).collect()}
    assert got == {
        ("x", "A"): (1, "A", 80.0), ("x", "B"): (2, "B", 90.0), ("x", "C"): (3, "B", 95.0), ("x", "D"): (4, "C", 100.0),
        ("y", "Only"): (1, "A", 100.0), ("z", "Zero"): (1, "A", 0.0),
    }


def test_concentration_and_periods(spark):
    old = rows_of(spark, ("x", "Alfa", 100), ("x", "Beta", 50))
    new = rows_of(spark, ("x", " alfa", 150), ("x", "Gama", 20), ("x", "GAMA", 30))
    con = suppliers.concentration(old, ["doc"]).first()
    assert round(con.indice_hhi, 4) == round((200 / 3) ** 2 + (100 / 3) ** 2, 4) and con.tres_maiores == "Alfa, Beta"
    got = {r.nome: (float(r.variacao_absoluta), r.variacao_percentual, r.situacao) for r in suppliers.compare_periods(old, new, ["doc"]).collect()}
    # of two equal names the lower one in the ranking counts
    assert got == {" alfa": (50.0, 50.0, "Ativo"), "Beta": (-50.0, -100.0, "Descontinuado"), "Gama": (20.0, None, "Novo")}


def test_supplier_documents(spark):
    # a supplier that is itself called FORNECEDOR counts as a heading
    headings = shop_text("natural").replace("TECELAGEM", "FORNECEDOR").replace("AVIAMENTOS", "FORNECEDOR")
    docs = spark.createDataFrame([("a", headings), ("b", WORKSHOP_TEXT)], "doc_id string, texto string")
    read = read_supplier_documents(docs)
    assert supplier_rows(read, ["doc_id"]).filter("nome like 'FORNECEDOR%'").count() == 0
    renamed = shop_text("natural").replace("TECELAGEM AURORA", "ALFA INFORMATICA").replace("AVIAMENTOS SERRANA", "BETA")
    read = read_supplier_documents(spark.createDataFrame([("a", "Empresa: Loja  X  Folha: 1\n" + renamed)], "doc_id string, texto string"))
    assert read.first().nome == "Loja X"
    assert {r.nome for r in supplier_rows(read, ["doc_id"]).collect()} == {"ALFA INFORMATICA LTDA", "BETA EIRELI"}
    found = supplier_analysis(account_rows(read, ["doc_id"]), supplier_rows(read, ["doc_id"]))
    titles = {r.titulo for r in found.recomendacoes.collect()}
    assert "Dependência crítica de ALFA INFORMATICA LTDA" in titles and "Base de fornecedores muito pequena" in titles
    lines = [r.texto for r in supplier_report(found, read).orderBy("linha").collect()]
    assert lines[0] == "═" * 78 and lines[-1] == "═" * 78
    assert f"  {'Ativo Circulante':<28} {'R$ 0,00':>20}" in lines
    assert any(l.startswith("  1  ALFA INFORMATICA LTDA") for l in lines)
    assert set(workbook_tables(found)) >= {"resumo_executivo", "fornecedores", "categorias", "plano_de_contas"}


def test_cleaning(spark):
    rows = [("d", 1, " a\u0007 b ", None, "1"), ("d", 2, " ", None, ""), ("d", 3, " a\u0007 b ", None, "1"), ("d", 4, "c", None, "1")]
    df = spark.createDataFrame(rows, "doc string, linha int, nome string, vazia string, col_0 string")
    got = cleaning.clean(df, ["doc"])
    assert sorted((r.linha, r.nome) for r in got.linhas.collect()) == [(1, "a b"), (4, "c")]
    assert {r.mensagem for r in got.avisos.collect()} == {
        "1 linhas vazias removidas.", "1 colunas vazias removidas.", "Colunas sem utilidade removidas: ['col_0']", "1 duplicatas removidas.",
    }


def test_columns_are_empty_by_key(spark):
    rows = [("d", 1, "a", None), ("d", 2, "b", None), ("e", 1, "a", "x")]
    got = cleaning.clean(spark.createDataFrame(rows, "doc string, linha int, nome string, nota string"), ["doc"])
    assert [tuple(r) for r in got.avisos.collect()] == [("d", "1 colunas vazias removidas.")]


def test_strategy_registry(spark):
    df = spark.createDataFrame([("BALANCETE", "4 CAIXA"), ("LIVRO_DIARIO", "5 BANCO")], "document_type string, descricao string")
    special = lambda rows, keep: standard_rows(rows, keep).withColumn("natureza", F.lit("X"))
    before = dict(STRATEGIES)
    try:
        register_strategy("LIVRO_DIARIO", special)
        got = {r.codigo: r.natureza for r in route(df, ["document_type"]).collect()}
    finally:
        STRATEGIES.clear()
        STRATEGIES.update(before)
    assert got == {"4": None, "5": "X"}


FILES = {
    "a.csv": "Cód.;Histórico;Vlr.\n1;Compra; 1.234,56 \n1;Compra; 1.234,56 \n;;\n2;Luz;x\n".encode(),
    "b.CSV": "codigo,descricao,valor\n1,\"Serviço, mensal\",\"10,00\"\n".encode("latin-1"),
    "c.csv": "uma coluna\n1\n".encode(),
    "d.csv": b" \n ",
    "e.doc": b"x",
    "f.pdf": b"nope",
    "g.pdf": b"%PDF-1.4",
    "h.csv": b"",
    "i.csv": b"codigo;descricao\n1;a\n2;b;c;d\n",
}


def test_uploads(spark, tmp_path):
    for name, content in FILES.items():
        (tmp_path / name).write_bytes(content)
    found = files.read_files(spark, str(tmp_path)).select("nome", "length", "content")
    # the file reader passes over files of no bytes; as rows they are refused like any other
    empty = spark.createDataFrame([("h.csv", 0, bytearray())], found.schema)
    found = found.union(empty).withColumn("doc_id", F.col("nome"))
    data = prepare(found)
    entries = {r.nome: (r.entrada.status, r.leitura.separador if r.leitura else None) for r in data.arquivos.collect()}
    assert entries == {
        "a.csv": ("ACEITO", ";"), "b.CSV": ("ACEITO", ","), "c.csv": ("REJEITADO", None), "d.csv": ("REJEITADO", None),
        "e.doc": ("REJEITADO", None), "f.pdf": ("REJEITADO", None), "g.pdf": ("ACEITO", None), "h.csv": ("REJEITADO", None),
        "i.csv": ("REJEITADO", None),
    }
    rows = {(r.doc_id, r.linha): (r.codigo, r.descricao, None if r.valor is None else float(r.valor)) for r in data.registros.collect()}
    assert rows == {
        ("a.csv", 1): ("1", "COMPRA", 1234.56), ("a.csv", 2): ("2", "LUZ", None), ("b.CSV", 1): ("1", "SERVICO, MENSAL", 10.0),
    }
    assert [tuple(r) for r in data.erros.collect()] == [("a.csv", 2, 4, "valor", "VALOR_INVALIDO", "x")]
    stats = {r.doc_id: (r.linhas_validas, r.linhas_invalidas, r.duplicatas_removidas) for r in data.estatisticas.collect()}
    assert stats == {"a.csv": (1, 1, 1), "b.CSV": (1, 0, 0)}
    assert files.first_of_each(found.union(found)).count() == len(FILES)


ODD_FILES = {
    "vazia.csv": "codigo;nada;descricao\n1;;A\n2;;B\n",
    "indice.csv": "Unnamed: 0;codigo;descricao\n0;1;A\n1;1;A\n",
    "contabil.csv": "codigo;descricao;nota\n1;BALANCETE DO ANO;x\n2;CAIXA;y\n2;CAIXA;z\n;;w\n",
    "solta.csv": "texto;x\nBALANCETE;1\nCAIXA;2\n",
    "branca.csv": "codigo;descricao\n ; \n;\n",
}


def test_uploads_are_cleaned_in_order(spark):
    rows = [(name, name, len(text), bytearray(text.encode())) for name, text in ODD_FILES.items()]
    data = prepare(spark.createDataFrame(rows, "doc_id string, nome string, length long, content binary"))
    kept = {(r.doc_id, r.linha, r.linha_arquivo): (r.codigo, r.descricao) for r in data.registros.collect()}
    assert kept == {
        ("vazia.csv", 1, 1): ("1", "A"), ("vazia.csv", 2, 2): ("2", "B"), ("indice.csv", 1, 1): ("1", "A"),
        ("contabil.csv", 1, 1): ("1", "BALANCETE DO ANO"), ("contabil.csv", 2, 2): ("2", "CAIXA"),
        ("solta.csv", 1, 1): (None, None), ("solta.csv", 2, 2): (None, None),
    }
    said = {(r.doc_id, r.mensagem) for r in data.avisos.collect()}
    assert said == {
        ("vazia.csv", "1 colunas vazias removidas."),
        ("indice.csv", "Colunas sem utilidade removidas: ['Unnamed: 0']"), ("indice.csv", "1 duplicatas removidas."),
        ("contabil.csv", "5 colunas vazias removidas."), ("contabil.csv", "1 duplicatas removidas."),
        ("branca.csv", "2 linhas vazias removidas."), ("branca.csv", "2 colunas vazias removidas."),
    }
    stats = {r.doc_id: (r.linhas_validas, r.duplicatas_removidas) for r in data.estatisticas.collect()}
    assert stats == {"vazia.csv": (2, 0), "indice.csv": (1, 1), "contabil.csv": (2, 1), "solta.csv": (2, 0), "branca.csv": (0, 0)}


def test_quoted_cells(spark):
    text = 'codigo;descricao;valor\n1;"DUAS\nLINHAS; E ""ASPAS""";"1,50"\nNA;null;N/A\n3;NADA;2\n'
    data = prepare(spark.createDataFrame([("q", "q.csv", len(text), bytearray(text.encode()))], "doc_id string, nome string, length long, content binary"))
    rows = {r.linha: (r.codigo, r.descricao, None if r.valor is None else float(r.valor)) for r in data.registros.collect()}
    assert rows == {1: ("1", 'DUAS LINHAS; E "ASPAS"', 1.5), 2: ("3", "NADA", 2.0)}


def test_ledger_files_and_sinks(spark, tmp_path):
    (tmp_path / "l.csv").write_text("data,categoria,fornecedor,valor\n2026-06-01,a,b,1.5\n", encoding="utf-8")
    (tmp_path / "l.tsv").write_text("data\tcategoria\tfornecedor\tvalor\n2026-06-01\ta\tb\t1.5\n", encoding="utf-8")
    csv, tsv = (tables.read_ledger(spark, str(tmp_path / n)) for n in ("l.csv", "l.tsv"))
    assert csv.collect() == tsv.collect()
    with pytest.raises(ValueError):
        tables.read_ledger(spark, "x.ods")
    assert tables.combine_tables([csv, tsv.withColumn("mais", F.lit(1))]).columns[-1] == "mais"
    lines = spark.createDataFrame([("e/1", i, f"linha {i} é") for i in range(1, 40)], "empresa string, linha int, texto string")
    sinks.write_lines(lines.repartition(4), str(tmp_path / "out"), ["empresa"], lines_per_file=7)
    parts = sorted((tmp_path / "out" / "empresa=e_1").glob("parte=*/part-*"))
    assert len(parts) == 6
    text = "".join(p.read_text(encoding="utf-8") for p in parts)
    assert text.splitlines() == [f"linha {i} é" for i in range(1, 40)]
    sinks.write_records(csv.withColumn("empresa", F.lit("x")), str(tmp_path / "rec"), ["empresa"])
    assert spark.read.parquet(str(tmp_path / "rec")).count() == 1
    assert sinks.safe_name("06/2026 – x") == "06_2026_x"


def test_sinks_evaluate_their_input_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    def rows(schema, n=50):
        made = spark.range(n).selectExpr("CAST(id % 3 AS string) AS empresa", "CAST(id + 1 AS int) AS linha", "concat('t', id) AS texto", "'s' AS secao", "concat('{', id, '}') AS json")
        return made.select(*schema).mapInPandas(counted, made.select(*schema).schema)

    sinks.write_records(rows(["empresa", "texto"]), str(tmp_path / "a"), ["empresa"])
    sinks.write_lines(rows(["empresa", "linha", "texto"]), str(tmp_path / "b"), ["empresa"])
    sinks.write_json_lines(rows(["empresa", "secao", "json"]), str(tmp_path / "c"), ["empresa"])
    assert seen.value == 150
    assert spark.read.parquet(str(tmp_path / "a")).count() == spark.read.text(str(tmp_path / "b")).count() == spark.read.text(str(tmp_path / "c")).count() == 50


def test_upload_statistics_read_the_files_once(spark):
    rows = [(name, name, len(text), bytearray(text.encode())) for name, text in ODD_FILES.items()]
    files_read = spark.createDataFrame(rows, "doc_id string, nome string, length long, content binary").repartition(2)
    data = prepare(files_read)
    for table in (data.estatisticas, data.metadados, data.registros, data.avisos):
        plan = table._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1 and plan.count("Join") == 0


def test_stream_takes_each_file_once(spark, tmp_path):
    source, out, mark = (tmp_path / n for n in ("in", "out", "mark"))
    source.mkdir()
    (source / "1.txt").write_text(shop_text(), encoding="utf-8")
    (source / "2.txt").write_text("nada aqui", encoding="utf-8")
    run = lambda: folder.ingest_trial_balances(spark, str(source), str(out), str(mark))
    run()
    run()
    (source / "3.txt").write_text(WORKSHOP_TEXT, encoding="utf-8")
    run()
    status = spark.read.parquet(str(out / "status"))
    assert sorted(r.status for r in status.collect()) == ["NOT_ACCOUNTING", "OK", "OK"]
    assert spark.read.parquet(str(out / "lancamentos")).count() == 6
    assert folder.any_success(status)


def test_stream_uploads(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.csv").write_bytes(FILES["a.csv"])
    folder.ingest_uploads(spark, str(source), str(tmp_path / "out"), str(tmp_path / "mark"))
    assert spark.read.parquet(str(tmp_path / "out" / "registros")).count() == 2
    assert spark.read.parquet(str(tmp_path / "out" / "erros")).count() == 1


def test_a_renamed_folder_brings_no_upload_twice(spark, tmp_path):
    source = tmp_path / "in"
    (source / "maio").mkdir(parents=True)
    (source / "maio" / "a.csv").write_bytes(FILES["a.csv"])
    run = lambda: folder.ingest_uploads(spark, str(source), str(tmp_path / "out"), str(tmp_path / "mark"))
    run()
    (source / "maio").rename(source / "junho")
    (source / "junho" / "b.csv").write_bytes(FILES["b.CSV"])
    (source / "copia").mkdir()
    (source / "copia" / "a.csv").write_bytes(FILES["a.csv"])
    run()
    run()
    taken = spark.read.parquet(str(tmp_path / "out" / "arquivos"))
    assert sorted(r.nome for r in taken.collect()) == ["a.csv", "b.csv"]
    assert spark.read.parquet(str(tmp_path / "out" / "registros")).count() == 3

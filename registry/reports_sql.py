"""SQL for the JSON records and the supplier report, character by character."""

from __future__ import annotations

from registry.analysis import SQL as ANALYSIS
from registry.common import FULL
from registry.suppliers_sql import IND, _DOC_CON, _DOC_RULES, _brl
from registry.uploads import SQL as UPLOADS

_MONEY = "printf('%.2f', {0})".format
_PLAIN = "CAST({0} AS VARCHAR)".format
_TEXT = "to_json({0})".format


def _record(**fields: str) -> str:
    """A JSON object of the fields that are not null, in this order."""
    return "'{' || concat_ws(',', " + ", ".join(f"'\"{name}\":' || {value}" for name, value in fields.items()) + ") || '}'"


_INCREASE = _record(
    categoria=_TEXT("categoria"), variacao_percentual=_PLAIN("variacao_percentual"), valor_atual=_MONEY("valor_atual"),
    valor_referencia=_MONEY("valor_referencia"),
)
_CHANGE = {
    "categoria": _TEXT("categoria"), "valor_atual": _MONEY("valor_atual"), "valor_referencia": _MONEY("valor_referencia"),
    "variacao_absoluta": _MONEY("variacao_absoluta"), "variacao_percentual": _PLAIN("variacao_percentual"),
    "base_comparacao": _TEXT("base_comparacao"),
}
_ALERT = {
    "categoria": _TEXT("categoria"), "tipo": _TEXT("tipo"), "severidade": _TEXT("severidade"), "valor_atual": _MONEY("valor_atual"),
    "valor_referencia": _MONEY("valor_referencia"), "variacao_percentual": _PLAIN("variacao_percentual"), "mensagem": _TEXT("mensagem"),
}
_COUNTS = {name: _PLAIN(name) for name in ("numero_alertas", "alertas_baixa", "alertas_media", "alertas_alta", "alertas_critica")}


def _ranking(dimension: str) -> str:
    record = _record(**{
        "posicao": _PLAIN("posicao"), dimension: _TEXT(dimension), "total": _MONEY("total"), "quantidade": _PLAIN("quantidade"),
        "percentual_do_total": _PLAIN("percentual_do_total"),
    })
    return f"SELECT empresa, periodo, 'rankings.por_{dimension}', {record} FROM ({ANALYSIS[f'ranking_{dimension}']})"


_RESULT = _record(
    receita_total=_MONEY("receita_total"), despesa_total=_MONEY("despesa_total"), resultado=_MONEY("resultado"),
    situacao=_TEXT("situacao"), margem_percentual=_PLAIN("margem_percentual"),
)
_CARDS = _record(gasto_total=_MONEY("gasto_total"), quantidade_lancamentos=_PLAIN("quantidade_lancamentos"), maior_aumento="maior", **_COUNTS)

BUNDLE = f"""SELECT empresa, periodo, 'resultado_contabil' AS secao, {_RESULT} AS json FROM ({ANALYSIS['pnl']})
UNION ALL SELECT empresa, periodo, 'resumo', {_CARDS} FROM ({ANALYSIS['summary_cards']})
  LEFT JOIN (SELECT empresa, periodo, {_INCREASE} AS maior FROM ({ANALYSIS['biggest_increase']})) USING (empresa, periodo)
UNION ALL SELECT empresa, periodo, 'variacoes', {_record(**_CHANGE)} FROM ({FULL} SELECT * FROM variations)
UNION ALL SELECT empresa, periodo, 'alertas', {_record(**_ALERT)} FROM ({ANALYSIS['alerts']})
UNION ALL {_ranking('categoria')} UNION ALL {_ranking('fornecedor')}"""

# the letters before the amount in 'CPFL 1.234,56' read as the mark of a sheet number
_SHEET = """SELECT o_orderkey AS doc_id, regexp_extract(format('{:,.2f}', CAST((t // 10) / 100 AS DOUBLE)), '^([0-9]+)', 1) AS folha
  FROM (SELECT *, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS t FROM orders) WHERE o_orderpriority = '1-URGENT'"""
_METADATA = _record(
    folha=_TEXT("folha"), nome_arquivo=_TEXT("nome_arquivo"), tipo_arquivo=_TEXT("tipo_arquivo"), document_type=_TEXT("document_type"),
    numero_registros=_PLAIN("numero_registros"), numero_colunas=_PLAIN("numero_colunas"),
)
_STATISTICS = _record(
    duplicatas_removidas=_PLAIN("duplicatas_removidas"), linhas_validas=_PLAIN("linhas_validas"), linhas_invalidas=_PLAIN("linhas_invalidas"),
    categorias_identificadas=_TEXT("string_split(categorias_identificadas, ',')"), valores_ausentes=_PLAIN("valores_ausentes"),
    total_gastos_fornecedores=_MONEY("total_gastos_fornecedores"),
)
_ERROR = _record(
    linha=_PLAIN("linha"), linha_arquivo=_PLAIN("linha_arquivo"), coluna=_TEXT("coluna"), erro=_TEXT("erro"), motivo=_TEXT("motivo")
)
# rows 1 to 3 stand before the copy and the blank row, rows 4 and 5 behind them
_RECORD = _record(
    linha=_PLAIN("linha"), linha_arquivo=_PLAIN("CASE WHEN linha > 3 THEN linha + 2 ELSE linha END"), codigo=_TEXT("codigo"),
    descricao=_TEXT("descricao"), data=_TEXT("data"), valor="printf('%.3f', valor)", categoria=_TEXT("categoria"),
    outras="CASE WHEN NOT contabil THEN '{\"filial\":' || coalesce(to_json(filial), 'null') || '}' END",
)
_SPEND = _record(
    fornecedor=_TEXT("fornecedor"), valor_gasto=_MONEY("valor_gasto"), debito=_MONEY("debito"), credito=_MONEY("credito"),
    saldo_atual=_MONEY("saldo_atual"), quantidade_lancamentos=_PLAIN("quantidade_lancamentos"),
)

DATASET = f"""SELECT doc_id, 'metadata' AS secao, {_METADATA} AS json FROM ({UPLOADS['dataset_metadata']}) LEFT JOIN ({_SHEET}) USING (doc_id)
UNION ALL SELECT doc_id, 'statistics', {_STATISTICS} FROM ({UPLOADS['quality_stats']})
UNION ALL SELECT doc_id, 'warnings', {_record(mensagem=_TEXT('mensagem'))} FROM ({UPLOADS['upload_warnings']})
UNION ALL SELECT doc_id, 'errors', {_ERROR} FROM ({UPLOADS['typed_errors']})
UNION ALL SELECT doc_id, 'records', {_RECORD} FROM ({UPLOADS['upload_records']})
  JOIN (SELECT o_orderkey AS doc_id, o_orderpriority = '1-URGENT' AS contabil FROM orders) USING (doc_id)
UNION ALL SELECT doc_id, 'gastos_por_fornecedor', {_SPEND} FROM ({UPLOADS['supplier_spend_stats']})"""


def _left(x: str, width: int) -> str:
    """Padded on the left, never cut."""
    return f"repeat(' ', greatest({width} - length({x}), 0)) || {x}"


def _right(x: str, width: int) -> str:
    return f"{x} || repeat(' ', greatest({width} - length({x}), 0))"


_RULER, _FRAME = "─" * 78, "═" * 78
_FIGURES = (
    ("Ativo Circulante", "ativo_circulante"), ("Passivo Circulante", "passivo_circulante"), ("Caixa Disponível", "caixa"), ("Estoque", "estoque"),
    ("Patrimônio Líquido", "patrimonio_liquido"), ("Receita Bruta do Período", "receita_bruta"), ("Capital de Giro", "capital_de_giro"),
)


class _Lines:
    """Lines with a place: section, block, place of the row within the block, place within the row."""

    def __init__(self):
        self.parts: list[str] = []

    def one(self, section: int, block: int, text: str, source: str, row: str = "0", within: int = 0) -> None:
        self.parts.append(f"SELECT doc_id, {section} AS secao, {block} AS bloco, CAST({row} AS DOUBLE) AS lugar, {within} AS parte, {text} AS texto FROM {source}")

    def heading(self, section: int, title: str) -> None:
        for block, text in enumerate(("", title, _RULER)):
            self.one(section, block, f"'{text}'", "todos")


def _report() -> str:
    lines, some, none = _Lines(), "ct", "todos ANTI JOIN ct USING (doc_id)"
    known = "todos JOIN cab USING (doc_id)"
    for block, text in enumerate((f"'{_FRAME}'", "'  ANÁLISE DE FORNECEDORES'", f"'{_FRAME}'", "'Empresa : ' || nome",
                                  "CASE WHEN cnpj <> '' THEN 'CNPJ    : ' || cnpj END", "'Período : ' || periodo",
                                  "'Arquivo : balancete_' || doc_id || '.txt'")):
        lines.one(0, block, text, known)
    lines.heading(1, "INDICADORES FINANCEIROS")
    for block, (name, column) in enumerate(_FIGURES, start=3):
        lines.one(1, block, f"'  {name:<28} ' || {_left('(' + _brl(column) + ')', 20)}", "todos")
    lines.one(1, 20, f"'  {'Liquidez Corrente':<28} ' || " + _left("printf('%.2f', liquidez_corrente)", 19) + """ || 'x  (' || CASE WHEN liquidez_corrente >= 1.5
    THEN 'saudável' WHEN liquidez_corrente >= 1 THEN 'apertada' ELSE 'crítica' END || ')'""", "todos")
    lines.one(1, 21, f"'  {'Margem Líquida':<28} ' || " + _left("printf('%.1f', margem_liquida)", 19) + " || '%'", "todos")
    lines.heading(2, "RANKING DE FORNECEDORES (POR MOVIMENTAÇÃO NO PERÍODO, TOP 15)")
    lines.one(2, 3, "'  Nenhum fornecedor com saldo identificado neste período.'", none)
    lines.one(2, 3, f"'  {'#':<3}{'Fornecedor':<40}{'Movimentação':>16}{'%':>8}{'Acum%':>8}{'ABC':>5}'", some)
    lines.one(2, 4, f"'  {'-' * 80}'", some)
    ranked = "'  ' || " + " || ".join((
        _right("CAST(ranking AS VARCHAR)", 3), _right("nome_curto", 40), _left("(" + _brl("CAST(mov / 100 AS DOUBLE)") + ")", 16),
        _left("printf('%.1f', mov / total * 100)", 7), "'%'", _left("printf('%.1f', ate / total * 100)", 7), "'%    '",
        "CASE WHEN ate * 100 <= total * 80 OR ranking = 1 THEN 'A' WHEN ate * 100 <= total * 95 THEN 'B' ELSE 'C' END",
    ))
    lines.one(2, 10, ranked, "rk WHERE ranking <= 15", row="ranking")
    for block, text in enumerate((f"'  {'-' * 80}'", f"'  {'TOTAL':<43}' || " + _left("(" + _brl("total") + ")", 16), "''",
                                  "'  Saldo em aberto total (a pagar na data-base): ' || " + _brl("aberto"),
                                  "'  Índice de concentração (HHI): ' || format('{:,.0f}', hhi) || ' / 10.000'"), start=20):
        lines.one(2, block, text, "ct JOIN con USING (doc_id)")
    lines.heading(3, "GASTOS POR CATEGORIA")
    lines.one(3, 3, "'  Sem dados suficientes.'", none)
    bar = "'  ' || " + " || ".join((_right("categoria", 40), _left("(" + _brl("total") + ")", 14), "' (' || quantidade_fornecedores || ') '",
                                    "repeat('█', CAST(floor(total / CASE WHEN maior <> 0 THEN maior ELSE 1 END * 30) AS BIGINT))"))
    lines.one(3, 10, bar, """(SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY total DESC, categoria) AS k, max(total) OVER (PARTITION BY doc_id) AS maior
    FROM cat)""", row="k")
    lines.one(4, 0, "''", "todos")
    lines.one(4, 1, "'RECOMENDAÇÕES (' || coalesce(n, 0) || ')'", "todos LEFT JOIN (SELECT doc_id, count(*) AS n FROM adv GROUP BY ALL) USING (doc_id)")
    lines.one(4, 2, f"'{_RULER}'", "todos")
    lines.one(4, 3, "'  Nenhuma recomendação gerada.'", "todos ANTI JOIN adv USING (doc_id)")
    for part, text in enumerate(("''", "'  ' || ordem || '. [' || upper(prioridade) || '] ' || titulo || '  (' || categoria || ')'", "'     ' || descricao")):
        lines.one(4, 10, text, "adv", row="ordem", within=part)
    lines.one(5, 0, "''", "todos")
    lines.one(5, 1, f"'{_FRAME}'", "todos")
    return "\n  UNION ALL ".join(lines.parts)


def supplier_report(header: str) -> str:
    return f"""{IND}{_DOC_CON}, todos AS (SELECT base.*, ind.* EXCLUDE (doc_id, caixa, passivo_circulante) FROM base JOIN ind USING (doc_id)),
ct AS (SELECT doc_id, CAST(sum(mov) / 100 AS DOUBLE) AS total, CAST(sum(atual) / 100 AS DOUBLE) AS aberto FROM f GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY mov DESC, seq) AS ranking, sum(mov) OVER (PARTITION BY doc_id) AS total,
  sum(mov) OVER (PARTITION BY doc_id ORDER BY mov DESC, seq ROWS UNBOUNDED PRECEDING) AS ate FROM f),
adv AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY peso, least(regra, 14), na_regra, titulo) AS ordem FROM ({_DOC_RULES})),
cab AS ({header}),
linhas AS ({_report()})
SELECT doc_id, secao, row_number() OVER (PARTITION BY doc_id ORDER BY secao, bloco, lugar, parte) AS linha, texto FROM linhas WHERE texto IS NOT NULL"""

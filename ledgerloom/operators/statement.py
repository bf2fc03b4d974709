"""Accounting statements in loose text or tables, to the seven standard columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.money import nature_suffix, parse_money
from ledgerloom.functions.text import SPACE, bind, clean_cell, lines, strip, upper_key
from ledgerloom.operators.layouts import item_rows
from ledgerloom.operators.ranking import top_rows
from ledgerloom.vocab import STANDARD_ACCOUNT_COLUMNS

# Ways a code and a description stand on one line, tried in this order.
# The last number is the group of the code, the first that of the description.
CODE_DESCRIPTION = (
    (r"^([A-ZÀ-Ü\s.&\-]+?)\s+(\d+)\s+\1$", 1, 2),
    (r"^([A-ZÀ-Ü]+)(\d+)\s+\1$", 1, 2),
    (r"^(\d+)\s+(.+)$", 2, 1),
    (r"^(.+?)\s+(\d+)$", 1, 2),
)
_AMOUNT = r"(?:\(?\-?\d[\d.,]*\)?)"
# the first form may cut one amount in two, because nothing has to stand between amounts
AMOUNTS_AT_END_LEGACY = rf"^(.+?)\s+({_AMOUNT}?)\s*({_AMOUNT}?)\s*({_AMOUNT}?)\s*({_AMOUNT})\s*$"
AMOUNTS_AT_END = rf"^(.+?)(?:\s+({_AMOUNT}))?(?:\s+({_AMOUNT}))?(?:\s+({_AMOUNT}))?\s+({_AMOUNT})\s*$"


def _pattern(p: str) -> str:
    return f"(?dU){p}"


def split_code(text: Column) -> Column:
    """``struct(codigo, descricao)`` of a text such as ``4 CAIXA`` or ``CAIXA4 CAIXA``."""

    def read(own: Column) -> Column:
        pair = lambda code, name: F.struct(code.alias("codigo"), name.alias("descricao"))
        result = F
        for p, name, code in CODE_DESCRIPTION:
            found = lambda g, p=p: F.regexp_extract(own, _pattern(p), g)
            result = result.when(own.rlike(_pattern(p)), pair(found(code), found(name)))
        split = result.otherwise(pair(F.lit(None).cast("string"), own))
        return bind(split, lambda s: pair(s["codigo"], upper_key(s["descricao"])))

    return bind(strip(text), read)


def _amounts(line: Column, form: str) -> Column:
    part = lambda g: F.regexp_extract(line, _pattern(form), g)
    names = ("saldo_anterior", "debito", "credito", "saldo_atual")
    return bind(
        split_code(part(1)),
        lambda cd: F.struct(
            cd["codigo"].alias("codigo"), cd["descricao"].alias("descricao"),
            *[parse_money(part(g)).alias(n) for g, n in enumerate(names, start=2)],
        ),
    )


def read_line(line: Column, legacy_order: bool = False) -> Column:
    """One statement line. Amounts at the end come first; with ``legacy_order`` the code and
    description patterns come first, so that a line starting with a number loses its amounts."""
    none = F.lit(None).cast("decimal(28,3)")

    def read(own: Column) -> Column:
        plain_text = bind(
            split_code(own),
            lambda cd: F.struct(
                cd["codigo"].alias("codigo"), cd["descricao"].alias("descricao"), none.alias("saldo_anterior"),
                none.alias("debito"), none.alias("credito"), none.alias("saldo_atual"),
            ),
        )
        coded = reduce(lambda a, b: a | b, [own.rlike(_pattern(p)) for p, _, _ in CODE_DESCRIPTION])
        form = AMOUNTS_AT_END_LEGACY if legacy_order else AMOUNTS_AT_END
        money_end = own.rlike(_pattern(form))
        if legacy_order:
            return F.when(F.length(own) >= 3, F.when(coded, plain_text).when(money_end, _amounts(own, form)))
        # a bare number at the end is a code, not an amount, unless it carries cents
        cents = own.rlike(r",\d{2}\)?\s*$")
        return F.when(
            F.length(own) >= 3,
            F.when(money_end & cents, _amounts(own, form)).when(coded, plain_text).when(money_end, _amounts(own, form)),
        )

    return bind(strip(line), read)


def statement_lines(docs: DataFrame, by, legacy_order: bool = False) -> DataFrame:
    """Statement rows of documents with a ``texto`` column."""
    read = F.transform(
        lines(F.col("texto")),
        lambda l, i: F.struct((i + 1).alias("linha"), read_line(l, legacy_order).alias("r")),
    )
    rows = item_rows(docs, by, F.filter(read, lambda x: x["r"].isNotNull()))
    return rows.select(*by, "c.linha", "c.r.*")


def standard_account(cells: Mapping[str, Column]) -> Column:
    """The seven columns from raw text cells, as one struct: code split off, nature from a
    suffix or the sign, money parsed, description as a key."""
    raw = {c: cells.get(c, F.lit(None).cast("string")) for c in STANDARD_ACCOUNT_COLUMNS}
    money_columns = ("saldo_atual", "saldo_anterior", "credito", "debito")
    amounts = F.transform(F.array(*[raw[c] for c in money_columns]), parse_money)
    suffixes = F.transform(F.array(*[raw[c] for c in money_columns]), nature_suffix)
    suffix = F.get(F.filter(suffixes, lambda n: n.isNotNull()), F.lit(0))
    has_code = F.coalesce(raw["codigo"], F.lit("")) != ""
    has_name = F.coalesce(raw["descricao"], F.lit("")) != ""
    named = F.when(has_code | ~has_name, F.struct(raw["codigo"].alias("codigo"), F.when(has_name, upper_key(raw["descricao"])).otherwise(raw["descricao"]).alias("descricao")))

    def row(name: Column, amount: Column) -> Column:
        balance = F.get(amount, F.lit(0))
        sign = F.when(balance >= 0, "D").when(balance < 0, "C")
        return F.struct(
            name["codigo"].alias("codigo"),
            name["descricao"].alias("descricao"),
            F.get(amount, F.lit(1)).alias("saldo_anterior"),
            F.get(amount, F.lit(3)).alias("debito"),
            F.get(amount, F.lit(2)).alias("credito"),
            balance.alias("saldo_atual"),
            F.coalesce(raw["natureza"], suffix, sign).alias("natureza"),
        )

    return bind(
        F.coalesce(named, split_code(raw["descricao"])), lambda name: bind(amounts, lambda amount: row(name, amount))
    )


def standard_rows(df: DataFrame, keep) -> DataFrame:
    """Table with alias-renamed text columns to the standard columns; rows with neither code
    nor description are dropped."""
    cells = {c: F.col(c) for c in df.columns if c in STANDARD_ACCOUNT_COLUMNS}
    raw = lambda c: F.coalesce(cells.get(c, F.lit(None).cast("string")), F.lit(""))
    # asked of the raw cells: a filter on the parsed ones would repeat the parsing
    named = df.filter((raw("codigo") != "") | (clean_cell(raw("descricao")) != ""))
    return named.select(*keep, standard_account(cells).alias("_c")).select(*keep, "_c.*")


# -- layouts by document type ----------------------------------------------------------

Strategy = Callable[[DataFrame, list[str]], DataFrame]
GENERIC = "GENERICO"

# Document type to the way its rows are standardised; the generic one serves all others.
STRATEGIES: dict[str, Strategy] = {
    "BALANCETE": standard_rows,
    "BALANCO_PATRIMONIAL": standard_rows,
    "DRE": standard_rows,
    GENERIC: standard_rows,
}


def register_strategy(document_type: str, strategy: Strategy) -> None:
    STRATEGIES[document_type] = strategy


def route(df: DataFrame, keep: list[str], type_column: str = "document_type") -> DataFrame:
    """Standardise every row with the strategy of its document type. Strategies that are the
    same function share one pass."""
    groups: dict[Strategy, list[str]] = {}
    for name, strategy in STRATEGIES.items():
        if name != GENERIC:
            groups.setdefault(strategy, []).append(name)
    generic = STRATEGIES[GENERIC]
    special = [n for s, names in groups.items() if s is not generic for n in names]
    kind = F.col(type_column)
    out = generic(df.filter(~kind.isin(*special)) if special else df, keep)
    for strategy, names in groups.items():
        if strategy is not generic:
            out = out.unionByName(strategy(df.filter(kind.isin(*names)), keep), allowMissingColumns=True)
    return out


def text_columns(docs: DataFrame, by) -> DataFrame:
    """Free text as cells: lines split on two blanks or a tab, else on any blank. Long form."""
    own = lambda l: F.split(l, rf"{SPACE}{{2,}}|\t")
    cells = lambda l: F.when(F.size(own(l)) > 1, own(l)).otherwise(F.split(l, f"{SPACE}+"))
    kept = F.filter(F.transform(lines(F.col("texto")), strip), lambda l: l != "")
    rows = item_rows(docs, by, F.transform(kept, lambda l, i: F.struct((i + 1).alias("linha"), cells(l).alias("celulas"))))
    split = rows.select(*by, "c.linha", F.posexplode("c.celulas").alias("_i", "valor"))
    return split.select(*by, "linha", F.concat(F.lit("col_"), F.col("_i").cast("string")).alias("coluna"), "valor")


def sheet_preview(rows: DataFrame, by, order: str, columns: list[str], n: int = 15) -> DataFrame:
    """Text of the first and last ``n`` rows of each table (all rows of a short one)."""
    head = top_rows(rows, by, [F.asc(order)], n, "_p").drop("_p")
    tail = top_rows(rows, by, [F.desc(order)], n, "_p").drop("_p")
    text = F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    both = head.unionByName(tail).select(*by, order, text.alias("_t")).distinct()
    # at most 2n short rows per key
    body = F.transform(F.array_sort(F.collect_list(F.struct(order, "_t"))), lambda x: x["_t"])
    header = F.lit(" ".join(columns))
    return both.groupBy(*by).agg(F.concat_ws("\n", header, F.array_join(body, "\n")).alias("texto"))

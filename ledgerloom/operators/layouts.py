"""Account lines of extracted text: known layouts, parsing and the choice between layouts.

A document is one row. Its accounts and layout stay inside that row as arrays, so parsing a
corpus is a narrow map without any shuffle, whatever the documents weigh. Lines are read in
Arrow batches (``reading.py``).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import reading
from ledgerloom.operators.hierarchy import TREE
from ledgerloom.vocab import BR_NUMBER, BR_NUMBER_GROUPED

@dataclass(frozen=True)
class Layout:
    """A line pattern and the fields its groups hold, in order. Patterns are Python's; those without
    look-around, back references and word bounds are matched in linear time."""

    name: str
    pattern: str
    groups: tuple[str, ...]
    #: What the signature of a line must hold for the pattern to have a chance; None: every line is tried.
    shape: str | None = None
    #: Every match has the shape, but for lines with a mark or with numbers run together.
    implied: bool = False

    @property
    def plan(self) -> tuple[str, tuple[str, ...], str | None, bool]:
        """What the workers need of it."""
        return self.pattern, self.groups, self.shape, self.implied


# Line patterns, tried in this order. Append a Layout to support another system.
_N = f"({BR_NUMBER})"
KNOWN_LAYOUTS: list[Layout] = [
    Layout(
        "reverso",
        rf"{_N}([DC]){_N}{_N}{_N}(\d+)\s+(.+)$",
        ("atual", "natureza", "credito", "debito", "anterior", "codigo", "descricao"),
        r"#[DC]###\d",
        implied=True,
    ),
    Layout(
        "natural",
        rf"(\d+)\s+(\D+?)\s+{_N}\s+{_N}\s+{_N}\s+{_N}([DC])\s*$",
        ("codigo", "descricao", "anterior", "debito", "credito", "atual", "natureza"),
        r"# # # #[DC] ?$",
        implied=True,
    ),
    Layout(
        "classificado",
        rf"(\d+)\s+([\d.]+)\s+{_N}([DC]){_N}([DC])?\s+{_N}\s+{_N}(.+)$",
        ("codigo", "classificacao", "atual", "natureza", "anterior", "natureza_anterior", "debito", "credito",
         "descricao"),
        r"#[DC]#[DC]? # #",
        implied=True,
    ),
]

_G = f"({BR_NUMBER_GROUPED})"
SUPPLIER_LAYOUT = Layout(
    "linha",
    rf"^(\d+)\s+(.+?)\s+{_G}\s+{_G}\s+{_G}\s+{_G}([DC])\s*$",
    ("codigo", "descricao", "anterior", "debito", "credito", "atual", "natureza"),
)


def _blank_null(c: Column) -> Column:
    return F.when(c != "", c)


_ACCOUNT = (
    "struct<seq: int, codigo: string, classificacao: string, descricao: string, saldo_anterior: bigint, "
    "natureza_anterior: string, debito: bigint, credito: bigint, saldo_atual: bigint, natureza: string>"
)
_MEASURES = "array<struct<contas: int, reconciliadas: int>>"
_READ = f"struct<layout: string, contas: array<{_ACCOUNT}>, medidas: {_MEASURES}, falha: {_ACCOUNT}>"


def _workers(function, kind: str, column: Column) -> Column:
    # not repeatable, so that no filter or projection above it has the texts read again
    return F.arrow_udf(function, kind).asNondeterministic()(column)


def accounts_with(text_lines: Column, layout: Layout) -> Column:
    """Array of accounts, money in cents, of lines (see :func:`signed_lines`). ``seq`` is the line number in the document."""
    return _workers(reading.finder(layout.plan), f"array<{_ACCOUNT}>", text_lines)


def signed_lines(text: Column, single_blanks: bool = False) -> Column:
    """``struct(seq, texto)`` of the lines that can hold an account at all; the others never reach the patterns."""
    return _workers(reading.liner(single_blanks), "array<struct<seq: int, texto: string>>", text)


def supplier_accounts(text: Column) -> Column:
    """Accounts of the supplier reports: blanks collapsed, dots and blanks cut off the name."""
    rows = accounts_with(signed_lines(text, single_blanks=True), SUPPLIER_LAYOUT)
    trimmed = lambda d: F.coalesce(_blank_null(F.btrim(d, F.lit(" ."))), d)
    return F.transform(rows, lambda c: c.withField("descricao", trimmed(c["descricao"])))


def measures_of(text: Column, layouts: Sequence[Layout]) -> Column:
    """What every layout finds in a text, whether or not it is needed: accounts, and accounts that reconcile."""
    return _workers(reading.measurer([l.plan for l in layouts]), _MEASURES, text)


def parse(text: Column, layouts: Sequence[Layout]) -> Column:
    """Everything read from a text: ``struct(layout, contas, medidas, falha)``. A layout after one that
    fits every account is not tried, and measures nothing."""
    return _workers(reading.parser([l.name for l in layouts], [l.plan for l in layouts]), _READ, text)


def parse_with_trees(text: Column, layouts: Sequence[Layout]) -> Column:
    """``struct(leitura, arvore)``: everything read from a text, and the tree of its accounts, without handing them over in between."""
    kind = f"struct<leitura: {_READ}, arvore: {TREE}>"
    return _workers(reading.parser([l.name for l in layouts], [l.plan for l in layouts], with_trees=True), kind, text)


def item_rows(df: DataFrame, by: Sequence[str], items: Column, *more: Column) -> DataFrame:
    """One row per array item, as struct ``c``.

    The outer form, because for the inner one the optimizer adds a filter on the array size
    and evaluates everything behind the array a second time.
    """
    return df.select(*by, *more, F.explode_outer(items).alias("c")).filter(F.col("c").isNotNull())


def money(cents: Column) -> Column:
    return (cents.cast("decimal(20,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(18,2)")

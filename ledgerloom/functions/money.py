"""Money parsing, rounding and Brazilian formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import SPACE, bind, strip
from ledgerloom.vocab import MONEY_PATTERN, NATURE_PATTERN

MONEY = "decimal(18,2)"


def as_money(c: Column) -> Column:
    return c.try_cast(MONEY)


def fixed(x: Column, places: int) -> Column:
    """Plain text with a fixed number of decimals, nearest value, exact halves to even."""
    return F.translate(F.format_number(x.cast("double"), places), ",", "")


def signed(x: Column, places: int) -> Column:
    text = fixed(x, places)
    return F.when(text.startswith("-"), text).otherwise(F.concat(F.lit("+"), text))


def round_exact(x: Column, places: int = 2) -> Column:
    """Nearest decimal of the binary value; used where rows are rounded one by one."""
    return fixed(x, places).cast("double")


def round_scaled(x: Column, places: int = 2) -> Column:
    """Scale, round half to even, unscale; used where whole columns are rounded."""
    return F.rint(x * F.lit(float(10**places))) / F.lit(float(10**places))


def br_number(c: Column) -> Column:
    """``1.234,56`` to a decimal."""
    return F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast(MONEY)


def br_text(x: Column, places: int = 2) -> Column:
    return F.translate(F.format_number(x, places), ",.", ".,")


def currency(x: Column) -> Column:
    return F.concat(F.lit("R$ "), br_text(x))


def currency_round(x: Column) -> Column:
    """Without cents, for chart labels."""
    return F.concat(F.lit("R$ "), br_text(x.cast("double"), 0))


def parse_money(c: Column) -> Column:
    """Money text to a number; null when the text does not look like money.

    Parentheses or a leading or trailing minus make it negative. Text such as
    ``1.234.567`` keeps the last dot as the decimal one, hence three decimals.
    """

    def number(bare: Column) -> Column:
        return (
            F.when(
                bare.contains(",") & bare.contains("."),
                F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit(".")),
            )
            .when(bare.contains(","), F.replace(bare, F.lit(","), F.lit(".")))
            .otherwise(F.regexp_replace(bare, r"\.(?=.*\.)", ""))
            .try_cast("decimal(28,3)")
        )

    def value(text: Column) -> Column:
        bare = F.regexp_replace(text, f"(?i)(?:[R$()]|{SPACE})", "")
        bare = F.regexp_replace(F.regexp_replace(bare, "[DCdc]$", ""), "-+$", "")
        negative = text.startswith("(") | text.startswith("-") | text.endswith("-")
        signed_value = bind(bind(bare, number), lambda n: F.when(negative, -F.abs(n)).otherwise(n))
        return F.when(text.rlike(MONEY_PATTERN), signed_value)

    return bind(strip(c), value)


def nature_suffix(c: Column) -> Column:
    """``D`` or ``C`` after the last digit, as in ``92.553,10C``."""
    found = F.regexp_extract(F.upper(strip(c)), NATURE_PATTERN, 1)
    return F.when(found != "", found)

"""Dates written in Brazilian and ISO forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import bind, strip
from ledgerloom.vocab import PERIOD_PATTERN


def _iso(text: Column, pattern: str, order: str) -> Column:
    return F.when(text.rlike(pattern), F.regexp_replace(text, pattern, order))


def parse_date(c: Column) -> Column:
    """One of five written forms, else null. Two-digit years 69 to 99 belong to the 1900s."""
    return bind(strip(c), _written_date)


def _written_date(text: Column) -> Column:
    century = F.when(F.substring(text, 7, 2).try_cast("int") >= 69, "19").otherwise("20")
    short = F.when(
        text.rlike(r"^\d{2}/\d{2}/\d{2}$"),
        F.concat(century, F.substring(text, 7, 2), F.lit("-"), F.substring(text, 4, 2), F.lit("-"),
                 F.substring(text, 1, 2)),
    )
    return F.coalesce(
        short,
        _iso(text, r"^(\d{2})[/](\d{2})[/](\d{4})$", "$3-$2-$1"),
        _iso(text, r"^(\d{2})-(\d{2})-(\d{4})$", "$3-$2-$1"),
        _iso(text, r"^(\d{4}-\d{2}-\d{2})$", "$1"),
        _iso(text, r"^(\d{2})\.(\d{2})\.(\d{4})$", "$3-$2-$1"),
    ).try_cast("date")


def parse_entry_date(c: Column) -> Column:
    """Looser reading for ledger files: ISO first, then month first, then day first."""
    return bind(strip(c), _entry_date)


def _entry_date(text: Column) -> Column:
    day = r"(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})(?:[ T].*)?"
    padded = lambda g: F.lpad(F.regexp_extract(text, f"^{day}$", g), 2, "0")
    year = F.regexp_extract(text, f"^{day}$", 3)
    month_first = F.concat_ws("-", year, padded(1), padded(2)).try_cast("date")
    day_first = F.concat_ws("-", year, padded(2), padded(1)).try_cast("date")
    slashed = F.regexp_extract(text, r"^(\d{4}/\d{1,2}/\d{1,2})(?:[ T].*)?$", 1)
    packed = F.regexp_replace(F.regexp_extract(text, r"^(\d{8})$", 1), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    return F.coalesce(
        # the usual case, without any pattern
        F.when(F.substring(text, 5, 1) == "-", text.try_cast("date")),
        F.when(packed != "", packed).try_cast("date"),
        F.when(slashed != "", F.replace(slashed, F.lit("/"), F.lit("-"))).try_cast("date"),
        F.when(year != "", F.coalesce(month_first, day_first)),
    )


def month_key(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def br_date(c: Column) -> Column:
    return F.date_format(c, "dd/MM/yyyy")


def period_end(text: Column, fallback: Column | None = None) -> Column:
    """Last day of the first ``dd/mm/yyyy - dd/mm/yyyy`` as ISO text."""
    found = F.regexp_extract(text, PERIOD_PATTERN, 2)
    iso = F.regexp_replace(found, r"^(\d{2})/(\d{2})/(\d{4})$", "$3-$2-$1")
    other = F.lit(None).cast("string") if fallback is None else fallback.cast("string")
    # bound, as the whole text would be searched again for the comparison
    return bind(iso, lambda day: F.when(day != "", day).otherwise(other))

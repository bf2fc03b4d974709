"""Document type, header fields and text checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import SPACE, bind, collapse, strip
from ledgerloom.vocab import (
    DOCUMENT_TYPE_PATTERNS,
    HEADER_PATTERNS,
    MIN_TEXT_CHARS,
    NO_COMPANY_LABEL,
    SUPPLIER_HEADER_PATTERNS,
    UNKNOWN_DOCUMENT,
)


def document_type(text: Column) -> Column:
    result = F
    for name, pattern in DOCUMENT_TYPE_PATTERNS:
        result = result.when(text.rlike(f"(?iuU){pattern}"), F.lit(name))
    return result.otherwise(F.lit(UNKNOWN_DOCUMENT))


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return bind(strip(F.regexp_extract(text, pattern, group)), lambda value: F.when(value != "", value))


def header_fields(text: Column) -> dict[str, Column]:
    """Company, tax number, period and the other header fields; null where absent."""
    return {
        name: _found(text, f"(?{'' if name == 'cnpj' else 'iu'}dU){pattern}") for name, pattern in HEADER_PATTERNS.items()
    }


def supplier_header(text: Column) -> dict[str, Column]:
    name = collapse(F.regexp_extract(text, f"(?dU){SUPPLIER_HEADER_PATTERNS['nome']}", 1))
    period = f"(?dU){SUPPLIER_HEADER_PATTERNS['periodo']}"
    day = lambda g: F.regexp_replace(
        F.regexp_extract(text, period, g), r"^(\d{2})/(\d{2})/(\d{4})$", "$3-$2-$1"
    ).try_cast("date")
    return {
        "nome": F.when(name != "", name).otherwise(F.lit(NO_COMPANY_LABEL)),
        "cnpj": F.regexp_extract(text, f"(?dU){SUPPLIER_HEADER_PATTERNS['cnpj']}", 1),
        "periodo_inicio": day(1),
        "periodo_fim": day(2),
    }


def too_little_text(text: Column) -> Column:
    """The text layer is missing: the document needs character recognition first."""
    seen = lambda part: F.length(F.regexp_replace(F.coalesce(part, F.lit("")), SPACE, ""))
    # the beginning tells it of most texts
    return F.when(seen(F.substring(text, 1, 4 * MIN_TEXT_CHARS)) >= MIN_TEXT_CHARS, False).otherwise(seen(text) < MIN_TEXT_CHARS)

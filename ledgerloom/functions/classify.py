"""Keyword classifiers, compiled to one ordered CASE each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import bind, blank_to_null, has_any, lower_key, upper_collapsed, upper_key
from ledgerloom.vocab import (
    EXPENSE_WORDS,
    LEDGER_CATEGORY_WORDS,
    PAYABLE_WORD,
    PERSON_CATEGORY,
    PERSON_PATTERN,
    REDUCER_PREFIX,
    REVENUE_PATTERN,
    STOCK_ROLLOVER_WORDS,
    SUPPLIER_CATEGORY_DEFAULT,
    SUPPLIER_CATEGORY_WORDS,
    UPLOAD_CATEGORY_DEFAULT,
    UPLOAD_CATEGORY_WORDS,
)


def first_group(text: Column, groups, default: str, whole_word: bool = False) -> Column:
    """Name of the first group with a word inside the text."""
    result = F
    for name, words in groups:
        result = result.when(has_any(text, words, whole_word), F.lit(name))
    return result.otherwise(F.lit(default))


def ledger_key(*texts: Column) -> Column:
    """What the spend category of an account description and the path above it is looked for in."""
    return F.concat_ws(" ", *[lower_key(t) for t in texts])


def category_of_key(key: Column, whole_word: bool = False) -> Column:
    """Spend category of a :func:`ledger_key`. A key that is a column of its own is searched in compiled code."""
    return first_group(key, LEDGER_CATEGORY_WORDS, "outros", whole_word)


def ledger_category(*texts: Column, whole_word: bool = False) -> Column:
    """Spend category from an account description and the path above it."""
    return bind(ledger_key(*texts), lambda j: category_of_key(j, whole_word))


def upload_category(text: Column, whole_word: bool = False) -> Column:
    plain = tuple((name, tuple(w.lower() for w in words)) for name, words in UPLOAD_CATEGORY_WORDS)
    return F.when(
        blank_to_null(text).isNotNull(),
        bind(F.lower(upper_key(text)), lambda k: first_group(k, plain, UPLOAD_CATEGORY_DEFAULT, whole_word)),
    )


def supplier_category(name: Column) -> Column:
    return bind(
        upper_collapsed(name),
        lambda upper: F.when(upper.rlike(PERSON_PATTERN), F.lit(PERSON_CATEGORY)).otherwise(
            first_group(upper, SUPPLIER_CATEGORY_WORDS, SUPPLIER_CATEGORY_DEFAULT)
        ),
    )


def entry_type(description: Column, path: Column, nature: Column) -> Column:
    """What a leaf account is in the ledger: ``struct(tipo, origem)``, null when nothing.

    ``path`` joins the descriptions above the leaf. The order of the tests matters:
    an expense branch wins over a word that sounds like revenue.
    """
    entry = lambda kind, origin: F.struct(F.lit(kind).alias("tipo"), F.lit(origin).alias("origem"))
    keys = F.struct(lower_key(description).alias("own"), lower_key(path).alias("above"))

    def decide(k: Column) -> Column:
        own, above = k["own"], k["above"]
        return (
            F.when(has_any(own, STOCK_ROLLOVER_WORDS), None)
            .when(has_any(above, EXPENSE_WORDS), F.when(nature == "D", entry("despesa", "resultado")))
            .when(
                above.rlike(REVENUE_PATTERN) | own.rlike(REVENUE_PATTERN),
                F.when(
                    F.ltrim(description).startswith(REDUCER_PREFIX),
                    F.when(nature == "D", entry("despesa", "resultado")),
                ).when(nature == "C", entry("receita", "resultado")),
            )
            .when(above.contains(PAYABLE_WORD), entry("despesa", "fornecedor_pagavel"))
        )

    return bind(keys, decide)

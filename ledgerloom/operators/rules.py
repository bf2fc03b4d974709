"""Rule-based advice. Rules are data: each key's facts are one wide row, and all rules are asked of it together."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.labels import fill
from ledgerloom.functions.money import currency, fixed
from ledgerloom.messages import NAMES_ELSEWHERE, PRIORITY_ORDER, RULES
from ledgerloom.operators.ranking import ranked
from ledgerloom.operators.suppliers import MOVEMENT, category_members

@dataclass(frozen=True)
class Facts:
    """What the rules look at: per key, per category and per change of a supplier. Without ``documents`` the keys
    are those of ``indicators``."""

    documents: DataFrame | None
    concentration: DataFrame | None
    categories: DataFrame | None
    members: DataFrame | None
    indicators: DataFrame | None
    changes: DataFrame | None = None


@dataclass(frozen=True)
class Rule:
    """When a rule speaks, what its texts hold, and its place among rows of its own.

    Conditions and values are asked of one wide row a key, which has the columns of ``concentration`` and
    ``indicators`` and the largest category as ``principal``; with ``each``, of the items of that array column
    (``x``), or of a change. Number and texts live in ``messages``.
    """

    number: int
    when: Callable[[Callable[[str], Column]], Column]
    values: Callable[[Callable[[str], Column]], dict[str, Column]] = lambda x: {}
    order: Callable[[Callable[[str], Column]], Column] | None = None
    each: str | None = None

    def advice(self, x: Callable[[str], Column]) -> Column:
        """The advice as a struct, null where the rule is silent."""
        priority, subject, title, text = RULES[self.number]
        values = self.values(x)
        return F.when(
            self.when(x),
            F.struct(
                fill(title, **values).alias("titulo"),
                fill(text, **values).alias("descricao"),
                F.lit(priority).alias("prioridade"),
                F.lit(subject).alias("categoria"),
                F.lit(PRIORITY_ORDER[priority]).alias("peso"),
                F.lit(self.number).alias("regra"),
                (F.lit(0.0) if self.order is None else self.order(x).cast("double")).alias("ordem_na_regra"),
            ),
        )


def _times(x: Callable[[str], Column]) -> Column:
    return x("caixa").cast("double") / x("passivo_circulante").cast("double")


single_supplier = Rule(
    1, lambda x: x("maior_fornecedor_percentual") >= 40,
    lambda x: {"nome": x("maior_fornecedor"), "percentual": fixed(x("maior_fornecedor_percentual"), 1)},
)
top_three = Rule(
    2, lambda x: (x("quantidade_fornecedores") >= 3) & (x("top_3_percentual") >= 70),
    lambda x: {"nomes": x("tres_maiores"), "percentual": fixed(x("top_3_percentual"), 1)},
)
high_index = Rule(
    3, lambda x: (x("indice_hhi") > 2500) & (x("quantidade_fornecedores") >= 2), lambda x: {"hhi": F.format_number(x("indice_hhi"), 0)}
)
few_suppliers = Rule(4, lambda x: x("quantidade_fornecedores").between(1, 3), lambda x: {"quantidade": x("quantidade_fornecedores")})
dominant_category = Rule(
    5, lambda x: (x("principal")["percentual_do_total"] >= 50) & ~x("principal")["categoria"].startswith("Outros"),
    lambda x: {
        "categoria": x("principal")["categoria"], "percentual": fixed(x("principal")["percentual_do_total"], 1),
        "quantidade": x("principal")["quantidade_fornecedores"],
    },
)
# the sentence counts the suppliers; their names are the rows of `merge_names`
merge_category = Rule(
    6, lambda x: F.lit(True),
    lambda x: {"categoria": x("categoria"), "quantidade": x("quantidade_fornecedores"), "nomes": F.lit(NAMES_ELSEWHERE), "total": currency(x("total"))},
    lambda x: -x("total"), each="consolidaveis",
)
low_liquidity = Rule(7, lambda x: x("liquidez_corrente") < 1, lambda x: {"liquidez": fixed(x("liquidez_corrente"), 2)})
idle_cash = Rule(
    8, lambda x: (x("caixa") > 0) & (x("passivo_circulante") > 0) & F.when(x("passivo_circulante") != 0, _times(x) >= 10),
    lambda x: {"caixa": currency(x("caixa")), "razao": fixed(_times(x), 0), "passivo": currency(x("passivo_circulante"))},
)
negative_capital = Rule(9, lambda x: x("capital_de_giro") < 0, lambda x: {"capital": currency(F.abs(x("capital_de_giro")))})
margin_too_high = Rule(10, lambda x: x("margem_liquida") >= 90, lambda x: {"margem": fixed(x("margem_liquida"), 1)})
margin_low = Rule(11, lambda x: x("margem_liquida") < 5, lambda x: {"margem": fixed(x("margem_liquida"), 1)})
no_suppliers = Rule(12, lambda x: x("quantidade_fornecedores").isNull())
good_practice = Rule(13, lambda x: x("quantidade_fornecedores").isNotNull())

# Add a rule here to have it run.
RULE_SET: list[Rule] = [
    single_supplier, top_three, high_index, few_suppliers, dominant_category, merge_category, low_liquidity,
    idle_cash, negative_capital, margin_too_high, margin_low, no_suppliers, good_practice,
]


def _change_values(x: Callable[[str], Column]) -> dict[str, Column]:
    return {
        "nome": x("nome"), "percentual": fixed(F.abs(x("variacao_percentual")), 0),
        "anterior": currency(x("valor_periodo_anterior")), "atual": currency(x("valor_periodo_atual")),
    }


def _change_rule(number: int, when: Callable[[Callable[[str], Column]], Column]) -> Rule:
    return Rule(number, when, _change_values, lambda x: -x("variacao_absoluta"))


# New, sharply risen and sharply fallen suppliers
CHANGE_RULES: list[Rule] = [
    _change_rule(14, lambda x: x("situacao") == "Novo"),
    _change_rule(15, lambda x: (x("situacao") != "Novo") & (x("variacao_percentual") >= 40)),
    _change_rule(16, lambda x: (x("situacao") != "Novo") & (x("variacao_percentual") <= -40)),
]


def _can_merge(quantity: Column, category: Column) -> Column:
    return (quantity >= 2) & ~category.startswith("Outros")


def _category_facts(categories: DataFrame, by: Sequence[str]) -> DataFrame:
    """The largest category of each key and those that can be merged; a key has a fixed, short list of categories."""
    own = F.struct("categoria", "total", "quantidade_fornecedores", "percentual_do_total")
    return categories.groupBy(*by).agg(
        F.min_by(own, F.struct(-F.col("total"), F.col("categoria"))).alias("principal"),
        F.collect_list(F.when(_can_merge(F.col("quantidade_fornecedores"), F.col("categoria")), own)).alias("consolidaveis"),
    )


def _wide(facts: Facts, by: Sequence[str]) -> DataFrame:
    """One row a key that any table has, with all of its facts; every table is read once."""
    keys = facts.documents if facts.documents is not None else facts.indicators
    tables = [facts.concentration, None if facts.categories is None else _category_facts(facts.categories, by)]
    if facts.documents is not None:
        tables.append(facts.indicators)
    if not by:
        keys, tables = keys.withColumn("_k", F.lit(1)), [t if t is None else t.withColumn("_k", F.lit(1)) for t in tables]
    for table in tables:
        if table is not None:
            keys = keys.join(table, list(by) or ["_k"], "full")
    return keys


def _spoken(rows: DataFrame, by: Sequence[str], rules: Sequence[Rule]) -> DataFrame:
    """The advice of each row: all rules in one array, of which those that speak become rows."""
    single = F.array_compact(F.array(*[r.advice(F.col) for r in rules if r.each is None]))
    parts = [single] if any(r.each is None for r in rules) else []
    for rule in rules:
        if rule.each is not None:
            found = F.transform(F.coalesce(F.col(rule.each), F.array()), lambda item: rule.advice(lambda name: item[name]))
            parts.append(F.array_compact(found))
    advice = F.concat(*parts) if len(parts) > 1 else parts[0]
    return rows.select(*by, F.explode_outer(advice).alias("_c")).filter(F.col("_c").isNotNull()).select(*by, "_c.*")


def period_changes(facts: Facts, by: Sequence[str]) -> DataFrame:
    """Advice on new, sharply risen and sharply fallen suppliers."""
    return _spoken(facts.changes, list(by), CHANGE_RULES)


def merge_names(facts: Facts, by: Sequence[str]) -> DataFrame:
    """The suppliers that rule 6 speaks of, largest first, one row each in any number."""
    by = list(by)
    mergeable = facts.categories.filter(_can_merge(F.col("quantidade_fornecedores"), F.col("categoria")))
    rows = facts.members.join(mergeable.select(*by, "categoria"), [*by, "categoria"], "left_semi")
    placed = ranked(rows, [*by, "categoria"], [F.desc(MOVEMENT), F.asc("seq")], position="posicao")
    return placed.select(*by, F.lit(6).alias("regra"), "categoria", "posicao", F.col("nome_curto").alias("nome"))


def advise(facts: Facts, by: Sequence[str], rules: Sequence[Rule] | None = None) -> DataFrame:
    """All advice of all keys. ``peso``, ``regra`` and ``ordem_na_regra`` give the reading order."""
    by = list(by)
    out = _spoken(_wide(facts, by), by, RULE_SET if rules is None else rules)
    return out if facts.changes is None else out.unionByName(period_changes(facts, by))


def ordered_advice(advice: DataFrame, by: Sequence[str]) -> DataFrame:
    """Advice numbered in reading order."""
    # the three period rules share one place in the order of rules
    place = F.least("regra", F.lit(14))
    order = [F.asc("peso"), F.asc("_lugar"), F.asc("ordem_na_regra"), F.asc("titulo")]
    return ranked(advice.withColumn("_lugar", place), by, order, position="ordem").drop("_lugar")


__all__ = ["Facts", "RULE_SET", "advise", "category_members", "merge_names", "ordered_advice", "period_changes"]

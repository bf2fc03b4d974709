"""Full ledger analysis of every key at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.contract import validate_budget, validate_ledger
from ledgerloom.operators.ranking import spend_rankings
from ledgerloom.operators.results import (
    alerts,
    check_thresholds,
    expenses_only,
    profit_and_loss,
    summary,
    variations,
)
from ledgerloom.vocab import DEFAULT_THRESHOLDS


@dataclass(frozen=True)
class Thresholds:
    """Change in percent from which each severity starts."""

    levels: Mapping[str, float] = field(default_factory=lambda: dict(DEFAULT_THRESHOLDS))

    def __post_init__(self) -> None:
        check_thresholds(self.levels)


@dataclass(frozen=True)
class Analysis:
    """Result tables, all keyed by ``by`` and all lazy."""

    by: list[str]
    lancamentos: DataFrame
    resultado_contabil: DataFrame
    resumo: DataFrame
    variacoes: DataFrame | None
    alertas: DataFrame | None

    @property
    def rankings(self) -> dict[str, DataFrame]:
        """Spend rankings. Reading this lays the totals out in order, which runs a job."""
        return spend_rankings(expenses_only(self.lancamentos), self.by)


def previous_period(ledger: DataFrame, period: str = "periodo") -> DataFrame:
    """The ledger as history: each row is the reference of the period after its own."""
    return ledger.withColumn(period, F.col(period) + 1)


def analyze(
    ledger: DataFrame,
    budget: DataFrame | None = None,
    history: DataFrame | None = None,
    by: Sequence[str] = ("empresa", "periodo"),
    thresholds: Thresholds | None = None,
    mode: str = "fail",
) -> Analysis:
    """Validate, then profit and loss, variations, alerts and summary.

    Rankings are on the result. Everything but the profit and loss looks at expenses only.
    """
    by = list(by)
    levels = (thresholds or Thresholds()).levels
    rows = validate_ledger(ledger, mode)
    limits = validate_budget(budget, by, mode) if budget is not None else None
    before = validate_ledger(history, mode) if history is not None else None
    changes = variations(rows, by, limits, before)
    found = alerts(changes, levels) if changes is not None else None
    return Analysis(
        by=by,
        lancamentos=rows,
        resultado_contabil=profit_and_loss(rows, by),
        resumo=summary(rows, by, changes, found),
        variacoes=changes,
        alertas=found,
    )

"""Ledger analytics for many companies and periods at once, on Spark DataFrames."""

from ledgerloom.plans.analysis import Analysis, Thresholds, analyze
from ledgerloom.plans.supplier import read_supplier_documents, supplier_analysis
from ledgerloom.plans.trial_balance import read_trial_balance
from ledgerloom.plans.upload import prepare

__all__ = [
    "Analysis",
    "Thresholds",
    "analyze",
    "prepare",
    "read_supplier_documents",
    "read_trial_balance",
    "supplier_analysis",
]

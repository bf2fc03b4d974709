"""Registered queries against their SQL on the smallest tables. All of them: tools/compare.py."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.compare import TABLES, bag

FOLDER = "/root/testdata/sf0.001"
CHECKED = [
    "budget_alerts", "pnl", "ranking_fornecedor", "top_fornecedores", "summary_cards", "recommendations", "supplier_abc",
    "supplier_period_change", "totals_rollup", "account_lines", "doc_status", "trial_balance_ledger", "leaves_by_class",
    "upload_records", "parse_money", "text_keys", "contract_violations", "clean_rows", "standard_rows", "indicators",
]


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    assert bag(df.columns, [tuple(r) for r in df.collect()]) == bag([d[0] for d in cur.description], cur.fetchall())

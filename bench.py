"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

Every query is run once to warm the JVM and once for the time. The whole result is produced
each time (the noop sink takes all rows and columns).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from ledgerloom.session import local_session
from registry import all_queries

HEADLINE = (
    "budget_alerts", "pnl", "ranking_fornecedor", "ranking_all", "summary_cards", "recommendations", "supplier_abc",
    "supplier_concentration", "supplier_period_change", "trial_balance_ledger", "doc_status", "indicators", "upload_records",
    "clean_rows", "parse_money", "parse_date", "categorize_ledger", "contract_violations", "report_text", "quality_stats",
    "advice_rules",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores, partitions=max(int(cores), 1) if cores.isdigit() else 8)
    queries, times = all_queries(), {}
    for name in HEADLINE:
        for timed in (False, True):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            spent = round(time.perf_counter() - start, 3)
            if timed:
                times[name] = spent
            # each run as it ends, so that a run that is stopped leaves figures
            print(f"{name} {'timed' if timed else 'warm-up'} {spent} s", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_seconds_headline_queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

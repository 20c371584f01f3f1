"""Wall time of the headline queries: prints one JSON line.

Environment: BENCH_SF_DIR (data), BENCH_CPUS (local cores), BENCH_RUNS (timed runs per query, median is reported).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import DataFrame

from ledgerloom import query_catalog
from ledgerloom.config import session

HEADLINE = (
    "silver_accounts",
    "silver_customers",
    "silver_transactions",
    "silver_holdings",
    "gold_customer_360",
    "gold_account_summary",
    "gold_transaction_patterns",
    "gold_loan_portfolio_summary",
    "gold_aml_risk_scoring",
    "gold_branch_performance",
    "gold_portfolio_performance",
    "gold_client_revenue",
    "gold_asset_allocation",
    "gold_advisor_scorecard",
    "gold_net_interest_margin",
    "gold_liquidity_coverage",
    "gold_market_risk_var",
    "gold_operational_risk",
    "gold_balance_sheet_summary",
    "wq_total_relationship",
    "gl_hierarchy_rollup",
    "snapshot_monthly_balances",
    "snapshot_quarterly_positions",
    "staging_fr_y9c",
    "dq_rule_results",
    "profile",
    "profile_exact_loans",
    "pii_leak_scan",
    "dq_volume_rules",
    "retention_due",
    "vw_profile_summary",
    "ev_outcome",
    "ev_report",
)


def consume(df: DataFrame) -> None:
    """Compute every row and column without bringing them to the driver."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    wanted = sys.argv[1:] or HEADLINE
    spark = session("bench", master=f"local[{cpus}]", partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    queries = query_catalog()
    times: dict[str, float] = {}
    for name in wanted:
        consume(queries[name](spark, path))  # warm: code generation and file cache
        taken = []
        for _ in range(runs):
            start = time.perf_counter()
            consume(queries[name](spark, path))
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken), 3)
    print(json.dumps({
        "metric": "headline_queries_wall_time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(os.path.basename(path.rstrip("/")).removeprefix("sf")), "cpus": int(cpus), "runs": runs}))
    spark.stop()


if __name__ == "__main__":
    main()

"""Time the headline queries: one JSON line on stdout.

BENCH_SF_DIR names the table folder, BENCH_CPUS the cores, BENCH_QUERIES (comma-separated) restricts the run.
Each query is written to Spark's no-op sink once; the session is warmed on a small query first.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from barloom.plans.catalog import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "SRC1_scan_universe_and_range",
    "DQ5_quality_report",
    "IND18_all_indicators",
    "REG2_squeeze_override",
    "REG4_kmeans_regime",
    "REG_hmm_regime",
    "SIG8_trade_levels",
    "SIG9_latest_signals",
    "SIG10_signal_grid",
    "REC14_top_lists",
    "REC15_exit_alerts",
    "TRD4_record_statistics",
    "TRD9_log_statistics",
    "PERF17_tear_sheet",
    "STAT2_bootstrap_interval",
    "STAT9_alpha_newey_west",
    "FAC7_factor_regression",
    "PF5_covariance",
    "PF8_portfolio_metrics",
    "PF10_risk_contributions",
    "PF12_value_at_risk",
    "PF15_warnings",
    "WF3_rule_signals",
    "WF6_window_summary",
    "HLD8_holdings",
    "HLD12_instrument_search",
    "STR2_change",
    "STR5_portfolio_value",
)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("barloom-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    QUERIES["PERF4_sharpe"](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    times: dict[str, float | None] = {}
    for name in names:
        begin = time.perf_counter()
        try:
            QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - begin, 3)
        except Exception as error:  # keep timing the others
            times[name] = None
            print(f"{name}: {error}"[:500], file=sys.stderr)
    total = round(sum(t for t in times.values() if t is not None), 3)
    line = {"metric": "headline queries, wall clock", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/"))}
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()

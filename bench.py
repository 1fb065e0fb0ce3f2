"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then $BENCH_RUNS times (2); the median counts. Results go to a
sink that computes every row and keeps none.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from sievelark.operators import anomaly, cleaning, explore, forecast, profile, quality, sales  # noqa: E402
from sievelark.operators.isolation import isolation_forest  # noqa: E402
from sievelark.session import build_session  # noqa: E402
from suite.inputs import daily_orders, dirty_customers, table, transactions  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))
MEMORY = os.environ.get("BENCH_MEMORY", "12g")
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def compute(result) -> None:
    """Run a frame, or all frames of a report, to the end."""
    frames = result.values() if isinstance(result, dict) else [result]
    for frame in frames:
        if hasattr(frame, "write"):
            frame.write.format("noop").mode("overwrite").save()


def workloads(spark):
    t = transactions(spark, SF_DIR)
    line = table(spark, SF_DIR, "lineitem")
    numbers = line.select(*NUMBERS)
    keyed = line.select("l_orderkey", "l_linenumber", *NUMBERS)
    dirty = dirty_customers(spark, SF_DIR)
    events = table(spark, SF_DIR, "events")
    return {
        "q04_customer_segmentation": lambda: sales.customer_segmentation(t),
        "q06_customer_retention": lambda: sales.customer_retention(t),
        "q08_sales_by_region": lambda: sales.sales_by_region(t),
        "q16_running_total_sales": lambda: sales.running_total_sales(t),
        "q17_sales_rank_by_customer": lambda: sales.sales_rank_by_customer(t),
        "q18_percentile_sales": lambda: sales.percentile_sales(t),
        "q19_lag_lead_analysis": lambda: sales.lag_lead_analysis(t),
        "q22_cohort_analysis": lambda: sales.cohort_analysis(t),
        "profile_lineitem": lambda: profile.profile(line),
        "quality_report_lineitem": lambda: quality.quality_report(line),
        "quality_report_dirty": lambda: quality.quality_report(dirty, ids=["id"]),
        "summary_lineitem": lambda: profile.numeric_summary(numbers),
        "correlation_lineitem": lambda: explore.correlation_matrix(numbers),
        "z_score_lineitem": lambda: anomaly.z_scores(keyed, ["l_orderkey", "l_linenumber"], columns=NUMBERS),
        "iqr_lineitem": lambda: anomaly.iqr(keyed, ["l_orderkey", "l_linenumber"], columns=NUMBERS),
        "isolation_forest_lineitem": lambda: isolation_forest(numbers),
        "spikes_events": lambda: anomaly.spikes(events, "ts", "value", ties=["event_id"]),
        "dedup_dirty": lambda: cleaning.remove_duplicates(dirty),
        "fill_mode_dirty": lambda: cleaning.fill_mode(dirty),
        "cleaning_chain_dirty": lambda: cleaning.apply_rules(dirty)[0],
        "linear_forecast_daily": lambda: forecast.forecast(
            daily_orders(spark, SF_DIR), "day", "total", "linear_regression"),
    }


def main() -> None:
    spark = build_session(
        "bench", f"local[{CPUS}]", spark__sql__shuffle__partitions=CPUS, spark__driver__memory=MEMORY,
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    only = sys.argv[1:]
    seconds = {}
    for name, make in workloads(spark).items():
        if only and not any(part in name for part in only):
            continue
        taken = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            compute(make())
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken[1:] or taken), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "total of median query times", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(SF_DIR).name.removeprefix("sf"), "runs": RUNS,
        "cpus": CPUS, "memory": MEMORY, "shuffle_partitions": CPUS,
    }))


if __name__ == "__main__":
    main()

"""Time the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from marketgrid import catalogue  # noqa: E402
from marketgrid.session import build_session  # noqa: E402

HEADLINE = [
    "q01_deposits_by_county_year", "q02_market_share_by_county_year", "q03_branch_deposit_cagr",
    "q04_rank_branches_in_market", "q05_market_vs_branch_attribution", "q06_branch_percentile_in_county",
    "q07_catchment_demographics", "q08_branch_performance_index", "q09_tract_lending_outcomes",
    "q10_capture_rate_by_tract", "q11_unmet_demand_ranking", "q12_market_opportunity_index", "q13_lmi_coverage",
    "q14_reconciliation", "j18_point_in_polygon", "g06_household_growth", "x05_transitions", "d05_tract_competition",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
            "spark.python.sql.dataFrameDebugging.enabled": "false", "spark.log.level": "ERROR",
        },
    )
    queries = catalogue.queries()
    spark.read.parquet(f"{folder}/orders.parquet").count()      # start the executor threads
    times: dict[str, float] = {}
    for name in [n for n in HEADLINE if not only or any(n.startswith(o) for o in only)]:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
    }))
    spark.stop()


if __name__ == "__main__":
    main()

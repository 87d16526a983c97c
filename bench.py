"""Time the headline queries: one warm-up and three timed runs each, median seconds.

Reads $BENCH_SF_DIR (default /root/testdata/sf0.1), runs on local[$BENCH_CPUS] and prints
one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks.queries import QUERIES  # noqa: E402
from tickertide.session import build_session  # noqa: E402

HEADLINE_QUERIES = [
    "match_tickers",
    "ai_flag",
    "base_data_plan",
    "process_plan",
    "daily_ai_sentiment",
    "score_unique_join",
    "dedup_headline_url",
    "dedup_canonical",
    "first_keep_dedup",
    "daily_sentiment",
    "daily_features",
    "ticker_summary_ai",
    "asof_forward_orders",
    "forward_returns",
    "market_excess",
    "corr_matrix",
    "corr_by_ticker",
    "quintile_excess",
    "quintile_lineitem",
    "hit_rate_by_ticker",
    "strip_html_snippet",
    "parse_score",
    "anti_join_new_rows",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE_QUERIES
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in names:
        runs = []
        for i in range(4):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:
                runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs), 4)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    total = round(sum(times.values()), 4)
    print(
        json.dumps(
            {
                "metric": "sum of median query seconds",
                "value": total,
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": cpus,
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

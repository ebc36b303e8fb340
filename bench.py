"""Times the headline queries and prints one JSON line.

Each query runs once to warm up and then three times; the median counts. All rows are
computed and counted out by the no-op sink, so nothing is cut short.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from agorametrics.session import local_session  # noqa: E402
from workloads import registry  # noqa: E402

HEADLINE = [
    "user_stats_monthly",
    "user_reactions_monthly",
    "leaderboard_top10",
    "personal_12m",
    "stats_all_time",
    "inflation_monthly_change",
    "inflation_yearly_change",
    "inflation_monthly_new",
    "gdp_24",
    "hdi_24",
    "trade_exports_top5",
    "trade_summary",
    "trade_user_partners",
    "reaction_percentage",
    "given_received",
    "message_filter_flags",
    "reaction_explode",
    "newest_copies",
    "reply_info",
    "most_liked_edges",
    "most_liked_top5",
    "user_clusters",
    "ingest_stats",
    "stream_user_stats",
]
# These run whole jobs of many steps; once after the warm-up is enough.
LONG = {"most_liked_top5", "ingest_stats", "stream_user_stats"}


def seconds(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus, **{"spark.sql.shuffle.partitions": cpus})
    timings = {}
    for name in HEADLINE:
        seconds(spark, name, folder)
        runs = 1 if name in LONG else 3
        timings[name] = round(statistics.median(seconds(spark, name, folder) for _ in range(runs)), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total of median query times",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()

"""Time the headline queries and print one JSON line.

Each query runs once to warm up and then three times; its time is the median of the three, from
building the query to the last row, which is computed but not kept. The split queries cut items
into pieces as they would be cut on skewed data.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from quayside.catalogue.queries import QUERIES
from quayside.session import local_session

HEADLINES = (
    "stock_levels", "priority_rank", "waterfall_allocation", "waterfall_allocation_split",
    "waterfall_null_items", "allocation_report",
    "forecast_normalised", "ordered_quantities", "forecast_gap", "bom_explosion",
    "bom_material_requirements", "bom_chain_requirements",
)


def seconds(query, spark, folder) -> float:
    start = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("quayside-bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINES:
        seconds(QUERIES[name], spark, folder)
        times[name] = round(statistics.median(seconds(QUERIES[name], spark, folder) for _ in range(3)), 3)
    print(json.dumps({
        "metric": "total time of the headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()

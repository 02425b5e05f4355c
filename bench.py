"""Time the registered queries on one folder; prints one JSON line.

``land_raw``, ``land_staged`` and ``land_clean`` are the tables all results start from, and
``land_results`` those that further results are read off, timed once cold. Every other figure is the faster of two warm runs that compute every row and
column and keep none.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame

from ratewright.plans.registered import QUERIES, Tables
from ratewright.session import local_session


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    chosen = sys.argv[1:] or list(QUERIES)
    partitions = max(8, int(cores)) if cores.isdigit() else 8
    spark = local_session(cores, partitions)
    spark.sparkContext.setLogLevel("ERROR")

    spark.range(1000).selectExpr("sum(id)").collect()
    tables = Tables.of(spark, folder)
    seconds = {
        "land_raw": timed(lambda: tables.raw),
        "land_staged": timed(lambda: tables.staged),
        "land_clean": timed(lambda: tables.clean),
        "land_results": timed(lambda: [tables.cube, tables.ranked, tables.bands, tables.regions, tables.overall]),
    }
    for name in chosen:
        build = QUERIES[name]
        seconds[name] = min(timed(lambda: run(build(spark, folder))) for _ in range(repeats))
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": {k: round(v, 3) for k, v in seconds.items()},
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
                "cores": cores,
                "shuffle_partitions": partitions,
                "repeats": repeats,
            }
        )
    )


if __name__ == "__main__":
    main()

"""Headline timings.  Prints one JSON line.

    BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8)

``build_*`` are the two stored base tables (event table; order log = prefix
scalars + per-order fold), the counterparts of a forward pass.  The other
entries read them.  ``events_per_sec`` divides the event count by the time of
an entry."""

from __future__ import annotations

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

from pyspark.sql import SparkSession  # noqa: E402

from orderloom.plans import queries as registry  # noqa: E402

READS = ["c02_emission_order", "d01_volume_at_price", "d09_value_area", "d15_cvd_candles", "d26_session_summary", "e15_depth",
         "e17_bbo_series", "e22_queue_position", "e23_flow_window", "e25_refreshes", "e30_iceberg_census", "f01_state_at", "f04_ladder"]


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus)
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "16g").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()

    times: dict[str, float] = {}

    def timed(name, run):
        start = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - start, 3)

    timed("build_events", lambda: registry.ev(spark, sf))
    timed("build_order_log", lambda: registry.log_of(spark, sf))
    n = registry.ev(spark, sf).count()
    for q in READS:
        timed(q, lambda q=q: drain(registry.QUERIES[q](spark, sf)))
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf, "events": n,
        "events_per_sec": {q: round(n / s) for q, s in times.items()}}))


if __name__ == "__main__":
    main()

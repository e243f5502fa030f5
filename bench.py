"""Headline reports, timed. Prints one JSON line.

The campaign tables are derived from the test tables and written once, untimed.
``stage_frames`` enriches all contacts and writes coupon, purchase and visit facts;
the reports read these.
Every time includes planning and writing out the whole result; best of two runs
(one for the final report).
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from promolift.operators.uplift import uplift_statistics
from promolift.plans.prepare import prepare, stage_frames
from promolift.plans.reports import MODULES, combined_report, final_report, module_report
from promolift.sources.sinks import shared_folder
from testbed.queries import LEVELS, UPLIFT_LEVELS
from testbed.tables import CAMPAIGN, written_tables


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("promolift-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        # The test data is small: let a partition of it be small too.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="promolift-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    raw = written_tables(spark, folder, shared_folder(spark))

    times: dict[str, float] = {}

    def timed(name, action, runs=2):
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            result = action()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
        return result

    def written(build):
        return lambda: build().write.format("noop").mode("overwrite").save()

    frames = timed("stage_frames", lambda: stage_frames(prepare(raw, CAMPAIGN)))
    for module in MODULES:
        timed(f"report_{module}", written(lambda: module_report(module, frames, LEVELS)))
    timed("uplift_ancova", written(lambda: uplift_statistics(frames, UPLIFT_LEVELS)))

    def final():
        uplift = module_report("uplift", frames, UPLIFT_LEVELS)
        return final_report([combined_report(frames, LEVELS), uplift])

    timed("report_final", written(final), runs=1)
    print(json.dumps({
        "metric": "campaign_reports_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()

"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

HEADLINE = ["AUT-REV-001", "AUT-BIB-002", "ART-WF-002", "ART-PROD-003", "ART-REV-002", "CROSS-001", "CROSS-002", "CROSS-004", "CROSS-006", "BIB-006", "BIB-ART-002"]


def main() -> None:
    os.environ["PYTHONPATH"] = os.path.dirname(os.path.abspath(__file__)) + os.pathsep + os.environ.get("PYTHONPATH", "")
    from pyspark.sql import SparkSession

    from foliospark.catalog import registry

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-")).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    runs = {registry.name(c): (lambda c=c: registry.run(spark, sf_dir, c)) for c in HEADLINE}
    took: dict[str, float] = {}
    for name, frame in runs.items():
        times = []
        for _ in range(3):
            began = time.perf_counter()
            frame().write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(statistics.median(times), 3)
    print(json.dumps({"metric": "total_median_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir}))
    spark.stop()


if __name__ == "__main__":
    sys.exit(main())

"""Wall time per registered query; prints one JSON line.

Every query is executed in full (``noop`` sink).  Queries share the stored
tables they read; ``stored_tables`` is the time spent writing those, timed on
its own and part of the total.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession

from carbonsplit.plans.bindings import Star
from carbonsplit.plans.catalog import STORED, registered

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    spark = session()
    run(spark.range(1000).groupBy("id").count())  # JVM warm-up, not measured
    star = Star(spark, SF_DIR)
    times = {"stored_tables": timed(lambda: [star.stored(name) for name in STORED])}
    for name, fn in registered(star).items():
        times[name] = timed(lambda: run(fn(spark, SF_DIR)))
    print(
        json.dumps(
            {
                "metric": "total wall time of all queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cpus": CPUS,
            }
        )
    )


if __name__ == "__main__":
    main()

"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) select data and cores.
BENCH_WARM=1 runs everything twice and also reports the first (cold) pass.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from checks.registry import QUERIES, events_pipeline  # noqa: E402
from tidemark.plans import run_event_reports  # noqa: E402

HEADLINE = (
    "base_orders", "purchase_history", "cohort_table", "promo_events", "new_customer_flags",
    "report_item", "report_brand", "report_company", "report_category", "report_event",
    "report_item_v1",
)


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def five_reports(spark: SparkSession, sf_dir: str) -> None:
    """All five reports from one set of staged tables."""
    run_event_reports(events_pipeline(spark, sf_dir), lambda df, level: run(df))


def one_pass(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    seconds = {}
    for name in (*HEADLINE, "five_reports"):
        started = time.perf_counter()
        if name == "five_reports":
            five_reports(spark, sf_dir)
        else:
            run(QUERIES[name](spark, sf_dir))
        seconds[name] = round(time.perf_counter() - started, 3)
    return seconds


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        # a folder of its own for staged tables, as a cluster names a shared one
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    passes = [one_pass(spark, sf_dir)]
    if os.environ.get("BENCH_WARM"):
        passes.append(one_pass(spark, sf_dir))
    result = {
        "metric": "total_seconds",
        "value": round(sum(passes[-1].values()), 3),
        "unit": "sec",
        "queries": passes[-1],
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }
    if len(passes) > 1:
        result["cold"] = passes[0]
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()

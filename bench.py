"""Time headline queries: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the data and the cores."""

from __future__ import annotations

import json
import os
import re
import statistics
import time

from pyspark.sql import SparkSession

from galley import catalog
from galley.plans import recipes

HEADLINE = ["core_counts", "pantry_match", "pantry_coverage", "facet_counts", "tags_any", "without_ingredient", "ingredient_use", "occurrence_keys", "upsert_newest", "full_text_all", "quantity_by_ingredient"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda name: catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    def timed(name: str) -> float:
        """The median of three runs after one that warms up."""
        taken = []
        for _ in range(4):
            began = time.time()
            run(name)
            taken.append(time.time() - began)
        return round(statistics.median(taken[1:]), 3)

    times = {name: timed(name) for name in HEADLINE}
    batch, pantries = timed("pantry_batch"), recipes._pantries(spark, sf_dir).count()
    links = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    rates = {"pantries_per_s": round(pantries / batch, 1), "batch_sec": batch, "link_rows_per_s": round(links / times["core_counts"])}
    sf = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "throughput": rates, "sf": float(sf[1]) if sf else None}))
    spark.stop()


if __name__ == "__main__":
    main()

"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import time

from stratagrid.session import local_session

HEADLINE = (
    "index_lue", "spectral_indices", "zonal_mean_sum", "mass_preserve", "largest_remainder", "ols_trend", "mk_trend", "outlier_lag", "savgol_1d",
    "gap_fill_weighted", "mode_filter", "regression_metrics", "space_time_overlay", "point_in_polygon", "rasterize_count", "tile_join", "nearest_centroid", "rf_interval",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    from stratagrid.plans import catalog

    known, took = catalog.queries(), {}
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()
    for name in HEADLINE:
        start = time.perf_counter()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf[1]) if sf else None}))


if __name__ == "__main__":
    main()

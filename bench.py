"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose the tables and the cores. Each query
runs whole, every row of every column, into Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

from geoloom.registry import all_queries
from geoloom.session import local_session

HEADLINE = [
    "d4_ndvi_timeseries", "d5_ndvi_masked", "d1_land_cover", "d2_class_histogram", "d3_scalar_stats",
    "d22_band_stretch_bounds", "d9_cluster_stats", "b6_reflectance_checks", "e10_window_grid", "k19_score_windows",
    "g6_smooth_raster", "i1_stitch", "k17_render_tiles", "k14_region_table", "k14_region_outlines",
    "b1_search_scenes", "c1_scenes_for_aois", "c2_scenes_for_periods", "g2_least_cloudy", "b7_complete_scenes",
    "a20_cache_plan", "d8_polygon_stats", "c8_points_in_polygons", "c7_neighbors_within", "e2_plan_chunks",
    "k2_similarity", "k5_few_shot", "k12_zero_shot", "k7_change_map", "k4_pca_rgb", "k8_embedding_export",
    "d19_merge_overlaps", "d10_class_summary", "d13_confusion_matrix", "d15_prf_metrics", "k18_validate_features",
    "g3_failure_streaks", "g4_failure_rate_trip", "a13_dataset_registry", "d25_aoi_report", "s10_strip_meta",
    "w3_progress_stream", "w6_usage_sessions",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:] or HEADLINE
    spark = local_session(cores)
    known = all_queries()
    # one small query starts the JVM's and the Python workers' code paths
    known["d4_ndvi_timeseries"].run(spark, folder).limit(1).collect()
    times: dict[str, float] = {}
    for key in only:
        t0 = time.perf_counter()
        known[key].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[key] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                      "cores": int(cores)}))


if __name__ == "__main__":
    main()

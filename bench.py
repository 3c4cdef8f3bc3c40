"""Time the headline queries and print one JSON line.

Each query runs to a no-op sink, so the result is computed in full but not moved to the
driver. A query runs twice and the better time counts, which leaves code generation and
start-up out. ``--all`` times every registered query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from terrakit.registry import all_queries  # noqa: E402
from terrakit.session import build_session  # noqa: E402

HEADLINE = [
    "d3_points_near_routes", "d2_points_in_polygons", "d4_buffered_polygons", "d11_cells_a_mask_needs",
    "d13_nearest_distances", "d16_shared_nodes", "c9_clipped_lines", "c12_simplified_tracks", "c15_ascents",
    "c18_track_imports", "j2_marching_squares", "j3_contours", "j4_slope_field", "j5_slope_areas", "j7_relief_raster",
    "e3_group_counts_per_area", "e14_column_profile", "e27_counts_per_km_cell", "e5_newest_tiles",
    "b7_tag_maps", "b11_kept_addresses", "b17_rule_classes", "b18_access_flags", "b20_zoom_levels",
    "g1_place_search", "e18_normal_equations", "k1_predicted_sizes", "k5_partition_plans",
    "a3_decoded_geometries", "a6_gpx_points", "a7_fit_points", "a10_catalogue_assets", "l1_stage_clock",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    args = [a for a in sys.argv[1:] if not a.startswith("-")]
    names = sorted(queries) if "--all" in sys.argv else args or HEADLINE
    queries["e1_rows_per_layer"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        runs = []
        for _ in range(2):
            start = time.time()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - start)
        times[name] = round(min(runs), 3)
        print(f"{name} {times[name]}", file=sys.stderr)
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()

"""The entry module works from any folder, without the package on the workers' path."""

import os
import subprocess
import sys

SCRIPT = """
import importlib.util
spec = importlib.util.spec_from_file_location("entry", {path!r})
m = importlib.util.module_from_spec(spec)
spec.loader.exec_module(m)
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
for name in ("d3_points_near_routes", "c12_simplified_tracks", "a1_geopackage_scan", "a4_shapefile_scan", "a7_fit_points", "j3_contours", "l1_stage_clock"):
    print(name, m.queries()[name](s, "/root/testdata/sf0.001").count())
"""


def test_runs_from_elsewhere():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = SCRIPT.format(path=os.path.join(root, "__spark_entry__.py"))
    out = subprocess.run([sys.executable, "-c", code], cwd="/tmp", env=env, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    counts = dict(line.split() for line in out.stdout.split("\n") if line and line.split()[-1].isdigit())
    assert len(counts) == 7 and counts["d3_points_near_routes"] == "4"

"""Areas from GeoJSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrakit.functions.projection import to_lv95
from terrakit.functions.shapes import point
from terrakit.session import cut_lineage
from terrakit.sources.gpx import read_documents

c = F.col
NODE = "type string, features array<string>, geometry string, geometries array<string>, coordinates string"
RING = "array<array<double>>"

#: Levels that are opened in one plan before it is asked whether any are left.
STEP = 6


def geometries(documents: DataFrame, step: int = STEP) -> DataFrame:
    """(path, order, type, coordinates) of all plain geometries in (path, text) documents.

    Collections and features are opened level by level; ``order`` is the path of positions
    taken, so document order is kept. Levels are opened until none is left, however deep.
    """
    level = documents.select("path", F.array().cast("array<int>").alias("order"), F.from_json("text", NODE).alias("g"))
    plain = None
    while True:
        for _ in range(step):
            leaf = level.filter("g.coordinates is not null").select("path", "order", "g.type", "g.coordinates")
            plain = leaf if plain is None else plain.unionByName(leaf)
            inside = (
                F.when(c("g.type") == "FeatureCollection", c("g.features"))
                .when(c("g.type") == "Feature", F.array(c("g.geometry")))
                .when(c("g.type") == "GeometryCollection", c("g.geometries"))
            )
            level = level.select("path", "order", F.posexplode(inside).alias("pos", "node")).filter("node is not null").select(
                "path", F.concat("order", F.array("pos")).alias("order"), F.from_json("node", NODE).alias("g"))
        if level.isEmpty():
            return plain
        level = cut_lineage(level)


def polygons(documents: DataFrame) -> DataFrame:
    """(path, part, points) of all polygons: exterior rings only, projected, the closing
    point dropped, at least three points. Points and lines are no areas."""
    g = geometries(documents)
    single = F.from_json("coordinates", f"array<{RING}>")
    many = F.from_json("coordinates", f"array<array<{RING}>>")
    rings = F.when(c("type") == "Polygon", F.array(F.try_element_at(single, F.lit(1)))).when(
        c("type") == "MultiPolygon", F.transform(many, lambda p: F.try_element_at(p, F.lit(1))))

    def placed(p):
        e, n = to_lv95(p[0], p[1])
        return point(e, n)

    r = g.select("path", "order", F.posexplode(rings).alias("k", "ring"))
    r = r.filter("ring is not null and not exists(ring, p -> p is null or size(p) < 2 or p[0] is null or p[1] is null)")
    r = r.withColumn("points", F.transform("ring", placed))
    doubled = (F.size("points") > 1) & (F.element_at("points", 1) == F.element_at("points", -1))
    r = r.withColumn("points", F.when(doubled, F.slice("points", 1, F.size("points") - 1)).otherwise(c("points")))
    r = r.filter(F.size("points") >= 3)
    # Documents are files people draw; their parts are few.
    packed = r.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("order", "k", "points"))).alias("parts"))
    return packed.select("path", F.posexplode("parts").alias("part", "p")).select("path", "part", "p.points")


def rejected(documents: DataFrame) -> DataFrame:
    """Paths without any polygon."""
    return documents.select("path").join(polygons(documents).select("path").distinct(), "path", "left_anti")


def read_areas(spark: SparkSession, path: str) -> DataFrame:
    docs = read_documents(spark, path, "*.{geojson,json}")
    return polygons(docs).select(c("path").alias("area_id"), "part", F.lit("polygon").alias("kind"), "points")

"""Node, way and tag tables: the sink of classified features.

Ids do not depend on arrival order: a way vertex is numbered by the rank of its
fixed-point coordinate, elements by the rank of (layer, id, part).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrakit.functions.projection import to_wgs84
from terrakit.functions.shapes import e7, without_repeats
from terrakit.operators.lines import drop_repeats
from terrakit.operators.ordered import ranked


def quantised(points: DataFrame) -> DataFrame:
    """Add lon_e7, lat_e7 to rows with e, n."""
    lon, lat = to_wgs84(F.col("e"), F.col("n"))
    return points.withColumn("lon_e7", e7(lon)).withColumn("lat_e7", e7(lat))


def shared_nodes(points: DataFrame) -> DataFrame:
    """(node, lon_e7, lat_e7): one node per distinct coordinate, ranked by coordinate.

    Ranks are built from 0.001 degree strips, so no task sorts the country.
    """
    distinct = quantised(points).select("lon_e7", "lat_e7").distinct()
    return ranked(distinct, [], F.floor(F.col("lon_e7") / 10000), ["lon_e7", "lat_e7"], "node", fine=F.col("lon_e7")).select(
        "node", "lon_e7", "lat_e7"
    )


def line_references(points: DataFrame, key: str) -> DataFrame:
    """(key, i, lon_e7, lat_e7) with repeated neighbours dropped; lines of any length."""
    q = quantised(points).select(key, "i", "lon_e7", "lat_e7")
    return drop_repeats(q, key, ["lon_e7", "lat_e7"])


def emit_elements(features: DataFrame) -> DataFrame:
    """Features (layer, id, kind, parts) to (layer, id, kind, element, part, refs).

    A point part is a poi of its own. Every line and every ring, holes included, is one
    way; its references are fixed-point coordinates without repeated neighbours. Rings
    are closed; ways left with too few references are dropped.
    """
    parts = features.select("layer", "id", "kind", F.posexplode("parts").alias("part", "p"))
    is_point = F.col("kind").endswith("Point")
    is_ring = F.col("kind").endswith("Polygon")

    def key(p):
        lon, lat = to_wgs84(p["e"], p["n"])
        return F.struct(e7(lon).alias("lon_e7"), e7(lat).alias("lat_e7"))

    refs = F.transform("p.pts", key)
    ways = parts.filter(~is_point).withColumn("refs", without_repeats(refs))
    ways = ways.filter(F.size("refs") >= F.when(is_ring, 3).otherwise(2))
    first, last = F.element_at("refs", 1), F.element_at("refs", -1)
    ways = ways.withColumn(
        "refs", F.when(is_ring & (first != last), F.concat("refs", F.array(first))).otherwise(F.col("refs"))
    )
    pois = parts.filter(is_point).select(
        "layer", "id", "kind", "part", F.posexplode(refs).alias("sub", "r")
    ).select("layer", "id", "kind", F.lit("poi").alias("element"), (F.col("part") + F.col("sub")).alias("part"),
             F.array("r").alias("refs"))
    return ways.select("layer", "id", "kind", F.lit("way").alias("element"), "part", "refs").unionByName(pois)


def element_tables(features: DataFrame) -> dict[str, DataFrame]:
    """nodes, pois, ways and tags from features (layer, id, kind, parts, tags)."""
    elements = emit_elements(features.drop("tags"))
    ways = elements.filter("element = 'way'")
    vertices = ways.select("layer", "id", "part", F.posexplode("refs").alias("pos", "r")).select(
        "layer", "id", "part", "pos", "r.lon_e7", "r.lat_e7"
    )
    distinct = vertices.select("lon_e7", "lat_e7").distinct()
    nodes = ranked(distinct, [], F.floor(F.col("lon_e7") / 10000), ["lon_e7", "lat_e7"], "node", fine=F.col("lon_e7"))
    pois = elements.filter("element = 'poi'").select("layer", "id", "part", F.inline("refs"))
    node_refs = vertices.join(nodes, ["lon_e7", "lat_e7"]).select("layer", "id", "part", "pos", "node")
    tags = features.select("layer", "id", F.explode("tags").alias("k", "v"))
    return {"nodes": nodes.select("node", "lon_e7", "lat_e7"), "pois": pois, "way_nodes": node_refs, "tags": tags}


def write_element_tables(features: DataFrame, path: str) -> None:
    """The four tables as Parquet below ``path``; way references and tags by layer."""
    for name, df in element_tables(features).items():
        writer = df.write.mode("overwrite")
        if "layer" in df.columns:
            writer = writer.partitionBy("layer")
        writer.parquet(f"{path}/{name}")

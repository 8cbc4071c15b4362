"""Road maps from files: Overpass JSON, OSM XML, GeoJSON. All give (way, pos, node, lat, lon, oneway), then segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftframe.functions.geo import east_north

#: Kinds of highway that cars use.
DRIVABLE = (
    "motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link", "unclassified", "residential", "living_street", "service", "road",
)

_OVERPASS = "elements array<struct<type: string, id: long, lat: double, lon: double, nodes: array<long>, tags: map<string, string>>>"
_GEOJSON = "features array<struct<geometry: struct<type: string, coordinates: string>, properties: map<string, string>>>"


def overpass(spark: SparkSession, path: str) -> DataFrame:
    e = spark.read.schema(_OVERPASS).option("multiLine", True).json(path).select(F.explode("elements").alias("e")).select("e.*")
    nodes = e.where("type = 'node'").select(F.col("id").cast("string").alias("node"), "lat", "lon")
    ways = e.where("type = 'way'").where(F.col("tags")["highway"].isin(*DRIVABLE))
    ways = ways.select(F.col("id").cast("string").alias("way"), F.coalesce(F.col("tags")["oneway"] == "yes", F.lit(False)).alias("oneway"), F.posexplode("nodes").alias("pos", "n"))
    return ways.withColumn("node", F.col("n").cast("string")).drop("n").join(nodes, "node")


def osm_xml(spark: SparkSession, path: str) -> DataFrame:
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    nodes = read("node", "_id string, _lat double, _lon double").select(F.col("_id").alias("node"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"))
    ways = read("way", "_id string, nd array<struct<_ref: string>>, tag array<struct<_k: string, _v: string>>")
    tag = lambda k: F.get(F.transform(F.filter("tag", lambda x: x["_k"] == k), lambda x: x["_v"]), F.lit(0))
    ways = ways.where(tag("highway").isin(*DRIVABLE)).select(F.col("_id").alias("way"), F.coalesce(tag("oneway") == "yes", F.lit(False)).alias("oneway"), F.posexplode("nd._ref").alias("pos", "node"))
    return ways.join(nodes, "node")


def geojson(spark: SparkSession, path: str) -> DataFrame:
    f = spark.read.schema(_GEOJSON).option("multiLine", True).json(path).select(F.posexplode("features").alias("feature", "f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    lines = F.when(kind == "LineString", F.array(F.from_json(text, "array<array<double>>"))).when(kind == "MultiLineString", F.from_json(text, "array<array<array<double>>>"))
    ways = f.select("feature", F.coalesce(F.col("f.properties")["oneway"] == "yes", F.lit(False)).alias("oneway"), F.posexplode(lines).alias("part", "line"))
    pts = ways.select(F.concat_ws("/", "feature", "part").alias("way"), "oneway", F.posexplode("line").alias("pos", "p"))
    pts = pts.select("way", "oneway", "pos", F.col("p")[1].alias("lat"), F.col("p")[0].alias("lon"))
    return pts.withColumn("node", F.concat_ws(",", F.round("lat", 7), F.round("lon", 7)))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Ways of a map file by its kind; a JSON file with `elements` is Overpass, any other GeoJSON, the rest OSM XML."""
    if path.endswith((".json", ".geojson")):
        return overpass(spark, path) if "elements" in spark.read.option("multiLine", True).json(path).columns else geojson(spark, path)
    return osm_xml(spark, path)


def segments(ways: DataFrame, lat0: float, lon0: float) -> DataFrame:
    """(seg, x0, y0, x1, y1, oneway, node_a, node_b) between neighbouring known nodes of each way, about an origin."""
    x, y = east_north(F.col("lat"), F.col("lon"), lat0, lon0)
    w = Window.partitionBy("way").orderBy("pos")
    s = ways.withColumns({"x0": x, "y0": y}).withColumns({"x1": F.lead("x0").over(w), "y1": F.lead("y0").over(w), "node_b": F.lead("node").over(w)}).where("node_b is not null")
    return s.select(F.xxhash64("way", "pos").alias("seg"), "x0", "y0", "x1", "y1", "oneway", F.col("node").alias("node_a"), "node_b")

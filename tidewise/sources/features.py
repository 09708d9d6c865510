"""GeoJSON features, masked reads, named layers and dimension tables."""

from __future__ import annotations

import importlib.resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewise.functions import geo
from tidewise.operators.geometry import intersecting
from tidewise.sources import collections

#: Public layer names and the tables behind them.
LAYERS = {
    "flood_clipped": "flood_hazard",
    "flood_hazard": "flood_hazard",
    "qc_boundary": "qc_boundary",
    "district1_boundary": "district_boundary",
    "project8_boundary": "district_boundary",
    "district1_roads": "roads",
    "project8_roads": "roads",
    "evacuation_sites": "evacuation_sites",
}
_PACKED = (".gz", ".bz2", ".zst", ".lz4", ".snappy", ".deflate")
_FEATURE = "struct<type:string,properties:string,geometry:struct<type:string,coordinates:string>>"


def _points(c: Column) -> Column:
    return F.transform(c, lambda p: geo.point(p[0], p[1]))


def _parsed(features: DataFrame) -> DataFrame:
    """(ord, f) -> (ord, properties, geom_type, geom, line): polygons as multipolygons, lines and points as point arrays."""
    v = F.parse_json(F.col("f.geometry.coordinates"))
    get = lambda depth: F.variant_get(v, "$", "array<" * depth + "double" + ">" * depth)
    kind = F.col("f.geometry.type")
    geom = F.when(kind == "Polygon", F.array(F.transform(get(3), _points))).when(kind == "MultiPolygon", F.transform(get(4), lambda p: F.transform(p, _points)))
    line = F.when(kind == "Point", F.array(geo.point(get(1)[0], get(1)[1]))).when(kind == "LineString", _points(get(2))).when(kind == "MultiLineString", F.flatten(F.transform(get(3), _points)))
    return features.select("ord", F.col("f.properties").alias("properties"), kind.alias("geom_type"), geom.alias("geom"), line.alias("line"))


def read_features(spark: SparkSession, path: str, lines: bool = False, range_bytes: int = collections.RANGE_BYTES) -> DataFrame:
    """Features of FeatureCollections, or of one feature a line, with their order.

    A collection is read in ranges of bytes, a task each, and a feature belongs to the range that it begins in; packed files
    (``.gz``) cannot be read from the middle and are one task each.
    """
    if lines:
        rows = spark.read.schema("type string, properties string, geometry struct<type:string,coordinates:string>").json(path)
        features = rows.filter("type = 'Feature'").select(F.monotonically_increasing_id().alias("ord"), F.struct("type", "properties", "geometry").alias("f"))
    elif not path.endswith(_PACKED):
        texts = collections.feature_texts(spark, path, range_bytes).select("ord", F.from_json("value", _FEATURE).alias("f"))
        features = texts.filter("f.type = 'Feature'")
    else:
        features = spark.read.schema(f"features array<{_FEATURE}>").option("multiLine", True).json(path).select(F.posexplode("features").alias("ord", "f"))
    return _parsed(features.select(F.col("ord").cast("long").alias("ord"), "f"))


def write_features(df: DataFrame, path: str, geom_type: Column, coordinates: Column, properties: list[str]) -> None:
    """One feature a line, replacing what is there; ``coordinates`` is an array of numbers of any depth."""
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), F.struct(geom_type.alias("type"), coordinates.alias("coordinates")).alias("geometry"))
    df.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def coordinates(geom: Column) -> Column:
    """Multipolygon -> nested arrays of numbers."""
    return F.transform(geom, lambda p: F.transform(p, lambda r: F.transform(r, lambda q: F.array(q["x"], q["y"]))))


def read_masked(spark: SparkSession, path: str, mask: DataFrame) -> DataFrame:
    """Polygons of a Parquet layer (ord, geom, min_x, max_x, min_y, max_y, ...) that meet a mask (geom).

    The mask's box is a handful of numbers, so the boxes of the layer are compared in the scan (pushed down to row
    groups) before the exact test.
    """
    points = F.flatten(F.flatten("geom"))
    box = mask.select(geo.bounds(points).alias("b")).agg(F.min("b.min_x"), F.max("b.max_x"), F.min("b.min_y"), F.max("b.max_y")).first()
    layer = spark.read.parquet(path)
    if box[0] is None:
        return layer.limit(0)
    near = layer.filter((F.col("min_x") <= box[1]) & (F.col("max_x") >= box[0]) & (F.col("min_y") <= box[3]) & (F.col("max_y") >= box[2]))
    return intersecting(near, mask)


def layer(spark: SparkSession, name: str, jdbc: dict[str, str] | None = None) -> DataFrame:
    """A whole table by its public name, from the catalog or over JDBC; unknown names raise KeyError."""
    target = LAYERS[name]
    if jdbc:
        return spark.read.format("jdbc").options(**jdbc, dbtable=target).load()
    return spark.table(target)


def dimension_lines(name: str) -> list[str]:
    """The lines of a file of fixed values."""
    text = importlib.resources.files("tidewise.sources").joinpath("data", name).read_text(encoding="utf-8")
    return [x for x in text.splitlines() if x and not x.startswith("#")]


def _dimension(spark: SparkSession, name: str, schema: str) -> DataFrame:
    lines = spark.createDataFrame(list(enumerate(dimension_lines(name))), "ord long, value string")
    return lines.select("ord", F.from_csv("value", schema, {"sep": ","}).alias("r")).select("ord", "r.*")


def evacuation_sites(spark: SparkSession) -> DataFrame:
    """(ord, name, barangay, lat, lng): the site dimension."""
    return _dimension(spark, "sites.csv", "name string, barangay string, lat double, lng double")


def barangays(spark: SparkSession) -> DataFrame:
    """(ord, name)."""
    return _dimension(spark, "barangays.csv", "name string")

"""GeoJSON and annotation JSON as tables and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import lines

FEATURES = "struct<type:string,features:array<struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>>"


def parse_features(df: DataFrame, text: str, geom: str = "line") -> DataFrame:
    """Feature collections in ``text`` to one row per line feature.

    A MultiLineString gives its longest part (the first on ties); empty and other
    geometries are dropped. Properties come as a string map.
    """
    parsed = df.withColumn("_fc", F.from_json(text, FEATURES)).drop(text)
    f = parsed.select("*", F.posexplode("_fc.features").alias("feature_index", "_f")).drop("_fc")
    kind, raw = F.col("_f.geometry.type"), F.col("_f.geometry.coordinates")
    one = F.array(F.from_json(raw, "array<array<double>>"))
    many = F.from_json(raw, "array<array<array<double>>>")
    f = f.withColumn("_parts", F.when(kind == "LineString", one).when(kind == "MultiLineString", many))
    pts = F.transform("_parts", lambda part: F.transform(F.filter(part, lambda c: F.size(c) >= 2), lambda c: lines.point(c[0], c[1])))
    f = f.withColumn("_parts", F.filter(pts, lambda part: F.size(part) >= 2))
    sized = F.transform("_parts", lambda part, i: F.struct(lines.line_length(part).alias("len"), (-i).alias("i"), part.alias("p")))
    return f.withColumn(geom, F.array_max(sized)["p"]).filter(F.col(geom).isNotNull()).withColumn("properties", F.col("_f.properties")).drop("_f", "_parts")


def read_geojson(spark: SparkSession, path: str, geom: str = "line") -> DataFrame:
    """Line features of all files under ``path``; each file is one document."""
    docs = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return parse_features(docs, "value", geom)


def geometry_json(line: Column | str, kind: str = "LineString") -> Column:
    """Geometry struct: ``LineString`` from an array of points, ``Point`` from one point."""
    c = F.col(line) if isinstance(line, str) else line
    coords = F.array(c["x"], c["y"]) if kind == "Point" else F.transform(c, lambda p: F.array(p["x"], p["y"]))
    if kind == "Polygon":
        coords = F.array(coords)
    return F.struct(F.lit(kind).alias("type"), coords.alias("coordinates"))


def to_features(df: DataFrame, geom: str, props: Sequence[str], kind: str = "LineString", keep: Sequence[str] = ()) -> DataFrame:
    """One GeoJSON feature text per row in ``feature``."""
    body = F.struct(F.lit("Feature").alias("type"), F.struct(*props).alias("properties"), geometry_json(geom, kind).alias("geometry"))
    return df.select(*keep, F.to_json(body, {"ignoreNullFields": "false"}).alias("feature"))


def to_collections(features: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One FeatureCollection document per key, for artifacts of one run or AOI.

    A document is one value by nature; use ``write_feature_lines`` for unbounded output.
    """
    joined = F.concat_ws(",", F.sort_array(F.collect_list("feature")))
    return features.groupBy(*keys).agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), joined, F.lit("]}")).alias("value"))


def write_geojson(collections: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Documents partitioned by key, one per file row."""
    collections.select(*keys, "value").write.mode("overwrite").partitionBy(*keys).text(path)


def write_feature_lines(features: DataFrame, path: str) -> None:
    """Newline-delimited features: any number, written in parallel."""
    features.select("feature").write.mode("overwrite").text(path)


def read_feature_lines(spark: SparkSession, path: str, geom: str = "line") -> DataFrame:
    """Line features of newline-delimited files; each feature is one row."""
    one = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.col("value"), F.lit("]}"))
    return parse_features(spark.read.text(path).select(one.alias("value")), "value", geom)


# --- annotations ---

ANNOTATION = "version string, shapes array<struct<label:string,points:array<array<double>>,shape_type:string,description:string>>, imagePath string, imageWidth int, imageHeight int, _bad string"


def parse_annotations(df: DataFrame, text: str) -> DataFrame:
    """Annotation documents to one row per shape; malformed documents are skipped."""
    parsed = df.withColumn("_a", F.from_json(text, ANNOTATION, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})).drop(text)
    good = parsed.filter(F.col("_a._bad").isNull() & F.col("_a.shapes").isNotNull())
    s = good.select("*", F.posexplode("_a.shapes").alias("shape_index", "_s"))
    pts = F.transform(F.filter("_s.points", lambda c: (F.size(c) >= 2) & c[0].isNotNull() & c[1].isNotNull()), lambda c: lines.point(c[0], c[1]))
    return s.withColumns({
        "label": F.lower(F.trim("_s.label")), "shape_type": F.lower(F.coalesce(F.trim("_s.shape_type"), F.lit("line"))), "line": pts,
        "image_path": F.col("_a.imagePath"), "image_width": F.col("_a.imageWidth"), "image_height": F.col("_a.imageHeight"),
    }).drop("_a", "_s")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    docs = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return parse_annotations(docs, "value")


def label_lines(shapes: DataFrame, label: str) -> DataFrame:
    """Shapes of one label with at least two points."""
    return shapes.filter((F.col("label") == label.lower()) & (F.size("line") >= 2))


def to_annotations(df: DataFrame, keep: Sequence[str], version: str = "5.0.1", label: str = "ve") -> DataFrame:
    """One annotation document per label line (``line, image_path, image_width, image_height, description``)."""
    shape = F.struct(
        F.lit(label).alias("label"), F.transform("line", lambda p: F.array(p["x"], p["y"])).alias("points"), F.lit(None).cast("string").alias("group_id"),
        F.col("description"), F.lit("linestrip").alias("shape_type"),
    )
    doc = F.struct(
        F.lit(version).alias("version"), F.array(shape).alias("shapes"), F.col("image_path").alias("imagePath"),
        F.col("image_width").cast("int").alias("imageWidth"), F.col("image_height").cast("int").alias("imageHeight"),
    )
    return df.select(*keep, F.to_json(doc, {"ignoreNullFields": "false"}).alias("value"))


def write_annotations(docs: DataFrame, path: str, keys: Sequence[str]) -> None:
    docs.write.mode("overwrite").partitionBy(*keys).text(path)

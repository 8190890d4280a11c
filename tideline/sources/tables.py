"""Series, feature, scene and run tables in files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.text_time import parse_iso
from tideline.operators import selection

SERIES_CSV = (
    "run_id string, scene_id string, datetime string, transect_id int, VE_distance_m double, WL_distance_m double, "
    "wl_lon double, wl_lat double, ve_lon double, ve_lat double"
)


def read_series(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Observation series; text times parse as UTC and bad ones become NULL."""
    if fmt == "csv":
        df = spark.read.csv(path, header=True, schema=SERIES_CSV)
    else:
        df = spark.read.format(fmt).load(path)
    if dict(df.dtypes)["datetime"] == "string":
        df = df.withColumn("datetime", parse_iso("datetime"))
    return df


def write_series(df: DataFrame, path: str, fmt: str = "parquet", partition: Sequence[str] = ()) -> None:
    """Series sorted by time and transect over the whole output: a range sort, no single task."""
    order = [c for c in ("datetime", "transect_index", "transect_id") if c in df.columns]
    writer = df.orderBy(*partition, *order).write.mode("overwrite")
    if partition:
        writer = writer.partitionBy(*partition)
    if fmt == "csv":
        writer.option("header", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").csv(path)
    else:
        writer.format(fmt).save(path)


# What each artifact type offers.
ARTIFACTS = {
    "geojson": ("intersections", "transects", "waterlines", "veglines", "forecast"),
    "csv": ("timeseries", "forecast", "metrics"),
    "parquet": ("timeseries", "forecast"),
}


def load_artifact(spark: SparkSession, root: str, run_id: str, kind: str, artifact: str) -> DataFrame:
    """Rows of one artifact of one run: tables are partitioned by ``run_id``."""
    if kind not in ARTIFACTS:
        raise ValueError(f"unknown artifact type: {kind}")
    if artifact not in ARTIFACTS[kind]:
        raise ValueError(f"unknown {kind} artifact: {artifact}")
    return spark.read.parquet(f"{root}/{kind}/{artifact}").filter(F.col("run_id") == run_id)


def save_artifact(df: DataFrame, root: str, kind: str, artifact: str) -> None:
    if artifact not in ARTIFACTS.get(kind, ()):
        raise ValueError(f"unknown {kind} artifact: {artifact}")
    replace_partitions(df, f"{root}/{kind}/{artifact}", ["run_id"])


def replace_partitions(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Overwrite only the partitions that occur in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def list_features(features: DataFrame, kind: str) -> DataFrame:
    """Readable features of a kind, newest first."""
    return features.filter((F.col("kind") == kind) & F.col("name").isNotNull() & F.col("created").isNotNull()).orderBy(F.desc("created"), "name")


def save_features(old: DataFrame, new: DataFrame) -> DataFrame:
    """Table with the new features in place of equal names."""
    return selection.upsert(old, new, ["kind", "name"])


def get_feature(features: DataFrame, kind: str, name: str) -> DataFrame:
    """The named feature; a name that does not occur is an error."""
    return selection.assert_present(features.filter((F.col("kind") == kind) & (F.col("name") == name)), f"no {kind} named {name}")


def drop_features(features: DataFrame, kind: str, name: str) -> DataFrame:
    """Table without the named feature; a name that does not occur is an error."""
    get_feature(features, kind, name)
    return features.filter(~((F.col("kind") == kind) & (F.col("name") == name)))


def get_or_create(features: DataFrame, default: DataFrame) -> DataFrame:
    """Table with the fixed feature added where it is not there yet."""
    return selection.insert_if_absent(features, default, ["kind", "name"])


def save_scene_catalog(spark: SparkSession, scenes: DataFrame, path: str, mode: str, error: str | None = None) -> None:
    """Search results of the AOIs in ``scenes`` replace what was cached for them."""
    replace_partitions(scenes.withColumn("search_mode", F.lit(mode)).withColumn("search_error", F.lit(error).cast("string")), path, ["aoi_id"])


def write_report(parts: Sequence[DataFrame], path: str) -> DataFrame:
    """Rows of all parts with the union of their columns, as CSV and JSON."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    out.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    out.write.mode("overwrite").json(f"{path}/json")
    return out


def run_report(summaries: DataFrame, predictions: DataFrame, run_id: str | None = None) -> DataFrame:
    """Run summaries with their prediction summary where there is one."""
    s = summaries if run_id is None else selection.assert_present(summaries.filter(F.col("run_id") == run_id), f"no run {run_id}")
    pred = predictions.select("run_id", F.struct(*[c for c in predictions.columns if c != "run_id"]).alias("prediction"))
    return s.join(pred, "run_id", "left")

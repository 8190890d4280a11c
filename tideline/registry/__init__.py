"""Queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.lineage import prepare

MODULES = ["scalar", "series", "geometry", "raster", "thresholds", "metrics", "samples", "selection", "twin"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Output types both engines share: BIGINT, DOUBLE, zone-free timestamps, text."""
    out = []
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            col = col.cast("bigint")
        elif isinstance(f.dataType, (T.FloatType, T.DecimalType)):
            col = col.cast("double")
        elif isinstance(f.dataType, T.TimestampType):
            col = col.cast("timestamp_ntz")
        out.append(col.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its DuckDB counterpart."""
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain(fn(prepare(spark), sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def r6(col):
    """Round half up to 6 decimals with the same double arithmetic in both engines."""
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(c * 1e6 + 0.5) / 1e6


def s6(expr: str) -> str:
    return f"floor(({expr}) * 1e6 + 0.5) / 1e6"


def r3(col):
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(c * 1e3 + 0.5) / 1e3


def s3(expr: str) -> str:
    return f"floor(({expr}) * 1e3 + 0.5) / 1e3"


def load_all() -> None:
    import importlib

    for module in MODULES:
        importlib.import_module(f"tideline.registry.{module}")

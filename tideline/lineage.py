"""Session settings, scratch space and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Settings every job relies on: UTC timestamps and adaptive re-planning."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # inferring constraints is exponential in derived columns; our plans state their filters
    spark.conf.set("spark.sql.constraintPropagation.enabled", "false")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors reach: the session's ``spark.checkpoint.dir``.

    Only where that is unset (local tests) is a folder of our own chosen.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    current = context.getCheckpointDir()
    if named:
        if current is None:
            context.setCheckpointDir(named)
        return named
    if current is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        current = tempfile.mkdtemp(prefix="tideline-")
        context.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, never used twice."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in reliable storage so an iteration does not grow its plan."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Like ``cut``, but the result's size is that of its files. A checkpoint keeps the estimate of the plan it came from, and
    estimates multiply at each join: over a plan of many loops they become numbers of millions of digits, which planning then has to
    multiply again. Composed plans therefore settle their stages.
    """
    path = scratch_path(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

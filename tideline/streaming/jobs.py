"""Job status rolled up from an append-only event log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACTIVE = ("queued", "running")


def phase_status(events: DataFrame) -> DataFrame:
    """Latest state of every job phase (``seq`` orders events); works on a stream in update mode."""
    last = F.max_by(F.struct("state", "ts", "message", "seq"), "seq")
    return events.groupBy("job_id", "phase").agg(last.alias("_e")).select("job_id", "phase", "_e.state", "_e.ts", "_e.message", "_e.seq")


def job_status(events: DataFrame) -> DataFrame:
    """One row per job: phase map, overall status, error of the last failed phase, active flag.

    A failed phase fails the job; all phases complete complete it; else it runs, or is queued
    while nothing has started. A job has a fixed set of phases, which bounds the map.
    """
    p = phase_status(events)
    is_ = lambda s: F.count_if(F.col("state") == s)
    out = p.groupBy("job_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("phase", "state")))).alias("phases"), F.count("*").alias("_n"),
        is_("failed").alias("_f"), is_("completed").alias("_c"), is_("running").alias("_r"),
        F.max_by(F.when(F.col("state") == "failed", F.col("message")), F.when(F.col("state") == "failed", F.col("seq"))).alias("error"), F.max("ts").alias("updated_at"),
    )
    status = F.when(F.col("_f") > 0, "failed").when(F.col("_c") == F.col("_n"), "completed").when(F.col("_r") + F.col("_c") > 0, "running").otherwise("queued")
    out = out.withColumn("status", status)
    return out.select("job_id", "phases", "status", "error", "updated_at", F.col("status").isin(*ACTIVE).alias("active"))


def job_log(events: DataFrame) -> DataFrame:
    """Log rows in order."""
    return events.select("job_id", "seq", "ts", "phase", "state", "message").orderBy("job_id", "seq")

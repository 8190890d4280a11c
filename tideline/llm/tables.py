"""Intermediate tables in the shared folder, and joins that withstand hot keys."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.lineage import scratch_path


#: Rows of a narrow table that are worth a task of their own.
TASK_ROWS = 50_000


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, lost executors cost nothing.

    ``rows`` tells that the table is narrow and that about so many rows make it: tasks, and so files, are then no more than ``TASK_ROWS`` asks,
    whatever the number of shuffle partitions.
    """
    path = scratch_path(df.sparkSession, name)
    if rows is not None:
        df = df.coalesce(max(1, math.ceil(rows / TASK_ROWS)))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hot_keys(df: DataFrame, keys: list[str], counts: DataFrame | None = None) -> DataFrame:
    """Keys with more than one shuffle partition's even share of the rows, and how many parts they need.

    At most one key per shuffle partition can have that many rows, so the result may be broadcast. ``counts``
    (keys, ``_n``) saves the counting.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max(1, df.count() // partitions)
    if counts is None:
        counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counts.where(F.col("_n") > share).select(*keys, F.ceil(F.col("_n") / share).cast("int").alias("_parts"))


#: Bits of the cells that ``near`` sends to every task: at most 2 ** CELLS numbers.
CELLS = 20


def near(df: DataFrame, keys: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """``df`` parted into rows that may have a match in ``keys`` and rows that cannot, before wide rows are moved.

    Both carry all columns of ``df``. Rows may match where a key's hash cell does; the more keys there are, the more rows pass, all of them
    at worst, and the join that follows is exact either way.
    """
    cell = F.pmod(F.xxhash64(*on), F.lit(1 << CELLS)).cast("int")
    cells = F.broadcast(keys.select(cell.alias("_cell")).distinct().withColumn("_met", F.lit(True)))
    marked = df.withColumn("_cell", cell).join(cells, "_cell", "left").drop("_cell")
    return marked.where("_met").drop("_met"), marked.where("_met is null").drop("_met")


def spread_join(big: DataFrame, small: DataFrame, keys: list[str], spread: list[str], how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """Equi-join of ``big`` with ``small`` (few rows per key) in which hot keys of ``big`` are salted by ``spread``.

    Only hot keys' rows of ``small`` are copied, once per part. ``how``: ``inner`` or ``left``.
    """
    hot = F.broadcast(stored(hot_keys(big, keys, counts), "hot"))
    parts = F.coalesce("_parts", F.lit(1))
    salted = big.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*spread), parts).cast("int")).drop("_parts")
    copies = small.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")

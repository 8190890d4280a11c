"""Exact duplicates by an extendible-hash index on shared files (operator 5).

Keys are 64-bit hashes of the normalised text. A directory over the first ``depth`` bits points to buckets; a bucket with more than
``capacity`` distinct keys is split, and the directory doubles when a split needs a bit more than it has. Bucket
files lie in the shared folder; each owner task holds one bucket's key range. Keys that several rows have form chains, and within a
chain texts are compared byte for byte, so two texts whose hashes collide stay apart.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.lineage import scratch_path
from tideline.llm.tables import near, spread_join, stored

CAPACITY = 1 << 20
#: The directory has at most 2 ** MAX_DEPTH cells; fuller buckets chain.
MAX_DEPTH = 16


def normalised(text: Column) -> Column:
    """A-Z lower-cased, all else as it is; null counts as empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cell(key: Column, depth: int) -> Column:
    """The first ``depth`` bits of a key."""
    return F.lit(0) if depth == 0 else F.shiftrightunsigned(key, 64 - depth).cast("int")


def directory(keys: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> list[tuple[int, int, int]]:
    """Buckets as (local depth, prefix, keys), grown by splitting from one bucket.

    One pass counts keys by the longest prefix that could be needed; splits then halve those counts, at most 2 ** max_depth of them.
    """
    n = keys.count()
    depth = min(max_depth, max(0, math.ceil(math.log2(max(1.0, n / capacity))) + 2)) if n > capacity else 0
    fine = {r.c: r.n for r in keys.groupBy(cell(F.col("h"), depth).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}
    out, open_buckets = [], [(0, 0, fine)]
    while open_buckets:
        local, prefix, cells = open_buckets.pop()
        total = sum(cells.values())
        if total <= capacity or local == depth:
            out.append((local, prefix, total))
            continue
        bit = depth - local - 1
        for half in (1, 0):
            open_buckets.append((local + 1, prefix * 2 + half, {c: k for c, k in cells.items() if (c >> bit & 1) == half}))
    return sorted(out, key=lambda b: b[1] << (64 - b[0]))


def build_index(rows: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """The index as a table of (bucket, h, n): one entry a key with the length of its chain, a folder for each bucket's files.

    ``rows`` has ``h``. Equal keys are counted before the shuffle, so a hot text is one entry a task.
    """
    entries = stored(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")), "entries")
    buckets = directory(entries, capacity, max_depth)
    depth = max(b[0] for b in buckets)
    spark = rows.sparkSession
    slots = [(s, i) for i, (local, prefix, _) in enumerate(buckets) for s in range(prefix << (depth - local), (prefix + 1) << (depth - local))]
    table = spark.createDataFrame(slots, "slot int, bucket int")  # at most 2 ** max_depth rows
    path = scratch_path(spark, "hash-index")
    placed = entries.withColumn("slot", cell(F.col("h"), depth)).join(F.broadcast(table), "slot").select("bucket", "h", "n")
    placed.repartition("bucket").sortWithinPartitions("bucket", "h").write.partitionBy("bucket").parquet(path)
    return spark.read.schema("h bigint, n bigint, bucket int").parquet(path)


def deduplicate(df: DataFrame, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, max_depth: int = MAX_DEPTH, key: Column | None = None) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    The largest id of equal texts stays; null ids are smallest, and a group with none but null ids keeps one of them by marking
    all (they cannot be told apart). Rows repeated with the same id and text count in ``group_size`` and share one mark. Empty and null
    texts are equal to each other. An empty table gives an empty result; other columns are ignored. ``key`` replaces the hash in tests of collisions.
    """
    norm = df.select(F.col(id_col).alias("id"), normalised(F.col(text)).alias("t"))
    hashed = norm.select("id", "t", (F.xxhash64("t") if key is None else key).alias("h"))
    seen = stored(hashed.select("id", "h", F.sha2("t", 256).alias("sha")), "hashed")
    index = build_index(seen, capacity, max_depth)
    chains = stored(index.where("n > 1").select("h"), "chains")
    # only chained rows send their bytes; equal bytes meet before the shuffle
    chained = stored(near(hashed, chains, ["h"])[0].join(chains, "h", "left_semi").select("id", "t", "h"), "chained")
    groups = stored(chained.groupBy("h", "t").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    sure = groups.groupBy("h").agg(F.count(F.lit(1)).alias("texts"), F.first("keep_id").alias("keep_id"), F.first("group_size").alias("group_size"))
    sure = stored(sure, "compared")
    # members of a chain that holds one text were all compared; chains of several texts are told apart by their bytes
    joined = spread_join(seen, sure, ["h"], ["id", "sha"], "left", index.where("n > 1").select("h", F.col("n").alias("_n"))).where("texts is null or texts = 1")
    apart = chained.join(sure.where("texts > 1").select("h"), "h", "left_semi")
    split = spread_join(apart, groups, ["h", "t"], ["id"]).withColumn("sha", F.sha2("t", 256))
    cols = ["id", "sha", "keep_id", "group_size"]
    rows = joined.select(*cols).unionByName(split.select(*cols))
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return rows.select(
        F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"), F.col("sha").alias("text_sha256"),
    )

"""Merkle manifest of a table: one tree a group, one root over the groups, and a proof for every row (operator 13).

Rows are leaves. Each group's leaves are ordered, and pairs of neighbours are hashed level by level up to the group's root; the groups' roots
are the leaves of one more tree, whose root stands for the table. Leaves get their places from a range partitioning, so no group is
ordered in one task. The levels are built and stored in bands: a node row of band b knows its hash, the siblings on its way through the band, and the
node of band b + 1 where that way ends. A recursive query climbs these links for every leaf, appends the siblings and folds a (possibly
altered) leaf hash up to the root.
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.tables import stored

#: Levels of a band. It grows with the table so that bands above the first have about ``UPPER_NODES`` rows a tree or fewer.
LEAST_WIDTH, MOST_WIDTH, UPPER_NODES = 8, 20, 1 << 16
#: Node rows above the first band that may be sent to every task (each at most 33 bytes a level); with more, the climb is a shuffle join.
BROADCAST_NODES = 1 << 17
#: The tree over the groups' roots; groups' trees are named by ``tree_name``, which never gives this.
TOP = "#"


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the text."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def tree_name(group: Column) -> Column:
    """Null first, then by bytes."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def placed(leaves: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``leaves`` (tree, hash, …) with ``pos``, their place in their tree by ``order`` from 0, and ``n``, its size; and how many there are.

    A range partitioning sorts all trees at once; a row's place is its place in its partition plus the rows of its tree in earlier partitions. Partitions
    hold consecutive trees, so there are at most as many (partition, tree) counts as partitions and trees together.
    """
    spark = leaves.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col("tree"), *(F.col(c).asc_nulls_first() for c in order)]
    row = leaves.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    row = stored(row, "leaf-order")
    part = F.shiftright("_at", 33)
    counts = stored(row.groupBy("tree", part.alias("_part")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")), "leaf-counts")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    before = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("tree")
    offsets = counts.select("tree", F.col("_part"), "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("n"))
    found = row.withColumn("_part", part).join(offsets, ["tree", "_part"])
    return found.withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_first", "_before", "_part"), total


def _digest(*parts: bytes) -> bytes:
    return hashlib.sha256("".join(p.hex() for p in parts).encode()).digest()


def _climbed(hashes: list[bytes], steps: int) -> tuple[list[bytes], bytes]:
    """Each node's way through ``steps`` levels, and the node that all ways end in. A way has 33 bytes a level: the side of the sibling (0 none, 1 left, 2 right) and its hash."""
    ways: list[list[bytes]] = [[] for _ in hashes]
    level = hashes
    for step in range(steps):
        for i, way in enumerate(ways):
            here = i >> step
            other = here ^ 1
            way.append((b"\x01" if other < here else b"\x02") + level[other] if other < len(level) else bytes(33))
        level = [_digest(*level[k : k + 2]) for k in range(0, len(level), 2)]
    return [b"".join(w) for w in ways], level[0]


def band(nodes: DataFrame, width: int) -> DataFrame:
    """``nodes`` (tree, pos, n, hash binary, …) with ``way``, and on a block's first row ``above``, the hash where the ways of its 2 ** width nodes end."""
    cols = [c for c in nodes.columns if c not in ("tree", "pos", "n", "hash")]
    blocks = nodes.select(F.shiftright("pos", width).alias("_block"), "tree", "pos", "n", "hash", *cols)

    def build(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, [("pos", "ascending")])).drop_columns("_block")
        steps = min(width, (rows["n"][0].as_py() - 1).bit_length())
        ways, above = _climbed(rows["hash"].to_pylist(), steps)
        more = pa.array([above] + [None] * (len(ways) - 1), pa.binary())
        return rows.append_column("way", pa.array(ways, pa.binary())).append_column("above", more)

    kinds = ", ".join(f"{c} {nodes.schema[c].dataType.simpleString()}" for c in ("tree", "pos", "n", "hash", *cols))
    return blocks.groupBy("tree", "_block").applyInArrow(build, f"{kinds}, way binary, above binary")


def levels(leaves: DataFrame, width: int) -> tuple[list[DataFrame], DataFrame]:
    """Node rows (tree, pos, n, hash, …, way) of every band, and the trees' roots (tree, bands, root). ``leaves`` has tree, pos, n, hash (binary) and what else its rows keep.

    A tree of one leaf has one band without a level.
    """
    bands, roots, now = [], None, leaves
    while True:
        built = stored(band(now, width), "band")
        bands.append(built.drop("above"))
        up = built.where("above is not null").select("tree", F.shiftright("pos", width).alias("pos"), F.ceil(F.col("n") / (1 << width)).cast("bigint").alias("n"), F.col("above").alias("hash"))
        ended = up.where("n = 1").select("tree", F.lit(len(bands)).alias("bands"), F.col("hash").alias("root"))
        roots = ended if roots is None else roots.unionByName(ended)
        now = up.where("n > 1")
        if now.isEmpty():
            return bands, roots


def fold(start: Column, way: Column) -> Column:
    """The hash (hex text) that ``start`` (hex text) leads to along ``way``."""
    def step(acc: Column, k: Column) -> Column:
        side, other = F.hex(F.substring(way, k * 33 + 1, F.lit(1))), F.lower(F.hex(F.substring(way, k * 33 + 2, F.lit(32))))
        return F.sha2(F.when(side == "01", F.concat(other, acc)).when(side == "02", F.concat(acc, other)).otherwise(acc), 256)

    steps = (F.length(way) / 33).cast("int")
    return F.when(steps == 0, start).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(steps, F.lit(1)) - 1), start, step))


def siblings(way: Column) -> Column:
    """The hashes (hex text) of the siblings along ``way``, joined."""
    steps = (F.length(way) / 33).cast("int")
    one = lambda k: F.when(F.hex(F.substring(way, k * 33 + 1, F.lit(1))) == "00", "").otherwise(F.lower(F.hex(F.substring(way, k * 33 + 2, F.lit(32)))))
    return F.when(steps == 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(steps, F.lit(1)) - 1), one), ""))


def _climb(starts: DataFrame, upper: DataFrame, small: bool) -> DataFrame:
    """(k, way, subroot, root) of every start: the recursive query ascends the links, appends the ways and notes where a tree ends."""
    hint = "/*+ BROADCAST(nodes) */" if small else ""
    text = f"""
    WITH RECURSIVE climb(k, tree, band, pos, way, subroot, root) AS (
      SELECT k, next_tree, next_band, next_pos, way, ended, CAST(NULL AS BINARY) FROM {{starts}}
      UNION ALL
      SELECT {hint} climb.k, nodes.next_tree, nodes.next_band, nodes.next_pos, climb.way || nodes.way, COALESCE(climb.subroot, nodes.ended), CASE WHEN nodes.next_tree IS NULL THEN nodes.ended END
      FROM climb JOIN {{nodes}} AS nodes ON climb.tree = nodes.tree AND climb.band = nodes.band AND climb.pos = nodes.pos
    )
    SELECT k, way, subroot, root FROM climb WHERE tree IS NULL"""
    spark, limit = starts.sparkSession, "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")  # the rows of a climb are those of the table, and it ends with the trees' height
    try:
        return stored(spark.sql(text, starts=starts, nodes=upper), "proofs")
    finally:
        spark.conf.set(limit, before)


def manifest(df: DataFrame, fields: list[str], group: str, order: list[str], keep: dict[str, Column] | None = None, altered: Column | None = None, width: int | None = None) -> DataFrame:
    """One row per input row: ``keep``'s columns, ``leaf``, ``subroot``, ``root``, ``way`` (binary, the proof), ``folded`` and ``altered_leaf``.

    ``fields`` make the leaf's hash, ``group`` names the tree, ``order`` sorts it (nulls first, ties by the leaf's hash, so equal rows are alike). ``altered``, if given, is the leaf hash that is folded in
    place of the true one. Null groups form a tree of their own, before all others. Null or repeated ids, empty and long texts and further columns change nothing. An empty
    table gives an empty result. One group may hold nearly all rows; a task orders a range and hashes blocks of 2 ** width leaves.
    """
    keep = keep if keep is not None else {c: F.col(c) for c in order}
    leaf, names = leaf_hash(*map(F.col, fields)), [f"k{i}" for i in range(len(keep))]
    keys = [f"o{i}" for i in range(len(order))]
    row = df.select(
        tree_name(F.col(group)).alias("tree"), F.unhex(leaf).alias("hash"), F.unhex(leaf if altered is None else altered).alias("other"),
        *(F.col(c).alias(k) for c, k in zip(order, keys)), *(x.alias(n) for x, n in zip(keep.values(), names)),
    )
    leaves, total = placed(row, [*keys, "hash", "other"])
    if width is None:
        width = min(MOST_WIDTH, max(LEAST_WIDTH, math.ceil(math.log2(max(total, 1) / UPPER_NODES))))
    bands, roots = levels(leaves.drop(*keys), width)
    roots = stored(roots, "subroots")
    tops, groups = placed(roots.select(F.lit(TOP).alias("tree"), F.col("root").alias("hash"), F.col("tree").alias("group"), "bands"), ["group"])
    tops = stored(tops, "top-leaves")
    above, crown = levels(tops.select("tree", "pos", "n", "hash"), width)
    # where a tree's last band leads: a group's to its leaf of the top tree, the top tree's nowhere
    out_of = tops.select(F.col("group").alias("tree"), "bands", F.col("hash").alias("root"), F.lit(TOP).alias("to_tree"), F.col("pos").alias("to_pos"))
    out_of = stored(out_of.unionByName(crown.select("tree", "bands", "root", F.lit(None).cast("string").alias("to_tree"), F.lit(None).cast("bigint").alias("to_pos"))), "tree-ends")

    def linked(nodes: DataFrame, number: int) -> DataFrame:
        """Node rows with the node that their way ends in."""
        ends = F.broadcast(out_of) if groups < BROADCAST_NODES else out_of
        row = nodes.join(ends, "tree").withColumn("_last", F.col("bands") == number + 1)
        return row.withColumns({
            "band": F.lit(number), "next_tree": F.when(F.col("_last"), F.col("to_tree")).otherwise(F.col("tree")), "next_band": F.when(F.col("_last"), 0).otherwise(number + 1),
            "next_pos": F.when(F.col("_last"), F.col("to_pos")).otherwise(F.shiftright("pos", width)), "ended": F.when(F.col("_last"), F.col("root")),
        })

    upper = None
    for b in [*((b, i) for i, b in enumerate(bands[1:], 1)), *((b, i) for i, b in enumerate(above))]:
        rows = linked(*b).select("tree", "band", "pos", "way", "next_tree", "next_band", "next_pos", "ended")
        upper = rows if upper is None else upper.unionByName(rows)
    upper = stored(upper, "nodes")
    starts = linked(bands[0], 0).select(F.struct("hash", "other", *names).alias("k"), "next_tree", "next_band", "next_pos", "way", "ended")
    out = _climb(starts, upper, upper.count() <= BROADCAST_NODES)
    text = lambda c: F.lower(F.hex(c))
    other = text(F.col("k.other"))
    return out.select(
        *(F.col(f"k.{n}").alias(c) for n, c in zip(names, keep)), text(F.col("k.hash")).alias("leaf"), text(F.col("subroot")).alias("subroot"), text(F.col("root")).alias("root"),
        "way", fold(other, F.col("way")).alias("folded"), other.alias("altered_leaf"),
    )


def verify(proofs: DataFrame) -> DataFrame:
    """``proofs`` of ``manifest`` with ``proof_sha256``, ``folded_root`` and ``verified`` in place of ``way`` and ``folded``."""
    kept = [c for c in proofs.columns if c not in ("way", "folded", "altered_leaf")]
    return proofs.select(*kept, F.sha2(siblings(F.col("way")), 256).alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))

"""Connected components of raster masks.

Runs of foreground pixels are cut at tile borders and united inside each tile; only components that touch another tile's are contracted further, so
the rounds of joins see tile borders, not pixels or runs.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.lineage import cut, settle
from tideline.operators.skew import salted_join

COL_TILE = 64
#: Rows and columns of the tiles whose runs are united in one task; a tile has at most TILE * TILE / 2 runs.
TILE = 256


def row_runs(mask: DataFrame, keys: Sequence[str], row: str = "row", col: str = "col") -> DataFrame:
    """Foreground pixels to maximal horizontal runs ``(row, c0, c1, node)``.

    One window holds one raster row; repeated pixels count once. ``node`` is unique per key set.
    """
    w = Window.partitionBy(*keys, row).orderBy(col)
    tagged = mask.select(*keys, row, col).withColumn("_g", F.col(col) - F.dense_rank().over(w))
    runs = tagged.groupBy(*keys, row, "_g").agg(F.min(col).alias("c0"), F.max(col).alias("c1"))
    node = F.shiftleft(F.col(row).cast("long"), 32) + F.col("c0").cast("long")
    return runs.drop("_g").withColumn("node", node)


def run_links(runs: DataFrame, keys: Sequence[str], connectivity: int = 8, row: str = "row") -> DataFrame:
    """Pairs of touching runs in adjacent rows, met inside column tiles only."""
    d = 1 if connectivity == 8 else 0
    tiles = lambda lo, hi: F.explode(F.sequence(F.floor(lo / COL_TILE), F.floor(hi / COL_TILE)))
    upper = runs.select(
        *keys, (F.col(row) + 1).alias("_row"), F.col("c0").alias("a0"), F.col("c1").alias("a1"), F.col("node").alias("a")
    ).withColumn("_t", tiles(F.col("a0") - d, F.col("a1") + d))
    lower = runs.select(*keys, F.col(row).alias("_row"), F.col("c0").alias("b0"), F.col("c1").alias("b1"), F.col("node").alias("b"))
    lower = lower.withColumn("_t", tiles(F.col("b0"), F.col("b1")))
    touch = (F.col("b0") <= F.col("a1") + d) & (F.col("b1") >= F.col("a0") - d)
    # the same pair can meet in several tiles: keep the first one both reach
    first = F.col("_t") == F.greatest(F.floor((F.col("a0") - d) / COL_TILE), F.floor(F.col("b0") / COL_TILE))
    return upper.join(lower, [*keys, "_row", "_t"]).filter(touch & first).select(*keys, "a", "b")


def spread_labels(nodes: DataFrame, links: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Smallest node id of each component as ``label``.

    Each round takes the smallest label among neighbours, then replaces a label by its own
    label (pointer jumping), so the number of rounds grows with the logarithm of the
    longest path. The jump is salted: one giant component is one hot label.
    """
    keys = list(keys)
    both = cut(links.unionByName(links.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut(nodes.select(*keys, "node").withColumn("label", F.col("node")))
    while True:
        offered = (
            both.join(labels.select(*keys, F.col("node").alias("b"), "label"), [*keys, "b"])
            .groupBy(*keys, F.col("a").alias("node"))
            .agg(F.min("label").alias("_offer"))
        )
        pulled = labels.join(offered, [*keys, "node"], "left").withColumn(
            "_new", F.least("label", F.coalesce("_offer", "label"))
        )
        # a root that learns a smaller label takes its whole tree along
        roots = pulled.filter(F.col("_new") < F.col("label")).groupBy(*keys, F.col("label").alias("_root")).agg(
            F.min("_new").alias("_hook")
        )
        hooked = salted_join(
            pulled.select(*keys, "node", "label", F.col("label").alias("_root"), "_new"), roots, [*keys, "_root"], "left", spread=["node"]
        ).select(*keys, "node", F.col("label").alias("_old"), F.least("_new", F.coalesce("_hook", "_new")).alias("label"))
        step = cut(hooked)
        jump = step.select(*keys, F.col("node").alias("_at"), F.col("label").alias("_to"))
        out = cut(
            salted_join(step.withColumn("_at", F.col("label")), jump, [*keys, "_at"], "left", spread=["node"]).select(
                *keys, "node", "_old", F.least("label", F.coalesce("_to", "label")).alias("label")
            )
        )
        labels = out.select(*keys, "node", "label")
        if out.filter(F.col("label") != F.col("_old")).isEmpty():
            return settle(labels)


def united(rows: np.ndarray, c0: np.ndarray, c1: np.ndarray, reach: int) -> np.ndarray:
    """For runs sorted by (row, c0), the index of the first run of each one's component; runs of neighbouring rows touch within ``reach`` columns."""
    up = list(range(len(rows)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    r, a, b = rows.tolist(), c0.tolist(), c1.tolist()
    above = 0
    for i in range(len(r)):
        # runs above that end before this one can touch none behind it either
        while above < i and (r[above] < r[i] - 1 or (r[above] == r[i] - 1 and b[above] + reach < a[i])):
            above += 1
        k = above
        while k < i and r[k] == r[i] - 1 and a[k] - reach <= b[i]:
            x, y = root(k), root(i)
            up[max(x, y)] = min(x, y)
            k += 1
    return np.array([root(i) for i in range(len(r))], np.int64)


def tile_labels(mask: DataFrame, keys: Sequence[str], connectivity: int, row: str, col: str) -> DataFrame:
    """Pieces of runs ``(row, c0, c1, node, label)``, cut at tile borders; ``label`` is the smallest node of the piece's component inside its tile."""
    runs, reach = row_runs(mask, keys, row, col), 1 if connectivity == 8 else 0
    cut_at = F.explode(F.sequence(F.floor(F.col("c0") / TILE).cast("int"), F.floor(F.col("c1") / TILE).cast("int")))
    pieces = runs.withColumn("_tc", cut_at).withColumns({"c0": F.greatest(F.col("c0"), F.col("_tc") * TILE), "c1": F.least(F.col("c1"), F.col("_tc") * TILE + TILE - 1)})
    pieces = pieces.select(*keys, F.floor(F.col(row) / TILE).alias("_tr"), "_tc", F.col(row).cast("int").alias("_row"), F.col("c0").cast("int").alias("c0"), F.col("c1").cast("int").alias("c1"))

    def solve(tile: pa.Table) -> pa.Table:
        tile = tile.sort_by([("_row", "ascending"), ("c0", "ascending")])
        r, a, b = (tile[c].to_numpy().astype(np.int64) for c in ("_row", "c0", "c1"))
        node = (r << 32) + a
        return tile.append_column("node", pa.array(node)).append_column("label", pa.array(node[united(r, a, b, reach)]))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return pieces.groupBy(*keys, "_tr", "_tc").applyInArrow(solve, f"{kinds}, node bigint, label bigint")


def border_links(pieces: DataFrame, keys: Sequence[str], connectivity: int) -> DataFrame:
    """Pairs of labels (a, b) of different tiles whose pieces touch."""
    edge = lambda c: (F.pmod(c, F.lit(TILE)) == 0) | (F.pmod(c, F.lit(TILE)) == TILE - 1)
    rim = pieces.filter(edge(F.col("_row")) | edge(F.col("c0")) | edge(F.col("c1"))).withColumn("node", F.col("label"))
    tile = lambda d, s: d.select(*keys, F.col("_row").alias("_r"), F.col("label").alias(s), F.struct("_tr", "_tc").alias(f"_t{s}"), "c0", "c1")
    # in one row: a piece goes on behind the border
    left, right = tile(rim, "a").withColumn("_c", F.col("c1") + 1).drop("c0", "c1"), tile(rim, "b").withColumn("_c", F.col("c0")).drop("c0", "c1")
    along = left.join(right, [*keys, "_r", "_c"]).select(*keys, "a", "b", "_ta", "_tb")
    # in the next row: columns meet in strips, and a pair that meets in several is told by the first
    reach = 1 if connectivity == 8 else 0
    strips = lambda lo, hi: F.explode(F.sequence(F.floor(lo / COL_TILE), F.floor(hi / COL_TILE)))
    upper = tile(rim, "a").select(*keys, (F.col("_r") + 1).alias("_r"), "a", "_ta", F.col("c0").alias("a0"), F.col("c1").alias("a1")).withColumn("_s", strips(F.col("a0") - reach, F.col("a1") + reach))
    lower = tile(rim, "b").select(*keys, "_r", "b", "_tb", F.col("c0").alias("b0"), F.col("c1").alias("b1")).withColumn("_s", strips(F.col("b0"), F.col("b1")))
    touch = (F.col("b0") <= F.col("a1") + reach) & (F.col("b1") >= F.col("a0") - reach)
    down = upper.join(lower, [*keys, "_r", "_s"]).filter(touch).select(*keys, "a", "b", "_ta", "_tb")
    return along.unionByName(down).filter("_ta <> _tb").select(*keys, "a", "b").distinct()


def labelled_runs(mask: DataFrame, keys: Sequence[str], connectivity: int, row: str, col: str) -> DataFrame:
    """Pieces of runs ``(keys, row, c0, c1, node, component)``."""
    pieces = settle(tile_labels(mask, keys, connectivity, row, col))
    links = settle(border_links(pieces, keys, connectivity))
    out = pieces.withColumn("component", F.col("label"))
    if not links.isEmpty():
        met = links.select(*keys, F.col("a").alias("node")).unionByName(links.select(*keys, F.col("b").alias("node"))).distinct()
        whole = spread_labels(met, links, keys).select(*keys, F.col("node").alias("label"), F.col("label").alias("_whole"))
        out = salted_join(pieces, whole, [*keys, "label"], "left", spread=["node"]).withColumn("component", F.coalesce("_whole", "label"))
    return out.select(*keys, F.col("_row").alias(row), "c0", "c1", "node", "component")


def components(mask: DataFrame, keys: Sequence[str], connectivity: int = 8, row: str = "row", col: str = "col") -> DataFrame:
    """Foreground pixels with the ``component`` they belong to.

    The id is ``row << 32 | col`` of the first run in raster order, so ids sort the way a
    raster scan meets the components.
    """
    keys = list(keys)
    return labelled_runs(mask, keys, connectivity, row, col).select(*keys, row, F.explode(F.sequence("c0", "c1")).alias(col), "component")


def component_sizes(mask: DataFrame, keys: Sequence[str], connectivity: int = 8, row: str = "row", col: str = "col") -> DataFrame:
    """Pieces of runs with their component and its size in pixels: sized before they are expanded."""
    keys = list(keys)
    named = settle(labelled_runs(mask, keys, connectivity, row, col))
    sizes = named.groupBy(*keys, "component").agg(F.sum(F.col("c1") - F.col("c0") + 1).alias("size"))
    return salted_join(named, sizes, [*keys, "component"], spread=["node"])


def remove_small(mask: DataFrame, keys: Sequence[str], min_size: int, connectivity: int = 8) -> DataFrame:
    """Foreground pixels of components with at least ``min_size`` pixels."""
    kept = component_sizes(mask, keys, connectivity).filter(F.col("size") >= max(1, int(min_size)))
    return kept.select(*keys, "row", F.explode(F.sequence("c0", "c1")).alias("col"))


def keep_largest(mask: DataFrame, keys: Sequence[str], connectivity: int = 4) -> DataFrame:
    """Foreground pixels of the largest component, the first in raster order on ties."""
    sized = cut(component_sizes(mask, keys, connectivity))
    best = sized.groupBy(*keys).agg(F.max_by("component", F.struct("size", -F.col("component"))).alias("component"))
    kept = salted_join(sized, best, [*keys, "component"], spread=["node"])
    return kept.select(*keys, "row", F.explode(F.sequence("c0", "c1")).alias("col"))

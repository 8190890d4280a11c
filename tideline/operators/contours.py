"""Iso-lines of an index raster: cell segments, stitching and choice of lines."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.lineage import cut, settle
from tideline.operators import geometry
from tideline.operators.skew import salted_join, tile_halo

#: Rows and columns of the tiles whose vertices are chained in one task; a tile has two vertices a pixel at most.
TILE = 256


def corners(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """2x2 cells with the four corner values ``ul, ur, ll, lr``; cells with a gap vanish.

    The column neighbour is met inside one raster row, the row neighbour inside row tiles.
    """
    v = df.filter(F.col(value).isNotNull())
    wr = Window.partitionBy(*keys, "row").orderBy("col")
    right = v.withColumn("_nc", F.lead("col").over(wr)).withColumn("_r", F.lead(value).over(wr))
    right = right.filter(F.col("_nc") == F.col("col") + 1)
    tiles = tile_halo(right, "row", 0, 1)
    wc = Window.partitionBy(*keys, "_tile", "col").orderBy("row")
    cells = tiles.withColumn("_nr", F.lead("row").over(wc)).withColumn("_d", F.lead(F.struct(value, "_r")).over(wc))
    return cells.filter(F.col("_home") & (F.col("_nr") == F.col("row") + 1)).select(
        *[c for c in df.columns if c != value],
        F.col(value).alias("ul"),
        F.col("_r").alias("ur"),
        F.col(f"_d.{value}").alias("ll"),
        F.col("_d._r").alias("lr"),
    )


# For each of the 16 corner patterns (bits ul=1, ur=2, ll=4, lr=8 set where the
# corner is above the level) the directed cell-edge pairs, low side on the left; saddles keep
# the high corners apart. T, R, B, L name the cell's edges.
CELL_EDGES = {
    1: ["TL"], 2: ["RT"], 3: ["RL"], 4: ["LB"], 5: ["TB"], 6: ["RT", "LB"], 7: ["RB"],
    8: ["BR"], 9: ["TL", "BR"], 10: ["BT"], 11: ["BL"], 12: ["LR"], 13: ["TR"], 14: ["LT"],
}


def iso_segments(df: DataFrame, keys: Sequence[str], value: str, level: Column) -> DataFrame:
    """Directed iso-line segments of the cells, with linear crossing points.

    Returns ``keys, a, b`` (ids of the crossed cell edges) and ``r0, c0, r1, c1`` in pixel
    coordinates. An interior edge is the end of one segment and the start of another.
    """
    cells = corners(df.withColumn("_level", level), keys, value)
    lv = F.col("_level")
    bit = lambda c, b: F.when(F.col(c) > lv, b).otherwise(0)
    case = bit("ul", 1) + bit("ur", 2) + bit("ll", 4) + bit("lr", 8)
    r, c = F.col("row").cast("long"), F.col("col").cast("long")

    def share(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(lv - F.col(a), F.col(b) - F.col(a)), F.lit(0.0))

    # horizontal edges start at a pixel and run right (even id), vertical ones run down (odd id)
    eid = lambda rr, cc, odd: (F.shiftleft(rr, 32) + cc) * 2 + odd
    edge = lambda i, rr, cc: F.struct(i.alias("id"), rr.cast("double").alias("r"), cc.cast("double").alias("c"))
    at = {
        "T": edge(eid(r, c, 0), r, c + share("ul", "ur")),
        "B": edge(eid(r + 1, c, 0), r + 1, c + share("ll", "lr")),
        "L": edge(eid(r, c, 1), r + share("ul", "ll"), c),
        "R": edge(eid(r, c + 1, 1), r + share("ur", "lr"), c + 1),
    }
    pieces = None
    for k, pairs in CELL_EDGES.items():
        arr = F.array(*[F.struct(at[p[0]].alias("p"), at[p[1]].alias("q")) for p in pairs])
        pieces = F.when(F.col("_case") == k, arr) if pieces is None else pieces.when(F.col("_case") == k, arr)
    out = cells.withColumn("_case", case).filter(~F.col("_case").isin(0, 15)).withColumn("_s", F.explode(pieces))
    return out.select(
        *keys,
        F.col("_s.p.id").alias("a"), F.col("_s.q.id").alias("b"),
        F.col("_s.p.r").alias("r0"), F.col("_s.p.c").alias("c0"),
        F.col("_s.q.r").alias("r1"), F.col("_s.q.c").alias("c1"),
    )


def stitch(segs: DataFrame, keys: Sequence[str], min_vertices: int = 3) -> DataFrame:
    """Directed segments to contours: ``contour, seq, row, col, closed``.

    A closed contour starts and ends at the same vertex. Contours with fewer than
    ``min_vertices`` vertices are dropped. Vertices are chained inside tiles; only the pieces of
    contours that leave their tile are ranked by pointer doubling.
    """
    keys = list(keys)
    segs = cut(segs)
    starts = segs.select(*keys, F.col("a").alias("node"), F.col("b").alias("next"), F.col("r0").alias("row"), F.col("c0").alias("col"))
    ends = segs.select(*keys, F.col("b").alias("node"), F.lit(None).cast("long").alias("next"), F.col("r1").alias("row"), F.col("c1").alias("col"))
    nodes = starts.unionByName(ends).groupBy(*keys, "node").agg(F.max("next").alias("next"), F.max("row").alias("row"), F.max("col").alias("col"))
    placed = _placed(settle(tile_chains(nodes, keys)), keys)
    seq = F.col("seq").cast("long")
    again = F.when(F.col("closed") & (F.col("seq") == 0), F.array(seq, F.col("n_vertices") - 1)).otherwise(F.array(seq))
    rows = placed.withColumn("n_vertices", F.col("n_vertices") + F.col("closed").cast("int")).filter(F.col("n_vertices") >= min_vertices)
    return settle(rows.select(*keys, "contour", F.explode(again).alias("seq"), "row", "col", "closed", "n_vertices"))


def chained(node: np.ndarray, following: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the vertices of a tile in ascending order: index of the first vertex of each one's piece, place in the piece, and whether the piece is a ring.

    ``following`` is the index of the next vertex, -1 where it lies elsewhere or nowhere. A ring starts at its smallest vertex.
    """
    n, to = len(node), following.tolist()
    piece, place, ring = [-1] * n, [0] * n, [False] * n
    led = np.zeros(n, bool)
    led[following[following >= 0]] = True

    def walk(first: int, closed: bool) -> None:
        i, k = first, 0
        while i >= 0 and piece[i] < 0:
            piece[i], place[i], ring[i] = first, k, closed
            i, k = to[i], k + 1

    for i in np.flatnonzero(~led).tolist():
        walk(i, False)
    for i in range(n):
        if piece[i] < 0:
            walk(i, True)
    return np.array(piece, np.int64), np.array(place, np.int64), np.array(ring, bool)


def tile_chains(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Vertices with the piece of a contour they make inside their tile.

    ``piece`` is the piece's first vertex, ``place`` counts from it; ``size``, ``exit`` (the vertex in another tile that follows), ``low`` and ``low_place`` (the
    smallest vertex) and ``ring`` are the piece's.
    """
    pixel = F.shiftright("node", 1)
    tiled = nodes.withColumn("_tr", F.floor(F.shiftright(pixel, 32) / TILE)).withColumn("_tc", F.floor(pixel.bitwiseAND(F.lit(0xFFFFFFFF)) / TILE))

    def solve(tile: pa.Table) -> pa.Table:
        tile = tile.sort_by("node")
        node, follows = tile["node"].to_numpy(), tile["next"].fill_null(-1).to_numpy()
        at = np.minimum(np.searchsorted(node, follows), len(node) - 1)
        inside = node[at] == follows
        piece, place, ring = chained(node, np.where(inside, at, -1))
        size = np.bincount(piece, minlength=len(node))
        leaves = np.full(len(node), -1, np.int64)
        out = (follows >= 0) & ~inside
        leaves[piece[out]] = follows[out]
        # vertices are sorted, so the first one met of a piece is its smallest
        _, lowest = np.unique(piece, return_index=True)
        low = np.zeros(len(node), np.int64)
        low[piece[lowest]] = lowest
        exits = pa.array(leaves[piece], mask=leaves[piece] < 0)
        more = {"piece": node[piece], "place": place, "size": size[piece].astype(np.int64), "exit": exits, "low": node[low[piece]], "low_place": place[low[piece]], "ring": ring}
        tile = tile.drop_columns(["next", "_tr", "_tc"])
        for name, values in more.items():
            tile = tile.append_column(name, pa.array(values))
        return tile

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tiled.schema.fields if f.name not in ("next", "_tr", "_tc"))
    return tiled.groupBy(*keys, "_tr", "_tc").applyInArrow(solve, f"{kept}, piece bigint, place bigint, size bigint, exit bigint, low bigint, low_place bigint, ring boolean")


def _placed(chains: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``contour``, ``seq``, ``closed`` and ``n_vertices`` of each vertex: open contours count from their head, rings from their smallest vertex."""
    first = chains.filter("place = 0").select(*keys, F.col("piece").alias("node"), F.col("exit").alias("next"), "size", "low", "low_place")
    leaving = first.filter("next IS NOT NULL")
    own = ["node", "row", "col"]
    if leaving.isEmpty():
        return chains.select(*keys, *own, F.col("piece").alias("contour"), F.col("place").alias("seq"), F.col("ring").alias("closed"), F.col("size").alias("n_vertices"))
    heads = first.select(*keys, F.col("node").alias("next"), F.lit(True).alias("_there"))
    met = leaving.select(*keys, "node").unionByName(leaving.select(*keys, F.col("next").alias("node"))).distinct()
    links = first.join(met, [*keys, "node"], "left_semi").join(heads, [*keys, "next"], "left")
    links = cut(links.select(*keys, "node", F.when(F.col("_there"), F.col("next")).alias("next"), "size", "low", "low_place"))
    ranked = _rank(links, keys).withColumnRenamed("node", "piece")
    rows = salted_join(chains, ranked, [*keys, "piece"], "left", spread=["node"])
    turned = F.pmod(F.col("_base") + F.col("place") - F.col("_turn"), F.col("_total"))
    linked = F.col("_total").isNotNull()
    return rows.select(
        *keys, *own, F.when(linked, F.col("contour")).otherwise(F.col("piece")).alias("contour"),
        F.when(linked & F.col("closed"), turned).when(linked, F.col("_base") + F.col("place")).otherwise(F.col("place")).alias("seq"),
        F.coalesce("closed", "ring").alias("closed"), F.coalesce("_total", "size").alias("n_vertices"),
    )


def _rank(links: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per linked piece: ``contour``, vertices before it (``_base``), those of the contour (``_total``), where a ring begins in its first piece (``_turn``), ``closed``."""
    # heads are never pointed at; everything reachable from one lies on an open chain
    rings = _ring_lows(links.select(*keys, "node", "next", "low"), keys)
    opened = links.join(rings, [*keys, "node"], "left")
    # cut each ring before the piece that holds its smallest vertex
    begins = F.coalesce(F.col("ring") == F.col("low"), F.lit(False))
    begin = opened.filter(begins).select(*keys, F.col("node").alias("next"), F.lit(True).alias("_begin"))
    chains = opened.join(begin, [*keys, "next"], "left")
    chains = cut(chains.select(*keys, "node", F.when(F.col("_begin").isNull(), F.col("next")).alias("next"), "size", "ring", "low_place"))
    far = _double(chains.select(*keys, "node", "next", "size"), keys).join(chains.select(*keys, "node", "size", "ring", "low_place"), [*keys, "node"])
    ends = far.groupBy(*keys, "tail").agg(
        F.max("hops").alias("_len"), F.max_by(F.struct("node", "low_place"), "hops").alias("_head"), F.max(F.when(F.col("hops") == 0, F.col("size"))).alias("_last")
    )
    return salted_join(far, ends, [*keys, "tail"], spread=["node"]).select(
        *keys, "node", F.coalesce("ring", "_head.node").alias("contour"), (F.col("_len") - F.col("hops")).alias("_base"), (F.col("_len") + F.col("_last")).alias("_total"),
        F.col("_head.low_place").alias("_turn"), F.col("ring").isNotNull().alias("closed"),
    )


def _double(links: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tail and hops (vertices) to it for every piece of open chains."""
    state = cut(
        links.select(
            *keys, "node", F.coalesce("next", "node").alias("to"), F.when(F.col("next").isNull(), 0).otherwise(F.col("size")).cast("long").alias("hops")
        )
    )
    while True:
        ahead = state.select(*keys, F.col("node").alias("to"), F.col("to").alias("_to"), F.col("hops").alias("_hops"))
        # many nodes may already point at one tail, so the lookup is salted
        step = cut(
            salted_join(state, ahead, [*keys, "to"], spread=["node"]).select(
                *keys, "node", F.col("_to").alias("to"), (F.col("hops") + F.col("_hops")).alias("hops"), (F.col("_hops") > 0).alias("_on")
            )
        )
        state = step.drop("_on")
        if step.filter("_on").isEmpty():
            return settle(state.withColumnRenamed("to", "tail"))


def _ring_lows(links: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pieces on rings with the smallest vertex of their ring.

    Doubling with the smallest vertex seen so far (``low`` at first). Chains drop out once their pointer runs
    off the end; on a ring the minimum stands still only when it is the ring's minimum.
    """
    state = cut(
        links.filter(F.col("next").isNotNull()).select(*keys, "node", F.col("next").alias("to"), F.col("low").alias("ring"))
    )
    before = state.count()
    while True:
        ahead = state.select(*keys, F.col("node").alias("to"), F.col("to").alias("_to"), F.col("ring").alias("_ring"))
        # inner join: a pointer that ran off its chain finds no partner
        step = cut(
            state.join(ahead, [*keys, "to"]).select(
                *keys, "node", F.col("_to").alias("to"), F.least("ring", "_ring").alias("ring"), (F.col("_ring") < F.col("ring")).alias("_moved")
            )
        )
        after = step.count()
        state = step.drop("_moved")
        if before == after and step.filter("_moved").isEmpty():
            return settle(state.select(*keys, "node", "ring"))
        before = after


def contour_lines(contours: DataFrame, scenes: DataFrame, keys: Sequence[str], min_length: Column | float = 0.0) -> DataFrame:
    """Pixel contours to world vertex rows ``contour, seq, x, y, length``; short lines dropped."""
    geo_cols = ["gt_a", "gt_c", "gt_e", "gt_f"]
    world = (
        salted_join(contours, scenes.select(*keys, *geo_cols), keys, spread=["contour", "seq"])
        .withColumn("x", F.col("gt_a") * (F.col("col") + 0.5) + F.col("gt_c"))
        .withColumn("y", F.col("gt_e") * (F.col("row") + 0.5) + F.col("gt_f"))
        .drop(*geo_cols)
    )
    world = cut(world)
    lengths = geometry.line_lengths(world.select(*keys, "contour", "seq", "x", "y"), [*keys, "contour"]).drop("n_vertices")
    limit = min_length if isinstance(min_length, Column) else F.lit(float(min_length))
    return salted_join(world, lengths.filter(F.col("length") >= limit), [*keys, "contour"], spread=["seq"])


def primary_line(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Vertices of the longest contour per key, the smallest contour id on ties."""
    best = (
        lines.groupBy(*keys, "contour").agg(F.max("length").alias("_l"))
        .groupBy(*keys).agg(F.max_by("contour", F.struct("_l", -F.col("contour"))).alias("contour"))
    )
    return salted_join(lines, best, [*keys, "contour"], spread=["seq"])

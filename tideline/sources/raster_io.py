"""Reading rasters into pixel tables."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.raster import BANDS, null_nan

BLOCK_ROWS = 64


def read_pixels(spark: SparkSession, path: str, bands: Sequence[str] = BANDS, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Pixel table from Parquet: the wanted bands and, with ``window`` (row0, col0, row1, col1),
    the rows and columns inside it. Both reach the scan as column pruning and pushed filters.
    """
    df = spark.read.parquet(path)
    keep = [c for c in df.columns if c not in BANDS or c in bands]
    df = df.select(*keep)
    if window is not None:
        r0, c0, r1, c1 = window
        df = df.filter((F.col("row") >= r0) & (F.col("row") < r1) & (F.col("col") >= c0) & (F.col("col") < c1))
    return null_nan(df, [b for b in bands if b in keep])


def explode_tiles(tiles: DataFrame, bands: Sequence[str] = BANDS) -> DataFrame:
    """Tiles with one array per band (``row_off, col_off, tile_width``) to pixel rows."""
    zipped = F.arrays_zip(*[F.col(b) for b in bands])
    rest = [c for c in tiles.columns if c not in {*bands, "row_off", "col_off", "tile_width"}]
    out = tiles.select(*rest, "row_off", "col_off", "tile_width", F.posexplode(zipped).alias("_i", "_p"))
    return null_nan(
        out.select(
            *rest, (F.col("row_off") + F.floor(F.col("_i") / F.col("tile_width"))).cast("int").alias("row"),
            (F.col("col_off") + F.col("_i") % F.col("tile_width")).cast("int").alias("col"), *[F.col(f"_p.{b}").cast("double").alias(b) for b in bands],
        ),
        bands,
    )


def _pixels_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            array = np.load(io.BytesIO(content), allow_pickle=False)
            if array.ndim == 2:
                array = array[:, :, None]
            if array.ndim != 3:
                raise ValueError(f"{path}: an array of {array.ndim} dimensions is no raster")
            height, width, depth = array.shape
            for top in range(0, height, BLOCK_ROWS):
                block = array[top : top + BLOCK_ROWS].astype("float64")
                rows, cols = np.divmod(np.arange(block.shape[0] * width), width)
                flat = block.reshape(-1, depth)
                yield pd.DataFrame({"path": path, "height": height, "width": width, "row": (rows + top).astype("int32"), "col": cols.astype("int32"), "values": list(flat)})


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """``.npy`` files (H×W or H×W×bands): ``path, height, width, row, col, values``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content")
    return files.mapInPandas(_pixels_of, "path string, height int, width int, row int, col int, values array<double>")


def read_scene_arrays(spark: SparkSession, path: str, bands: Sequence[str] = BANDS) -> DataFrame:
    """``.npy`` scenes with one layer per band as a pixel table; the file name is the scene id."""
    d = read_arrays(spark, path)
    scene = F.regexp_extract("path", r"([^/]+)\.npy$", 1)
    return null_nan(d.select(scene.alias("scene_id"), "row", "col", "height", "width", *[F.get("values", F.lit(i)).alias(b) for i, b in enumerate(bands)]), bands)


def read_index_arrays(spark: SparkSession, path: str, transects: DataFrame | None = None) -> DataFrame:
    """Index arrays with bounds: those of all transects padded by a tenth of the larger span,
    or the ±1 box. The transects reduce to one row of bounds.
    """
    d = read_arrays(spark, path).withColumn("value", F.get("values", F.lit(0))).drop("values")
    d = null_nan(d, ["value"])
    if transects is None or transects.isEmpty():
        west, east, south, north = -1.0, 1.0, -1.0, 1.0
    else:
        b = transects.agg(
            F.min(F.least("x0", "x1")), F.max(F.greatest("x0", "x1")), F.min(F.least("y0", "y1")), F.max(F.greatest("y0", "y1"))
        ).first()
        pad = max(b[1] - b[0], b[3] - b[2]) * 0.1
        west, east, south, north = b[0] - pad, b[1] + pad, b[2] - pad, b[3] + pad
    return d.withColumns({"west": F.lit(west), "east": F.lit(east), "south": F.lit(south), "north": F.lit(north)})

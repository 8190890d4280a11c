"""The driver's tables seen as coastal tables; every proxy uses the whole table.

Each function has a SQL twin of the same name in capitals (a CTE body).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# events as an observation series: user = transect, value = VE, props.k = WL
def obs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        (F.col("user_id") % 10).alias("aoi_id"),
        F.col("user_id").alias("transect_index"),
        F.col("event_id").alias("scene_id"),
        F.col("ts").cast("timestamp").alias("datetime"),
        F.col("event_type").alias("kind"),
        F.col("value").alias("ve"),
        F.get_json_object("props", "$.k").cast("double").alias("wl"),
    )


OBS = """obs AS (SELECT user_id % 10 AS aoi_id, user_id AS transect_index, event_id AS scene_id, ts AS datetime,
  event_type AS kind, value AS ve, CAST(json_extract(props, '$.k') AS DOUBLE) AS wl FROM events)"""


# embeddings as rasters: 100 vectors make a scene of 20 x 64 pixels in 5 bands; values under
# -0.3 are masked, others are |v| + 0.01
def pixels(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("col", "v"))
    v = F.col("v").cast("double")
    band = lambda i: F.max(F.when((F.col("vec_id") % 5 == i) & (v >= -0.3), F.abs(v) + 0.01))
    scene = F.floor(F.col("vec_id") / 100)
    return (
        e.groupBy(scene.alias("scene_id"), (F.floor(F.col("vec_id") / 5) % 20).cast("int").alias("row"), "col")
        .agg(*[band(i).alias(b) for i, b in enumerate(["b02", "b03", "b04", "b08", "b11"])])
        .select((F.col("scene_id") % 2).alias("aoi_id"), "scene_id", "row", "col", "b02", "b03", "b04", "b08", "b11",
                F.lit(20).alias("height"), F.lit(64).alias("width"))
    )


PIXELS = """raw AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS col FROM embeddings),
pixels AS (SELECT (vec_id // 100) % 2 AS aoi_id, vec_id // 100 AS scene_id, (vec_id // 5) % 20 AS row, col,
  max(CASE WHEN vec_id % 5 = 0 AND v >= -0.3 THEN abs(v) + 0.01 END) AS b02,
  max(CASE WHEN vec_id % 5 = 1 AND v >= -0.3 THEN abs(v) + 0.01 END) AS b03,
  max(CASE WHEN vec_id % 5 = 2 AND v >= -0.3 THEN abs(v) + 0.01 END) AS b04,
  max(CASE WHEN vec_id % 5 = 3 AND v >= -0.3 THEN abs(v) + 0.01 END) AS b08,
  max(CASE WHEN vec_id % 5 = 4 AND v >= -0.3 THEN abs(v) + 0.01 END) AS b11
  FROM raw GROUP BY ALL)"""

MASK_SQL = "(b02 IS NULL OR b03 IS NULL OR b04 IS NULL OR b08 IS NULL OR b11 IS NULL)"


def nd_sql(a: str, b: str) -> str:
    return f"(CASE WHEN ({a} + {b}) <> 0 THEN ({a} - {b}) / ({a} + {b}) END)"


# orders as a scene catalog
def scenes(spark: SparkSession, sf: str) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    cloud = (F.floor("o_totalprice") % 128).cast("double")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("c_nationkey").cast("bigint").alias("aoi_id"),
        F.col("o_orderkey").alias("scene_id"),
        F.col("o_orderdate").cast("timestamp").alias("datetime"),
        F.when(cloud <= 100, cloud).alias("cloud_pct"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("collection"),
        F.col("o_totalprice").alias("price"),
    )


SCENES = """scenes AS (SELECT CAST(c_nationkey AS BIGINT) AS aoi_id, o_orderkey AS scene_id, o_orderdate AS datetime,
  CASE WHEN CAST(floor(o_totalprice) AS BIGINT) % 128 <= 100 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) % 128 AS DOUBLE) END AS cloud_pct,
  o_orderstatus AS status, o_orderpriority AS collection, o_totalprice AS price
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


# a customer's orders by date as a line: 10 m per day along x, price in thousands as y
SEQ_SHIFT = 40
LINE_CHUNK_DAYS = 512


def vertices(spark: SparkSession, sf: str) -> DataFrame:
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))
    return table(spark, sf, "orders").select(
        (F.col("o_custkey") % 10).alias("aoi_id"),
        F.col("o_custkey").alias("line_id"),
        (F.shiftleft(day.cast("long"), SEQ_SHIFT) + F.col("o_orderkey")).alias("seq"),
        (day * 10.0 + F.col("o_orderkey") % 10).alias("x"),
        (F.col("o_totalprice") / 1000.0).alias("y"),
    )


def vertex_chunk():
    return F.floor(F.shiftright("seq", SEQ_SHIFT) / LINE_CHUNK_DAYS)


VERTICES = """vertices AS (SELECT o_custkey % 10 AS aoi_id, o_custkey AS line_id,
  (date_diff('day', TIMESTAMP '1995-01-01', o_orderdate)::BIGINT << 40) + o_orderkey AS seq,
  date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) * 10.0::DOUBLE + o_orderkey % 10 AS x, o_totalprice / 1000.0::DOUBLE AS y FROM orders)"""

MEASURED = VERTICES + """,
stepped AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS d FROM vertices
  WINDOW w AS (PARTITION BY line_id ORDER BY seq)),
cums AS (SELECT *, sum(d) OVER (PARTITION BY line_id ORDER BY seq) AS cum FROM stepped),
segs0 AS (SELECT aoi_id, line_id, seq, x AS x0, y AS y0, cum AS cum0, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(cum) OVER w AS cum1
  FROM cums WINDOW w AS (PARTITION BY line_id ORDER BY seq)),
segs1 AS (SELECT * FROM segs0 WHERE cum1 > cum0),
segs AS (SELECT *, max(cum1) OVER (PARTITION BY line_id) AS total FROM segs1)"""

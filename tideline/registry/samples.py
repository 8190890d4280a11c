"""Irregular monthly series and line shapes."""

from pyspark.sql import functions as F

from tideline.functions import geo
from tideline.operators import geometry, samples
from tideline.registry import proxies as p
from tideline.registry import query, r6, s6
from tideline.registry.geometry import KEYS

# a customer's orders by month are the observations of one area
SERIES = """obs AS (SELECT DISTINCT o_custkey AS aoi_id, year(o_orderdate) * 12 + month(o_orderdate) AS m FROM orders), ser AS (SELECT * FROM obs QUALIFY count(*) OVER (PARTITION BY aoi_id) >= 3)"""


def series(spark, sf):
    o = p.table(spark, sf, "orders").select(F.col("o_custkey").alias("aoi_id"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("month_idx"))
    return samples.load_series(o)


HIST = SERIES + """, h AS (SELECT aoi_id, m, count(*) OVER w AS n, first(m) OVER w AS oldest, sum(m) OVER w AS total FROM ser WINDOW w AS (PARTITION BY aoi_id ORDER BY m ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))"""


@query("history_windows", f"WITH {HIST} SELECT aoi_id, m AS ref_month, n AS n_real, 6 - n AS n_pad, CASE WHEN n < 6 THEN 999 ELSE m - oldest END AS first_offset, m - oldest AS oldest_offset, CAST(n * m - total AS BIGINT) AS offset_sum FROM h WHERE n >= 2")
def history_windows(spark, sf):
    h = samples.irregular_history(series(spark, sf), 6, 2)
    real = F.filter("offsets", lambda o: o != samples.PAD_OFFSET)
    return h.select(
        "aoi_id", F.col("month_idx").alias("ref_month"), F.size("history").alias("n_real"), F.size(F.filter("valid", lambda v: ~v)).alias("n_pad"),
        F.col("offsets")[0].alias("first_offset"), real[0].alias("oldest_offset"), F.aggregate(real, F.lit(0), lambda a, b: a + b).alias("offset_sum"),
    )


TARGETS = """hz AS (SELECT unnest([12, 24]) AS horizon), tg AS (SELECT a.aoi_id, a.m AS ref_month, horizon, arg_min(b.m, (abs(b.m - a.m - horizon), b.m)) AS target_month FROM ser a, hz JOIN ser b ON b.aoi_id = a.aoi_id AND b.m > a.m AND abs(b.m - a.m - horizon) <= 2 GROUP BY ALL)"""


@query("matched_targets", f"WITH {SERIES}, {TARGETS} SELECT * FROM tg")
def matched_targets(spark, sf):
    return samples.match_targets(series(spark, sf), [12, 24], 2)


@query("forecast_samples", f"""WITH {HIST}, {TARGETS}, mm AS (SELECT DISTINCT m FROM ser), cutoff AS (SELECT m FROM mm QUALIFY row_number() OVER (ORDER BY m) - 1 = greatest(1, CAST(floor(count(*) OVER () * 0.8) AS BIGINT)))
  SELECT tg.aoi_id, ref_month, horizon, target_month, n AS n_real, CASE WHEN target_month >= cutoff.m THEN 'val' ELSE 'train' END AS part FROM tg JOIN h ON h.aoi_id = tg.aoi_id AND h.m = ref_month, cutoff WHERE n >= 2""")
def forecast_samples(spark, sf):
    s = series(spark, sf)
    cutoff = F.lit(samples.temporal_cutoff(s, 0.2))
    train = samples.forecast_samples(s, 6, 2, [12, 24], 2, max_target=cutoff - 1).withColumn("part", F.lit("train"))
    val = samples.forecast_samples(s, 6, 2, [12, 24], 2, min_target=cutoff).withColumn("part", F.lit("val"))
    return train.unionByName(val).select("aoi_id", "ref_month", "horizon", "target_month", F.size("history").alias("n_real"), "part")


@query("area_splits", f"WITH {p.SCENES} SELECT scene_id, CASE WHEN aoi_id IN (3, 4) THEN 'holdout' WHEN aoi_id IN (5, 6) THEN 'val' ELSE 'train' END AS part FROM scenes")
def area_splits(spark, sf):
    return samples.split_by_aoi(p.scenes(spark, sf), ["3", "4"], ["5", "6"]).select("scene_id", "part")


@query("year_splits", f"WITH {p.SCENES} SELECT scene_id, CASE WHEN aoi_id = 3 THEN 'holdout' WHEN year(datetime) >= 2000 THEN 'val' ELSE 'train' END AS part FROM scenes")
def year_splits(spark, sf):
    s = p.scenes(spark, sf).withColumn("year", F.year("datetime"))
    return samples.split_by_year(s, 2000, 0.2, 1, ["scene_id"], ["3"]).select("scene_id", "part")


@query("seeded_splits", f"WITH {p.SCENES}, n AS (SELECT count(*) AS n FROM scenes WHERE aoi_id <> 3) SELECT 'train' AS part, CAST(floor(n * 0.8) AS BIGINT) AS n FROM n UNION ALL SELECT 'val', n - CAST(floor(n * 0.8) AS BIGINT) FROM n UNION ALL SELECT 'holdout', (SELECT count(*) FROM scenes WHERE aoi_id = 3)")
def seeded_splits(spark, sf):
    s = p.scenes(spark, sf).withColumn("year", F.year("datetime"))
    return samples.split_by_year(s, None, 0.2, 1, ["scene_id"], ["3"]).groupBy("part").agg(F.count("*").alias("n"))


@query("inference_history", f"WITH {SERIES}, u AS (SELECT aoi_id, m FROM ser WHERE m <= 23990 UNION SELECT aoi_id, 23995 FROM ser) SELECT aoi_id, m AS month_idx FROM u QUALIFY row_number() OVER (PARTITION BY aoi_id ORDER BY m DESC) <= 4")
def inference_history(spark, sf):
    s = series(spark, sf)
    fresh = s.select("aoi_id", F.lit(23995).alias("month_idx")).distinct()
    return samples.inference_history(s, F.lit(23990), 4, fresh)


# shapes: the orders of each customer and year, resampled to 8 points in the unit box
SHAPES = """vv AS (SELECT *, (seq >> 40) // 365 AS yr FROM vertices), st AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS d FROM vv WINDOW w AS (PARTITION BY line_id, yr ORDER BY seq)),
  cu AS (SELECT *, sum(d) OVER (PARTITION BY line_id, yr ORDER BY seq) AS cum FROM st), sg AS (SELECT line_id, yr, x AS x0, y AS y0, cum AS c0, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(cum) OVER w AS c1 FROM cu WINDOW w AS (PARTITION BY line_id, yr ORDER BY seq)),
  sg1 AS (SELECT *, max(c1) OVER (PARTITION BY line_id, yr) AS total FROM sg WHERE c1 > c0), k AS (SELECT line_id, yr, total, unnest(generate_series(0, 7)) AS seq FROM (SELECT DISTINCT line_id, yr, total FROM sg1)),
  pts AS (SELECT k.line_id, k.yr, k.seq, x0 + (k.seq * (k.total / 7) - c0) / (c1 - c0) * (x1 - x0) AS x, y0 + (k.seq * (k.total / 7) - c0) / (c1 - c0) * (y1 - y0) AS y FROM k JOIN sg1 s ON s.line_id = k.line_id AND s.yr = k.yr AND ((k.seq < 7 AND k.seq * (k.total / 7) >= c0 AND k.seq * (k.total / 7) < c1) OR (k.seq = 7 AND c1 = s.total))),
  shp AS (SELECT line_id AS aoi_id, yr, seq, least(greatest((x - yr * 3650) / 3651.0, 0), 1) AS u, least(greatest(y / 512.0, 0), 1) AS v FROM pts)"""


def shapes(spark, sf):
    v = p.vertices(spark, sf).withColumn("yr", F.floor(F.shiftright("seq", p.SEQ_SHIFT) / 365))
    r = geometry.resample_ordered(v, ["line_id", "yr"], F.lit(8), p.vertex_chunk())
    stamp = F.make_timestamp(F.col("yr") + 1996, F.lit(1), F.lit(31), F.lit(6), F.lit(0), F.lit(0))
    return r.select(F.col("line_id").alias("aoi_id"), "yr", stamp.alias("datetime"), "seq", geo.to_unit(F.col("x") - F.col("yr") * 3650, 0.0, 3651.0).alias("u"), geo.to_unit("y", 0.0, 512.0).alias("v"))


@query("shape_slots", f"""WITH {p.VERTICES}, {SHAPES}, r AS (SELECT DISTINCT aoi_id, yr FROM shp), l AS (SELECT *, row_number() OVER (PARTITION BY aoi_id ORDER BY yr DESC) AS rn, count(*) OVER (PARTITION BY aoi_id) AS n FROM r), t AS (SELECT *, 5 - rn AS s FROM l WHERE rn <= 5),
  sl AS (SELECT aoi_id, yr, unnest(generate_series(CASE WHEN rn = least(n, 5) THEN 0 ELSE s END, s)) AS slot FROM t) SELECT aoi_id, slot, yr, seq, {s6('u')} AS u, {s6('v')} AS v FROM sl JOIN shp USING (aoi_id, yr)""")
def shape_slots(spark, sf):
    return samples.shape_history(shapes(spark, sf), 5).select("aoi_id", "slot", "yr", "seq", r6("u").alias("u"), r6("v").alias("v"))


@query("shape_forecast", f"""WITH {p.VERTICES}, {SHAPES}, r AS (SELECT DISTINCT aoi_id, yr FROM shp), l AS (SELECT *, row_number() OVER (PARTITION BY aoi_id ORDER BY yr DESC) AS rn, count(*) OVER (PARTITION BY aoi_id) AS n, max(yr) OVER (PARTITION BY aoi_id) AS lastyr FROM r), t AS (SELECT *, 5 - rn AS s FROM l WHERE rn <= 5),
  sl AS (SELECT aoi_id, yr, lastyr, unnest(generate_series(CASE WHEN rn = least(n, 5) THEN 0 ELSE s END, s)) AS slot FROM t), h AS (SELECT aoi_id, lastyr, slot, seq, u, v FROM sl JOIN shp USING (aoi_id, yr)),
  one AS (SELECT aoi_id, seq, any_value(lastyr) AS lastyr, least(greatest(sum(u * (0.2 + 3 * (slot - 2) / 10.0)), 0), 1) AS u1, least(greatest(sum(v * (0.2 + 3 * (slot - 2) / 10.0)), 0), 1) AS v1 FROM h GROUP BY ALL),
  two AS (SELECT aoi_id, seq, least(greatest(sum(u * (0.2 + 3 * (slot - 3) / 10.0)) FILTER (slot >= 1) + any_value(u1) * 0.8, 0), 1) AS u2, least(greatest(sum(v * (0.2 + 3 * (slot - 3) / 10.0)) FILTER (slot >= 1) + any_value(v1) * 0.8, 0), 1) AS v2 FROM h JOIN one USING (aoi_id, seq) GROUP BY ALL)
  SELECT aoi_id, seq, 1 AS step, make_timestamp(1996 + lastyr, 1, 31, 6, 0, 0) + INTERVAL 1 MONTH AS datetime, {s6('u1')} AS u, {s6('v1')} AS v FROM one
  UNION ALL SELECT aoi_id, seq, 2, make_timestamp(1996 + lastyr, 1, 31, 6, 0, 0) + INTERVAL 2 MONTH, {s6('u2')}, {s6('v2')} FROM two JOIN one USING (aoi_id, seq)""")
def shape_forecast(spark, sf):
    return samples.shape_forecast(shapes(spark, sf).drop("yr"), 2, 5).select("aoi_id", "seq", "step", "datetime", r6("u").alias("u"), r6("v").alias("v"))

"""Observation series: daily values, windows, splits, forecasts and scores."""

from pyspark.sql import functions as F

from tideline.lineage import settle
from tideline.operators import run_models, selection, series
from tideline.registry import proxies as p
from tideline.registry import query, r3, r6, s3, s6


def _pchip_sql() -> str:
    """Daily PCHIP values of ``obs`` written with window functions and a range join."""
    per = []
    for v in ("ve", "wl"):
        per.append(f"({v}_n - {v}) / h AS m_{v}, ({v} - {v}_p) / hp AS mp_{v}, ({v}_q - {v}_n) / hn AS mn_{v}")
    inner = lambda h0, h1, a, b: f"CASE WHEN {a} * {b} <= 0 THEN 0.0 ELSE (3 * {h0} + 3 * {h1}) / ((2 * {h1} + {h0}) / {a} + ({h1} + 2 * {h0}) / {b}) END"

    def end(h0, h1, a, b):
        d = f"(((2 * {h0} + {h1}) * {a} - {h0} * {b}) / ({h0} + {h1}))"
        return f"CASE WHEN sign({d}) <> sign({a}) THEN 0.0 WHEN sign({a}) <> sign({b}) AND abs({d}) > 3 * abs({a}) THEN 3 * {a} ELSE {d} END"

    tang = []
    for v in ("ve", "wl"):
        m, mp, mn = f"m_{v}", f"mp_{v}", f"mn_{v}"
        tang.append(
            f"CASE WHEN hp IS NOT NULL THEN {inner('hp', 'h', mp, m)} WHEN hn IS NOT NULL THEN {end('h', 'hn', m, mn)} ELSE {m} END AS d0_{v}, "
            f"CASE WHEN hn IS NOT NULL THEN {inner('h', 'hn', m, mn)} WHEN hp IS NOT NULL THEN {end('h', 'hp', m, mp)} ELSE {m} END AS d1_{v}"
        )
    cubic = lambda v: f"{v} + t * (d0_{v} + t * ((3 * m_{v} - 2 * d0_{v} - d1_{v}) / h + t * ((d0_{v} + d1_{v} - 2 * m_{v}) / (h * h))))"
    return f"""{p.OBS},
knots AS (SELECT aoi_id, transect_index, epoch_us(datetime) / 1e6 AS x, avg(ve) AS ve, avg(wl) AS wl FROM obs WHERE ve IS NOT NULL AND wl IS NOT NULL GROUP BY ALL),
near AS (SELECT *, lead(x) OVER w - x AS h, x - lag(x) OVER w AS hp, lead(x, 2) OVER w - lead(x) OVER w AS hn,
  lead(ve) OVER w AS ve_n, lag(ve) OVER w AS ve_p, lead(ve, 2) OVER w AS ve_q, lead(wl) OVER w AS wl_n, lag(wl) OVER w AS wl_p, lead(wl, 2) OVER w AS wl_q
  FROM knots WINDOW w AS (PARTITION BY transect_index ORDER BY x)),
slopes AS (SELECT *, {', '.join(per)} FROM near),
tang AS (SELECT *, {', '.join(tang)} FROM slopes),
span AS (SELECT aoi_id, transect_index, min(x) AS x0, max(x) AS x1, CAST(floor(min(x) / 86400) AS BIGINT) AS a, CAST(floor(max(x) / 86400) AS BIGINT) AS b FROM knots GROUP BY ALL),
days AS (SELECT *, unnest(generate_series(a, b)) AS day FROM span),
probe AS (SELECT *, CASE WHEN day = a AND day * 86400.0 < x0 THEN (day + 1) * 86400.0 ELSE day * 86400.0 END AS q_at FROM days),
hit AS (SELECT probe.aoi_id, probe.transect_index, day, q_at, q_at - tang.x AS t, tang.* EXCLUDE (aoi_id, transect_index) FROM probe
  JOIN tang ON tang.transect_index = probe.transect_index AND q_at >= tang.x AND ((q_at < tang.x + tang.h) OR (q_at = tang.x + tang.h AND tang.x + tang.h = x1))),
daily AS (SELECT aoi_id, transect_index, day, {cubic('ve')} AS ve, {cubic('wl')} AS wl FROM hit)"""


DAILY = _pchip_sql()


def daily(spark, sf):
    return series.daily_series(p.obs(spark, sf))


@query("daily_series", f"WITH {DAILY} SELECT transect_index, day, {s6('ve')} AS ve, {s6('wl')} AS wl FROM daily")
def daily_series(spark, sf):
    return daily(spark, sf).select("transect_index", "day", r6("ve").alias("ve"), r6("wl").alias("wl"))


LAST = """ends AS (SELECT transect_index, aoi_id, max(day) AS last_day FROM daily GROUP BY ALL),
two AS (SELECT e.aoi_id, e.transect_index, e.last_day, l.ve, l.wl, coalesce(l.ve - k.ve, 0) AS sve, coalesce(l.wl - k.wl, 0) AS swl FROM ends e
  JOIN daily l ON l.transect_index = e.transect_index AND l.day = e.last_day LEFT JOIN daily k ON k.transect_index = e.transect_index AND k.day = e.last_day - 1),
steps AS (SELECT *, unnest(generate_series(1, 7)) AS step FROM two)"""


@query("drift_forecast", f"""WITH {DAILY}, {LAST} SELECT transect_index, step, strftime(DATE '1970-01-01' + CAST(last_day + step AS INTEGER), '%Y-%m-%d') AS date,
  {s6('ve + sve * step')} AS future_ve, {s6('wl + swl * step')} AS future_wl FROM steps""")
def drift_forecast(spark, sf):
    f = series.drift_forecast(daily(spark, sf), 7)
    return f.select("transect_index", "step", F.col("date").cast("string").alias("date"), r6("future_ve").alias("future_ve"), r6("future_wl").alias("future_wl"))


@query("persistence_forecast", f"""WITH {DAILY}, {LAST} SELECT transect_index, step, strftime(DATE '1970-01-01' + CAST(last_day + step AS INTEGER), '%Y-%m-%d') AS date,
  {s6('ve')} AS future_ve, {s6('wl')} AS future_wl FROM steps""")
def persistence_forecast(spark, sf):
    f = series.persistence_forecast(daily(spark, sf), 7)
    return f.select("transect_index", "step", F.col("date").cast("string").alias("date"), r6("future_ve").alias("future_ve"), r6("future_wl").alias("future_wl"))


SEQ = """lagged AS (SELECT transect_index, aoi_id, day, ve, wl, count(*) OVER f AS n, list(ve) OVER f AS wve, list(wl) OVER f AS wwl FROM daily
  WINDOW f AS (PARTITION BY transect_index ORDER BY day ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),
seqs AS (SELECT * FROM lagged WHERE n = 10)"""


@query("training_windows", f"""WITH {DAILY}, {SEQ}, flat AS (SELECT transect_index, day, ve, wl, unnest(wve) AS w_ve, unnest(wwl) AS w_wl, generate_subscripts(wve, 1) - 1 AS slot FROM seqs)
  SELECT transect_index, day, slot, {s6('w_ve')} AS w_ve, {s6('w_wl')} AS w_wl, {s6('ve')} AS ve, {s6('wl')} AS wl FROM flat""")
def training_windows(spark, sf):
    s = series.sequences(daily(spark, sf), 10)
    s = s.select("transect_index", "day", "ve", "wl", F.posexplode("window").alias("slot", "w"))
    return s.select("transect_index", "day", "slot", r6("w.ve").alias("w_ve"), r6("w.wl").alias("w_wl"), r6("ve").alias("ve"), r6("wl").alias("wl"))


@query("eligible_transects", f"""WITH {DAILY} SELECT transect_index, min(day) AS first_day, max(day) AS last_day, count(*) AS n_days, count(*) > 29 AS modelled FROM daily GROUP BY 1""")
def eligible_transects(spark, sf):
    return series.eligible(daily(spark, sf), 27).select("transect_index", "first_day", "last_day", "n_days", "modelled")


@query("scaler_statistics", f"""WITH {DAILY}, {SEQ}, flat AS (SELECT unnest(wve) AS a, unnest(wwl) AS b FROM seqs),
  x AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM flat), y AS (SELECT avg(ve) AS ma, stddev_pop(ve) AS sa, avg(wl) AS mb, stddev_pop(wl) AS sb FROM seqs)
  SELECT {s6('x.ma')} AS mean_x_ve, {s6('x.sa')} AS std_x_ve, {s6('x.mb')} AS mean_x_wl, {s6('x.sb')} AS std_x_wl,
  {s6('y.ma')} AS mean_y_ve, {s6('y.sa')} AS std_y_ve, {s6('y.mb')} AS mean_y_wl, {s6('y.sb')} AS std_y_wl FROM x, y""")
def scaler_statistics(spark, sf):
    s = series.fit_scaler(series.sequences(daily(spark, sf), 10))
    return s.select(*[r6(c).alias(c) for c in s.columns])


@query("training_scalers", f"""WITH {DAILY}, {SEQ}, tr AS (SELECT * FROM seqs WHERE day <= 19742), flat AS (SELECT aoi_id, unnest(wve) AS a, unnest(wwl) AS b FROM tr),
  x AS (SELECT aoi_id, avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM flat GROUP BY 1), y AS (SELECT aoi_id, avg(ve) AS ma, stddev_pop(ve) AS sa, avg(wl) AS mb, stddev_pop(wl) AS sb FROM tr GROUP BY 1)
  SELECT aoi_id, {s6('x.ma')} AS mean_x_ve, {s6('x.sa')} AS std_x_ve, {s6('x.mb')} AS mean_x_wl, {s6('x.sb')} AS std_x_wl,
  {s6('y.ma')} AS mean_y_ve, {s6('y.sa')} AS std_y_ve, {s6('y.mb')} AS mean_y_wl, {s6('y.sb')} AS std_y_wl FROM x JOIN y USING (aoi_id)""")
def training_scalers(spark, sf):
    """Per area, over the training part only."""
    s = run_models.run_scaler(series.split(series.sequences(daily(spark, sf), 10), "2024-01-20"), scope="train")
    return s.select("aoi_id", *[r6(c).alias(c) for c in s.columns if c != "aoi_id"])


def _split_sql(part: str) -> str:
    return f"""WITH {DAILY}, {SEQ}, pos AS (SELECT *, row_number() OVER (PARTITION BY aoi_id ORDER BY transect_index, day) - 1 AS rn, count(*) OVER (PARTITION BY aoi_id) AS total,
  count(*) FILTER (day <= 19742) OVER (PARTITION BY aoi_id) AS l, count(*) FILTER (day > 19742) OVER (PARTITION BY aoi_id) AS r FROM seqs),
  parts AS (SELECT *, CASE WHEN {part} THEN 'train' ELSE 'val' END AS part FROM pos)"""


DATE_RULE = "CASE WHEN l > 0 AND r > 0 THEN day <= 19742 ELSE rn < floor(total * 0.8) END"


@query("split_by_date", _split_sql(DATE_RULE) + " SELECT transect_index, day, part FROM parts")
def split_by_date(spark, sf):
    return series.split(series.sequences(daily(spark, sf), 10), "2024-01-20").select("transect_index", "day", "part")


@query("split_by_position", _split_sql("rn < floor(total * 0.8)") + " SELECT transect_index, day, part FROM parts")
def split_by_position(spark, sf):
    return series.split(series.sequences(daily(spark, sf), 10), mode="positional").select("transect_index", "day", "part")


@query("persistence_rmse", _split_sql(DATE_RULE) + f""" SELECT aoi_id, {s6('sqrt(avg(pow(ve - wve[-1], 2)))')} AS rmse_ve_m, {s6('sqrt(avg(pow(wl - wwl[-1], 2)))')} AS rmse_wl_m,
  any_value(t.train) AS train_samples, count(*) AS val_samples FROM parts JOIN (SELECT aoi_id, count(*) AS train FROM parts WHERE part = 'train' GROUP BY 1) t USING (aoi_id) WHERE part = 'val' GROUP BY aoi_id""")
def persistence_rmse(spark, sf):
    s = series.split(series.persistence_validation(series.sequences(daily(spark, sf), 10)), "2024-01-20")
    counts = s.groupBy("aoi_id").agg(F.count_if(F.col("part") == "train").alias("train_samples"), F.count_if(F.col("part") == "val").alias("val_samples"))
    e = series.rmse(s.filter("part = 'val'"), {"rmse_ve_m": ("ve", "pred_ve"), "rmse_wl_m": ("wl", "pred_wl")}, ["aoi_id"])
    return e.join(counts, "aoi_id").select("aoi_id", r6("rmse_ve_m").alias("rmse_ve_m"), r6("rmse_wl_m").alias("rmse_wl_m"), "train_samples", "val_samples")


# with a one-day window a run's model has two inputs, so its least-squares fit has a closed form. One area is too short for any window, one has few samples
SHORT = "NOT (aoi_id = 3 AND datetime >= TIMESTAMP '2024-01-04') AND NOT (aoi_id = 7 AND (transect_index <> 7 OR datetime >= TIMESTAMP '2024-01-12'))"
RUNS = f"""WITH RECURSIVE {DAILY.replace("FROM obs WHERE ve", f"FROM (SELECT * FROM obs WHERE {SHORT}) WHERE ve")},
size AS (SELECT transect_index, aoi_id, count(*) AS n, max(day) AS last_day FROM daily GROUP BY ALL),
lag1 AS (SELECT d.*, lag(ve) OVER w AS pve, lag(wl) OVER w AS pwl FROM daily d JOIN size USING (transect_index) WHERE n > 3 WINDOW w AS (PARTITION BY transect_index ORDER BY day)),
pos AS (SELECT *, row_number() OVER (PARTITION BY aoi_id ORDER BY transect_index, day) - 1 AS rn, count(*) OVER (PARTITION BY aoi_id) AS total,
  count(*) FILTER (day <= 19742) OVER (PARTITION BY aoi_id) AS l, count(*) FILTER (day > 19742) OVER (PARTITION BY aoi_id) AS r FROM lag1 WHERE pve IS NOT NULL),
parts AS (SELECT *, CASE WHEN l > 0 AND r > 0 THEN day <= 19742 ELSE rn < floor(total * 0.8) END AS train FROM pos),
cnt AS (SELECT aoi_id, count(*) FILTER (train) AS train_samples, count(*) FILTER (NOT train) AS val_samples FROM parts GROUP BY 1),
kind AS (SELECT a.aoi_id, coalesce(train_samples, 0) AS train_samples, coalesce(val_samples, 0) AS val_samples,
  CASE WHEN train_samples IS NULL THEN 'drift' WHEN train_samples < 8 OR val_samples < 2 THEN 'persistence' ELSE 'linear_ar' END AS model_type,
  CASE WHEN train_samples IS NULL THEN 'no_sequences' WHEN train_samples < 8 OR val_samples < 2 THEN 'too_few_samples' END AS reason FROM (SELECT DISTINCT aoi_id FROM daily) a LEFT JOIN cnt USING (aoi_id)),
cov AS (SELECT aoi_id, var_pop(pve) AS a, covar_pop(pve, pwl) AS b, var_pop(pwl) AS d, covar_pop(pve, ve) AS e1, covar_pop(pwl, ve) AS f1, covar_pop(pve, wl) AS e2, covar_pop(pwl, wl) AS f2,
  avg(pve) AS mp, avg(pwl) AS mq, avg(ve) AS m1, avg(wl) AS m2 FROM parts WHERE train GROUP BY aoi_id),
coef AS (SELECT *, (d * e1 - b * f1) / (a * d - b * b) AS p1, (a * f1 - b * e1) / (a * d - b * b) AS q1, (d * e2 - b * f2) / (a * d - b * b) AS p2, (a * f2 - b * e2) / (a * d - b * b) AS q2 FROM cov)"""


def _runs(spark, sf):
    o = p.obs(spark, sf)
    at = lambda d: F.lit(f"{d} 00:00:00").cast("timestamp")
    few = ((F.col("aoi_id") == 3) & (F.col("datetime") >= at("2024-01-04"))) | ((F.col("aoi_id") == 7) & ((F.col("transect_index") != 7) | (F.col("datetime") >= at("2024-01-12"))))
    return run_models.forecast_runs(o.filter(~few), 7, 1, "2024-01-20")


@query("area_models", RUNS + f""", err AS (SELECT aoi_id, CASE WHEN model_type = 'linear_ar' THEN ve - (m1 + p1 * (pve - mp) + q1 * (pwl - mq)) ELSE ve - pve END AS dv,
  CASE WHEN model_type = 'linear_ar' THEN wl - (m2 + p2 * (pve - mp) + q2 * (pwl - mq)) ELSE wl - pwl END AS dw FROM parts JOIN kind USING (aoi_id) LEFT JOIN coef USING (aoi_id) WHERE NOT train),
e AS (SELECT aoi_id, sqrt(avg(dv * dv)) AS rv, sqrt(avg(dw * dw)) AS rw FROM err GROUP BY 1)
SELECT aoi_id, model_type, reason, train_samples, val_samples, {s3('rv')} AS rmse_ve_m, {s3('rw')} AS rmse_wl_m FROM kind LEFT JOIN e USING (aoi_id)""")
def area_models(spark, sf):
    """One model per area, one of them too short and one with few samples."""
    m = _runs(spark, sf)[1]
    return m.select("aoi_id", "model_type", "reason", "train_samples", "val_samples", r3("rmse_ve_m").alias("rmse_ve_m"), r3("rmse_wl_m").alias("rmse_wl_m"))


@query("learned_forecast", RUNS + f""", ends AS (SELECT s.aoi_id, s.transect_index, s.last_day, s.n, d.ve, d.wl, coalesce(d.ve - k.ve, 0) AS sv, coalesce(d.wl - k.wl, 0) AS sw, model_type FROM size s JOIN kind USING (aoi_id)
  JOIN daily d ON d.transect_index = s.transect_index AND d.day = s.last_day LEFT JOIN daily k ON k.transect_index = s.transect_index AND k.day = s.last_day - 1 WHERE model_type = 'drift' OR s.n > 3),
roll AS (
  SELECT aoi_id, transect_index, last_day, 0 AS step, ve, wl, sv, sw, model_type FROM ends
  UNION ALL SELECT roll.aoi_id, transect_index, last_day, step + 1,
    CASE model_type WHEN 'drift' THEN ve + sv WHEN 'persistence' THEN ve ELSE m1 + p1 * (ve - mp) + q1 * (wl - mq) END,
    CASE model_type WHEN 'drift' THEN wl + sw WHEN 'persistence' THEN wl ELSE m2 + p2 * (ve - mp) + q2 * (wl - mq) END, sv, sw, model_type
  FROM roll LEFT JOIN coef ON coef.aoi_id = roll.aoi_id WHERE step < 7)
SELECT transect_index, step, strftime(DATE '1970-01-01' + CAST(last_day + step AS INTEGER), '%Y-%m-%d') AS date, {s3('ve')} AS future_ve, {s3('wl')} AS future_wl, model_type FROM roll WHERE step > 0""")
def learned_forecast(spark, sf):
    """Seven days ahead with every area's own model."""
    f = _runs(spark, sf)[0]
    return f.select("transect_index", "step", F.col("date").cast("string").alias("date"), r3("future_ve").alias("future_ve"), r3("future_wl").alias("future_wl"), "model_type")


# with a one-day window the model has two inputs, so its least-squares fit has a closed form
AR1 = f"""WITH {DAILY}, lag1 AS (SELECT transect_index, day, ve, wl, lag(ve) OVER w AS pve, lag(wl) OVER w AS pwl FROM daily WINDOW w AS (PARTITION BY transect_index ORDER BY day)),
fit AS (SELECT * FROM lag1 WHERE pve IS NOT NULL AND day <= 19742),
val AS (SELECT * FROM lag1 WHERE pve IS NOT NULL AND day > 19742),
cov AS (SELECT var_pop(pve) AS a, covar_pop(pve, pwl) AS b, var_pop(pwl) AS d, covar_pop(pve, ve) AS e1, covar_pop(pwl, ve) AS f1, covar_pop(pve, wl) AS e2, covar_pop(pwl, wl) AS f2,
  avg(pve) AS mp, avg(pwl) AS mq, avg(ve) AS m1, avg(wl) AS m2 FROM fit),
coef AS (SELECT *, (d * e1 - b * f1) / (a * d - b * b) AS p1, (a * f1 - b * e1) / (a * d - b * b) AS q1, (d * e2 - b * f2) / (a * d - b * b) AS p2, (a * f2 - b * e2) / (a * d - b * b) AS q2 FROM cov)
SELECT {s3('sqrt(avg(pow(ve - (m1 + p1 * (pve - mp) + q1 * (pwl - mq)), 2)))')} AS rmse_ve_m, {s3('sqrt(avg(pow(wl - (m2 + p2 * (pve - mp) + q2 * (pwl - mq)), 2)))')} AS rmse_wl_m, count(*) AS val_samples FROM val, coef"""


@query("learned_rmse", AR1)
def learned_rmse(spark, sf):
    s = settle(series.split(series.sequences(daily(spark, sf), 1), "2024-01-20"))
    scaler = series.fit_scaler(s).first().asDict()
    scaled = series.scale_sequences(s, scaler)
    model = series.fit_ar(scaled.filter("part = 'train'"), 1)
    pred = series.predict_ar(scaled.filter("part = 'val'"), model, 1)
    for v in ("ve", "wl"):
        pred = pred.withColumn(v, series.unscale(v, scaler, v)).withColumn(f"pred_{v}", series.unscale(f"pred_{v}", scaler, v))
    e = series.rmse(pred, {"rmse_ve_m": ("ve", "pred_ve"), "rmse_wl_m": ("wl", "pred_wl")})
    return e.crossJoin(pred.agg(F.count("*").alias("val_samples"))).select(r3("rmse_ve_m").alias("rmse_ve_m"), r3("rmse_wl_m").alias("rmse_wl_m"), "val_samples")


@query("model_choice", _split_sql(DATE_RULE) + """ SELECT transect_index, count(*) FILTER (part = 'train') AS train_samples, count(*) FILTER (part = 'val') AS val_samples,
  CASE WHEN count(*) FILTER (part = 'train') < 8 OR count(*) FILTER (part = 'val') < 2 THEN 'persistence' ELSE 'linear_ar' END AS model_type,
  CASE WHEN count(*) FILTER (part = 'train') < 8 OR count(*) FILTER (part = 'val') < 2 THEN 'too_few_samples' END AS reason,
  CASE WHEN count(*) FILTER (part = 'train') < 8 OR count(*) FILTER (part = 'val') < 2 THEN 'fallback to persistence' END AS warning FROM parts GROUP BY 1""")
def model_choice(spark, sf):
    s = series.split(series.sequences(daily(spark, sf), 10), "2024-01-20")
    counts = s.groupBy("transect_index").agg(F.count_if(F.col("part") == "train").alias("train_samples"), F.count_if(F.col("part") == "val").alias("val_samples"))
    return series.choose_model(counts)


@query("forecast_summary", f"""WITH {DAILY}, {LAST} SELECT aoi_id, count(*) AS forecast_rows, count(DISTINCT transect_index) AS forecast_transects,
  strftime(DATE '1970-01-01' + CAST(min(last_day + step) AS INTEGER), '%Y-%m-%d') AS first_date, strftime(DATE '1970-01-01' + CAST(max(last_day + step) AS INTEGER), '%Y-%m-%d') AS last_date,
  7 AS forecast_days, round(7 / 365.25, 3) AS forecast_years, 10 AS sequence_len_days, any_value(c.observations) AS observations FROM steps
  JOIN (SELECT aoi_id, count(*) AS observations FROM obs GROUP BY 1) c USING (aoi_id) GROUP BY aoi_id""")
def forecast_summary(spark, sf):
    o = p.obs(spark, sf)
    counts = o.groupBy("aoi_id").agg(F.count("*").alias("observations"))
    out = series.forecast_summary(series.drift_forecast(series.daily_series(o), 7), counts, 7, 10)
    return out.withColumns({c: F.col(c).cast("string") for c in ("first_date", "last_date")})


# transects on a line of 500 m northward, 20 m apart, one per user
@query("forecast_coastline", f"""WITH {DAILY}, {LAST}, pts AS (SELECT aoi_id, transect_index, last_day + step AS day, unnest(['vegetation_edge_forecast', 'waterline_forecast']) AS boundary,
  unnest([ve + sve * step, wl + swl * step]) AS d FROM steps)
  SELECT aoi_id, strftime(DATE '1970-01-01' + CAST(day AS INTEGER), '%Y-%m-%d') AS date, boundary, transect_index, 20.0 * transect_index AS x, {s6('greatest(least(250 + d, 500), 0)')} AS y
  FROM pts QUALIFY count(*) OVER (PARTITION BY aoi_id, day, boundary) >= 2""")
def forecast_coastline(spark, sf):
    o = p.obs(spark, sf)
    t = o.select("aoi_id", "transect_index").distinct().withColumns({
        "x0": F.col("transect_index") * 20.0, "y0": F.lit(0.0), "x1": F.col("transect_index") * 20.0, "y1": F.lit(500.0)
    })
    pts = series.forecast_points(series.drift_forecast(series.daily_series(o), 7), t)
    lines = series.forecast_lines(pts)
    v = lines.select("aoi_id", F.col("date").cast("string").alias("date"), "boundary", F.explode("line").alias("p"))
    return v.select("aoi_id", "date", "boundary", F.round(F.col("p.x") / 20).cast("bigint").alias("transect_index"), "p.x", r6("p.y").alias("y"))


@query("recent_observations", f"""WITH {p.OBS}, o AS (SELECT aoi_id, scene_id, CASE WHEN aoi_id % 3 = 0 THEN datetime - INTERVAL 365 DAY ELSE datetime END AS t FROM obs), e AS (SELECT aoi_id, max(t) AS e FROM o GROUP BY 1)
  SELECT o.aoi_id, scene_id FROM o JOIN e USING (aoi_id) WHERE t >= TIMESTAMP '2024-02-01' - INTERVAL 10 DAY OR e.e < TIMESTAMP '2024-02-01' - INTERVAL 10 DAY""")
def recent_observations(spark, sf):
    # a third of the areas ended a year ago: they have nothing in the lookback and keep everything
    ended = F.when(F.col("aoi_id") % 3 == 0, F.col("datetime") - F.expr("INTERVAL 365 DAYS")).otherwise(F.col("datetime"))
    o = p.obs(spark, sf).withColumn("datetime", ended)
    return selection.lookback(o, 10, now=F.lit("2024-02-01").cast("timestamp")).select("aoi_id", "scene_id")


@query("date_ranks", f"""WITH {p.OBS}, d AS (SELECT DISTINCT aoi_id, CAST(datetime AS DATE) AS date FROM obs), r AS (SELECT *, percent_rank() OVER (PARTITION BY aoi_id ORDER BY date) AS time_rank FROM d)
  SELECT scene_id, {s6('time_rank')} AS time_rank FROM obs JOIN r ON obs.aoi_id = r.aoi_id AND CAST(datetime AS DATE) = r.date""")
def date_ranks(spark, sf):
    o = p.obs(spark, sf).withColumn("date", F.to_date("datetime"))
    return selection.time_rank(o).select("scene_id", r6("time_rank").alias("time_rank"))

"""Scores and batch counts."""

from pyspark.sql import functions as F

from tideline.operators import metrics, raster
from tideline.registry import proxies as p
from tideline.registry import query, r6, s6
from tideline.registry.raster import IDX, indexed

KEYS = ["aoi_id", "scene_id"]
PRED, TRUTH = "coalesce(ndvi >= 0.2, false)", "coalesce(mndwi > 0, false)"
COUNTS = f"{IDX}, cnt AS (SELECT scene_id, count(*) FILTER ({PRED} AND {TRUTH}) AS tp, count(*) FILTER ({PRED} AND NOT {TRUTH}) AS fp, count(*) FILTER (NOT {PRED} AND {TRUTH}) AS fn FROM idx GROUP BY 1)"
IOU = "(tp + 1e-6) / (tp + fp + fn + 1e-6)"
PREC, REC, F1 = "(tp + 1e-6) / (tp + fp + 1e-6)", "(tp + 1e-6) / (tp + fn + 1e-6)", "(2.0 * tp + 1e-6) / (2.0 * tp + fp + fn + 1e-6)"


def counts(spark, sf):
    d = indexed(spark, sf)
    both = metrics.join_masks(d.filter("ndvi >= 0.2"), d.filter("mndwi > 0"), KEYS)
    return metrics.mask_counts(both, F.col("in_pred"), F.col("in_truth"), KEYS)


@query("mask_metrics", f"WITH {COUNTS} SELECT scene_id, tp, fp, fn, {s6(IOU)} AS iou, {s6(PREC)} AS precision, {s6(REC)} AS recall, {s6(F1)} AS f1 FROM cnt")
def mask_metrics(spark, sf):
    m = metrics.sample_metrics(counts(spark, sf))
    return m.select("scene_id", "tp", "fp", "fn", *[r6(c).alias(c) for c in ("iou", "precision", "recall", "f1")])


@query("mean_mask_metrics", f"WITH {COUNTS} SELECT {s6(f'avg({IOU})')} AS iou, {s6(f'avg({PREC})')} AS precision, {s6(f'avg({REC})')} AS recall, {s6(f'avg({F1})')} AS f1 FROM cnt")
def mean_mask_metrics(spark, sf):
    m = metrics.mean_metrics(metrics.sample_metrics(counts(spark, sf)))
    return m.select(*[r6(c).alias(c) for c in m.columns])


@query("label_agreement", f"""WITH cnt AS (SELECT doc_id % 10 AS sample, count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 1 AND toxic <> 1) AS fp, count(*) FILTER (quality <> 1 AND toxic = 1) AS fn FROM labels GROUP BY 1)
  SELECT sample, tp, fp, fn, {s6(F1)} AS f1 FROM cnt""")
def label_agreement(spark, sf):
    d = p.table(spark, sf, "labels").withColumn("sample", F.col("doc_id") % 10)
    m = metrics.sample_metrics(metrics.mask_counts(d, F.col("quality") == 1, F.col("toxic") == 1, ["sample"]))
    return m.select("sample", "tp", "fp", "fn", r6("f1").alias("f1"))


@query("dice_cross_entropy", f"""WITH {IDX}, z AS (SELECT scene_id, ndvi * 4 AS z, ({TRUTH})::INT::DOUBLE AS y FROM idx WHERE ndvi IS NOT NULL),
  l AS (SELECT *, (1 - y) * z + (1 + 2 * y) * (ln(1 + exp(-abs(z))) + greatest(-z, 0)) AS b, 1 / (1 + exp(-z)) AS p FROM z),
  s AS (SELECT scene_id, sum(b) AS b, count(*) AS n, 1 - (2 * sum(p * y) + 1e-6) / (sum(p) + sum(y) + 1e-6) AS dice FROM l GROUP BY 1)
  SELECT {s6('0.5 * sum(b) / sum(n) + 0.5 * avg(dice)')} AS loss, {s6('avg(dice)')} AS dice_loss, {s6('sum(b) / sum(n)')} AS bce_loss FROM s""")
def dice_cross_entropy(spark, sf):
    d = indexed(spark, sf).filter("ndvi IS NOT NULL").withColumn("z", F.col("ndvi") * 4).withColumn("y", F.coalesce(F.col("mndwi") > 0, F.lit(False)).cast("int"))
    out = metrics.dice_bce(d, "z", "y", KEYS, pos_weight=3.0)
    return out.select(*[r6(c).alias(c) for c in out.columns])


@query("metrics_by_horizon", f"WITH {COUNTS}, m AS (SELECT (scene_id % 3 + 1) * 12 AS horizon, {IOU} AS iou FROM cnt) SELECT horizon, {s6('avg(iou)')} AS iou, count(*) AS n FROM m GROUP BY ROLLUP (horizon)")
def metrics_by_horizon(spark, sf):
    m = metrics.sample_metrics(counts(spark, sf)).withColumn("horizon", (F.col("scene_id") % 3 + 1) * 12)
    return metrics.metrics_by_horizon(m).select("horizon", r6("iou").alias("iou"), "n")


@query("horizon_columns", f"WITH {COUNTS}, m AS (SELECT (scene_id % 3 + 1) * 12 AS horizon, {IOU} AS iou FROM cnt) SELECT {s6('avg(iou)')} AS iou, {s6('avg(iou) FILTER (horizon = 12)')} AS iou_1yr, {s6('avg(iou) FILTER (horizon = 24)')} AS iou_2yr FROM m")
def horizon_columns(spark, sf):
    m = metrics.sample_metrics(counts(spark, sf)).withColumn("horizon", (F.col("scene_id") % 3 + 1) * 12)
    h = metrics.horizon_columns(m, [1, 2])
    return h.select(*[r6(c).alias(c) for c in h.columns])


@query("boundary_distances", f"""WITH {IDX}, a AS (SELECT scene_id, row, col FROM idx WHERE ndvi >= 0.75), b AS (SELECT scene_id, row, col FROM idx WHERE mndwi > 0.7),
  da AS (SELECT a.scene_id, a.row, a.col, min(sqrt(pow(a.row - b.row, 2) + pow(a.col - b.col, 2))) AS d FROM a JOIN b USING (scene_id) GROUP BY ALL),
  db AS (SELECT b.scene_id, b.row, b.col, min(sqrt(pow(a.row - b.row, 2) + pow(a.col - b.col, 2))) AS d FROM b JOIN a USING (scene_id) GROUP BY ALL),
  ma AS (SELECT scene_id, avg(d) AS m, quantile_cont(d, 0.95) AS q FROM da GROUP BY 1), mb AS (SELECT scene_id, avg(d) AS m, quantile_cont(d, 0.95) AS q FROM db GROUP BY 1)
  SELECT scene_id, {s6('(ma.m + mb.m) / 2')} AS assd, {s6('greatest(ma.q, mb.q)')} AS hd95 FROM (SELECT scene_id FROM a UNION SELECT scene_id FROM b) s LEFT JOIN (ma JOIN mb USING (scene_id)) USING (scene_id)""")
def boundary_distances(spark, sf):
    d = indexed(spark, sf)
    b = metrics.boundary_metrics(d.filter("ndvi >= 0.75"), d.filter("mndwi > 0.7"), KEYS)
    return b.select("scene_id", r6("assd").alias("assd"), r6("hd95").alias("hd95"))


@query("transect_errors", f"""WITH {IDX}, c AS (SELECT scene_id, col, max(({TRUTH})::INT) AS any_t, arg_min(row, (-({TRUTH})::INT, row)) AS tr, arg_min(row, (-b08, row)) AS pr FROM idx WHERE b08 IS NOT NULL GROUP BY ALL)
  SELECT scene_id, {s6('avg(abs(tr - pr))')} AS transect_mae, {s6('sqrt(avg(pow(tr - pr, 2)))')} AS transect_rmse, count(tr) AS n_columns FROM (SELECT scene_id, CASE WHEN any_t > 0 THEN tr END AS tr, CASE WHEN any_t > 0 THEN pr END AS pr FROM c) GROUP BY 1""")
def transect_errors(spark, sf):
    d = indexed(spark, sf).filter("b08 IS NOT NULL").withColumn("t", F.coalesce(F.col("mndwi") > 0, F.lit(False)))
    e = metrics.transect_error(d, "b08", "t", KEYS)
    return e.select("scene_id", r6("transect_mae").alias("transect_mae"), r6("transect_rmse").alias("transect_rmse"), "n_columns")


# every vector of a label is one ensemble pass over an 8 x 8 mask
ENSEMBLE = """raw AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), smp AS (SELECT label, vec_id, i // 8 AS row, i % 8 AS col, 1 / (1 + exp(-8 * v)) AS prob FROM raw),
  ens AS (SELECT label, row, col, avg(prob) AS central, stddev_pop(prob) AS uncertainty, quantile_cont(prob, 0.1) AS env_low, quantile_cont(prob, 0.9) AS env_high, avg(prob) >= 0.5 AS bin, count(*) AS n_samples FROM smp GROUP BY ALL)"""


def ensemble(spark, sf):
    e = p.table(spark, sf, "embeddings").select("label", "vec_id", F.posexplode("embedding").alias("i", "v"))
    s = e.select("label", F.floor(F.col("i") / 8).alias("row"), (F.col("i") % 8).alias("col"), (1 / (1 + F.exp(-8 * F.col("v").cast("double")))).alias("prob"))
    return metrics.ensemble_summary(s, "prob", ["label"])


@query("ensemble_pixels", f"WITH {ENSEMBLE} SELECT label, row, col, {s6('central')} AS central, {s6('uncertainty')} AS uncertainty, {s6('env_low')} AS env_low, {s6('env_high')} AS env_high, n_samples FROM ens")
def ensemble_pixels(spark, sf):
    return ensemble(spark, sf).select("label", "row", "col", *[r6(c).alias(c) for c in ("central", "uncertainty", "env_low", "env_high")], "n_samples")


@query("ensemble_scenes", f"WITH {ENSEMBLE} SELECT label, {s6('avg(central)')} AS mean_prob, {s6('max(central)')} AS max_prob, {s6('avg(uncertainty)')} AS mean_uncertainty, {s6('max(uncertainty)')} AS max_uncertainty, {s6('avg(bin::INT)')} AS coverage, {s6('avg(env_high - env_low)')} AS envelope_width FROM ens GROUP BY 1")
def ensemble_scenes(spark, sf):
    s = metrics.ensemble_scene(ensemble(spark, sf), ["label"])
    return s.select("label", *[r6(c).alias(c) for c in s.columns[1:]])


@query("line_uncertainty", f"WITH {ENSEMBLE}, b AS (SELECT label, col, arg_min(uncertainty, (-central, row)) AS u FROM ens GROUP BY ALL) SELECT label, {s6('avg(u)')} AS uncertainty_at_line FROM b GROUP BY 1")
def line_uncertainty(spark, sf):
    return metrics.uncertainty_at_line(ensemble(spark, sf), ["label"]).select("label", r6("uncertainty_at_line").alias("uncertainty_at_line"))


@query("ensemble_lines", f"WITH {ENSEMBLE} SELECT label, col, arg_min(row, (-central, row)) AS central_row, arg_min(row, (-env_low, row)) AS low_row, arg_min(row, (-env_high, row)) AS high_row FROM ens GROUP BY ALL")
def ensemble_lines(spark, sf):
    e = ensemble(spark, sf)
    parts = [raster.argmax_line(e, c, ["label"]).withColumnRenamed("row", n) for c, n in (("central", "central_row"), ("env_low", "low_row"), ("env_high", "high_row"))]
    return parts[0].join(parts[1], ["label", "col"]).join(parts[2], ["label", "col"])


@query("training_progress", f"""WITH {p.OBS}, b AS (SELECT transect_index, scene_id, ve, max(ve) OVER w AS best FROM obs WINDOW w AS (PARTITION BY transect_index ORDER BY scene_id)),
  f AS (SELECT b.*, (SELECT min(c.scene_id) FROM b c WHERE c.transect_index = b.transect_index AND c.best = b.best) AS best_step FROM b)
  SELECT transect_index, scene_id, {s6('best')} AS best, best_step, (SELECT count(*) FROM b c WHERE c.transect_index = f.transect_index AND c.scene_id > f.best_step AND c.scene_id <= f.scene_id) AS stale_steps FROM f""")
def training_progress(spark, sf):
    """Events of a user as the epochs of one run, in event order."""
    b = metrics.best_so_far(p.obs(spark, sf).select("transect_index", "scene_id", "ve"), "scene_id", "ve", ["transect_index"])
    return b.select("transect_index", "scene_id", r6("best").alias("best"), "best_step", "stale_steps")


STATUS = "CASE event_type WHEN 'view' THEN 'ok' WHEN 'click' THEN 'skipped' WHEN 'error' THEN 'failed' ELSE 'dry_run' END"


@query("batch_outcomes", f"SELECT user_id % 10 AS aoi_id, count(*) AS total, count(*) FILTER ({STATUS} = 'ok') AS n_ok, count(*) FILTER ({STATUS} = 'skipped') AS n_skipped, count(*) FILTER ({STATUS} = 'failed') AS n_failed, count(*) FILTER ({STATUS} = 'dry_run') AS n_dry_run, count(*) FILTER (value > 100) AS n_warnings FROM events GROUP BY 1")
def batch_outcomes(spark, sf):
    s = F.when(F.col("kind") == "view", "ok").when(F.col("kind") == "click", "skipped").when(F.col("kind") == "error", "failed").otherwise("dry_run")
    return metrics.batch_counts(p.obs(spark, sf).withColumn("status", s).withColumn("warning", F.when(F.col("ve") > 100, "high")), ["aoi_id"])


@query("split_statistics", f"""WITH {p.SCENES}, r AS (SELECT CASE WHEN year(datetime) >= 2000 THEN 'val' ELSE 'train' END AS part, CAST(aoi_id AS VARCHAR) AS a, CAST(year(datetime) AS VARCHAR) AS y FROM scenes)
  SELECT part, 'aoi' AS kind, a AS key, count(*) AS n FROM r GROUP BY ALL UNION ALL SELECT part, 'year', y, count(*) FROM r GROUP BY ALL""")
def split_statistics(spark, sf):
    s = p.scenes(spark, sf).withColumn("year", F.year("datetime"))
    return metrics.split_stats(s.withColumn("part", F.when(F.col("year") >= 2000, "val").otherwise("train")))


@query("file_inventory", """WITH n AS (SELECT collection, count(*) AS n FROM (SELECT o_orderpriority AS collection FROM orders) GROUP BY 1), e AS (SELECT DISTINCT o_orderpriority AS folder FROM orders UNION ALL SELECT DISTINCT 'extra_' || o_orderstatus FROM orders),
  r AS (SELECT folder, coalesce(n, 0) AS n_files, CASE WHEN n IS NULL THEN 'missing_folder' END AS warning FROM e LEFT JOIN n ON n.collection = e.folder)
  SELECT * FROM r UNION ALL SELECT 'TOTAL', CAST(sum(n_files) AS BIGINT), CASE WHEN sum(n_files) < 300 THEN 'few_files' END FROM r""")
def file_inventory(spark, sf):
    o = p.table(spark, sf, "orders")
    files = o.select(F.col("o_orderpriority").alias("folder"))
    expected = files.distinct().unionByName(o.select(F.concat(F.lit("extra_"), "o_orderstatus").alias("folder")).distinct())
    return metrics.dataset_inventory(files, expected)

"""Twin state fed by a stream of scenes: assimilation cycle, state tables and policies."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.lineage import settle
from tideline.operators import selection

KEYS = ["aoi_id", "scene_id", "transect_index"]
META = (
    "aoi_id bigint, last_assimilation_at timestamp, last_scene_datetime timestamp, last_run_id string, "
    "last_retrained_at timestamp, active_model_run_id string, timeseries_rows bigint"
)


def poll_window(meta: DataFrame, today: Column, lookback_days: int = 45) -> DataFrame:
    """Per AOI the days to ask for: after the last scene's day, else the lookback; or up to date."""
    start = F.coalesce(F.date_add(F.to_date("last_scene_datetime"), 1), F.date_sub(today, lookback_days))
    out = meta.withColumn("poll_start", start).withColumn("poll_end", today)
    return out.withColumn("poll_status", F.when(F.col("poll_start") > F.col("poll_end"), "up_to_date").otherwise("poll"))


def retrain_due(meta: DataFrame, rows: DataFrame, transects: DataFrame, now: Column, min_rows: int = 200, interval_days: int = 180) -> DataFrame:
    """Retrain decision per AOI, checked in order: enough rows, long enough ago, transects present."""
    n = rows.groupBy("aoi_id").agg(F.count("*").alias("_n"))
    t = transects.select("aoi_id").distinct().withColumn("_t", F.lit(True))
    out = meta.join(n, "aoi_id", "left").join(t, "aoi_id", "left")
    recent = F.col("last_retrained_at").isNotNull() & (now - F.col("last_retrained_at") < F.expr(f"INTERVAL {int(interval_days)} DAYS"))
    decision = (
        F.when(F.coalesce("_n", F.lit(0)) < min_rows, "insufficient_samples").when(recent, "not_due")
        .when(F.col("_t").isNull(), "missing_transects").otherwise("due")
    )
    return out.withColumn("retrain", decision).drop("_n", "_t")


def advance_meta(old: DataFrame, batch: DataFrame) -> DataFrame:
    """Metadata after a batch: new values where the batch has them, old ones elsewhere.

    ``batch``: one row per touched AOI with any of the metadata columns.
    """
    new = batch.select("aoi_id", *[F.col(c).alias(f"_{c}") for c in batch.columns if c != "aoi_id"])
    out = old.join(new, "aoi_id", "full_outer")
    return out.select("aoi_id", *[F.coalesce(f"_{c}", c).alias(c) if f"_{c}" in new.columns else F.col(c) for c in old.columns if c != "aoi_id"])


def seed_state(parts: dict[str, DataFrame], run_parts: dict[str, DataFrame], runs: DataFrame) -> dict[str, DataFrame]:
    """Fill parts an AOI lacks from its latest run; parts that exist stay as they are.

    ``run_parts`` carry ``run_id``; ``runs`` is one chosen run per AOI.
    """
    out = {}
    chosen = runs.select("aoi_id", "run_id")
    for name, have in parts.items():
        add = run_parts[name].join(chosen, ["aoi_id", "run_id"]).join(have.select("aoi_id").distinct(), "aoi_id", "left_anti")
        out[name] = have.unionByName(add.select(*have.columns))
    return out


class TwinState:
    """Series and metadata in Parquet under ``root``, written batch by batch.

    A batch writes its own ``batch_id`` partition and then one commit row; readers see
    committed batches only, so a batch that failed half-way is written again and a batch
    that is replayed is skipped. Reading keeps the latest batch per key. ``compact`` folds
    committed batches into one base table.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _there(self, name: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def commits(self) -> DataFrame:
        schema = "batch_id bigint, base bigint"
        return self.spark.read.schema(schema).parquet(f"{self.root}/commits") if self._there("commits") else self.spark.createDataFrame([], schema)

    def _marks(self) -> tuple[int, int]:
        last, base = self.commits().agg(F.max("batch_id"), F.max("base")).first()
        return (-1 if last is None else int(last)), (-1 if base is None else int(base))

    def done(self, batch_id: int) -> bool:
        return not self.commits().filter((F.col("batch_id") == batch_id)).isEmpty()

    def read(self, name: str, keys: Sequence[str]) -> DataFrame | None:
        """Latest row per key over the base and the committed batches after it."""
        last, base = self._marks()
        parts = []
        if base >= 0 and self._there(f"{name}_base/upto={base}"):
            parts.append(self.spark.read.parquet(f"{self.root}/{name}_base/upto={base}").withColumn("batch_id", F.lit(base).cast("bigint")))
        if self._there(name):
            done = self.commits().select("batch_id").distinct()
            deltas = self.spark.read.parquet(f"{self.root}/{name}").withColumn("batch_id", F.col("batch_id").cast("bigint"))
            deltas = deltas.filter((F.col("batch_id") > base) & (F.col("batch_id") <= last)).join(done, "batch_id", "left_semi")
            parts.append(deltas)
        if not parts:
            return None
        both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return selection.best_per_key(both, keys, [F.col("batch_id")]).drop("batch_id")

    def write(self, batch_id: int, tables: dict[str, DataFrame]) -> None:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/{name}/batch_id={int(batch_id)}")
        self.spark.range(1).select(F.lit(int(batch_id)).alias("batch_id"), F.lit(None).cast("bigint").alias("base")).coalesce(1).write.mode("append").parquet(f"{self.root}/commits")

    def compact(self, tables: dict[str, Sequence[str]]) -> None:
        last, _ = self._marks()
        for name, keys in tables.items():
            df = self.read(name, keys)
            if df is not None:
                df.write.mode("overwrite").parquet(f"{self.root}/{name}_base/upto={last}")
        self.spark.range(1).select(F.lit(last).alias("batch_id"), F.lit(last).alias("base")).coalesce(1).write.mode("append").parquet(f"{self.root}/commits")


def upsert_batch(state: TwinState, batch_id: int, rows: DataFrame, now: Column, run_id: str) -> str:
    """One assimilation step: new scenes of the batch into the state, with its outcome.

    ``rows``: observation rows; repeated keys inside a batch keep the last ``_seq``. Scenes
    already known are dropped, as are scenes older than their AOI's last one. The index of scenes is read, not the series. ``heartbeat.follow`` is the streaming form.
    """
    if state.done(batch_id):
        return "replayed"
    old_meta = state.read("meta", ["aoi_id"])
    if old_meta is None:
        old_meta = state.spark.createDataFrame([], META)
    fresh = selection.upsert(rows.limit(0), rows, KEYS).join(old_meta.select("aoi_id", "last_scene_datetime"), "aoi_id", "left")
    late = F.col("last_scene_datetime").isNotNull() & (F.col("datetime") <= F.col("last_scene_datetime"))
    fresh = fresh.filter(~late).drop("last_scene_datetime")
    known = state.read("scenes", ["aoi_id", "scene_id"])
    if known is not None:
        fresh = fresh.join(known.select("aoi_id", "scene_id"), ["aoi_id", "scene_id"], "left_anti")
    fresh = fresh.persist()
    try:
        if fresh.isEmpty():
            state.write(batch_id, {})
            return "no_new_scenes"
        counts = fresh.groupBy("aoi_id").agg(F.count("*").alias("_add"), F.max("datetime").alias("last_scene_datetime"))
        counts = counts.join(old_meta.select("aoi_id", F.col("timeseries_rows").alias("_had")), "aoi_id", "left")
        delta = counts.select(
            "aoi_id", "last_scene_datetime", (F.col("_add") + F.coalesce("_had", F.lit(0))).alias("timeseries_rows"), now.alias("last_assimilation_at"), F.lit(run_id).alias("last_run_id")
        )
        meta = advance_meta(old_meta.join(delta.select("aoi_id"), "aoi_id", "left_semi"), delta)
        state.write(batch_id, {"series": fresh, "meta": meta, "scenes": fresh.select("aoi_id", "scene_id").distinct()})
        return "updated"
    finally:
        fresh.unpersist()


def cycle(
    state: TwinState, batch_id: int, scenes: DataFrame, extract: Callable[[DataFrame], DataFrame], now: Column, run_id: str,
    transects: DataFrame | None = None, lines: DataFrame | None = None, lookback_days: int = 45, min_rows: int = 200, interval_days: int = 180,
) -> DataFrame:
    """One heartbeat of all areas: poll, extract, append, latest line, retraining decision. Returns one status row per area.

    ``scenes``: ``aoi_id, scene_id, datetime`` and what ``extract`` needs to give observation rows; ``transects`` by area keep the
    first version, ``lines`` (``aoi_id, scene_id, datetime, …``) update the latest line. An area whose last scene's next day lies ahead is
    ``up_to_date`` and stays untouched; one without new scenes only notes the time. Scenes before the window count as late,
    known ones as known. The state keeps an index of scenes, so no cycle reads the whole series. A batch done before returns its old status rows.
    """
    if state.done(batch_id):
        return state.read("status", ["aoi_id", "cycle"]).filter(F.col("cycle") == batch_id)
    spark, today = state.spark, F.to_date(now)
    old = state.read("meta", ["aoi_id"])
    old = spark.createDataFrame([], META) if old is None else old
    areas = scenes.select(F.col("aoi_id").cast("bigint").alias("aoi_id")).unionByName(old.select("aoi_id")).distinct()
    polled = settle(poll_window(areas.join(old, "aoi_id", "left"), today, lookback_days))
    day = F.to_date("datetime")
    seen = settle(scenes.join(polled.select("aoi_id", "poll_start", "poll_end", "poll_status"), "aoi_id"))
    known = state.read("scenes", ["aoi_id", "scene_id"])
    found = seen.withColumn("_late", day < F.col("poll_start")).withColumn("_in", (F.col("poll_status") == "poll") & day.between(F.col("poll_start"), F.col("poll_end")))
    if known is not None:
        found = found.join(known.select("aoi_id", "scene_id", F.lit(True).alias("_known")), ["aoi_id", "scene_id"], "left")
    else:
        found = found.withColumn("_known", F.lit(None).cast("boolean"))
    found = settle(found)
    fresh = found.filter("_in AND _known IS NULL").select(*scenes.columns)
    rows = settle(selection.upsert(extract(fresh).limit(0), extract(fresh), KEYS))
    counts = rows.groupBy("aoi_id").agg(F.count("*").alias("_add"), F.max("datetime").alias("_last"))
    tally = found.groupBy("aoi_id").agg(
        F.count_distinct(F.when(F.col("_in") & F.col("_known").isNull(), F.col("scene_id"))).alias("new_scenes"),
        F.count_distinct(F.when(F.col("_late") & F.col("_known").isNull(), F.col("scene_id"))).alias("late_scenes"),
        F.count_distinct(F.when(F.col("_known"), F.col("scene_id"))).alias("known_scenes"),
    )
    both = settle(polled.drop("poll_start", "poll_end").join(tally, "aoi_id", "left").join(counts, "aoi_id", "left").fillna(0, ["new_scenes", "late_scenes", "known_scenes"]))
    reason = F.when(F.col("poll_status") == "up_to_date", "up_to_date").when(F.col("new_scenes") == 0, "no_new_scenes").otherwise("updated")
    both = both.withColumn("reason", reason)
    touched, updated = F.col("reason") != "up_to_date", F.col("reason") == "updated"
    total = F.coalesce("timeseries_rows", F.lit(0)) + F.coalesce("_add", F.lit(0))
    have = state.read("transects", ["aoi_id", "transect_index"])
    first = None
    if transects is not None:
        mine = transects.join(both.filter(updated).select("aoi_id"), "aoi_id", "left_semi")
        first = mine if have is None else mine.join(have.select("aoi_id").distinct(), "aoi_id", "left_anti")
        first = settle(first)
        have = first if have is None else have.unionByName(first.select(*have.columns))
    placed = spark.createDataFrame([], "aoi_id bigint") if have is None else have.select("aoi_id").distinct()
    recent = F.col("last_retrained_at").isNotNull() & (now - F.col("last_retrained_at") < F.expr(f"INTERVAL {int(interval_days)} DAYS"))
    decision = F.when(~updated, None).when(total < min_rows, "insufficient_samples").when(recent, "not_due").when(F.col("_placed").isNull(), "missing_transects").otherwise("due")
    both = settle(both.join(placed.withColumn("_placed", F.lit(True)), "aoi_id", "left").withColumn("retrain", decision))
    meta = both.filter(touched).select(
        "aoi_id", now.alias("last_assimilation_at"), F.when(updated, F.coalesce("_last", "last_scene_datetime")).otherwise(F.col("last_scene_datetime")).alias("last_scene_datetime"),
        F.when(updated, F.lit(run_id)).otherwise(F.col("last_run_id")).alias("last_run_id"), "last_retrained_at", "active_model_run_id", total.cast("bigint").alias("timeseries_rows"),
    )
    status = both.select("aoi_id", F.lit(int(batch_id)).cast("bigint").alias("cycle"), F.when(updated, "updated").otherwise("no_update").alias("status"), "reason", "new_scenes", "late_scenes", "known_scenes", total.cast("bigint").alias("timeseries_rows"), "retrain")
    tables = {"series": rows, "meta": meta, "status": status, "scenes": fresh.select("aoi_id", "scene_id").distinct()}
    if first is not None:
        tables["transects"] = first
    if lines is not None:
        newest = latest_line(lines.join(rows.select("aoi_id", "scene_id").distinct(), ["aoi_id", "scene_id"], "left_semi"))
        tables["latest"] = newest
    state.write(batch_id, tables)
    return state.read("status", ["aoi_id", "cycle"]).filter(F.col("cycle") == batch_id)


def dedup_scenes(stream: DataFrame, delay: str = "0 seconds", keys: Sequence[str] = ("aoi_id", "scene_id")) -> DataFrame:
    """Each scene once within the watermark; later rows than the watermark are dropped."""
    return stream.withWatermark("datetime", delay).dropDuplicatesWithinWatermark(list(keys))


def latest_line(lines: DataFrame, keys: Sequence[str] = ("aoi_id",)) -> DataFrame:
    """Latest line per AOI; on a stream use the update output mode."""
    rest = [c for c in lines.columns if c not in keys]
    return lines.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("datetime", "scene_id")).alias("_l")).select(*keys, *[F.col(f"_l.{c}").alias(c) for c in rest])


def monthly(scenes: DataFrame, keys: Sequence[str] = ("aoi_id",)) -> DataFrame:
    """Candidate set of each calendar month: count, clearest scene and its cloud share."""
    cloud = F.coalesce(F.col("cloud_pct"), F.lit(100.0))
    return scenes.groupBy(*keys, F.date_trunc("month", "datetime").alias("month")).agg(
        F.count("*").alias("candidates"), F.min_by("scene_id", F.struct(cloud, F.col("scene_id"))).alias("best_scene"), F.min(cloud).alias("best_cloud")
    )

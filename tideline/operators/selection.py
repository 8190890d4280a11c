"""Scene search, de-duplication, matching and other choices over keyed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.text_time import scene_window
from tideline.operators.skew import salted_join


def search_scenes(
    scenes: DataFrame, start: str, end: str, max_cloud: float, limit: int | None = None,
    bbox: Sequence[float] | None = None, per_aoi: bool = True,
) -> DataFrame:
    """Scenes with a time inside ``start``..end of ``end``, few clouds, meeting ``bbox``; newest first.

    A missing cloud share counts as 100. With ``per_aoi`` the limit holds for each AOI.
    """
    t = F.col("datetime")
    out = scenes.filter(t.isNotNull() & (t >= F.lit(start).cast("timestamp")) & (t < F.lit(end).cast("timestamp") + F.expr("INTERVAL 1 DAY")))
    out = out.withColumn("cloud_pct", F.coalesce(F.col("cloud_pct"), F.lit(100.0))).filter(F.col("cloud_pct") <= max_cloud)
    if bbox is not None:
        b, (w, s, e, n) = F.col("bbox"), bbox
        out = out.filter((b[0] <= e) & (b[2] >= w) & (b[1] <= n) & (b[3] >= s))
    order = [F.desc("datetime"), F.asc("scene_id")]
    if limit is None:
        return out.orderBy(*order)
    if not per_aoi:
        return out.orderBy(*order).limit(limit)
    w = Window.partitionBy("aoi_id").orderBy(*order)
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def resolve_scenes(requested: DataFrame, catalog: DataFrame, key: str = "scene_id") -> tuple[DataFrame, DataFrame]:
    """Catalog rows of the requested ids in request order, and the ids that do not exist."""
    found = requested.join(catalog, key).orderBy("position")
    return found, requested.join(catalog, key, "left_anti")


def new_scenes(scenes: DataFrame, state: DataFrame, keys: Sequence[str] = ("aoi_id", "scene_id")) -> DataFrame:
    """Scenes not in the state yet, oldest first."""
    return scenes.join(state.select(*keys), list(keys), "left_anti").orderBy("datetime", *keys)


def pending(jobs: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every job with ``status`` pending, or skipped when it is done already."""
    seen = done.select(*keys).distinct().withColumn("_done", F.lit(True))
    out = jobs.join(seen, list(keys), "left")
    return out.withColumn("status", F.when(F.col("_done"), "skipped").otherwise("pending")).drop("_done")


def job_grid(aois: DataFrame, start: str, end: str, role: str | None = None) -> DataFrame:
    """One job per AOI and calendar month: the month list is generated on each AOI row."""
    from tideline.functions.text_time import month_windows

    rows = aois if role is None else aois.filter(F.col("role") == role)
    rows = rows.withColumn("_s", F.lit(start).cast("date")).withColumn("_e", F.lit(end).cast("date"))
    return month_windows(rows, "_s", "_e").drop("_s", "_e")


def best_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], largest: bool = True) -> DataFrame:
    """The row with the largest (smallest) ``order`` per key, by a map-side combined aggregate."""
    rest = [c for c in df.columns if c not in keys]
    pick = (F.max_by if largest else F.min_by)(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(pick.alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def newest_source(files: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Newest source file per key, raw arrays before images."""
    return best_per_key(files, keys, [F.col("is_raw"), F.col("modified"), F.col("path")])


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union where the last row per key wins: rows of ``new`` over ``old``.

    ``_seq`` orders rows inside one side when a side repeats a key; without it the largest
    row wins, so the result does not depend on row order.
    """
    seq = lambda df: F.col("_seq") if "_seq" in df.columns else F.lit(0).cast("long")
    both = old.withColumn("_batch", F.lit(0)).withColumn("_seq", seq(old)).unionByName(
        new.withColumn("_batch", F.lit(1)).withColumn("_seq", seq(new))
    )
    rest = [c for c in both.columns if c not in keys]
    order = [F.col("_batch"), F.col("_seq"), F.struct(*[c for c in rest if c not in ("_batch", "_seq")])]
    return best_per_key(both, keys, order).drop("_batch", "_seq")


def insert_if_absent(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union where existing keys stay as they are; a key new twice keeps its smallest row."""
    fresh = new.join(old.select(*keys), list(keys), "left_anti")
    rest = [c for c in fresh.columns if c not in keys]
    return old.unionByName(best_per_key(fresh, keys, [F.struct(*rest)], largest=False))


def valid_rows(df: DataFrame, how: str = "all", cols: Sequence[str] = ("VE_distance_m", "WL_distance_m")) -> DataFrame:
    """``all`` drops rows where every distance is missing, ``any`` rows where one is."""
    return df.dropna(how=how, subset=list(cols))


def distinct_ids(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct().orderBy(col)


def lookback(df: DataFrame, days: int, keys: Sequence[str] = ("aoi_id",), ts: str = "datetime", now: Column | None = None) -> DataFrame:
    """Rows of the last ``days`` before ``now`` (the time of the run if not given); everything of an AOI where none is left."""
    ends = df.groupBy(*keys).agg(F.max(ts).alias("_end"))
    since = (now if now is not None else F.current_timestamp()) - F.expr(f"INTERVAL {int(days)} DAYS")
    marks = ends.withColumn("_since", since).withColumn("_none", F.col("_end") < F.col("_since")).drop("_end")
    spread = [c for c in df.columns if c not in keys][:2]
    return salted_join(df, marks, keys, spread=spread).filter(F.col("_none") | (F.col(ts) >= F.col("_since"))).drop("_since", "_none")


def least_cloud(scenes: DataFrame, requests: DataFrame, hours: int = 12) -> DataFrame:
    """Scene with the fewest clouds within ``hours`` of each request (``aoi_id, request_id, at``).

    Time is cut into buckets as long as a window, so a window is the end of one bucket and the start of the next, and two running minima answer
    it: the work grows with scenes and requests, not with their pairs. Equal times of an AOI are asked for once.
    """
    width = 2 * hours * 3_600_000_000
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    bucket = (F.col("_t") - F.pmod("_t", F.lit(width))).alias("_b")
    item = F.struct(F.coalesce("cloud_pct", F.lit(100.0)).alias("clouds"), "scene_id", "datetime", "cloud_pct")
    best = scenes.filter(F.col("datetime").isNotNull()).groupBy("aoi_id", micros("datetime").alias("_t")).agg(F.min(item).alias("_s"))
    asked = requests.filter(F.col("at").isNotNull()).select("aoi_id", "at").distinct().withColumn("_w", scene_window("at", hours))
    none = F.lit(None).cast(best.schema["_s"].dataType).alias("_s")
    border = lambda c, last: asked.select("aoi_id", micros(f"_w.{c}").alias("_t"), none, "at", F.lit(last).alias("_last"))
    points = best.select("aoi_id", "_t", "_s", F.lit(None).cast(asked.schema["at"].dataType).alias("at"), F.lit(None).cast("boolean").alias("_last"))
    points = points.unionByName(border("start", False)).unionByName(border("end", True)).select("*", bucket)
    part = Window.partitionBy("aoi_id", "_b")
    ran = points.withColumn("_to", F.min("_s").over(part.orderBy("_t"))).withColumn("_from", F.min("_s").over(part.orderBy(F.desc("_t"))))
    found = ran.filter(F.col("at").isNotNull()).groupBy("aoi_id", "at").agg(F.min(F.when(F.col("_last"), F.col("_to")).otherwise(F.col("_from"))).alias("s"))
    met = requests.select("aoi_id", "request_id", "at").join(found.filter(F.col("s").isNotNull()), ["aoi_id", "at"])
    return met.groupBy("aoi_id", "request_id").agg(F.min("s").alias("s")).select("aoi_id", "request_id", "s.scene_id", "s.datetime", "s.cloud_pct")


def latest_run(runs: DataFrame, aois: DataFrame, artifacts: Sequence[str]) -> DataFrame:
    """Newest run per AOI that has every artifact, by AOI id or by a name that starts with it and an underscore."""
    whole = F.lit(True)
    for a in artifacts:
        whole = whole & F.coalesce(F.col(a), F.lit(False))
    ready = runs.filter(whole)
    own = ready.filter(F.col("aoi_id").isNotNull())
    # a run without an AOI belongs to the AOI its name starts with, up to one of its underscores
    names = aois.select(F.col("aoi_id").alias("_aoi"))
    loose = ready.filter(F.col("aoi_id").isNull())
    parts = F.split("run_id", "_")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "_"))
    prefixes = loose.filter(F.contains("run_id", F.lit("_"))).withColumn("_p", F.explode(heads))
    matched = prefixes.join(names, F.col("_p") == F.col("_aoi")).withColumn("aoi_id", F.col("_aoi")).drop("_p", "_aoi")
    both = own.join(aois.select("aoi_id"), "aoi_id", "left_semi").unionByName(matched)
    return best_per_key(both, ["aoi_id"], [F.col("generated_at"), F.col("run_id")])


def waterline_history(
    lines: DataFrame, latest: DataFrame, days: int, now: Column, keys: Sequence[str] = ("aoi_id",)
) -> DataFrame:
    """Observed waterlines since the cutoff plus the latest state line, longest per time, ascending.

    ``lines``: ``aoi_id, run_id, datetime, length, …``; a line without an AOI counts for the
    AOIs whose ids its run's name contains, case and all. The state line is always in; without a time it counts as now.
    """
    names = latest.select(*keys).distinct().withColumn("_aoi", F.col("aoi_id").cast("string"))
    own = lines.filter(F.col("aoi_id").isNotNull()).join(names.select(*keys), list(keys), "left_semi")
    # only words as long as some id are looked up; there are few lengths, however many ids
    lengths = sorted(r[0] for r in names.select(F.length("_aoi")).distinct().collect())
    words = F.array_distinct(F.flatten(F.transform(F.array(*map(F.lit, lengths)), lambda n: F.when(
        F.length("run_id") >= n, F.transform(F.sequence(F.lit(1), F.length("run_id") - n + 1), lambda i: F.substr("run_id", i, n))
    ).otherwise(F.array().cast("array<string>"))))) if lengths else F.array().cast("array<string>")
    loose = lines.filter(F.col("aoi_id").isNull()).drop("aoi_id").withColumn("_aoi", F.explode(words)).join(names, "_aoi").drop("_aoi")
    seen = own.unionByName(loose, allowMissingColumns=True).filter(
        (F.col("length") > 0) & (F.col("datetime") >= now - F.expr(f"INTERVAL {int(days)} DAYS"))
    )
    kept = latest.filter(F.col("length") > 0).withColumn("datetime", F.coalesce("datetime", now))
    both = seen.unionByName(kept, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*keys, "datetime", "length")]
    best = best_per_key(both, [*keys, "datetime"], [F.col("length"), *[F.col(c) for c in rest if c == "run_id"]])
    return best.orderBy(*keys, "datetime")


def select_targets(
    images: DataFrame, name: str = "name", pattern: str | None = None, years: tuple[int | None, int | None] = (None, None),
    include: Sequence[str] = (), exclude: Sequence[str] = (),
) -> DataFrame:
    """Images by name pattern, year range and AOI lists (``aoi``, ``year`` columns)."""
    keep = F.lit(True) if pattern is None else F.col(name).rlike(pattern)
    if years[0] is not None:
        keep = keep & (F.col("year") >= years[0])
    if years[1] is not None:
        keep = keep & (F.col("year") <= years[1])
    if include:
        keep = keep & F.lower("aoi").isin([a.lower() for a in include])
    if exclude:
        keep = keep & ~F.lower("aoi").isin([a.lower() for a in exclude])
    return images.filter(keep)


def match_files(labels: DataFrame, images: DataFrame, candidates: Sequence[Column]) -> DataFrame:
    """Each label with the first candidate path that exists; ``path`` is NULL where none does."""
    cand = F.posexplode(F.array(*candidates)).alias("_prio", "path")
    tried = labels.select("label_id", cand).join(images.select("path"), "path")
    best = tried.groupBy("label_id").agg(F.min_by("path", "_prio").alias("path"), F.min("_prio").alias("priority"))
    return labels.join(best, "label_id", "left")


def selected_scene(selection: DataFrame, candidates: DataFrame, keys: Sequence[str] = ("aoi_id", "month", "scene_id")) -> DataFrame:
    """Chosen scenes with their record from the month's candidates, else a minimal record."""
    c = candidates.select(*keys, "datetime", "cloud_pct", F.lit("candidate").alias("_src"))
    out = selection.join(c, list(keys), "left")
    return out.withColumn("record_source", F.coalesce("_src", F.lit("minimal"))).drop("_src")


def apply_selection(current: DataFrame, selection: DataFrame, dry_run: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Replace a month's scene by a selected one.

    Returns the new current table, the replaced versions and one audit row per selection
    row with status ``invalid``, ``error`` (no such month), ``dry_run`` or ``replaced``.
    A month selected twice takes the last row (``position``).
    """
    keys = ["aoi_id", "month"]
    ok = (
        F.col("aoi_id").isNotNull() & F.coalesce(F.col("month").rlike(r"^\d{4}-(0[1-9]|1[0-2])$"), F.lit(False))
        & F.coalesce(F.col("new_scene_id") != "", F.lit(False))
    )
    there = current.select(*keys, F.col("scene_id").alias("old_scene_id"))
    audit = selection.withColumn("_ok", ok).join(there, keys, "left").withColumn(
        "status",
        F.when(~F.col("_ok"), "invalid").when(F.col("old_scene_id").isNull(), "error").otherwise("dry_run" if dry_run else "replaced"),
    ).drop("_ok")
    chosen = best_per_key(audit.filter(F.col("status") == "replaced").select(*keys, "position", "new_scene_id"), keys, [F.col("position")])
    merged = current.join(chosen.select(*keys, "new_scene_id"), keys, "left")
    history = merged.filter(F.col("new_scene_id").isNotNull()).drop("new_scene_id")
    updated = merged.withColumn("scene_id", F.coalesce("new_scene_id", "scene_id")).drop("new_scene_id")
    return updated, history, audit


def forecast_view(features: DataFrame, start: str | None = None, end: str | None = None, keys: Sequence[str] = ("aoi_id",)) -> DataFrame:
    """Features whose boundary type names a waterline, or all of an AOI that has none; within dates."""
    is_wl = F.lower("boundary_type").contains("waterline")
    any_wl = features.groupBy(*keys).agg(F.coalesce(F.max(is_wl), F.lit(False)).alias("_any"))
    spread = [c for c in features.columns if c not in keys][:2]
    out = salted_join(features, any_wl, keys, spread=spread).filter(is_wl | ~F.col("_any")).drop("_any")
    if start is not None:
        out = out.filter(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        out = out.filter(F.col("date") <= F.lit(end).cast("date"))
    return out


def view_range(view: DataFrame, keys: Sequence[str] = ("aoi_id",)) -> DataFrame:
    return view.groupBy(*keys).agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("n_features"))


def forecast_points(features: DataFrame, line: str = "line") -> DataFrame:
    """Forecast lines to points with a step label; unusable coordinates dropped."""
    pts = features.select("*", F.posexplode(line).alias("point_index", "_p")).drop(line)
    x, y = F.col("_p.x"), F.col("_p.y")
    good = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y) & x.between(-180, 180) & y.between(-90, 90)
    return pts.filter(good).withColumns({"lon": x, "lat": y}).drop("_p").withColumn(
        "label", F.concat(F.lit("step "), F.col("step").cast("string"))
    )


def time_rank(features: DataFrame, by: Sequence[str] = ("aoi_id",), ts: str = "date") -> DataFrame:
    """Place of each date in [0,1] by date order; the ranking runs over distinct dates only."""
    dates = features.select(*by, ts).distinct()
    ranked = dates.withColumn("time_rank", F.percent_rank().over(Window.partitionBy(*by).orderBy(ts)))
    return features.join(ranked, [*by, ts])


def reference_lines(refs: DataFrame, keys: Sequence[str] = ("aoi_id",)) -> DataFrame:
    """One fixed reference per AOI: first manual line, else first auto line (``source, position``)."""
    return best_per_key(refs, keys, [F.when(F.col("source") == "manual", 0).otherwise(1), F.col("position")], largest=False)


def pick_baseline(lines: DataFrame, keys: Sequence[str] = ("aoi_id",)) -> DataFrame:
    """First scene (``position``) with a waterline, else the first with a vegetation edge."""
    order = [F.when(F.col("boundary") == "WL", 0).otherwise(1), F.col("position")]
    return best_per_key(lines, keys, order, largest=False)


def line_method(df: DataFrame, first: str, second: str) -> DataFrame:
    """Scene method and error: the model's line, else the index line, else none."""
    return df.withColumn("line", F.coalesce(F.col(first), F.col(second))).withColumn(
        "method", F.when(F.col(first).isNotNull(), "model").when(F.col(second).isNotNull(), "weighted_peaks").otherwise("none")
    )


def assert_present(df: DataFrame, reason: str) -> DataFrame:
    """Raise when a step that must yield something yields nothing."""
    if df.isEmpty():
        raise ValueError(reason)
    return df

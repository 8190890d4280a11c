"""Names, timestamps, months and horizons as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def slugify(col: Column | str, default: str = "item") -> Column:
    """Runs outside ``[a-zA-Z0-9_-]`` become ``_``; outer ``_`` go; empty becomes ``default``."""
    slug = F.btrim(F.regexp_replace(F.trim(_c(col)), r"[^a-zA-Z0-9_-]+", "_"), F.lit("_"))
    return F.when(F.coalesce(slug, F.lit("")) == "", F.lit(default)).otherwise(slug)


def safe_scene_id(col: Column | str) -> Column:
    """Same rule with ``.`` allowed."""
    return F.btrim(F.regexp_replace(_c(col), r"[^a-zA-Z0-9_.-]+", "_"), F.lit("_"))


def parse_iso(col: Column | str) -> Column:
    """ISO text to timestamp: ``Z`` is a zero offset, fraction cut to 6 digits, no zone is UTC."""
    s = F.trim(_c(col))
    pattern = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2})(:\d{2})?(?:\.(\d+))?\s*(Z|z|[+-]\d{2}:?\d{2})?)?$"
    part = lambda i: F.regexp_extract(s, pattern, i)
    clock = F.when(part(2) == "", "00:00").otherwise(part(2))
    seconds = F.when(part(3) == "", ":00").otherwise(part(3))
    fraction = F.rpad(F.substring(part(4), 1, 6), 6, "0")
    zone = F.regexp_replace(part(5), r"^([+-]\d{2})(\d{2})$", "$1:$2")
    zone = F.when(part(5).isin("", "Z", "z"), "+00:00").otherwise(zone)
    return F.when(
        s.rlike(pattern), F.try_to_timestamp(F.concat(part(1), F.lit(" "), clock, seconds, F.lit("."), fraction, zone))
    )


def scene_window(ts: Column | str, hours: int = 12) -> Column:
    """``struct(start, end)`` of ``ts`` plus and minus ``hours``."""
    step = F.expr(f"INTERVAL {int(hours)} HOURS")
    return F.struct((_c(ts) - step).alias("start"), (_c(ts) + step).alias("end"))


def parse_image_name(col: Column | str, suffix: str = ".png") -> Column:
    """``run__scene<suffix>`` to ``struct(run_id, scene_id, aoi_key)``; NULL when malformed."""
    name = _c(col)
    stem = F.left(name, F.length(name) - len(suffix))
    run = F.substring_index(stem, "__", 1)
    scene = F.substring(stem, F.length(run) + 3, F.length(stem))
    ok = F.lower(name).endswith(suffix) & name.contains("__") & (run != "") & (scene != "")
    return F.when(ok, F.struct(run.alias("run_id"), scene.alias("scene_id"), aoi_key(run).alias("aoi_key")))


def aoi_key(run: Column | str) -> Column:
    """``aoi_NN`` prefix, else the first two ``_`` parts, lower case."""
    run = _c(run)
    tagged = F.regexp_extract(run, r"(?i)^(aoi_\d+)", 1)
    return F.lower(F.when(tagged != "", tagged).otherwise(F.substring_index(run, "_", 2)))


# The two name patterns.
AOI_MONTH_PATTERN = r"(?i)(aoi_\d+(?:_holdout)?)_(20\d{2})(\d{2})"
STEM_MONTH_PATTERN = r"_(20\d{2})(\d{2})__"


def parse_aoi_year_month(col: Column | str) -> Column:
    """``aoi_NN[_holdout]_YYYYMM`` anywhere in a name to ``struct(aoi, year, month)``; month 1..12."""
    name = _c(col)
    pick = lambda i: F.regexp_extract(name, AOI_MONTH_PATTERN, i)
    year, month = pick(2).try_cast("int"), pick(3).try_cast("int")
    return F.when(
        month.between(1, 12), F.struct(F.lower(pick(1)).alias("aoi"), year.alias("year"), month.alias("month"))
    )


def parse_stem_month(col: Column | str) -> Column:
    """Lenient form: leading ``aoi_NN`` (or empty) and the month before ``__`` (or NULL)."""
    stem = _c(col)
    pick = lambda i: F.regexp_extract(stem, STEM_MONTH_PATTERN, i).try_cast("int")
    return F.struct(
        F.lower(F.regexp_extract(stem, r"(?i)^(aoi_\d+)", 1)).alias("aoi"), pick(1).alias("year"), pick(2).alias("month")
    )


def month_index(year: Column | str, month: Column | str) -> Column:
    """``year*12 + month``: only differences are meaningful, decode with ``month_of_index``."""
    return _c(year) * 12 + _c(month)


def month_of_index(index: Column | str) -> Column:
    """``struct(year, month)`` of a month index, right for December too."""
    i = _c(index) - 1
    return F.struct(F.floor(i / 12).cast("int").alias("year"), (F.pmod(i, F.lit(12)) + 1).cast("int").alias("month"))


def month_tokens(df: DataFrame, text: str) -> DataFrame:
    """Distinct valid ``YYYY-MM`` tokens of comma/space/semicolon lists; ``#`` lines skipped."""
    lines = df.select(F.explode(F.split(F.col(text), r"\r?\n")).alias("line")).filter(~F.trim("line").startswith("#"))
    return (
        lines.select(F.explode(F.split("line", r"[\s,;]+")).alias("month"))
        .filter(F.col("month").rlike(r"^\d{4}-(0[1-9]|1[0-2])$"))
        .distinct()
        .orderBy("month")
    )


def month_range(month: Column | str, today: Column) -> Column:
    """``struct(start, end, status)`` of a ``YYYY-MM``; end clipped to today, future dropped."""
    start = F.to_date(F.concat(_c(month), F.lit("-01")))
    future = start > today
    return F.struct(
        F.when(~future, start).alias("start"),
        F.when(~future, F.least(F.last_day(start), today)).alias("end"),
        F.when(future, F.lit("skipped_future")).otherwise(F.lit("ok")).alias("status"),
    )


def month_windows(df: DataFrame, start: str, end: str) -> DataFrame:
    """One row per calendar month between two dates; first and last month are clipped."""
    first = F.trunc(F.col(start), "month")
    return (
        df.withColumn("_m", F.explode(F.sequence(first, F.trunc(F.col(end), "month"), F.expr("INTERVAL 1 MONTH"))))
        .withColumn("window_start", F.greatest(F.col("_m"), F.col(start)))
        .withColumn("window_end", F.least(F.last_day("_m"), F.col(end)))
        .withColumn("month", F.date_format("_m", "yyyy-MM"))
        .drop("_m")
    )


def horizon_days(years: Column | str) -> Column:
    """Years to days, half to even, at least one."""
    days = F.rint(_c(years) * 365.25).cast("int")
    return F.when(days < 1, 1).otherwise(days)


def horizon_steps(days: Column | str) -> Column:
    """Days to monthly steps, at least one."""
    steps = F.ceil(_c(days) / 30.0).cast("int")
    return F.when(steps < 1, 1).otherwise(steps)


def scene_seed(run: Column | str, scene: Column | str) -> Column:
    """CRC32 of ``run__scene``: the same seed on every run."""
    return F.crc32(F.concat(_c(run), F.lit("__"), _c(scene)).cast("binary"))

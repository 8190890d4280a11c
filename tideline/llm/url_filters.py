"""URL filters over dated lists by a temporal as-of join (operator 1). DataFrame functions only.

A list is a log of dated entries (add or remove a pattern). Entries become validity intervals; every capture is judged by the entries
that were active when it was fetched. A capture offers a handful of keys (its host and parent domains, its address,
its path folders); keys and intervals meet in an equi-join on (pattern, period), where a period is a span of days, so a pattern with a long
history meets a capture only through the intervals that touch the capture's period.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.tables import spread_join, stored

PERIOD_DAYS = 32
_FAR = "timestamp_ntz'9999-12-31 00:00:00'"
_FIRST = "timestamp_ntz'0001-01-01 00:00:00'"


def host(url: Column) -> Column:
    """Lower-case host without port and user; empty where there is none."""
    rest = F.regexp_extract(F.lower(url.cast("string")), "^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    return F.regexp_replace(F.regexp_replace(rest, "^.*@", ""), ":[0-9]*$", "")


def address(url: Column) -> Column:
    """Scheme-free address: lower-case host, then the path without query, fragment or closing slash."""
    path = F.regexp_extract(url.cast("string"), "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.concat(host(url), F.regexp_replace(path, "/+$", ""))


def url_keys(url: Column, folders: int) -> Column:
    """Keys a capture can be listed by: ``d:`` host and each parent domain of two labels or more, ``p:`` host and up to ``folders`` path folders, ``u:`` the address."""
    labels, parts = F.split(host(url), "\\."), F.split(address(url), "/")
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    paths = F.transform(F.sequence(F.lit(1), F.least(F.size(parts) - 1, F.lit(folders))), lambda i: F.concat(F.lit("p:"), F.array_join(F.slice(parts, 1, i + 1), "/")))
    paths = F.when((F.size(parts) > 1) & (F.lit(folders) > 0), paths).otherwise(F.array().cast("array<string>"))
    every = F.array_distinct(F.concat(domains, paths, F.array(F.concat(F.lit("u:"), address(url)))))
    return F.when(host(url) != "", every).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, verdict, pattern, valid_from, valid_to) from entries (list, verdict, pattern, at, action).

    An entry holds until the next entry of the same list and pattern; ``remove`` closes without opening. Of entries at one moment the
    removal wins; repeated entries count once. Entries with a null list, pattern or moment are void, other verdicts than ``allow`` and ``block`` too.
    """
    valid = entries.where("list is not null and pattern is not null and at is not null and verdict in ('allow', 'block') and action in ('add', 'remove')")
    # equal moments are folded before the shuffle, so a list replayed many times is small
    moments = valid.groupBy("list", "pattern", "at").agg(F.max("action").alias("action"), F.min("verdict").alias("verdict"))
    # adds behind an add change nothing: only changes are ordered further. Histories are ordered by year first
    year = F.year("at")
    chunk = Window.partitionBy("list", "pattern", "year").orderBy("at")
    rows = moments.withColumn("year", year).withColumn("next", F.lead("at").over(chunk))
    first = moments.groupBy("list", "pattern", year.alias("year")).agg(F.min("at").alias("head"))
    later = Window.partitionBy("list", "pattern").orderBy("year")
    heads = first.withColumn("after", F.lead("head").over(later)).select("list", "pattern", "year", "after")
    joined = rows.join(heads, ["list", "pattern", "year"])
    return joined.where("action = 'add'").select("list", "verdict", "pattern", F.col("at").alias("valid_from"), F.coalesce("next", "after", F.expr(_FAR)).alias("valid_to"))


def period(at: Column, days: int) -> Column:
    return F.floor(F.datediff(at.cast("date"), F.lit("1970-01-01").cast("date")) / days).cast("int")


def judge(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url: str = "url", at: str = "fetched_at", period_days: int = PERIOD_DAYS, folders: int | None = None) -> DataFrame:
    """One row per capture: id, ``fetched_at``, ``allowed``, ``verdict``, ``list``, ``pattern``, ``valid_from``, ``n_active``.

    Of the entries active at the fetch (from inclusive, to exclusive) the longest pattern decides, then ``allow`` before ``block``, then the list's
    name; ``n_active`` counts them. Captures with a null or host-less URL, or without a fetch time, match nothing and are allowed. Rows are told apart by (id, url, fetch time): repeated
    rows give repeated rows. Null ids are judged too. Empty tables are fine; other columns are ignored. Path entries match
    however many folders they have, up to ``folders`` if given. Long URLs are compared whole.
    """
    rows = captures.select(F.col(id_col).alias("id"), F.col(url).cast("string").alias("url"), F.col(at).cast("timestamp_ntz").alias("at"))
    # a capture is looked up once, however often it is repeated
    looked = stored(rows.groupBy("url", "at").agg(F.count(F.lit(1)).alias("n")).where("url is not null and at is not null"), "captures")
    valid = stored(intervals(entries).where("valid_from < valid_to"), "intervals")
    if folders is None:  # no key that matches has more folders than the deepest path entry
        folders = valid.where("pattern like 'p:%'").agg(F.max(F.size(F.split("pattern", "/")) - 1)).first()[0] or 0
    keyed = stored(looked.select("url", "at", period(F.col("at"), period_days).alias("period"), F.explode(url_keys(F.col("url"), folders)).alias("pattern")), "capture-keys")
    # an open interval reaches the last period that a capture has
    last = keyed.agg(F.max("period")).first()[0]
    last = 0 if last is None else last
    until = F.least(period(F.col("valid_to") - F.expr("interval 1 microsecond"), period_days), F.lit(last))
    begin = period(F.col("valid_from"), period_days)
    spans = valid.where(begin <= until).withColumn("period", F.explode(F.sequence(begin, until)))
    met = spread_join(keyed, spans, ["pattern", "period"], ["url", "at"]).where("at >= valid_from and at < valid_to")
    order = F.struct(-F.length("pattern"), F.col("verdict"), F.col("list"), F.col("pattern"), F.col("valid_from"))
    best = met.groupBy("url", "at").agg(F.min(order).alias("b"), F.count(F.lit(1)).alias("n_active"))
    best = stored(best.select("url", "at", "n_active", F.col("b.verdict").alias("verdict"), F.col("b.list").alias("list"), F.col("b.pattern").alias("pattern"), F.col("b.valid_from").alias("valid_from")), "judged")
    out = rows.join(best, ["url", "at"], "left")
    return out.select(
        F.col("id").alias(id_col), F.col("at").alias("fetched_at"), (F.coalesce("verdict", F.lit("allow")) != "block").alias("allowed"), "verdict", "list", "pattern", "valid_from",
        F.coalesce("n_active", F.lit(0)).cast("bigint").alias("n_active"),
    )

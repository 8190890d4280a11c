"""Mixing sources to target weights by temperature (operator 6). DataFrame functions only.

A source's weight is its token share to the power ``alpha``, normalised. ``alpha`` (0: all alike, 1: natural shares) is bisected for the
least flattening whose weights have ``target_entropy`` times the largest entropy, and raised again as far as a limit on
repetition asks. The weights are realised as block permutations under a token budget: a source's rows are dealt to hashed blocks, whole passes
repeat all of them, and the last pass takes blocks in the order of a seeded permutation until the source's quota is used up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.tables import spread_join, stored

BLOCKS = 1024
STEPS = 50


def tokens(text: Column) -> Column:
    """Words of a text: runs of anything but space and 0x09-0x0D."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def weights(sources: DataFrame, target_entropy: float, max_repetition: float, budget: str = "sum") -> DataFrame:
    """(source, tokens, weight, alpha, quota) from (source, tokens). One row per source; sources are assumed far fewer than rows.

    ``budget`` ``sum`` spends as many tokens as there are, ``cover`` as many as give every source one whole pass at least.
    """
    # one row holding every source's tokens: bounded by the number of sources
    whole = sources.where("tokens > 0").agg(F.array_sort(F.collect_list("tokens")).alias("ts"), F.sum("tokens").alias("total"))
    share = F.transform("ts", lambda t: t / F.col("total"))
    spent = lambda ps, a: F.aggregate(ps, F.lit(0.0), lambda s, p: s + F.pow(p, a))
    # H(a) = ln Z - a * sum(p^a ln p) / Z, compared without dividing twice
    spread = lambda ps, a: F.log(spent(ps, a)) - a * F.aggregate(ps, F.lit(0.0), lambda s, p: s + F.pow(p, a) * F.log(p)) / spent(ps, a)
    # the smallest source is repeated most: w(min) / p(min) passes of a budget of all tokens
    passes = lambda ps, a: F.pow(F.element_at(ps, 1), a) / spent(ps, a) / F.element_at(ps, 1)
    even = lambda ps, a: F.pow(F.element_at(ps, 1) / F.element_at(ps, -1), a - 1) if budget == "cover" else passes(ps, a)

    def bisect(good) -> Column:
        """The smallest end of [0, 1] where ``good`` holds going up, by halving."""
        start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
        step = lambda acc, _: F.when(good((acc["lo"] + acc["hi"]) / 2), F.struct(acc["lo"].alias("lo"), ((acc["lo"] + acc["hi"]) / 2).alias("hi"))).otherwise(F.struct(((acc["lo"] + acc["hi"]) / 2).alias("lo"), acc["hi"].alias("hi")))
        return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda acc: acc["hi"])

    rows = whole.where(F.size("ts") > 0).select("total", share.alias("ps"))
    target = F.lit(target_entropy) * F.log(F.size("ps").cast("double"))
    # entropy falls as alpha grows, so "too high" holds below the solution; it is approached from above
    entropy = F.when(spread(F.col("ps"), F.lit(1.0)) >= target, F.lit(1.0)).otherwise(bisect(lambda a: spread(F.col("ps"), a) <= target))
    limit = F.when(even(F.col("ps"), F.lit(0.0)) <= max_repetition, F.lit(0.0)).otherwise(bisect(lambda a: even(F.col("ps"), a) <= max_repetition))
    alpha = rows.select("total", "ps", F.round(F.greatest(entropy, limit), 6).alias("alpha"))
    scale = alpha.select("total", "alpha", spent(F.col("ps"), F.col("alpha")).alias("z"), F.pow(F.element_at("ps", -1), F.col("alpha")).alias("top"), F.element_at("ps", -1).alias("ptop"))
    each = sources.withColumn("k", F.lit(0)).join(F.broadcast(scale.withColumn("k", F.lit(0))), "k", "left")  # one row
    p = F.col("tokens") / F.col("total")
    weight = F.when(F.col("tokens") > 0, F.round(F.pow(p, F.col("alpha")) / F.col("z"), 6)).otherwise(F.lit(0.0))
    spend = F.col("total") if budget == "sum" else F.col("total") * F.col("ptop") / F.round(F.col("top") / F.col("z"), 6)
    quota = F.floor(F.col("w") * spend + F.lit(1e-6)).cast("bigint")
    each = each.withColumn("w", weight)
    if budget == "cover":
        quota = F.greatest(quota, F.col("tokens"))
    return each.select("source", "tokens", F.col("w").alias("weight"), "alpha", F.coalesce(quota, F.lit(0)).cast("bigint").alias("quota"))


def mix(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", target_entropy: float = 0.95, max_repetition: float = 4.0, budget: str = "sum", blocks: int = BLOCKS, seed: int = 1) -> DataFrame:
    """One row per input row: id, ``source``, ``tokens``, ``weight``, ``quota``, ``block``, ``copies`` (times the row is used; 0: not at all).

    A source's copies use at most its quota of tokens, and fall short of it by less than the one row that no longer fits. A null source is a
    source of its own. Rows without tokens cost nothing and are used as often as their source's whole passes (once in a source without tokens). Repeated rows and null ids are rows of their own; their
    order among equal hashes is settled by id, text and a row's place. An empty table gives an empty result; other columns are ignored.
    """
    rows, placed = _layout(df, id_col, text, source, target_entropy, max_repetition, budget, blocks, seed)
    joined = spread_join(_keyed(rows), _keyed(placed), ["source", "block"], ["id", "order"])
    rest = joined.where("state <> 1").withColumn("extra", F.when((F.col("state") == 2) & (F.col("tokens") > 0), 1).otherwise(0))
    out = rest.unionByName(_cut(joined.where("state = 1")))
    return out.select(
        F.col("id").alias(id_col), F.when(F.col("source") != "", F.substring("source", 2, 1 << 30)).alias("source"), "tokens", "weight", "quota", "block", (F.col("passes") + F.col("extra")).alias("copies"),
    )


def _order(id_col: str, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col)))


def _block(order: Column, blocks: int) -> Column:
    return (F.conv(F.substring(order, 1, 8), 16, 10).cast("bigint") % blocks).cast("int")


def _keyed(df: DataFrame) -> DataFrame:
    """Joins need a source that is not null: ``=`` and its name, or nothing."""
    return df.withColumn("source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))


def _cut(rows: DataFrame) -> DataFrame:
    """Only one block of a source is cut: its rows alone are put in order."""
    running = Window.partitionBy("source", "block").orderBy("order", "id", "tokens").rowsBetween(Window.unboundedPreceding, 0)
    fits = (F.sum("tokens").over(running) <= F.col("room")) & (F.col("tokens") > 0)
    return rows.withColumn("extra", fits.cast("int"))


def _layout(df: DataFrame, id_col: str, text: str, source: str, target_entropy: float, max_repetition: float, budget: str, blocks: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their tokens, order and block; and per (source, block) its weight, quota, whole passes and place in the last pass."""
    rows = stored(df.select(F.col(id_col).alias("id"), F.col(source).cast("string").alias("source"), tokens(F.col(text)).alias("tokens"), _order(id_col, seed).alias("order")), "mix-rows")
    rows = rows.withColumn("block", _block(F.col("order"), blocks))
    # sums by (source, block) are made before the shuffle: at most sources x blocks rows
    sums = stored(rows.groupBy("source", "block").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")), "mix-blocks")
    plan = weights(sums.groupBy("source").agg(F.sum("t").alias("tokens")), target_entropy, max_repetition, budget)
    plan = stored(plan.withColumn("passes", F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(F.lit(1)).cast("bigint")).withColumn("rest", F.when(F.col("tokens") > 0, F.col("quota") - F.col("passes") * F.col("tokens")).otherwise(F.lit(0))), "mix-plan")
    # the permutation of the last pass: blocks by a hash of the pass; a window of at most ``blocks`` rows
    perm = F.md5(F.concat_ws("|", F.lit(str(seed)), "source", "block", "passes"))
    plan_of = F.col("b.source").eqNullSafe(F.col("p.source"))
    ahead = Window.partitionBy("source").orderBy("perm", "block").rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.alias("b").join(plan.alias("p"), plan_of).select("b.source", "block", "t", "weight", "quota", "passes", "rest")
    placed = placed.withColumn("perm", perm).withColumn("before", F.coalesce(F.sum("t").over(ahead), F.lit(0)))
    state = F.when(F.col("before") + F.col("t") <= F.col("rest"), 2).when(F.col("before") < F.col("rest"), 1).otherwise(0)
    placed = stored(placed.withColumn("state", state).select("source", "block", "weight", "quota", "passes", F.col("rest") - F.col("before"), "state").toDF("source", "block", "weight", "quota", "passes", "room", "state"), "mix-placed")
    return rows, placed


#: Blocks of all sources that are sent to every task; with more, rows are joined by a salted shuffle.
SENT_BLOCKS = 1 << 17


def mixed(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", target_entropy: float = 0.95, max_repetition: float = 4.0, budget: str = "sum", blocks: int = BLOCKS, seed: int = 1,
) -> DataFrame:
    """The rows of ``df``, all columns, each as often as ``mix`` says.

    Rows learn their copies from their block, so texts stay where they are; only rows of the one cut block of a source are looked up by id, and
    rows with the same id and source fare alike there.
    """
    rows, placed = _layout(df, id_col, text, source, target_entropy, max_repetition, budget, blocks, seed)
    within = _cut(_keyed(rows).join(_keyed(placed.where("state = 1")), ["source", "block"]))
    within = within.groupBy(F.col("id").alias("_id"), "source").agg(F.max(F.col("passes") + F.col("extra")).alias("copies"))
    within = stored(within, "mix-cut")
    order = _order(id_col, seed)
    row = _keyed(df.select(F.struct("*").alias("r"), F.col(source).cast("string").alias("source"), order.alias("order"), _block(order, blocks).alias("block")))
    plan = _keyed(placed).select("source", "block", "passes", "state")
    if placed.count() <= SENT_BLOCKS:
        joined = row.join(F.broadcast(plan), ["source", "block"])
    else:
        joined = spread_join(row, plan, ["source", "block"], ["order"])
    some = F.coalesce(F.col(f"r.{text}").cast("string").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    plain = joined.where("state <> 1").select("r", (F.col("passes") + F.when((F.col("state") == 2) & some, 1).otherwise(0)).alias("copies"))
    looked = joined.where("state = 1").alias("j").join(within.alias("w"), (F.col("j.source") == F.col("w.source")) & F.col(f"j.r.{id_col}").eqNullSafe(F.col("w._id"))).select("j.r", "w.copies")
    both = plain.unionByName(looked).where("copies > 0")
    return both.select("r", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("r.*")

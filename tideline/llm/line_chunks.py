"""Removal of repeated multi-line passages by line chunks (operator 3). DataFrame functions only.

Each line is hashed. Every two neighbouring lines of a document are a chunk, so each repeated passage of two or more lines is made of
repeated chunks wherever it stands and however long it is, and none falls between sampled cuts. Chunks whose hash occurs more than once are compared
byte for byte; the occurrence in the smallest document (then at the first line) stays, the lines of all others are removed.
Blank lines are lines like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.personal_data import let
from tideline.llm.tables import near, spread_join, stored

MIN_LINES = 2


def chunks(hashes: Column) -> Column:
    """(a, b) of the chunks of an array of two line hashes or more; b is exclusive.

    Within a run of equal lines neighbouring pairs would be equal and overlap, and a first occurrence would lose lines to itself:
    there every second pair is a chunk, and the last three lines of an odd run.
    """
    n = F.size(hashes)
    opens = F.zip_with(hashes, F.concat(F.array(F.lit(None).cast("bigint")), F.slice(hashes, F.lit(1), n - 1)), lambda x, before: ~x.eqNullSafe(before))
    starts = F.array_compact(F.transform(opens, lambda new, i: F.when(new, i)))
    # a start's run reaches to the next start
    runs = F.zip_with(starts, F.slice(starts, F.lit(2), F.size(starts)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    span = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))
    none = F.array().cast("array<struct<a:int,b:int>>")

    def inside(r: Column) -> Column:
        """Chunks that begin in the run; the last one reaches into the next run."""
        a, size, last = r["a"], F.coalesce(r["b"], n) - r["a"], r["b"].isNull()
        pairs = F.when(size > 1, F.transform(F.sequence(F.lit(0), F.floor(size / 2).cast("int") - 1), lambda j: span(a + 2 * j, a + 2 * j + 2))).otherwise(none)
        odd = F.when((size > 2) & (size % 2 == 1), F.array(span(a + size - 3, a + size))).otherwise(none)
        return F.concat(pairs, odd, F.when(last, none).otherwise(F.array(span(a + size - 1, a + size + 1))))

    return F.flatten(F.transform(runs, inside))


def documents(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, k, lines): ``k`` numbers a document by id and text, so that null or repeated ids do not mix documents up."""
    t = F.col(text).cast("string")
    return df.select(F.col(id_col).alias("id"), F.xxhash64(id_col, t).alias("k"), F.split(t, "\n", -1).alias("lines"))


def occurrences(docs: DataFrame) -> DataFrame:
    """(id, k, a, b, h): every chunk of every document and a hash of its line hashes."""
    hashed = docs.where(F.size("lines") >= MIN_LINES).select("id", "k", F.transform("lines", lambda x: F.xxhash64(x)).alias("hs"))
    # a chunk of three holds equal lines only, so its ends and size say all
    keyed = F.transform(chunks(F.col("hs")), lambda c: F.struct(c["a"].alias("a"), c["b"].alias("b"), F.xxhash64(F.get("hs", c["a"]), F.get("hs", c["b"] - 1), c["b"] - c["a"]).alias("h")))
    return hashed.select("id", "k", F.explode(keyed).alias("c")).select("id", "k", "c.a", "c.b", "c.h")


def bodies(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` (id, k, a, b, h) with the chunks' bytes; only documents that have a chunk in it move their text."""
    lists = stored(found.groupBy("id", "k").agg(F.collect_set(F.struct("a", "b", "h")).alias("cs")), "chunk-lists")  # of one document
    same = F.col("d.k") == F.col("l.k")
    met = near(docs, lists, ["k"])[0].alias("d").join(lists.alias("l"), same & F.col("d.id").eqNullSafe(F.col("l.id")))
    body = F.transform("l.cs", lambda c: F.struct(c["a"].alias("a"), c["b"].alias("b"), c["h"].alias("h"), F.array_join(F.slice("d.lines", c["a"] + 1, c["b"] - c["a"]), "\n").alias("body")))
    return met.select("d.id", "d.k", F.explode(body).alias("c")).select("id", "k", "c.a", "c.b", "c.h", "c.body")


def repeated(docs: DataFrame) -> DataFrame:
    """(id, k, a, b): line ranges to remove. The first occurrence of equal bytes, by (id, k, a) with null ids last, is not among them."""
    keys = occurrences(docs).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    keys = stored(keys, "chunk-keys")
    some = near(occurrences(docs), keys, ["h"])[0].join(keys, "h", "left_semi")
    found = stored(bodies(docs, some), "chunks")
    # equal bytes meet before the shuffle; hashes that collide part here
    place = F.struct(F.col("id").isNull().alias("z"), "id", "k", "a")
    first = stored(found.groupBy("h", "body").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "body", "first"), "chunk-firsts")
    joined = spread_join(found, first, ["h", "body"], ["k", "a"])
    return joined.where(place != F.col("first")).select("id", "k", "a", "b")


def deduplicate_lines(df: DataFrame, id_col: str = "doc_id", text: str = "text", size_col: str | None = None, marks: bool = False) -> DataFrame:
    """``df`` with repeated chunks removed from ``text``; ``size_col``, if given, becomes the new text's length. All columns stay.

    With ``marks`` the columns ``_removed`` (line numbers) and ``_lines`` (lines there were) are added. Null and one-line texts stay as they are; a text
    wholly removed becomes empty. Rows with the same id and text are one document and change alike. Documents with null ids never hold the first
    occurrence while one with an id has the chunk. An empty table stays empty.
    """
    gone = repeated(documents(df, id_col, text))
    lines = gone.select("id", "k", F.explode(F.sequence(F.col("a"), F.col("b") - 1)).alias("i")).groupBy("id", "k").agg(F.collect_set("i").alias("gone"))
    lines = stored(lines, "removed")
    row = df.select(F.struct("*").alias("r"), F.xxhash64(id_col, F.col(text).cast("string")).alias("k"))
    touched, rest = near(row, lines, ["k"])
    met = touched.alias("d").join(lines.alias("l"), (F.col("d.k") == F.col("l.k")) & F.col(f"d.r.{id_col}").eqNullSafe(F.col("l.id")), "left").select("d.r", "l.gone")
    out = met.unionByName(rest.select("r", F.lit(None).cast("array<int>").alias("gone")))
    split = F.split(F.col(f"r.{text}"), "\n", -1)
    # the kept numbers come from one hash set, and the lines are split once: a long document takes time in proportion to its lines
    kept = lambda xs: F.array_except(F.sequence(F.lit(0), F.size(xs) - 1), F.col("gone"))
    left = let(split, lambda xs: F.array_join(F.transform(kept(xs), lambda i: F.get(xs, i)), "\n"))
    new = F.when(F.col("gone").isNull(), F.col(f"r.{text}")).otherwise(left)
    cols = []
    for c in df.columns:
        kind = df.schema[c].dataType
        if c == text:
            cols.append(new.cast(kind).alias(c))
        elif c == size_col:
            cols.append(F.when(F.col("gone").isNull(), F.col(f"r.{c}")).otherwise(F.length(new)).cast(kind).alias(c))
        else:
            cols.append(F.col(f"r.{c}").alias(c))
    if marks:
        cols += [F.coalesce(F.array_sort("gone"), F.expr("array()").cast("array<int>")).alias("_removed"), F.coalesce(F.size(split), F.lit(0)).alias("_lines")]
    return out.select(*cols)

"""A corpus from raw documents to pieces: five stages, each written as Parquet and read again by the next.

Stages 1 to 4 return the columns of documents; the last adds the ids. Stage 4 mixes with a budget that gives every source one whole pass
at least, so no document that the filters keep is lost; small sources are repeated at most twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import chosen_path, line_chunks, mixing, pieces, queries, rule_cascade
from tideline.llm.tables import near, stored


#: Rows of an Arrow batch. A Python worker and its executor hold a few batches each, and texts of one batch may be long.
BATCH_ROWS = "1000"


def small_batches(spark: SparkSession) -> None:
    """The session's Arrow batches, for stages with Python workers, hold at most ``BATCH_ROWS`` rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= int(BATCH_ROWS):
        spark.conf.set(name, BATCH_ROWS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go; null and empty texts are judged as texts without words, repeated rows alike."""
    small_batches(spark)
    return rule_cascade.passing(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated multi-line passages go from the texts, and documents that held nothing else go too; ``n_chars`` follows."""
    out = line_chunks.deduplicate_lines(docs, size_col="n_chars" if "n_chars" in docs.columns else None, marks=True)
    left = (F.size("_removed") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    return out.where(left).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies one row stays: of those with the smallest id one, and a row without an id only where the class has none with one.

    Rows are told apart by (id, text), so rows that share an id are judged by their own texts. Texts without a word are no copies; of repeated ones one row
    of each id stays, and all without an id.
    """
    small_batches(spark)
    t = F.col("text").cast("string")
    key = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("i"), F.xxhash64(t).alias("h"))
    found = chosen_path.similar(docs.select(key.alias("_id"), t.alias("text")), id_col="_id")
    found = stored(found.groupBy("_id", "class_id").agg(F.count(F.lit(1)).alias("n")), "classes")
    gone = F.col("_id") != F.col("class_id")
    met = stored(found.where(gone | (F.col("n") > 1)).select("_id", gone.alias("gone")), "near-copies")
    row = docs.select(F.struct("*").alias("r"), key.alias("_id"))
    some, rest = near(row, met, ["_id"])
    told = some.join(met, "_id", "left")
    wordless = F.col("_id.z") & ~F.coalesce(F.col("r.text").cast("string"), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    alone = F.col("gone").isNull() | wordless
    # repeated rows of one key: the least stays, found before the shuffle
    once = told.where(~alone & ~F.col("gone")).groupBy("_id").agg(F.min("r").alias("r"))
    out = told.where(alone).select("r").unionByName(once.select("r")).unionByName(rest.select("r"))
    return out.select("r.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are repeated as the sources' weights ask."""
    return mixing.mixed(docs, target_entropy=queries.TARGET_ENTROPY, max_repetition=2.0, budget="cover")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, in place of the text."""
    small_batches(spark)
    out = pieces.encode(docs.select("doc_id", "lang", "source", "text"), queries.TOKENIZER)
    return out.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_ids"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality), ("line_dedup", lines), ("ngram_jaccard_join", near_duplicates), ("mixing", mix), ("sentencepiece", encode),
]
#: SQL has neither the rolling hashes, the chosen paths nor the pieces; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

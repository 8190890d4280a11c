"""Registered queries of the operators: each runs one operator with its production parameters over whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import chosen_path, hash_index, line_chunks, merkle_manifest, mixing, noisy_channel, oracles, periodic_runs, personal_data, pieces, rank_profiles, rule_cascade, tool_calls, url_filters

#: Where the public tokenizer files lie; a parameter of operator 8.
TOKENIZER = os.environ.get("TIDELINE_TOKENIZER", "/opt/tokenizers/piece_bpe_32k.model")
TARGET_ENTROPY, MAX_REPETITION = 0.95, 4.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_col: str = "doc_id") -> Column:
    return ~noisy_channel.training(F.col(id_col))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a fetch time derived from their number: one every 37 minutes, round and round over 300 days."""
    minutes = (F.col("page_id") * 37) % (300 * 1440)
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int"), F.lit(0).cast("decimal(18,6)"))
    return table(spark, sf_dir, "pages").select("page_id", "url", at.alias("fetched_at"))


def list_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated list entries derived from the hosts of the pages; which hosts are listed, and when, follows from a host's first page."""
    pages = table(spark, sf_dir, "pages").select("page_id", url_filters.host(F.col("url")).alias("host"), url_filters.address(F.col("url")).alias("address"))
    hosts = pages.where("host <> ''").groupBy("host").agg(F.min("page_id").alias("m"), F.min_by("address", F.struct("page_id", "address")).alias("first"))
    day = lambda d: F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(d.cast("int"))

    def entry(name: str, verdict: str, pattern: Column, when: Column, action: str, where: str) -> DataFrame:
        return hosts.where(where).select(F.lit(name).alias("list"), F.lit(verdict).alias("verdict"), pattern.alias("pattern"), day(when).alias("at"), F.lit(action).alias("action"))

    m, host = F.col("m"), F.col("host")
    parent = F.concat(F.lit("d:"), F.regexp_replace(host, "^[^.]*[.]", ""))
    parts = [
        entry("abuse", "block", F.concat(F.lit("d:"), host), m % 200, "add", "m % 7 < 3"),
        entry("abuse", "block", F.concat(F.lit("d:"), host), m % 200 + 60, "remove", "m % 7 < 3 and m % 3 = 0"),
        entry("abuse", "block", F.concat(F.lit("d:"), host), m % 200 + 90, "add", "m % 7 < 3 and m % 6 = 0"),
        entry("regional", "block", parent, m % 50 + 20, "add", "host like '%.%.%.%' and m % 5 = 1"),
        entry("regional", "block", parent, m % 50 + 90, "remove", "host like '%.%.%.%' and m % 5 = 1"),
        entry("paths", "block", F.concat(F.lit("p:"), host, F.lit("/de")), m % 100, "add", "m % 4 = 0"),
        # up to three folders of the host's first page
        entry("deep", "block", F.concat(F.lit("p:"), F.array_join(F.slice(F.split("first", "/"), 1, 4), "/")), m % 120, "add", "m % 3 = 1 and first like '%/%'"),
        entry("trusted", "allow", F.concat(F.lit("d:"), host), m % 100 + 30, "add", "m % 7 = 1"),
        entry("trusted", "allow", F.concat(F.lit("d:"), host), m % 100 + 150, "remove", "m % 14 = 1"),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(captures(spark, sf_dir), list_entries(spark, sf_dir))


def op2_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.similar(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = line_chunks.deduplicate_lines(docs.select("doc_id", "text"), marks=True)
    return out.select("doc_id", F.col("_lines").cast("bigint").alias("n_lines"), F.size("_removed").cast("bigint").alias("n_removed"), F.col("_removed").alias("removed_lines"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    known = noisy_channel.training(F.col("doc_id"))
    chars = noisy_channel.learn_chars(docs.where(known))
    evidence = noisy_channel.learn_evidence(docs.where(known), labels.where(known), chars)
    out = noisy_channel.score(docs, chars, evidence)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_evidence", "strongest")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_index.deduplicate(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), target_entropy=TARGET_ENTROPY, max_repetition=MAX_REPETITION)
    return out.withColumn("block", F.col("block").cast("bigint"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    out = rule_cascade.apply_rules(table(spark, sf_dir, "documents"), measures=base)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.select("doc_id", *base, failed.alias("base_failed"), (~failed & F.col("passed")).alias("kept"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), TOKENIZER)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = rank_profiles.profiles(docs, where=noisy_channel.training(F.col("doc_id")))
    out = rank_profiles.identify(docs, learned)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "distance")


#: Tools that the derived calls use, with the schema of their arguments.
SCHEMAS = {
    "search": {"type": "object", "properties": {"query": {"type": "string", "minLength": 1, "maxLength": 60}, "limit": {"type": "integer", "minimum": 1, "maximum": 50}}, "required": ["query", "limit"], "additionalProperties": False},
    "fetch": {"type": "object", "properties": {"page": {"type": "integer", "minimum": 0}, "mode": {"enum": ["text", "html"]}}, "required": ["page"], "additionalProperties": False},
    "note": {"type": "object", "properties": {"words": {"type": "array", "items": {"type": "string", "minLength": 2}}}, "required": ["words"]},
}


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as messages with tool calls derived from their turns.

    An assistant turn makes a call, the user turn behind it is its result, and a call waits for the assistant turn before it. In some
    conversations results are missing, calls wait for later ones, or arguments break their schema.
    """
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    words = F.split(F.coalesce("text", F.lit("")), "[ \n]+", 4)  # three words and the rest
    n = F.length(F.coalesce("text", F.lit("")))
    assistant = (F.col("role") == "assistant") & F.col("turn").isNotNull()
    number = lambda x: F.concat(F.lit("c"), x.cast("string"))
    tool = F.element_at(F.array(*map(F.lit, ["search", "fetch", "note", "shell"])), (n % 4 + 1).cast("int"))
    quoted = lambda x: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(x, "\\\\", "\\\\\\\\"), '"', '\\\\"'), F.lit('"'))
    args = (
        F.when(n % 4 == 0, F.concat(F.lit('{"query": '), quoted(F.element_at(words, 1)), F.lit(', "limit": '), (n % 60).cast("string"), F.lit("}")))
        .when(n % 4 == 1, F.concat(F.lit('{"page": '), F.col("turn").cast("string"), F.lit(', "mode": "'), F.when(n % 3 == 0, "pdf").otherwise("text"), F.lit('"}')))
        .when(n % 4 == 2, F.concat(F.lit('{"words":  ['), F.array_join(F.transform(F.slice(words, 1, 3), quoted), ", "), F.lit("]}"))).otherwise(F.lit("{not json"))
    )
    after = F.when((F.col("conv_id") % 97 == 0) & (F.col("turn") == 1), number(F.col("turn") + 2)).when(F.col("turn") >= 3, number(F.col("turn") - 2))
    result = (F.col("role") == "user") & (F.col("turn") > 0) & (F.col("conv_id") % 11 != 0)
    return c.select(
        F.col("conv_id").alias("conv"), F.col("turn"), "role", "text", F.when(assistant, number(F.col("turn"))).alias("call"), F.when(assistant, tool).alias("tool"),
        F.when(assistant, args).alias("arguments"), F.when(assistant, after).alias("after"), F.when(result, number(F.col("turn") - 1)).alias("result_of"),
    )


def op10_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tool_calls.link(messages(spark, sf_dir), SCHEMAS)
    return out.select(F.col("conv").alias("conv_id"), "turn", "kind", "call", "status", "depth", "place", "json")


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.digest(personal_data.find(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    # tampering adds 1 to the number of characters of every seventh id by its crc32
    struck = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    altered = merkle_manifest.leaf_hash(*(F.col(c) + struck.cast("int") if c == "n_chars" else F.col(c) for c in fields))
    return merkle_manifest.verify(merkle_manifest.manifest(docs, fields, "lang", ["doc_id"], altered=altered))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_url_filters, op2_chosen_path_join, op3_line_dedup, op4_toxicity, op5_exact_dedup, op6_mixing, op7_quality_rules, op8_sentencepiece, op9_language_id, op10_tool_calls, op11_pii, op12_periodic_runs, op13_merkle_manifest)
}
ORACLES: dict[str, str] = dict(oracles.ORACLES)

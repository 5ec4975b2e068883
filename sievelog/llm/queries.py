"""Registered queries of the operators: thin, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup as exact
from . import language_id as lid
from . import line_dedup as lines
from . import near_dedup as near
from . import packing, quality, sharding, warc
from . import substring_dedup as substrings
from .decontaminate import find_leaks
from .sql import SQL

#: Name of the tokenizer file in the folder of public tokenizers.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Place of a vocabulary file that every machine has."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.learn(docs, labels.where(~lid.held_out(F.col("doc_id"), 5, 0)))
    scored = quality.score(docs.withColumn("held_out", lid.held_out(F.col("doc_id"), 5, 0)), model, keep="held_out")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prototypes = lid.learn_prototypes(docs.where(~lid.held_out(F.col("doc_id"), 3, 1)))
    return lid.identify(docs.withColumn("held_out", lid.held_out(F.col("doc_id"), 3, 1)), prototypes, keep="held_out")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents"), digest=True)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.dedup_substrings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    best = F.max(F.struct("score", "word_from", "word_to", "seeds"))
    return found.groupBy("doc_id", "item_id").agg(F.count("*").alias("passages"), best.alias("best")).select("doc_id", "item_id", "passages", "best.*")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, index = warc.write_warc(table(spark, sf_dir, "pages"))
    read = warc.read_warc(folder, index)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_dedup(table(spark, sf_dir, "documents"), words=3)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_quality": op2_quality,
    "op3_language_id": op3_language_id,
    "op4_sharding": op4_sharding,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_decontaminate": op7_decontaminate,
    "op8_warc": op8_warc,
    "op9_line_dedup": op9_line_dedup,
    "op10_near_dedup": op10_near_dedup,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, sql in SQL.items() if name in QUERIES}

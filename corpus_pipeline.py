"""A corpus pipeline: language ID, exact dedup, near dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``.  All but the last
return the columns of ``documents``.

Defined cases, of every stage: decisions are taken row by row, so rows that
repeat a doc_id or have none are documents of their own, of which one stays if
their texts are equal or near; a null text counts as empty, has no language and
goes with the first stage; nulls in other columns are kept; an empty table gives
an empty one; further columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelog.llm.decontaminate import decontaminate
from sievelog.llm.exact_dedup import exact_dedup
from sievelog.llm.language_id import identified, learn_prototypes
from sievelog.llm.near_dedup import near_dedup
from sievelog.llm.packing import pack
from sievelog.llm.queries import tokenizer_path
from sievelog.llm.shared import ORD, new_folder, remove_folder, with_order

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _kept(docs: DataFrame, judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of ``docs`` that ``judge`` keeps; it gets texts with a number of the row's own as the id."""
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("_doc")  # whatever the columns are called
    rows, _ = with_order(docs, "doc_id", docs["text"].alias("text"), whole)
    gone = judge(rows.select(ORD, "text")).where("not kept").select(F.col("doc_id").alias("_gone"))
    return rows.join(gone, rows[ORD] == gone["_gone"], "left_anti").select("_doc.*")


#: (letters, score): texts of fewer than 40 letters are too short to tell from chance and stay; longer ones score
#: above the chance matches of 1024 dimensions, and from 80 letters on above random letters too.
LEAST = ((0, -1.0), (40, 0.1), (80, 0.18))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or unlike every learned language, go."""
    return identified(docs, learn_prototypes(docs, dims=1024), least=LEAST, dims=1024)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts stays; only texts that share length and prefix are hashed in full."""
    return _kept(docs, lambda rows: exact_dedup(rows, id_col=ORD))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8 or more."""
    return _kept(docs, lambda rows: near_dedup(rows, id_col=ORD, words=5, similarity=(80, 100), bands=32, rows=5))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents and their places in sequences of 4096 ids."""
    return pack(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("language ID", language),
    ("exact dedup", exact),
    ("MinHash near-dedup", near),
    ("benchmark decontamination", benchmark),
    ("packing", packing),
]

#: SQL can't express the language model; the tests use brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's files are deleted once the next one's are written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        folder = new_folder(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if last is not None:
            remove_folder(spark, last)
        last = folder
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}

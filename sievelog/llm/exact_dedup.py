"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Only DataFrame functions.  Texts are equal when identical without the
characters ``[\\x20\\x09-\\x0D]``.  Each level drops the rows that are alone in
their group, so the full hash is grouped for surviving groups only.

Defined cases: null text is the empty text; empty texts equal each other;
rows that repeat a doc_id are rows of their own, of which one stays if their
texts are equal; a null doc_id sorts last; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ORD, checkpoint, with_order

SPACES = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text without white space; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def exact_dedup(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64, digest: bool = False
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept and, with ``digest``, text_sha256.

    Of equal texts the row with the most code points, then the smallest id
    stays.  Without ``digest`` the full content is read and hashed for rows of
    surviving (length, prefix) groups only; with it every row's hash is part
    of the result and is taken in the first scan.
    """
    rows, _ = with_order(docs, id_col, F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    norm = normalised(F.col("text"))
    keyed = checkpoint(
        rows.select(
            ORD,
            "doc_id",
            F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"),
            F.length(norm).alias("n_norm"),
            F.xxhash64(F.substring(norm, 1, prefix)).alias("head"),
            *([F.sha2(norm, 256).alias("full")] if digest else []),
        )
    )

    # keys are counted before they are dealt out, so a length or prefix that most rows share is a row per task
    lengths = keyed.groupBy("n_norm").agg(F.count("*").alias("n")).where("n > 1").select("n_norm")
    prefixes = keyed.groupBy("n_norm", "head").agg(F.count("*").alias("n"))
    heads = prefixes.join(lengths, "n_norm", "left_semi").where("n > 1").select("n_norm", "head")
    # the small sides are checkpoints, so that each join deals both sides itself and Spark can split a hot key
    heads = checkpoint(heads)
    alive = keyed.join(heads, ["n_norm", "head"], "left_semi")
    if not digest:
        alive = checkpoint(rows.select(ORD, "text").join(alive, ORD).select(ORD, "doc_id", "n_chars", "n_norm", F.sha2(norm, 256).alias("full")))
    best = F.min(F.struct((-F.col("n_chars")).alias("n"), ORD, "doc_id")).alias("best")
    groups = (
        alive.groupBy("n_norm", "full")
        .agg(F.count("*").alias("group_size"), best)
        .where("group_size > 1")
        .select("n_norm", "full", "group_size", F.col("best.doc_id").alias("keep_id"), F.col(f"best.{ORD}").alias("keep_ord"))
    )
    groups = checkpoint(groups)
    if digest:
        found = keyed.join(groups, ["n_norm", "full"], "left")
    else:
        grouped = alive.join(groups, ["n_norm", "full"]).select(ORD, "group_size", "keep_id", "keep_ord")
        found = keyed.select(ORD, "doc_id").join(grouped, ORD, "left")
    return found.select(
        "doc_id",
        F.when(F.col("keep_ord").isNotNull(), F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("keep_ord") == F.col(ORD), F.lit(True)).alias("kept"),
        *([F.col("full").alias("text_sha256")] if digest else []),
    )

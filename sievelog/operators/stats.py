"""Statistics of templates: per cluster and run, frozen by text, filtered and ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ALERTS, LEVELS
from ..functions.levels import most_severe, rank
from ..functions.tokens import template_id

LEVEL_COLUMNS = [f"n_{name.lower()}" for name in LEVELS]


def level_counts(level: str | Column = "level") -> list[Column]:
    """One conditional count per level; records without a level are in none."""
    level = F.col(level) if isinstance(level, str) else level
    return [F.count(F.when(level == name, 1)).alias(column) for name, column in zip(LEVELS, LEVEL_COLUMNS, strict=True)]


def per_template(records: DataFrame, keys: list[str]) -> DataFrame:
    """Count, first and last time, levels and the first message for each key."""
    return records.groupBy(*keys).agg(
        F.count("*").alias("count"),
        F.min("ts_micros").alias("first"),
        F.max("ts_micros").alias("last"),
        *level_counts(),
        F.min_by("message", "ord").alias("example"),
        F.min("ord").alias("first_ord"),
    )


def merge(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Add up statistics of the same keys; the example is the earliest."""
    return stats.groupBy(*keys).agg(
        F.sum("count").alias("count"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        *[F.sum(c).alias(c) for c in LEVEL_COLUMNS],
        F.min_by("example", "first_ord").alias("example"),
        F.min("first_ord").alias("first_ord"),
    )


def freeze(stats: DataFrame) -> DataFrame:
    """Templates of the same text as one, with id and most severe level; ``run`` stays a key."""
    merged = merge(stats, ["text", "run"])
    severe = most_severe({name: F.col(c) for name, c in zip(LEVELS, LEVEL_COLUMNS, strict=True)})
    return merged.select(template_id(F.col("text")).alias("id"), "*", severe.alias("level")).where("count > 0")


def ranked(templates: DataFrame, k: int | None = None) -> DataFrame:
    """Most frequent first, ties by the bytes of the text; with ``k`` only so many."""
    out = templates.orderBy(F.desc("count"), F.asc("text"))
    return out if k is None else out.limit(k)


def only(templates: DataFrame, *, min_level: str | None = None, min_count: int = 0) -> DataFrame:
    """Templates at least so severe and so frequent."""
    out = templates.where(F.col("count") >= min_count)
    return out.where(rank(F.col("level")) >= LEVELS.index(min_level)) if min_level else out


def is_alert(level: Column) -> Column:
    return F.coalesce(level.isin(*ALERTS), F.lit(False))


def level_totals(templates: DataFrame) -> DataFrame:
    """Records of each level over all templates."""
    sums = templates.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in LEVEL_COLUMNS])
    pairs = F.array(*[F.struct(F.lit(name).alias("level"), F.col(c).alias("records")) for name, c in zip(LEVELS, LEVEL_COLUMNS, strict=True)])
    return sums.select(F.inline(pairs))

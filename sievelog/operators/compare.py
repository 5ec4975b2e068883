"""Comparison of two runs: full outer join on the template text, classification, G-test, baselines.

Input frames have one row per template: text, count, first, last, n_<level>
columns and example.  Paired templates come from a matcher (see ``matchers``).
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import LEVELS, DiffConfig
from ..functions.levels import most_severe
from ..functions.tokens import template_id
from .stats import LEVEL_COLUMNS


def critical_g(significance: float) -> float:
    """G above which ``erfc(sqrt(G / 2)) <= significance``, by bisection."""
    low, high = 0.0, 2000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if math.erfc(math.sqrt(mid / 2)) > significance else (low, mid)
    return high


def g_statistic(a: Column, b: Column, records_a: Column, records_b: Column) -> Column:
    """G of the table (template, rest) x (run a, run b); empty cells add nothing."""
    zero = F.lit(0.0)
    cells = [[a, b], [F.greatest(records_a - a, F.lit(0)), F.greatest(records_b - b, F.lit(0))]]
    cells = [[c.cast("double") for c in row] for row in cells]
    columns = [cells[0][k] + cells[1][k] for k in (0, 1)]
    total, out = columns[0] + columns[1], zero
    for row in cells:
        across = row[0] + row[1]
        for k in (0, 1):
            out = out + F.when(row[k] > 0, row[k] * F.ln(row[k] * total / (across * columns[k]))).otherwise(zero)
    return F.greatest(out * 2, zero)


@F.pandas_udf(T.DoubleType())
def p_of_g(g: pd.Series) -> pd.Series:
    """p value of a G statistic with one degree of freedom, to 6 significant digits."""
    return g.map(lambda x: None if x is None or x != x else float(f"{math.erfc(math.sqrt(max(x, 0.0) / 2)):.6g}"))


def joined(before: DataFrame, after: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Full outer join on text; with ``pairs`` (before_text, after_text) a text of the first run is renamed first."""
    columns = ["count", "first", "last", *LEVEL_COLUMNS, "example"]
    left = before.where("count > 0")
    if pairs is not None:
        renamed = pairs.withColumnRenamed("before_text", "text")
        left = left.join(renamed, "text", "left").withColumn("text", F.coalesce("after_text", "text")).drop("after_text")
    left = left.select("text", *[F.col(c).alias(f"before_{c}") for c in columns])
    right = after.where("count > 0").select("text", *[F.col(c).alias(f"after_{c}") for c in columns])
    return left.join(right, "text", "full_outer")


def classify(both: DataFrame, before_records: int, after_records: int, config: DiffConfig | None = None) -> DataFrame:
    """A row per template: category (new, disappeared, changed, unchanged), counts, shares, ratio, factor, levels, score.

    A ``changed`` template that the significance refuses is ``unchanged``;
    without a level of significance score stays null.  Rare new or
    disappeared templates have category null.
    """
    config = config or DiffConfig()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    b, a = zero("before_count"), zero("after_count")
    share = lambda n, total: n / F.lit(float(total)) if total else F.lit(0.0)
    share_b, share_a = share(b, before_records), share(a, after_records)
    ratio = F.when((a > 0) & (b > 0) & (share_b > 0), share_a / share_b)
    factor = F.when(ratio.isNull() | (ratio == 0), F.lit(1.0)).otherwise(F.greatest(ratio, F.lit(1.0) / ratio))
    g = F.round(g_statistic(b, a, F.lit(before_records), F.lit(after_records)), 6)
    changed = (F.greatest(b, a) >= config.min_count) & (factor >= config.threshold_ratio)
    if config.significance is not None:
        changed &= g_statistic(b, a, F.lit(before_records), F.lit(after_records)) >= critical_g(config.significance)
    category = (
        F.when((a > 0) & (b > 0), F.when(changed, "changed").otherwise("unchanged"))
        .when((a > 0) & (a >= config.min_new_count), "new")
        .when((b > 0) & (b >= config.min_new_count), "disappeared")
    )
    levels = {name: zero(f"before_{c}") + zero(f"after_{c}") for name, c in zip(LEVELS, LEVEL_COLUMNS, strict=True)}
    newer = lambda c: F.when(a > 0, F.col(f"after_{c}")).otherwise(F.col(f"before_{c}"))
    tested = (a > 0) & (b > 0) & F.lit(config.significance is not None)
    return both.select(
        template_id(F.col("text")).alias("id"), "text", category.alias("category"), b.alias("before_count"), a.alias("after_count"),
        share_b.alias("before_share"), share_a.alias("after_share"), ratio.alias("ratio"), factor.alias("factor"),
        F.when(tested, g).alias("score"), most_severe(levels).alias("level"),
        *[levels[name].alias(c) for name, c in zip(LEVELS, LEVEL_COLUMNS, strict=True)],
        newer("first").alias("first"), newer("last").alias("last"), newer("example").alias("example"),
    )


def with_p(entries: DataFrame) -> DataFrame:
    """Add the p value of the changed templates."""
    return entries.withColumn("p", F.when(F.col("category") == "changed", p_of_g(F.col("score"))))


def ordered(entries: DataFrame, category: str) -> DataFrame:
    """One category in report order."""
    own = entries.where(F.col("category") == category)
    if category == "changed":
        largest = F.greatest("before_count", "after_count")
        return own.orderBy(F.desc(F.coalesce("score", "factor")), F.desc(largest), F.asc("text"))
    return own.orderBy(F.desc("after_count" if category == "new" else "before_count"), F.asc("text"))


def pool_baselines(stats: DataFrame, min_baselines: int | None, baselines: int) -> tuple[DataFrame, DataFrame]:
    """(pooled, unstable texts): statistics of several first runs as one.

    ``stats`` has a row per (text, run).  A template seen in some baselines, but
    fewer than ``min_baselines`` (default all), is unstable and left out.
    """
    need = baselines if min_baselines is None else min(min_baselines, baselines)
    pooled = stats.where("count > 0").groupBy("text").agg(
        F.sum("count").alias("count"), F.min("first").alias("first"), F.max("last").alias("last"),
        *[F.sum(c).alias(c) for c in LEVEL_COLUMNS], F.min_by("example", "run").alias("example"), F.countDistinct("run").alias("seen"),
    )
    return pooled.where(F.col("seen") >= need).drop("seen"), pooled.where(F.col("seen") < need).select("text")

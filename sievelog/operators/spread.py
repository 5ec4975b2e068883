"""Even work from uneven files."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(rows: DataFrame, key: str = "ord") -> DataFrame:
    """Rows of a scan with fewer splits than half the cores, dealt to all cores.

    A table in one small file is read by one task, which would then mask it all
    by itself.  Plans with an exchange, and scans with splits enough, are left alone.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    plan = rows._jdf.queryExecution().executedPlan()
    if "Exchange" in plan.toString() or plan.execute().getNumPartitions() * 2 > cores:
        return rows
    return rows.repartition(cores, key)

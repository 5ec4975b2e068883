"""Helpers shared by the operators: the shared folder, checkpoints, row numbers and ranks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: A whole number of each row's own, see ``with_order``.
ORD = "_ord"


def shared_folder(spark: SparkSession) -> str:
    """Folder that the driver and all executors see (``spark.checkpoint.dir``).

    Only in local mode, as in tests, one is made where none is named.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = getattr(spark.sparkContext, "_sievelog_folder", None)
        if base is None:
            base = f"file://{tempfile.mkdtemp(prefix='sievelog-')}"
            spark.sparkContext._sievelog_folder = base
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder below the shared one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def with_order(docs: DataFrame, id_col: str, *columns: Column) -> tuple[DataFrame, bool]:
    """(the columns and ``_ord``, whether it is the id): a whole number of each row's own that sorts like the id, nulls last.

    Ids that are unique and not null serve as they are.  Else rows of one id
    are told apart by their places in the files they are read from or, where
    they are read from none, in a copy that is written to the shared folder.
    """
    plain = docs.select(*columns, F.col(id_col).cast("long").alias(ORD))
    if id_col == ORD or plain.groupBy(ORD).agg(F.count("*").alias("n")).where(F.col(ORD).isNull() | (F.col("n") > 1)).limit(1).isEmpty():
        return plain, True

    def placed(df: DataFrame, *chosen: Column) -> DataFrame:
        place = df.metadataColumn("_metadata")
        return df.select(*chosen, F.xxhash64(place["file_path"]).alias("_file"), place["row_index"].alias("_row"))

    try:
        rows = placed(docs, *columns, F.col(id_col).cast("long").alias("_id"))
    except AnalysisException:
        folder = new_folder(docs.sparkSession, "rows")
        plain.withColumnRenamed(ORD, "_id").write.parquet(folder)
        copy = docs.sparkSession.read.parquet(folder)
        rows = placed(copy, *copy.columns)
    order = [F.col("_id").asc_nulls_last(), F.col("_file"), F.col("_row")]
    sorted_rows = rows.select("_id", "_file", "_row").repartitionByRange(*order).sortWithinPartitions(*order)
    numbers = checkpoint(sorted_rows.select("_file", "_row", F.monotonically_increasing_id().alias(ORD)))
    return rows.drop("_id").join(numbers, ["_file", "_row"]).drop("_file", "_row"), False


def salts_for(rows: int) -> int:
    """Salts that hold a window group near a million rows even if one key has them all."""
    return max(16, min(1 << 16, rows >> 20))


def salted_rank(df: DataFrame, keys: list[str], order: list[str], out: str, salts: int) -> DataFrame:
    """Add ``out``: the gapless rank from 0 of each row among the rows of its keys.

    A key's rows are dealt to ``salts`` groups, ranked there, and shifted by
    the sizes of the groups before, so no key has to fit one task.  ``df``
    should be a checkpoint, since it is read twice.
    """
    salt: Column = F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int")
    salted = df.withColumn("_salt", salt)
    group = [*keys, "_salt"]
    sizes = salted.groupBy(*group).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy(*group).orderBy(*order)
    ranked = salted.withColumn("_rank", F.row_number().over(within) - 1)
    return (
        ranked.join(bases, group)
        .withColumn(out, (F.col("_base") + F.col("_rank")).cast("long"))
        .drop("_salt", "_rank", "_base")
    )

"""Lines of log files as a DataFrame with a total order.

Columns: run, file, ord, line.  ``ord`` packs the run, the number of the file,
the split and the row there into one long, so that it sorts like the input
whatever the partitions.  How many bits a part has follows from the sizes of
splits and partitions that the session allows; a file has at most 1 TiB.
"""

from __future__ import annotations

import atexit
import gzip
import re
import shutil
import sys
import tempfile
from collections.abc import Sequence
from pathlib import Path
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tokens import cut_bytes

MAX_LINE_BYTES = 16 << 20
GZIP, ZSTD = b"\x1f\x8b", b"\x28\xb5\x2f\xfd"
FILE_SIZE_BITS, RUN_BIT = 40, 62
#: Bits of a line's place in a text, see ``lines_of``.
ROW_BITS = 27
_UNITS = {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}


def _unpacked(source: BinaryIO, spark: SparkSession | None) -> str:
    """A copy that all machines can read (below ``spark.checkpoint.dir``, where that is a local path), removed when the driver ends."""
    shared = (spark.conf.get("spark.checkpoint.dir", None) if spark else None) or ""
    folder = shared.removeprefix("file://") if shared.startswith(("file:///", "/")) else None
    if folder:
        Path(folder).mkdir(parents=True, exist_ok=True)
    with tempfile.NamedTemporaryFile(prefix="log-", suffix=".log", delete=False, dir=folder) as out:
        shutil.copyfileobj(source, out)
    atexit.register(Path(out.name).unlink, missing_ok=True)
    return out.name


def sniffed(path: str, spark: SparkSession | None = None) -> str:
    """A path that Spark reads by suffix: compression is told by the first bytes, not the name."""
    if path == "-":
        return _unpacked(sys.stdin.buffer, spark)
    local = Path(path.removeprefix("file://"))
    if not local.is_file():
        return path  # a folder, a pattern or another store
    with local.open("rb") as file:
        head = file.read(4)
    if head.startswith(GZIP) and local.suffix != ".gz":
        with gzip.open(local) as packed:
            return _unpacked(packed, spark)
    if head.startswith(ZSTD):  # Spark reads .zst only with a native library
        import zstandard

        with local.open("rb") as packed, zstandard.ZstdDecompressor().stream_reader(packed, read_across_frames=True) as plain:
            return _unpacked(plain, spark)
    return path


@F.pandas_udf(T.StringType())
def _cut(lines: pd.Series) -> pd.Series:
    return lines.map(lambda x: cut_bytes(x, MAX_LINE_BYTES))


def _bytes(spark: SparkSession, name: str) -> int:
    m = re.fullmatch(r"(\d+)([kmgt]?)i?b?", spark.conf.get(name).lower())
    return int(m[1]) << _UNITS[m[2]]


def _shares(spark: SparkSession) -> tuple[int, int]:
    """(bits below which splits do not start, bits for the rows of a partition): a row has a byte at least."""
    largest, opening = _bytes(spark, "spark.sql.files.maxPartitionBytes"), _bytes(spark, "spark.sql.files.openCostInBytes")
    least = max(1, min(largest, opening))
    return least.bit_length() - 1, (largest + opening).bit_length()


def read_lines(spark: SparkSession, paths: Sequence[str] | str, run: int = 0, run_bit: int = RUN_BIT) -> DataFrame:
    """Lines of the files in the given order (files of a folder by name); split at line feeds only, a carriage return at the end dropped.

    ``ord`` stays below ``2 ** run_bit`` but for the run.
    """
    read = [sniffed(p, spark) for p in ([paths] if isinstance(paths, str) else paths)]
    files = [f for p in read for f in sorted(spark.read.text(p).inputFiles())]
    split_bits, row_bits = _shares(spark)
    room = FILE_SIZE_BITS - split_bits + row_bits
    if len(files) >> max(0, run_bit - room):
        raise ValueError(f"at most {1 << max(0, run_bit - room)} files can be ordered")
    numbers = spark.createDataFrame([(re.sub("^file:/+", "file:/", f), k) for k, f in enumerate(files)], "_path string, file int") if len(files) > 1 else None
    raw = spark.read.option("lineSep", "\n").text(list(dict.fromkeys(read)))
    row = F.monotonically_increasing_id().bitwiseAND((1 << row_bits) - 1)
    rows = raw.select(F.regexp_replace("_metadata.file_path", "^file:/+", "file:/").alias("_path"), F.col("_metadata.file_block_start").alias("_start"), row.alias("_row"), "value")
    named = rows.withColumn("file", F.lit(0)) if numbers is None else rows.join(numbers, "_path")
    order = F.lit(run).cast("long") * (1 << run_bit) + F.col("file").cast("long") * (1 << room) + F.shiftright("_start", split_bits) * (1 << row_bits) + F.col("_row")
    whole = F.regexp_replace("value", "\\r\\z", "")
    line = F.when(F.octet_length(whole) <= MAX_LINE_BYTES, whole).otherwise(_cut(F.when(F.octet_length(whole) > MAX_LINE_BYTES, whole)))
    return named.select(F.lit(run).alias("run"), "file", order.alias("ord"), line.alias("line"))


def lines_of(df: DataFrame, text: str, order: Sequence[str], run: int = 0) -> DataFrame:
    """Lines of a text column: one row per line, ordered by the given columns and the line's place.

    ``order`` is one whole-numbered column below 2**35; a text has at most 2**27 lines.
    """
    (key,) = order
    number = F.col(key).cast("long")
    checked = F.when((number >= 0) & (number < 1 << (RUN_BIT - ROW_BITS)), number).otherwise(F.raise_error(F.lit(f"{key} has to lie between 0 and 2**{RUN_BIT - ROW_BITS}")).cast("long"))
    base = df.select(checked.alias("_key"), F.posexplode(F.split(text, "\n")).alias("_at", "line"))
    position = F.col("_key") * (1 << ROW_BITS) + F.col("_at")
    return base.select(F.lit(run).alias("run"), F.lit(0).alias("file"), position.alias("ord"), F.regexp_replace("line", "\\r\\z", "").alias("line"))

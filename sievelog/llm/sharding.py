"""Sharding by longest-processing-time scheduling (law ``bytes``).

Rows with equal texts form a group that stays together.  Groups, largest
first, go to the least-loaded shard, taken from a heap.  Groups of one size are
interchangeable, so the schedule needs only how many groups there are of each
size: a table whose rows are at most the square root of twice all bytes, since
different sizes add up.  Of a size with many groups, all but the last few turns
of the heap are counted at once: the heap hands out the smallest of the loads
``load + i * size``, and those that lie a whole size below the common level are
certain.  Groups then take their turns by their rank among those of their size.

Defined cases: null text has no bytes; rows that repeat a doc_id are rows of
their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpoint, salted_rank, salts_for


def turns(loads: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` items of one size each shard gets from the heap, ties to the smaller shard."""
    out = np.zeros(len(loads), dtype=object)
    if count > 4 * len(loads):
        rising = sorted(loads)
        below, k = 0, 0  # the level that the items fill the lowest shards up to
        while k < len(rising) and (k == 0 or rising[k] * k - below <= count * size):
            below += rising[k]
            k += 1
        certain = (below + count * size) // k - size
        out += [max(0, (certain - load) // size + 1) for load in loads]
    heap = [(load + int(n) * size, shard) for shard, (load, n) in enumerate(zip(loads, out, strict=True))]
    heapq.heapify(heap)
    for _ in range(count - int(out.sum())):
        load, shard = heap[0]
        out[shard] += 1
        heapq.heapreplace(heap, (load + size, shard))
    return [int(n) for n in out]


def longest_first(sizes: Iterable[tuple[int, int]], shards: int) -> list[tuple[int, list[int]]]:
    """(size, groups of it that each shard gets) for (size, groups), largest first."""
    loads, plan = [0] * shards, []
    for size, count in sorted(sizes, reverse=True):
        given = turns(loads, size, count)
        loads = [load + n * size for load, n in zip(loads, given, strict=True)]
        plan.append((size, given))
    return plan


def assign_shards(docs: DataFrame, *, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot (gapless from 0 in its shard), grown_shard (null)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = checkpoint(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.xxhash64(text).alias("group"),  # texts that share a hash just stay together too
        )
    )
    groups = checkpoint(rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    sizes = groups.groupBy("bytes").agg(F.count("*").alias("groups"), F.sum("n").alias("n")).toPandas()  # at most sqrt(2 * all bytes) rows
    plan = longest_first(zip(sizes["bytes"].tolist(), sizes["groups"].tolist(), strict=True), shards)
    ends = [(size, np.cumsum(given).tolist()) for size, given in plan]
    table = checkpoint(spark.createDataFrame(ends, "bytes long, ends array<long>"))  # as many rows as sizes
    ranked = salted_rank(groups.select("group", "bytes"), ["bytes"], ["group"], "turn", salts_for(int(sizes["groups"].sum())))
    placed = ranked.join(table, "bytes").select("group", F.size(F.filter("ends", lambda e: e <= F.col("turn"))).alias("shard"))
    found = rows.join(checkpoint(placed), "group").select("doc_id", "size", "text_crc32", "shard")
    slots = salted_rank(found, ["shard"], ["doc_id", "text_crc32"], "slot", 4 * salts_for(int(sizes["n"].sum())))
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

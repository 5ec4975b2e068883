"""Line dedup by winnowing over line hashes.

Every run of ``gram`` lines is hashed; of each ``window`` neighbouring hashes the
smallest (the first of equals) is a fingerprint.  The choice depends only on
the ``run = gram + window - 1`` lines of the window, so two equal runs of that
length always share a fingerprint at the same place.  Only fingerprints become
rows, each with its position and the digests of the lines that its windows
reach to both sides.  Fingerprints that occur once are dropped; the positions
of the others are joined and extended both ways: every run of ``run`` lines
around one is compared by its lines' digests (128 bits of SHA-256) with its
first occurrence.  A line goes if a run that covers it also starts earlier (in
a row before, or in an earlier line of its own), so a longer repeated run goes as a
whole.  A line of at least ``passage`` words is a run by itself: it always is a
fingerprint, and goes if it occurred before.  Runs of blank lines never go.

Only DataFrame functions; no group is gathered beyond one document.

Defined cases: lines are split at line feeds; null text has no line and stays
null; an empty text is one empty line; rows sort by doc_id, nulls last; rows
that repeat a doc_id are rows of their own, in the order in which they are
stored; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ORD, checkpoint, with_order

WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a line's digest.
DIGEST = 16


def _digest(line: Column) -> Column:
    """Identity of a line's text; empty for a blank line."""
    return F.when(line.rlike(WORD), F.unhex(F.substring(F.sha2(line, 256), 1, 2 * DIGEST))).otherwise(F.lit(b""))


def _prints(rows: DataFrame, gram: int, window: int, passage: int | None) -> DataFrame:
    """A row per fingerprint: f, _ord, the first line its windows reach, how many windows chose it, the lines of each, digests from the first line on."""
    run = gram + window - 1
    lines = rows.select(ORD, F.split("text", "\n").alias("lines"))
    known = lines.select(ORD, F.transform("lines", _digest).alias("d"), *([F.transform("lines", lambda x: F.regexp_count(x, F.lit(WORD))).alias("n")] if passage else []))
    hashed = known.where(F.size("d") >= run).withColumn("a", F.transform("d", lambda x: F.when(F.length(x) > 0, F.xxhash64(x)).otherwise(F.lit(0))))
    # a run of blank lines is chosen last
    grams = hashed.withColumn(
        "g", F.expr(f"transform(sequence(1, size(a) - {gram - 1}), i -> if(forall(slice(a, i, {gram}), z -> z = 0), {2**63 - 1}, xxhash64(slice(a, i, {gram}))))")
    )
    least = f"array_position(slice(g, i, {window}), array_min(slice(g, i, {window})))"
    chosen = grams.withColumn("at", F.expr(f"transform(sequence(1, size(g) - {window - 1}), i -> cast(i - 1 + {least} as int))"))
    # a place is chosen by at most ``window`` neighbouring windows
    fresh = F.expr(
        f"""filter(transform(at, (place, i) -> if(i > 0 AND at[i - 1] = place, null, named_struct(
          'f', g[place - 1], 'line', i, 'windows', size(filter(slice(at, i + 1, {window}), x -> x = place))))), x -> x IS NOT NULL)"""
    )
    spread = chosen.withColumn("p", F.explode(fresh)).select(
        F.col("p.f").alias("f"), ORD, F.col("p.line").alias("line"), F.col("p.windows").alias("windows"), F.lit(run).alias("run"), F.slice("d", F.col("p.line") + 1, F.col("p.windows") + (run - 1)).alias("d")
    )
    if not passage or run == 1:
        return spread
    alone = F.expr(f"filter(transform(n, (k, i) -> if(k >= {passage}, i, null)), i -> i IS NOT NULL)")
    single = known.withColumn("line", F.explode(alone))
    line = F.element_at("d", F.col("line") + 1)
    return spread.unionByName(single.select(F.xxhash64(F.lit(1), line).alias("f"), ORD, "line", F.lit(1).alias("windows"), F.lit(1).alias("run"), F.array(line).alias("d")))


def dedup_lines(
    docs: DataFrame, *, gram: int = 1, window: int = 2, passage: int | None = 8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: doc_id, n_lines, n_removed, text (the lines that stay).

    Repeated runs of ``gram + window - 1`` lines or more go, and single lines of ``passage`` words or more (None: no single lines).
    """
    rows, _ = with_order(docs, id_col, F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    prints = checkpoint(_prints(rows, gram, window, passage))
    # the small sides are checkpoints, so that each join deals both sides itself and Spark can split a hot key
    repeated = checkpoint(prints.groupBy("f").agg(F.count("*").alias("n")).where("n > 1").select("f"))
    places = prints.join(repeated, "f", "left_semi")
    reached = places.select(ORD, "run", F.posexplode(F.expr("transform(sequence(1, windows), i -> slice(d, i, run))")).alias("k", "own"), "line")
    key = F.array_join(F.transform("own", lambda x: F.base64(x)), ",")
    windows = checkpoint(reached.where(F.exists("own", lambda x: F.length(x) > 0)).select(ORD, (F.col("line") + F.col("k")).alias("line"), "run", key.alias("key")))
    firsts = (
        windows.groupBy("key")
        .agg(F.min(F.struct(ORD, "line")).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("key", F.col(f"first.{ORD}").alias("first_ord"), F.col("first.line").alias("first_line"))
    )
    firsts = checkpoint(firsts)
    later = windows.join(firsts, "key").where((F.col(ORD) != F.col("first_ord")) | (F.col("line") != F.col("first_line")))
    gone = F.array_distinct(F.flatten(F.collect_list(F.sequence("line", F.col("line") + F.col("run") - 1)))).alias("gone")
    joined = rows.join(later.groupBy(ORD).agg(gone), ORD, "left").select("doc_id", F.split("text", "\n").alias("lines"), "gone")
    stay = F.expr("transform(array_except(sequence(0, size(lines) - 1), gone), i -> lines[i])")
    return joined.select(
        "doc_id",
        F.greatest(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.greatest(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.array_join(F.when(F.col("gone").isNull(), F.col("lines")).otherwise(stay), "\n").alias("text"),
    )

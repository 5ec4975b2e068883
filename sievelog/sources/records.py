"""From lines to records: framing, parsing, the time window and the counters of a run.

A record has run, ord, message, ts_micros, tz_aware and level.  All of it is
column expressions; only records of several lines need a window over a file.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SettingError
from ..functions.levels import parse_level
from ..functions.timestamps import epoch_float_micros, epoch_micros, parse_format, parse_iso
from .formats import Format, JsonFormat, PlainFormat, RegexFormat

BLANK = r"^[ \t\n\x0C\r]*\z"
MAX_RECORD_BYTES = 1 << 20


@dataclass(frozen=True)
class TimeWindow:
    """``[since, until)`` in microseconds; an open window admits records without a time."""

    since: int | None = None
    until: int | None = None

    @property
    def open(self) -> bool:
        return self.since is None and self.until is None

    def admits(self, ts: Column) -> Column:
        out = F.lit(True) if self.open else ts.isNotNull()
        if self.since is not None:
            out &= F.coalesce(ts >= self.since, F.lit(False))
        if self.until is not None:
            out &= F.coalesce(ts < self.until, F.lit(False))
        return out


def _json_parts(line: Column, spec: JsonFormat) -> dict[str, Column]:
    keys, value = F.json_object_keys(line), F.try_parse_json(line)

    def first(names: tuple[str, ...]) -> tuple[Column, Column]:
        """Text and type of the first key that is present."""
        text, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
        for name in reversed(names):
            path = f"$['{name}']"
            has = F.array_contains(keys, name)
            got = F.coalesce(F.get_json_object(line, path), F.lit("null"))
            text = F.when(has, got).otherwise(text)
            kind = F.when(has, F.schema_of_variant(F.try_variant_get(value, path, "variant"))).otherwise(kind)
        return text, kind

    message, kind = first(spec.message_keys)
    good = keys.isNotNull() & line.rlike(r"^\s*\{") & message.isNotNull()
    terminated = (kind == "STRING") & message.rlike("\n\\z")
    body = F.when(kind == "STRING", F.regexp_replace(message, "\r?\n\\z", "")).otherwise(message)
    time, time_kind = first(spec.time_keys)
    text_time, text_zone = parse_format(time, spec.ts_format) if spec.ts_format else parse_iso(time)
    digits = (time_kind == "STRING") & time.rlike(r"^[0-9]{1,18}\z")
    whole = digits | time_kind.isin("BIGINT") | ((time_kind != "STRING") & time.rlike(r"^-?[0-9]{1,18}\z"))
    floating = time_kind.startswith("DECIMAL") | time_kind.isin("DOUBLE", "FLOAT")
    micros = (
        F.when(whole, epoch_micros(time.try_cast("long")))
        .when(floating, epoch_float_micros(time.try_cast("double")))
        .when(time_kind == "STRING", text_time)
    )
    zone = F.when(whole | floating, F.lit(True)).otherwise(text_zone)
    level, level_kind = first(spec.level_keys) if spec.level_keys else (F.lit(None).cast("string"), F.lit(None).cast("string"))
    return {"good": good, "message": body, "ts": micros, "zone": zone, "level": F.when(level_kind == "STRING", parse_level(level)), "terminated": terminated, "raw": message}


def _parts(line: Column, spec: Format, first_line: Column | None = None) -> dict[str, Column]:
    """good, message, ts, zone and level of a record; ``first_line`` differs from ``line`` when lines were joined."""
    head = line if first_line is None else first_line
    none = F.lit(None).cast("string")
    if isinstance(spec, PlainFormat):
        return {"good": F.lit(True), "message": line, "ts": F.lit(None).cast("long"), "zone": F.lit(False), "level": none}
    if isinstance(spec, JsonFormat):
        return _json_parts(line, spec)
    part = lambda group: F.regexp_extract(head, spec.java, spec.index(group)) if group else None
    message, time, level = part(spec.message_group), part(spec.time_group), part(spec.level_group)
    rest = F.lit("") if first_line is None else F.substring(line, F.length(head) + 1, F.length(line))
    micros, zone = (F.lit(None).cast("long"), F.lit(False)) if time is None else parse_format(time, spec.ts_format) if spec.ts_format else parse_iso(time)
    return {
        "good": head.rlike(spec.java),
        "message": F.concat(message if message is not None else head, rest),
        "ts": micros,
        "zone": zone,
        "level": none if level is None else parse_level(level),
    }


def starts_record(line: Column, spec: Format) -> Column:
    if isinstance(spec, RegexFormat):
        return line.rlike(spec.java)
    if isinstance(spec, JsonFormat):
        return line.rlike(r"^[ \t\n\x0C\r]*\{")
    if spec.record_start is None:
        raise SettingError("plain records of several lines need record_start")
    return line.rlike(spec.record_start)


#: Lines in order are cut into parts of so many places (a power of two), which are framed apart.
PART_BITS = 18


def _joined(lines: DataFrame, spec: Format) -> DataFrame:
    """Records of several lines: a line that starts none is appended to the one before.

    A record is named by the place of its first line.  Parts of a file are looked
    at apart; lines before the first start of a part belong to the last start of
    the parts before, a table of a row per part.
    """
    keys = ["run", "file", "part"]
    marked = lines.withColumn("part", F.shiftright("ord", PART_BITS)).withColumn("start", F.when(starts_record(F.col("line"), spec), F.col("ord")))
    within = marked.withColumn("own", F.max("start").over(Window.partitionBy(*keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)))
    lasts = marked.groupBy(*keys).agg(F.max("start").alias("last"))
    before = Window.partitionBy("run", "file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(*keys, F.max("last").over(before).alias("carried"))
    named = within.join(carried, keys).withColumn("record", F.coalesce("own", "carried"))
    inside = Window.partitionBy("run", "file", "record").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    size = F.coalesce(F.sum(F.octet_length("line") + 1).over(inside), F.lit(0)) - 1
    kept = named.where("record IS NOT NULL").withColumn("fits", size < MAX_RECORD_BYTES)
    parts = F.array_sort(F.collect_list(F.when(F.col("fits"), F.struct("ord", "line"))))
    grouped = kept.groupBy("run", "file", "record").agg(parts.alias("parts"), F.count("*").alias("n_lines"))
    joined = grouped.select("run", "file", F.col("record").alias("ord"), "n_lines", F.col("parts")[0]["line"].alias("head"), F.array_join(F.transform("parts", lambda p: p["line"]), "\n").alias("line"))
    early = named.where("record IS NULL").select("run", "file", "ord", F.lit(1).cast("long").alias("n_lines"), F.lit(None).cast("string").alias("head"), "line")
    return joined.unionByName(early)


def _entries(lines: DataFrame, spec: JsonFormat) -> DataFrame:
    """Entries joined until one ends with a line break; each group has the time and level of its first."""
    p = _parts(F.col("line"), spec)
    parsed = lines.select("run", "file", "ord", p["good"].alias("good"), p["raw"].alias("raw"), p["ts"].alias("ts"), p["zone"].alias("zone"), p["level"].alias("level"), p["terminated"].alias("terminated"))
    order = Window.partitionBy("run", "file").orderBy("ord")
    closed = F.coalesce(F.lag(F.coalesce(F.col("terminated"), F.lit(False)) | ~F.col("good")).over(order), F.lit(True)) | ~F.col("good")
    group = F.sum(closed.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    numbered = parsed.withColumn("group", group)
    first = lambda c: F.min_by(c, "ord").alias(c)
    pieces = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "raw"))), lambda x: x["raw"]), "")
    out = numbered.groupBy("run", "file", "group").agg(F.min("ord").alias("o"), F.count("*").alias("n_lines"), first("good"), first("ts"), first("zone"), first("level"), pieces.alias("message"))
    return out.select("run", F.col("o").alias("ord"), "n_lines", "good", F.regexp_replace("message", "\r?\n\\z", "").alias("message"), F.col("ts").alias("ts_micros"), F.coalesce("zone", F.lit(False)).alias("tz_aware"), "level")


def parse(lines: DataFrame, spec: Format) -> DataFrame:
    """Every record candidate: run, ord, n_lines, good, message, ts_micros, tz_aware, level.  Blank lines are left out."""
    full = lines.where(~F.col("line").rlike(BLANK))
    if isinstance(spec, JsonFormat) and spec.join_unterminated:
        return _entries(full, spec)
    if spec.multiline:
        framed = _joined(full, spec)
        p = _parts(F.col("line"), spec, F.col("head"))
        good = F.col("head").isNotNull() & p["good"]
    else:
        framed = full.withColumn("n_lines", F.lit(1).cast("long"))
        p = _parts(F.col("line"), spec)
        good = p["good"]
    return framed.select(
        "run", "ord", "n_lines", F.coalesce(good, F.lit(False)).alias("good"), p["message"].alias("message"), p["ts"].alias("ts_micros"), F.coalesce(p["zone"], F.lit(False)).alias("tz_aware"), p["level"].alias("level")
    )


def admitted(parsed: DataFrame, window: TimeWindow | None = None) -> DataFrame:
    """Records that are parsed and inside the window."""
    window = window or TimeWindow()
    return parsed.where(F.col("good") & window.admits(F.col("ts_micros"))).select("run", "ord", "message", "ts_micros", "tz_aware", "level")


def counters(lines: DataFrame, parsed: DataFrame, window: TimeWindow | None = None) -> DataFrame:
    """A row per run: lines, records, unparsed, out_of_range, untimed, tz_aware."""
    window = window or TimeWindow()
    inside, timed = window.admits(F.col("ts_micros")), F.col("ts_micros").isNotNull()
    counted = parsed.groupBy("run").agg(
        F.count(F.when(F.col("good") & inside, 1)).alias("records"),
        F.coalesce(F.sum(F.when(~F.col("good"), F.col("n_lines"))), F.lit(0)).alias("unparsed"),
        F.count(F.when(F.col("good") & ~inside & timed, 1)).alias("out_of_range"),
        F.count(F.when(F.col("good") & ~inside & ~timed, 1)).alias("untimed"),
        F.coalesce(F.bool_or(F.col("good") & inside & timed & F.col("tz_aware")), F.lit(False)).alias("tz_aware"),
    )
    total = lines.groupBy("run").agg(F.count("*").alias("lines"))
    zero = {"records": 0, "unparsed": 0, "out_of_range": 0, "untimed": 0, "tz_aware": False}
    return total.join(counted, "run", "left").fillna(zero)


def records_of(df: DataFrame, message: str | Column, order: str | Column, *, ts: str | Column | None = None, level: str | Column | None = None, run: int | Column = 0) -> DataFrame:
    """Records of a table: a message, an order and, if there are any, a time and a level."""
    col = lambda x: F.col(x) if isinstance(x, str) else x
    micros = F.lit(None).cast("long") if ts is None else F.unix_micros(col(ts).cast("timestamp"))
    return df.select(
        (F.lit(run) if isinstance(run, int) else run).cast("int").alias("run"), col(order).cast("long").alias("ord"), col(message).alias("message"),
        micros.alias("ts_micros"), F.lit(False).alias("tz_aware"), (F.lit(None).cast("string") if level is None else parse_level(col(level))).alias("level"),
    )


def split_at(records: DataFrame, cut_micros: int) -> DataFrame:
    """One input as two runs: run 0 before the cut, run 1 from it on; records without a time are left out."""
    timed = records.where(F.col("ts_micros").isNotNull())
    later = (F.col("ts_micros") >= cut_micros).cast("int")
    return timed.withColumn("run", later).withColumn("ord", F.col("ord") + later.cast("long") * (1 << 62))

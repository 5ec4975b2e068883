"""Registered queries of formats, times, masks and other functions of records, each with its SQL twin beside it.

Lines are rendered from the events in the layout of a format and parsed again;
the twin takes the same facts from the table.
"""

from __future__ import annotations

import json
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT_RULES, MaskRule, MiningConfig
from ..functions import masking, timestamps, tokens
from ..functions.mask_sets import load_set, select
from ..operators.spread import spread
from ..sources import records as rec
from ..sources.formats import FORMATS, Format, resolve

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def registered(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query by its function's name, with its twin."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


#: A message of events, a level of theirs, and the time in whole seconds.
TEXT = "concat('user ', user_id, ' did ', event_type, ' at ', props)"
SQL_TEXT = "'user ' || user_id || ' did ' || event_type || ' at ' || props"
LEVEL = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END"
SECONDS = "(epoch_us(ts) // 1000000) * 1000000"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("ts").cast("timestamp")
    table = spread(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id")
    return table.select("event_id", F.expr(TEXT).alias("text"), F.expr(LEVEL).alias("level"), F.unix_seconds(at).alias("seconds"), F.timestamp_seconds(F.unix_seconds(at)).alias("at"), "event_type", "user_id")


def lines_in(rows: DataFrame, line: Column) -> DataFrame:
    return rows.select(F.lit(0).alias("run"), F.lit(0).alias("file"), F.col("event_id").alias("ord"), line.alias("line"))


def stamp(layout: str) -> Column:
    return F.date_format("at", layout)


def rendered(spark: SparkSession, sf_dir: str, spec: Format, *parts: Column | str) -> DataFrame:
    """Records parsed from a line per event."""
    line = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return rec.parse(lines_in(events(spark, sf_dir), line), spec).select("ord", "good", "message", "ts_micros", "tz_aware", "level")


def expected(*, message: str = SQL_TEXT, micros: str = SECONDS, aware: str = "true", level: str = LEVEL) -> str:
    return f"SELECT event_id AS ord, true AS good, {message} AS message, {micros} AS ts_micros, {aware} AS tz_aware, {level} AS level FROM events"


NULL = "CAST(NULL AS VARCHAR)"


@registered(expected())
def format_journald(spark: SparkSession, sf_dir: str) -> DataFrame:
    priority = F.when(F.col("level") == "ERROR", "3").when(F.col("level") == "WARN", "4").otherwise("6")
    entry = F.to_json(F.struct(F.col("text").alias("MESSAGE"), (F.col("seconds") * 1_000_000).cast("string").alias("__REALTIME_TIMESTAMP"), priority.alias("PRIORITY")))
    return rendered(spark, sf_dir, FORMATS["journald"], entry)


@registered(expected())
def format_serilog_clef(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.to_json(F.struct(stamp("yyyy-MM-dd'T'HH:mm:ss'Z'").alias("@t"), F.col("text").alias("@mt"), F.initcap("level").alias("@l")))
    return rendered(spark, sf_dir, FORMATS["serilog-clef"], entry)


@registered(expected(aware="false"))
def format_nginx_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(spark, sf_dir, FORMATS["nginx-error"], stamp("yyyy/MM/dd HH:mm:ss"), " [", F.lower("level"), "] ", F.col("text"))


@registered(
    "SELECT event_id AS ord, true AS good, 'app[7]: ' || " + SQL_TEXT + " || CASE WHEN event_type = 'error' THEN chr(10) || '  at line ' || user_id ELSE '' END AS message, "
    "epoch_us(make_timestamp(1970, month(ts), day(ts), hour(ts), minute(ts), floor(second(ts)))) AS ts_micros, false AS tz_aware, CAST(NULL AS VARCHAR) AS level FROM events"
)
def format_syslog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No year and no level; errors go on in a second line."""
    rows = events(spark, sf_dir)
    first = lines_in(rows, F.concat(stamp("MMM"), F.lit(" "), F.lpad(F.date_format("at", "d"), 2, " "), F.lit(" "), stamp("HH:mm:ss"), F.lit(" host1 app[7]: "), F.col("text"))).withColumn("ord", F.col("ord") * 2)
    more = lines_in(rows.where("event_type = 'error'"), F.concat(F.lit("  at line "), F.col("user_id"))).withColumn("ord", F.col("ord") * 2 + 1)
    found = rec.parse(first.unionByName(more), FORMATS["syslog"])
    return found.select((F.col("ord") / 2).cast("long").alias("ord"), "good", "message", "ts_micros", "tz_aware", "level")


@registered(expected(level=NULL))
def format_k8s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(spark, sf_dir, FORMATS["k8s"], stamp("yyyy-MM-dd'T'HH:mm:ss'.000000Z'"), " stderr F ", F.col("text"))


@registered(expected())
def format_logfmt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(spark, sf_dir, FORMATS["logfmt"], 'ts="', stamp("yyyy-MM-dd'T'HH:mm:ss'Z'"), '" host=a level=', F.lower("level"), " ", F.col("text"))


@registered(expected(message="'web~ be/s1 0/0/1/2/3 200 5 ' || " + SQL_TEXT, micros=SECONDS + " + 250000", aware="false", level=NULL))
def format_haproxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(spark, sf_dir, FORMATS["haproxy"], "haproxy[12]: 10.0.0.1:4000 [", stamp("dd/MMM/yyyy:HH:mm:ss'.250'"), "] web~ be/s1 0/0/1/2/3 200 5 ", F.col("text"))


@registered(expected(aware="false", level="CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END"))
def format_postgresql(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("level") == "WARN", "WARNING").otherwise(F.col("level"))
    return rendered(spark, sf_dir, FORMATS["postgresql"], stamp("yyyy-MM-dd HH:mm:ss"), " UTC [42] db@user ", level, ":  ", F.col("text"))


@registered(expected(message=f"replace({SQL_TEXT}, chr(34), chr(34) || chr(34))", aware="false"))
def format_postgresql_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("level") == "WARN", "WARNING").otherwise(F.col("level"))
    text = F.regexp_replace("text", '"', '""')
    return rendered(
        spark, sf_dir, FORMATS["postgresql-csv"], stamp("yyyy-MM-dd HH:mm:ss"), ' UTC,"bob","db",42,"10.0.0.1:5",s1,7,"INSERT, all",', stamp("yyyy-MM-dd HH:mm:ss"), " UTC,3/4,0,", level, ',00000,"', text, '",,,'
    )


@registered(expected(level="CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' END"))
def format_github_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.when(F.col("level") == "ERROR", "##[error]").when(F.col("level") == "WARN", "##[warning]").otherwise("")
    return rendered(spark, sf_dir, FORMATS["github-actions"], stamp("yyyy-MM-dd'T'HH:mm:ss'.0000000Z'"), " ", mark, F.col("text"))


@registered(expected(aware="false"))
def format_log4j(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = resolve("log4j:%d{ISO8601} [%t] %-5p %c{1} - %m%n")
    return rendered(spark, sf_dir, spec, stamp("yyyy-MM-dd HH:mm:ss',000'"), " [main 1] ", F.rpad("level", 5, " "), " a.B - ", F.col("text"))


@registered(expected(micros="(epoch_us(ts) // 1000000 % 86400) * 1000000", aware="false"))
def format_log4j_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern with date letters of its own; the day is unknown."""
    spec = resolve("log4j:%level|%d{HH:mm:ss.SSS}|%X{id}|%msg%n%ex")
    return rendered(spark, sf_dir, spec, F.col("level"), "|", stamp("HH:mm:ss'.000'"), "|q|", F.col("text"))


@registered(expected(message="event_type || ' of ' || user_id"))
def format_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = resolve(r"regex:^<(?P<timestamp>[^>]+)> (?P<severity>\w+) (?P<message>.*)$")
    return rendered(spark, sf_dir, spec, "<", stamp("yyyy-MM-dd'T'HH:mm:ss'Z'"), "> ", F.col("level"), " ", F.col("event_type"), " of ", F.col("user_id"))


@registered(
    f"SELECT event_id * 3 AS ord, CASE WHEN event_type = 'view' THEN 2 ELSE 1 END AS n_lines, true AS good, {SQL_TEXT} || CASE WHEN event_type = 'view' THEN ' and more' ELSE '' END AS message, "
    f"{SECONDS} AS ts_micros, true AS tz_aware FROM events UNION ALL SELECT event_id * 3 + 2, 1, false, NULL, NULL, false FROM events WHERE event_type = 'error'"
)
def format_docker_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of views come in two parts, of which only the last ends with a line break; errors are followed by a line that is no entry."""
    rows = events(spark, sf_dir)
    entry = lambda text: F.to_json(F.struct(text.alias("log"), F.lit("stdout").alias("stream"), stamp("yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time")))
    view = F.col("event_type") == "view"
    first = lines_in(rows, F.when(view, entry(F.col("text"))).otherwise(entry(F.concat("text", F.lit("\n"))))).withColumn("ord", F.col("ord") * 3)
    second = lines_in(rows.where(view), entry(F.lit(" and more\n"))).withColumn("ord", F.col("ord") * 3 + 1)
    broken = lines_in(rows.where("event_type = 'error'"), F.lit("{broken")).withColumn("ord", F.col("ord") * 3 + 2)
    found = rec.parse(first.unionByName(second).unionByName(broken), FORMATS["docker-json"])
    return found.select("ord", F.col("n_lines").cast("int").alias("n_lines"), "good", F.when(F.col("good"), F.col("message")).alias("message"), "ts_micros", "tz_aware")


@registered(
    "SELECT count(*) AS lines, count(*) FILTER (event_type <> 'error') AS records, count(*) FILTER (event_type = 'error') AS unparsed, 0 AS out_of_range, 0 AS untimed, true AS tz_aware FROM events"
)
def unparsed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are no record of the format are counted and left out."""
    line = F.when(F.col("level") == "ERROR", F.lit("no time here")).otherwise(F.concat(stamp("yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(" INFO "), F.col("text")))
    lines = lines_in(events(spark, sf_dir), line)
    return rec.counters(lines, rec.parse(lines, FORMATS["app"])).select("lines", "records", "unparsed", "out_of_range", "untimed", "tz_aware")


@registered("SELECT event_id, floor(s * 1000000 + 0.5)::BIGINT AS s, floor(s * 1000000 + 0.5)::BIGINT AS ms, ((s * 1000000)::BIGINT // 2) * 2 AS us FROM (SELECT event_id, (epoch_us(ts) // 1000000) + 0.25 AS s FROM events)")
def epoch_floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.col("seconds") + F.lit(0.25)
    found = events(spark, sf_dir).select("event_id", *[timestamps.epoch_float_micros(x).alias(n) for n, x in (("s", seconds), ("ms", seconds * 1000), ("us", seconds * 1_000_000))])
    return found.withColumn("us", (F.floor(F.col("us") / 2) * 2).cast("long"))


# masks

_DIGITS = "list_transform(range(1, length(n) + 1), lambda i: substr(n, i::INT, 1)::INT)"
_LUHN = "(list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 1 THEN (2 * substr(n, i::INT, 1)::INT) // 10 + (2 * substr(n, i::INT, 1)::INT) % 10 ELSE substr(n, i::INT, 1)::INT END)) % 10 = 0)"


@registered(f"WITH c AS (SELECT event_id, '4' || lpad((event_id * 7919)::VARCHAR, 15, '0') AS n FROM events) SELECT event_id, CASE WHEN {_LUHN} THEN 'card <CARD> used' ELSE 'card <NUM> used' END AS masked FROM c")
def mask_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number of 16 digits is a card only if its check digit is right; else the default rules take it."""
    number = F.concat(F.lit("4"), F.lpad((F.col("event_id") * 7919).cast("string"), 15, "0"))
    return events(spark, sf_dir).select("event_id", masking.mask(F.concat(F.lit("card "), number, F.lit(" used")), select("payment")).alias("masked"))


@registered(
    "WITH c AS (SELECT event_id, lpad((event_id % 97)::VARCHAR, 2, '0') AS k, lpad((event_id * 104729)::VARCHAR, 18, '0') AS b FROM events) "
    "SELECT event_id, CASE WHEN (b || '1314' || k)::HUGEINT % 97 = 1 THEN 'to <IBAN>' ELSE 'to DE' || k || b END AS masked FROM c"
)
def mask_ibans(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.concat(F.lit("DE"), F.lpad((F.col("event_id") % 97).cast("string"), 2, "0"), F.lpad((F.col("event_id") * 104729).cast("string"), 18, "0"))
    return events(spark, sf_dir).select("event_id", masking.mask(F.concat(F.lit("to "), number), select("payment")).alias("masked"))


@registered("SELECT event_id, '<WHO> did <WHAT> ' || user_id || ' x' AS masked FROM events")
def mask_own_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of one's own replace the default ones; the earliest rule wins."""
    rules = (MaskRule("who", r"user \d+", "<WHO>"), MaskRule("what", r"(?:click|error|purchase|signup|view)", "<WHAT>"), MaskRule("late", r"user", "<NO>"))
    text = F.concat(F.lit("user "), "user_id", F.lit(" did "), "event_type", F.lit(" "), "user_id", F.lit(" x"))
    return events(spark, sf_dir).select("event_id", masking.mask(text, rules).alias("masked"))


@registered("SELECT event_id, 'pair <ODD> or <NUM>' AS masked FROM events")
def mask_set_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set read from a file in front of the default rules."""
    with tempfile.TemporaryDirectory() as folder:
        path = Path(folder) / "set.json"
        path.write_text(json.dumps({"name": "odd", "version": 2, "rules": [{"name": "odd", "pattern": r"<\d+>", "token": "<ODD>"}]}))
        rules = select(["odd", "default"], [load_set(path)])
    text = F.concat(F.lit("pair <"), "user_id", F.lit("> or "), "user_id")
    return events(spark, sf_dir).select("event_id", masking.mask(text, rules).alias("masked"))


_SIXTEEN = "substr(t, {}, 16)"
_CHECKED = "(list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 1 THEN (2 * substr({0}, i::INT, 1)::INT) // 10 + (2 * substr({0}, i::INT, 1)::INT) % 10 ELSE substr({0}, i::INT, 1)::INT END)) % 10 = 0)"


@registered(
    "WITH c AS (SELECT event_id, '4' || lpad((event_id * 7919)::VARCHAR, 16, '0') AS t FROM events) SELECT event_id, "
    f"CASE WHEN {_CHECKED.format(_SIXTEEN.format(1))} THEN 'x <SIXTEEN>' || substr(t, 17) WHEN {_CHECKED.format(_SIXTEEN.format(2))} THEN 'x ' || left(t, 1) || '<SIXTEEN>' ELSE 'x ' || t END AS masked FROM c"
)
def mask_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate that its check refuses is passed by one character, and the rule is tried again there."""
    rules = (MaskRule("sixteen", r"\d{16}", "<SIXTEEN>", "luhn"),)
    text = F.concat(F.lit("x 4"), F.lpad((F.col("event_id") * 7919).cast("string"), 16, "0"))
    return events(spark, sf_dir).select("event_id", masking.mask(text, rules).alias("masked"))


_RULES_JSON = json.dumps([{k: v for k, v in vars(r).items() if v is not None} for r in (MaskRule("a", "b+", "<C>"), MaskRule("d", "e", "<F>", "luhn"))], sort_keys=True, separators=(",", ":"))


@registered("""SELECT substr(sha256('[{"name":"a","pattern":"b+","token":"<C>"},{"check":"luhn","name":"d","pattern":"e","token":"<F>"}]'), 1, 16) AS fingerprint""")
def mask_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(masking.mask_fingerprint((MaskRule("a", "b+", "<C>"), MaskRule("d", "e", "<F>", "luhn"))),)], "fingerprint string")


# tokens

_WORDS = "w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda t: t <> '')) AS t FROM documents)"


@registered(f"WITH {_WORDS} SELECT CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE substr(t, 1, 2) END AS head, count(*) AS n FROM w GROUP BY 1")
def route_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens with a digit are routed as wildcards."""
    words = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.explode(tokens.tokenise(F.col("text"))).alias("t"))
    key = tokens.route_key(F.col("t"))
    return words.select(F.when(key == "<*>", key).otherwise(F.substring(key, 1, 2)).alias("head")).groupBy("head").agg(F.count("*").alias("n"))


_PAIR = (
    "p AS (SELECT event_id, string_split('do ' || event_type || ' by ' || user_id % 7 || ' now', ' ') AS x, string_split('do ' || (CASE WHEN event_id % 2 = 0 THEN 'click' ELSE '<*>' END) || ' by ' || event_id % 7 || ' now', ' ') AS y FROM events)"
)


@registered(
    f"WITH {_PAIR} SELECT event_id, list_sum(list_transform(list_zip(y, x), lambda z: CASE WHEN z[1] = z[2] AND z[1] <> '<*>' THEN 1 ELSE 0 END))::INT AS exact, "
    "array_to_string(list_transform(list_zip(y, x), lambda z: CASE WHEN z[1] = z[2] THEN z[1] ELSE '<*>' END), ' ') AS general FROM p"
)
def similarity_and_generalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.split(F.concat(F.lit("do "), "event_type", F.lit(" by "), (F.col("user_id") % 7).cast("string"), F.lit(" now")), " ")
    template = F.split(F.concat(F.lit("do "), F.when(F.col("event_id") % 2 == 0, "click").otherwise("<*>"), F.lit(" by "), (F.col("event_id") % 7).cast("string"), F.lit(" now")), " ")
    return events(spark, sf_dir).select("event_id", tokens.exact_matches(template, message).cast("int").alias("exact"), F.array_join(tokens.generalise(template, message), " ").alias("general"))


@registered(
    "WITH l AS (SELECT doc_id, text FROM documents WHERE octet_length(encode(text)) > 2000), c AS (SELECT doc_id, text, unnest(range(500, 2001)) AS k FROM l), "
    "f AS (SELECT doc_id, text, max(k) AS k FROM c WHERE octet_length(encode(left(text, k))) <= 2000 GROUP BY doc_id, text) SELECT doc_id, left(text, k) AS example FROM f"
)
def example_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples are cut after 2000 bytes, at a character."""
    from .pipeline import _examples

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.octet_length("text") > 2000).select("doc_id", F.col("text").alias("example"))
    return _examples(rows, "raw")


@registered("SELECT count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10 06:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00'")
def time_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds given as ISO texts, one of them with a zone."""
    from ..api import time_bound

    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.expr("unix_micros(cast(ts AS timestamp))").alias("us"))
    window = rec.TimeWindow(time_bound("2024-01-10T08:00:00+02:00"), time_bound("2024-01-20T00:00:00"))
    return rows.where(window.admits(F.col("us"))).agg(F.count("*").alias("n"))


@registered("SELECT count(*) AS n, 'sim_th has to lie between 0 and 1' AS refusal FROM events WHERE event_id < 0")
def refused_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings that cannot be used are refused before anything runs."""
    try:
        MiningConfig(sim_th=2.0)
        said = ""
    except ValueError as error:
        said = str(error)
    return spark.createDataFrame([(0, said)], "n long, refusal string")


assert len(DEFAULT_RULES) == 6

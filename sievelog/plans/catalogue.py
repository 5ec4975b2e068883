"""Registered queries of the log operators, with their SQL twins in ``catalogue_sql``.

Log surface of the tables: an event is a record with a message built from its
columns; a line of a document is a record of plain text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT_RULES, DiffConfig, MiningConfig
from ..functions import levels, timestamps
from ..functions.mask_sets import PAYMENT, PII
from ..functions.masking import mask, mask_default
from ..functions.tokens import template_id, tokenise
from ..operators import compare, matchers, stats, values
from ..operators.assign import assign
from ..operators.spread import spread
from ..operators.train import prepare, settled, stored
from ..operators.tree import Tree
from ..sources import records as rec
from ..sources.formats import FORMATS, JsonFormat
from ..sources.lines import lines_of
from . import pipeline
from .catalogue_sql import CUT_MICROS, SQL, WEEK_MICROS

LEVEL = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'warning' ELSE 'info' END"
MESSAGE = "concat(event_type, ' user ', user_id, ' value ', cast(value AS decimal(18,2)), ' props ', props)"
EXACT = MiningConfig(sim_th=1.0)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spread(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id")
    micros = F.expr("unix_micros(cast(ts AS timestamp))")
    return table.select(
        F.lit(0).alias("run"), F.col("event_id").alias("ord"), F.expr(MESSAGE).alias("message"), micros.alias("ts_micros"),
        F.lit(False).alias("tz_aware"), levels.parse_level(F.expr(LEVEL)).alias("level"),
    )


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents, in the order of the documents."""
    return lines_of(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id"), "text", ["doc_id"])


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec.admitted(rec.parse(document_lines(spark, sf_dir), FORMATS["plain"]))


def exact_templates(records: DataFrame) -> DataFrame:
    """Mining with ``sim_th = 1`` below the cap: records of the same masked tokens, by built-in expressions alone."""
    tokens = tokenise(mask_default(F.col("message")))
    return stats.freeze(stats.per_template(spread(records).withColumn("text", F.array_join(tokens, " ")), ["text", "run"]))


def analyze_events_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_templates(events(spark, sf_dir)).select("id", "text", "count", "first", "last", "n_info", "n_warn", "n_error", "level", "example")


def mask_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_lines(spark, sf_dir).select("ord", mask_default(F.col("line")).alias("masked"))


def mask_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", mask_default(F.col("url")).alias("url"), F.sha2(mask_default(F.col("html")), 256).alias("html"))


def top20_templates_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.ranked(exact_templates(document_records(spark, sf_dir)), 20).select("id", "text", "count")


def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = document_lines(spark, sf_dir)
    return rec.counters(lines, rec.parse(lines, FORMATS["plain"])).select("lines", "records", "unparsed")


def time_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = events(spark, sf_dir).withColumn("good", F.lit(True)).withColumn("n_lines", F.lit(1))
    window = rec.TimeWindow(CUT_MICROS - WEEK_MICROS, CUT_MICROS)
    return rec.counters(parsed, parsed, window).select("lines", "records", "out_of_range", "untimed")


def level_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.level_totals(exact_templates(events(spark, sf_dir)))


def level_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.only(exact_templates(events(spark, sf_dir)), min_level="WARN", min_count=2).select("text", "count", "level")


def token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared = prepare(document_records(spark, sf_dir), EXACT)
    return prepared.groupBy("n_tokens").agg(F.count("*").alias("records"))


def _split_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec.split_at(events(spark, sf_dir), CUT_MICROS)


def diff_split_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _busy(_split_events(spark, sf_dir))
    frozen = exact_templates(own)
    sizes = {r.run: r["count"] for r in own.groupBy("run").count().collect()}
    both = compare.joined(frozen.where("run = 0"), frozen.where("run = 1"))
    out = compare.classify(both, sizes.get(0, 0), sizes.get(1, 0), DiffConfig(threshold_ratio=1.05, min_count=5, significance=None))
    return out.select("id", "text", "category", "before_count", "after_count", "ratio", "factor", "level")


def _busy(records: DataFrame) -> DataFrame:
    """Records whose template differs with the user's last two digits, so that runs differ."""
    shape = F.regexp_extract("message", r"user [0-9]*?([0-9]{1,2}) ", 1)
    return records.withColumn("message", F.concat(F.translate(shape, "0123456789", "abcdefghij"), F.lit(" "), F.col("message")))


def diff_gtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _busy(_split_events(spark, sf_dir))
    frozen = exact_templates(own)
    sizes = {r.run: r["count"] for r in own.groupBy("run").count().collect()}
    both = compare.joined(frozen.where("run = 0"), frozen.where("run = 1"))
    out = compare.classify(both, sizes.get(0, 0), sizes.get(1, 0), DiffConfig(threshold_ratio=1.0, min_count=1, significance=0.01))
    return out.where("score is not null").select("text", "category", F.round("score", 4).alias("score"))


def baseline_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    week = F.floor(F.col("ts_micros") / WEEK_MICROS).cast("int")
    weekly = _busy(events(spark, sf_dir)).withColumn("run", week)
    weeks = weekly.select("run").distinct().count()
    pooled, unstable = compare.pool_baselines(exact_templates(weekly), None, weeks)
    stable = pooled.select("text", "count", F.lit(True).alias("stable"))
    return stable.unionByName(unstable.select("text", F.lit(None).cast("long").alias("count"), F.lit(False).alias("stable")))


def _one_sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line templates (text, count, odd) that are in even documents (``odd`` is 0) or in odd ones only."""
    records = document_records(spark, sf_dir)
    odd_document = F.pmod(F.shiftright("ord", 27), F.lit(2))
    tokens = tokenise(mask_default(F.col("message")))
    counts = records.groupBy(F.array_join(tokens, " ").alias("text")).agg(F.count("*").alias("count"), F.sum(odd_document).alias("odd"))
    return counts.where("odd = 0 OR odd = count")


def _two_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Line templates of even and of odd documents, each without the texts of the other, numbered."""
    one_sided = settled(_one_sided(spark, sf_dir))
    return matchers.numbered(one_sided.where("odd = 0")), matchers.numbered(one_sided.where("odd > 0"))


def _scores(spark: SparkSession, sf_dir: str, score: Callable[..., DataFrame], least: float) -> DataFrame:
    before, after = _two_sides(spark, sf_dir)
    found = score(before, after, least)
    named = found.join(before.select(F.col("i").alias("b"), F.col("text").alias("before_text")), "b")
    return named.join(after.select(F.col("i").alias("a"), F.col("text").alias("after_text")), "a").drop("a", "b")


def _text_pairs(spark: SparkSession, sf_dir: str, pairs: Callable[..., DataFrame], least: float) -> DataFrame:
    one_sided = _one_sided(spark, sf_dir)
    rows = stored(one_sided.select("text", (F.col("odd") > 0).alias("after"), F.monotonically_increasing_id().alias("i")))
    return pairs(rows.where("not after"), rows.where("after"), least).drop("a", "b")


def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_pairs(spark, sf_dir, matchers.jaccard_texts, 0.6)


def idf_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, matchers.idf_scores, 0.5).withColumn("score", F.round("score", 9))


def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = _one_sided(spark, sf_dir).select("text", (F.col("odd") > 0).cast("int").alias("side"), F.monotonically_increasing_id().alias("i"))
    return matchers.overlap_sided(sides, 0.8).drop("a", "b")


def subset_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = matchers.numbered(exact_templates(events(spark, sf_dir)).select(F.regexp_replace("text", "^(click|view) ", "<*> ").alias("text"), "count"))
    right = matchers.numbered(exact_templates(events(spark, sf_dir)).select(F.regexp_replace("text", " value <NUM>", " value <*>").alias("text"), "count"))
    return matchers.subset_candidates(left, right).select("b", "a", "gap")


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _split_events(spark, sf_dir)
    named = own.withColumn("text", F.array_join(tokenise(mask_default(F.col("message"))), " "))
    return values.parameters(named)


def value_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = values.distribution(_values(spark, sf_dir))
    top = F.array_join(F.transform("top", lambda x: F.concat_ws("=", x["value"], x["count"].cast("string"))), ";")
    return found.select("text", "position", "name", top.alias("top"), F.col("distinct").cast("long").alias("n_distinct"), "capped", "other")


def numeric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = values.numeric_summary(_values(spark, sf_dir))
    return found.select("text", "position", "name", "count", "min", "max", F.round("mean", 6).alias("mean"))


def numeric_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = values.numeric_summary(_values(spark, sf_dir))
    return found.select("text", "position", "name", *[F.round(c, 6).alias(c) for c in ("p50", "p90", "p99")])


def new_gone_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = values.value_changes(_values(spark, sf_dir))
    top = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("=", x["value"], x["count"].cast("string"))), ";").alias(c)
    return found.select("text", "position", "name", "n_new", "n_gone", "n_shared", top("new"), top("gone"))


def check_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second half against the exact templates of the first: matched and unmatched records of each template."""
    own = _busy(_split_events(spark, sf_dir))
    frozen = exact_templates(own)
    known = frozen.where("run = 0").select("text", F.lit(True).alias("known"))
    return frozen.where("run = 1").join(known, "text", "left").groupBy(F.coalesce("known", F.lit(False)).alias("known")).agg(F.count("*").alias("templates"), F.sum("count").alias("records"))


def match_exact_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records against templates with wildcards by the exact rule."""
    prepared = prepare(events(spark, sf_dir), MiningConfig())
    tree = Tree(MiningConfig())
    for k, text in enumerate(("<*> user <NUM> value <NUM> props {\"k\": <NUM>}", "click user <NUM> value <NUM> props {\"k\": <NUM>}", "view user <NUM> value <*> props {\"k\": <NUM>}")):
        tree.create(text.split(" "), k)
    return assign(prepared, tree, exact=True).groupBy("cluster").agg(F.count("*").alias("records"), F.min("ord").alias("first_ord"))


def _masked_with(spark: SparkSession, sf_dir: str, rules: tuple) -> DataFrame:
    lines = document_lines(spark, sf_dir)
    masked = mask(F.col("line"), (*rules, *DEFAULT_RULES))
    return lines.select("ord", "line", masked.alias("masked"))


def pii_mask_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _masked_with(spark, sf_dir, PII.rules)
    count = lambda token: (F.length("masked") - F.length(F.replace("masked", F.lit(token), F.lit("")))) / len(token)
    return found.select("ord", count("<EMAIL>").cast("long").alias("emails"), count("<PHONE>").cast("long").alias("phones")).where("emails > 0 or phones > 0")


def payment_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masked_with(spark, sf_dir, PAYMENT.rules).where(F.col("masked").rlike("<CARD>|<IBAN>")).select("ord", "masked")


def json_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spread(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id")
    lines = table.select(F.lit(0).alias("run"), F.lit(0).alias("file"), F.col("event_id").alias("ord"), F.to_json(F.struct(F.col("event_type").alias("msg"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("time"), F.expr(LEVEL).alias("severity"))).alias("line"))
    return rec.parse(lines, JsonFormat()).select("ord", "good", "message", "ts_micros", "tz_aware", "level")


def parse_app_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spread(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id")
    text = F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(" "), F.upper(F.expr(LEVEL)), F.lit(" "), F.expr(MESSAGE))
    lines = table.select(F.lit(0).alias("run"), F.lit(0).alias("file"), F.col("event_id").alias("ord"), text.alias("line"))
    return rec.parse(lines, FORMATS["app"]).select("ord", "good", "message", "ts_micros", "tz_aware", "level")


def parse_access_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spread(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id")
    stamp = F.date_format(F.col("ts").cast("timestamp"), "dd/MMM/yyyy:HH:mm:ss")
    text = F.concat(F.lit("10.0.0.1 - - ["), stamp, F.lit(' +0200] "GET /u/'), F.col("user_id"), F.lit(' HTTP/1.1" 200 512'))
    lines = table.select(F.lit(0).alias("run"), F.lit(0).alias("file"), F.col("event_id").alias("ord"), text.alias("line"))
    return rec.parse(lines, FORMATS["nginx"]).select("ord", "good", "message", "ts_micros", "tz_aware")


def multiline_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a file here; a line that starts with a capital letter of A to M starts a record."""
    lines = document_lines(spark, sf_dir).withColumn("file", F.shiftright("ord", 27).cast("int"))
    spec = rec.PlainFormat("plain", "^[A-M]", True)
    return rec.parse(lines, spec).select("ord", "n_lines", "good", F.sha2("message", 256).alias("message"))


def parse_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = F.element_at(F.array(*map(F.lit, [*levels.ALIASES, "other", " warn "])), (F.col("event_id") % (len(levels.ALIASES) + 2) + 1).cast("int"))
    level = levels.parse_level(text)
    return table.select(level.alias("level"), levels.rank(level).alias("rank"), levels.at_least(level, "WARN").alias("alert")).groupBy("level", "rank", "alert").agg(F.count("*").alias("n"))


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spread(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id")
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    scaled: list[tuple[str, Column]] = [("s", seconds), ("ms", seconds * 1000 + 7), ("us", seconds * 1_000_000 + 7), ("ns", seconds * 1_000_000_000 + 7001)]
    return table.select("event_id", *[timestamps.epoch_micros(v).alias(n) for n, v in scaled])


def drain_train_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    frozen, _, _ = pipeline.trained(prepare(events(spark, sf_dir), MiningConfig()), MiningConfig(), keep_tree=False)
    return frozen.select("id", "text", "count", "first", "last", "level", "example")


def drain_recount_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = pipeline.diff(_split_events(spark, sf_dir), MiningConfig(), DiffConfig(matcher="exact"))
    return result.entries.select("text", "category", "before_count", "after_count")


def drain_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mining of diverse text: every line of every document, default settings."""
    frozen, _, _ = pipeline.trained(prepare(document_records(spark, sf_dir), MiningConfig()), MiningConfig(), keep_tree=False)
    return frozen.select("id", "text", "count")


def template_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    return parts.select("p_partkey", template_id(F.col("p_name")).alias("id"))


_QUERIES = (
    analyze_events_exact, mask_documents, mask_pages, top20_templates_documents, run_counters, time_window, level_totals, level_filter, token_lengths,
    diff_split_at, diff_gtest, baseline_pooling, jaccard_pairs, idf_pairs, overlap_pairs, subset_pairs, value_distribution, numeric_summary,
    numeric_quantiles, new_gone_values, check_model, match_exact_rule, pii_mask_documents, payment_documents, json_parse, parse_app_lines,
    parse_access_lines, multiline_documents, parse_levels, epochs, drain_train_events, drain_recount_diff, drain_documents, template_ids,
)


def _more() -> list:
    """Modules that hold registered queries with their twins beside them."""
    from . import catalogue_formats, catalogue_io, catalogue_mining

    return [catalogue_formats, catalogue_mining, catalogue_io]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {f.__name__: f for f in _QUERIES}
    for module in _more():
        found |= module.QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found = dict(SQL)
    for module in _more():
        found |= module.SQL
    return {name: found[name] for name in queries() if name in found}

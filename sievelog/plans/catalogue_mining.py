"""Registered queries of training, recounting, models and matchers, each with its SQL twin beside it.

The events are dealt to groups.  All words of a message but one belong to its
group, so what training has to find is known: a template per group in which the
varying word is a wildcard, whatever the order, the number of groups or the
width of the tree.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CheckConfig, DiffConfig, MiningConfig
from ..operators import matchers, stats
from ..operators.spread import spread
from . import model as models
from . import pipeline
from .results import RunSummary

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
GROUPS = 150


def registered(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query by its function's name, with its twin."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_LETTERS = "translate(cast({} AS string), '0123456789', 'abcdefghij')"
_SQL_LETTERS = "translate(({})::VARCHAR, '0123456789', 'abcdefghij')"


def grouped(spark: SparkSession, sf_dir: str, group: str = f"event_id % {GROUPS}", head: str = "''") -> DataFrame:
    """Records "kaL kbL vW kcL [kdL ...]": L names the group, W the event; groups have four lengths."""
    table = spread(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id").withColumn("g", F.expr(group).cast("long")).withColumn("l", F.expr(_LETTERS.format("g")))
    text = f"concat({head}, 'ka', l, ' kb', l, ' v', {_LETTERS.format('event_id')}, ' kc', l, repeat(concat(' kd', l), cast(g % 4 AS int)))"
    level = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END"
    return table.select(
        F.lit(0).alias("run"), F.col("event_id").alias("ord"), F.expr(text).alias("message"), F.expr("unix_micros(cast(ts AS timestamp))").alias("ts_micros"),
        F.lit(False).alias("tz_aware"), F.expr(level).alias("level"), "g", F.expr(f"cast(event_id div {GROUPS} % 2 AS int)").alias("half"),
    )


def _events(group: str = f"event_id % {GROUPS}") -> str:
    text = f"'ka' || l || ' kb' || l || ' v' || {_SQL_LETTERS.format('event_id')} || ' kc' || l || repeat(' kd' || l, (g % 4)::INT)"
    return (
        f"r AS (SELECT *, {group} AS g FROM events), s AS (SELECT *, {_SQL_LETTERS.format('g')} AS l FROM r), "
        f"e AS (SELECT event_id AS ord, (event_id // {GROUPS}) % 2 AS half, g, l, epoch_us(ts) AS us, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END AS level, {text} AS message FROM s)"
    )


def _general(l: str = "l", g: str = "g") -> str:  # noqa: E741
    return f"'ka' || {l} || ' kb' || {l} || ' <*> kc' || {l} || repeat(' kd' || {l}, ({g} % 4)::INT)"


#: Template of a group: general if it has more than one message.
_TEMPLATE = f"CASE WHEN count(*) > 1 THEN {_general('min(l)', 'g')} ELSE min(message) END"
_ID = "substr(sha256(text), 1, 16)"
_WILD = "'<*> <*> <*> <*>' || repeat(' <*>', (g % 4)::INT)"
_TEMPLATES = f"WITH {_events()}, t AS (SELECT g, {_TEMPLATE} AS text, count(*) AS count, min(us) AS first, max(us) AS last, count(*) FILTER (level = 'ERROR') AS n_error, arg_min(message, ord) AS example FROM e GROUP BY g) "


def _mined(records: DataFrame, config: MiningConfig, **options) -> DataFrame:
    frozen, _, _ = pipeline.trained(pipeline.prepare(records, config), config, keep_tree=False, **options)
    return frozen


@registered(_TEMPLATES + f"SELECT {_ID} AS id, text, count, first, last, n_error, example FROM t")
def tree_generalises(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search, best candidate, generalising, and more first words than a node may have children."""
    return _mined(grouped(spark, sf_dir), MiningConfig()).select("id", "text", "count", "first", "last", "n_error", "example")


@registered(_TEMPLATES + "SELECT text, count FROM t")
def tree_few_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two children a node and two layers: nearly all paths lead through the wildcard child."""
    return _mined(grouped(spark, sf_dir), MiningConfig(depth=5, sim_th=0.7, max_children=2)).select("text", "count")


@registered(_TEMPLATES + "SELECT text, count, first, last, n_error, example FROM t")
def tree_of_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of eight stretches, merged in order."""
    return _mined(grouped(spark, sf_dir), MiningConfig(), chunks=8).select("text", "count", "first", "last", "n_error", "example")


@registered(
    f"WITH {_events()}, t AS (SELECT g, {_TEMPLATE} AS text, count(*) AS n, min(ord) AS born FROM e GROUP BY g), k AS (SELECT *, row_number() OVER (ORDER BY born) AS nth FROM t) "
    f"SELECT CASE WHEN nth <= 20 THEN text ELSE {_WILD} END AS text, sum(n)::BIGINT AS count FROM k GROUP BY 1"
)
def tree_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beyond 20 templates new shapes are pooled by their length."""
    return _mined(grouped(spark, sf_dir), MiningConfig(max_templates=20)).select("text", "count")


_BLOCKS = "event_id // 12"


@registered(
    f"WITH {_events(_BLOCKS)}, t AS (SELECT g, {_TEMPLATE} AS text, count(*) AS n, min(ord) AS born FROM e GROUP BY g), k AS (SELECT *, row_number() OVER (ORDER BY born DESC) AS back, count(*) OVER () AS total FROM t) "
    f"SELECT CASE WHEN back <= CASE WHEN total <= 30 THEN total ELSE 30 - 3 + 1 + (total - 30 - 1) % 3 END THEN text ELSE {_WILD} END AS text, sum(n)::BIGINT AS count FROM k GROUP BY 1"
)
def tree_evicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty templates, of which the three longest unused go when there is no room; groups come one after the other."""
    return _mined(grouped(spark, sf_dir, "event_id div 12"), MiningConfig(max_templates=30, on_full="evict")).select("text", "count")


@registered(
    f"WITH {_events('event_id')}, k AS (SELECT *, row_number() OVER (ORDER BY ord) AS nth FROM e) "
    f"SELECT CASE WHEN nth <= 5000 THEN message ELSE {_WILD} END AS text, count(*) AS count FROM k GROUP BY 1"
)
def tree_high_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template per record, up to 5000."""
    return _mined(grouped(spark, sf_dir, "event_id"), MiningConfig.high_cardinality()).select("text", "count")


# recount and models

_HALVES = f"x AS (SELECT g, {_general('min(l)', 'g')} AS text, count(*) FILTER (half = 0) AS b, count(*) FILTER (half = 1) AS a FROM e GROUP BY g)"


def _two_runs(records: DataFrame) -> DataFrame:
    return records.withColumn("run", F.col("half")).withColumn("ord", F.col("ord") + F.col("half").cast("long") * (1 << 62))


@registered(
    f"WITH {_events()}, {_HALVES}, c AS (SELECT text, CASE WHEN g % 50 = 0 THEN 0 ELSE b END AS b, CASE WHEN g % 50 = 1 THEN 0 ELSE a END AS a FROM x) "
    "SELECT text, CASE WHEN b = 0 THEN 'new' WHEN a = 0 THEN 'disappeared' ELSE 'unchanged' END AS category, b AS before_count, a AS after_count FROM c WHERE a + b > 0"
)
def recount_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tree over both runs, all records counted against it, templates compared."""
    records = _two_runs(grouped(spark, sf_dir)).where("NOT (run = 0 AND g % 50 = 0) AND NOT (run = 1 AND g % 50 = 1)")
    entries = pipeline.diff(records.drop("g", "half"), MiningConfig(), DiffConfig(matcher="exact", threshold_ratio=1e9)).entries
    return entries.select("text", "category", "before_count", "after_count")


def _model(records: DataFrame, config: MiningConfig | None = None) -> models.Model:
    """A model that has been saved and read again, checks and all."""
    config = config or MiningConfig()
    found = pipeline.analyze(records, config, keep_model=True).model
    with tempfile.TemporaryDirectory() as folder:
        path = Path(folder) / "model.json.gz"
        models.save(found, path)
        return models.load(path, config)


@registered(
    f"WITH {_events()}, k AS (SELECT g, {_general('min(l)', 'g')} AS text, count(*) FILTER (half = 0) AS b FROM e GROUP BY g), "
    "u AS (SELECT half, g, CASE WHEN g % 50 = 0 THEN 'lost' WHEN ord % 3 = 0 THEN 'shifted' ELSE 'known' END AS kind FROM e WHERE half = 1) "
    "SELECT k.text AS text, count(*) AS count, CAST(NULL AS INT) AS tokens FROM u JOIN k ON k.g = u.g WHERE kind <> 'lost' GROUP BY k.text "
    "UNION ALL SELECT NULL, count(*), (6 + g % 4)::INT FROM u WHERE kind = 'lost' GROUP BY 3"
)
def match_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second half of the records against a model of the first: some under another first word, found among all of their length, some that fit nothing."""
    first, second = grouped(spark, sf_dir).where("half = 0"), grouped(spark, sf_dir).where("half = 1")
    text = F.when(F.col("g") % 50 == 0, F.concat(F.lit("qa qb "), F.regexp_replace("message", "k[a-d]", "z"))).when(F.col("ord") % 3 == 0, F.regexp_replace("message", "^ka", "zz")).otherwise(F.col("message"))
    found = pipeline.match(second.withColumn("message", text).drop("g", "half"), _model(first.drop("g", "half")))
    lost = spark.createDataFrame([(None, n, t) for t, n in found.run.unmatched], "text string, count long, tokens int")
    return found.templates.select("text", "count", F.lit(None).cast("int").alias("tokens")).unionByName(lost)


@registered(
    f"WITH {_events()}, n AS (SELECT count(*) FILTER (g % 50 = 0) AS lost, count(*) AS total, count(DISTINCT g) FILTER (g % 50 = 0 AND level <> 'INFO') AS alerts FROM e WHERE half = 1) "
    "SELECT 'unmatched' AS kind, round(100.0 * lost / total, 6)::DOUBLE AS value FROM n UNION ALL SELECT 'new', alerts::DOUBLE FROM n"
)
def check_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why the second half fails a check against a model of the first, in which some groups have other shapes."""
    first, second = grouped(spark, sf_dir).where("half = 0"), grouped(spark, sf_dir).where("half = 1")
    text = F.when(F.col("g") % 50 == 0, F.regexp_replace("message", "k([a-d])", "z$1")).otherwise(F.col("message"))
    checked = pipeline.check(second.withColumn("message", text).drop("g", "half"), _model(first.drop("g", "half")), CheckConfig(max_unmatched=0.5, fail_on="new-alerts"))
    return spark.createDataFrame([(f.kind, round(f.value, 6)) for f in checked.findings], "kind string, value double")


@registered(
    f"WITH {_events()}, o AS (SELECT * FROM e WHERE half = 1), q AS (SELECT g, CASE WHEN count(*) > 1 THEN {_general('min(l)', 'g')} ELSE min(message) END AS text, count(*) AS n FROM o WHERE g % 50 = 0 GROUP BY g) "
    "SELECT CASE WHEN text LIKE 'ka%' THEN regexp_replace(text, 'k([a-d])', 'z\\1', 'g') END AS text, 'new' AS category, n AS after_count FROM q"
)
def check_new_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates of a checked log that its model does not have, mined from what fits nothing."""
    first, second = grouped(spark, sf_dir).where("half = 0"), grouped(spark, sf_dir).where("half = 1")
    text = F.when(F.col("g") % 50 == 0, F.regexp_replace("message", "k([a-d])", "z$1")).otherwise(F.col("message"))
    checked = pipeline.check(second.withColumn("message", text).drop("g", "half"), _model(first.drop("g", "half")))
    return checked.diff.of("new").select("text", "category", "after_count")


@registered(
    f"WITH {_events()}, k AS (SELECT g, {_general('min(l)', 'g')} AS text, count(*) FILTER (half = 0) AS b, count(*) AS n, min(us) AS first, max(us) AS last FROM e GROUP BY g) "
    "SELECT text, n AS total, first, last, n - b AS own FROM k"
)
def model_goes_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saved model of the first half goes on with the second: its history sums both, the result only the second."""
    first, second = grouped(spark, sf_dir).where("half = 0").drop("g", "half"), grouped(spark, sf_dir).where("half = 1").drop("g", "half")
    out = pipeline.analyze(second, MiningConfig(), start=_model(first), keep_model=True)
    history = [(" ".join(t), h[0], h[1], h[2]) for t, h in zip(out.model.tree.clusters, out.model.history, strict=True)]
    total = spark.createDataFrame(history, "text string, total long, first long, last long")
    return total.join(out.templates.select("text", F.col("count").alias("own")), "text")


@registered(
    f"WITH {_events()}, k AS (SELECT g, {_general('min(l)', 'g')} AS text, count(*) FILTER (half = 1) AS n FROM e GROUP BY g) SELECT text, n AS count FROM k"
)
def model_goes_on_in_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches that all start from the saved model; its templates are merged by their numbers."""
    first, second = grouped(spark, sf_dir).where("half = 0").drop("g", "half"), grouped(spark, sf_dir).where("half = 1").drop("g", "half")
    return pipeline.analyze(second, MiningConfig(), start=_model(first), chunks=4).templates.select("text", "count")


@registered("SELECT 'a state that evicts cannot be checked against' AS refusal")
def check_refuses_evicting_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = grouped(spark, sf_dir).drop("g", "half")
    model = _model(records, MiningConfig(on_full="evict", max_templates=10))
    try:
        pipeline.check(records, model)
        said = ""
    except ValueError as error:
        said = str(error)
    return spark.createDataFrame([(said,)], "refusal string")


# matchers

_SIDE = "SELECT DISTINCT 'on ' || w || ' and ' || w || 'x went ' || {} AS text, w FROM (SELECT " + _SQL_LETTERS.format("event_id % 400") + " AS w FROM events)"


def _sides(spark: SparkSession, sf_dir: str, before: str, after: str) -> tuple[DataFrame, DataFrame]:
    """Templates that differ only in how they end; each word group has one of either side."""
    words = spread(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id").select(F.expr(_LETTERS.format("event_id % 400")).alias("w")).distinct()
    frame = lambda end: words.select(F.expr(f"concat('on ', w, ' and ', w, 'x went {end}')").alias("text"), F.lit(1).cast("long").alias("count"))
    return frame(before), frame(after)


_PAIRED = f"SELECT b.text AS before_text, a.text AS after_text FROM ({_SIDE.format(chr(39) + 'badly off' + chr(39))}) b JOIN ({_SIDE.format(chr(39) + 'well off' + chr(39))}) a USING (w)"


@registered(_PAIRED)
def take_best_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-to-one pairs by word sets: every two templates share words, the best share their group's."""
    return matchers.match(spark, *_sides(spark, sf_dir, "badly off", "well off"), "jaccard", 0.6)


@registered(_PAIRED)
def take_best_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matchers.match(spark, *_sides(spark, sf_dir, "badly off", "well off"), "jaccard-idf", 0.5)


@registered(_PAIRED)
def take_best_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matchers.match(spark, *_sides(spark, sf_dir, "badly off", "well off"), "overlap", 0.8)


@registered(f"SELECT b.text AS before_text, a.text AS after_text FROM ({_SIDE.format(chr(39) + '<*> off' + chr(39))}) b JOIN ({_SIDE.format(chr(39) + 'well off' + chr(39))}) a USING (w)")
def take_token_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates that generalise others of their length."""
    return matchers.match(spark, *_sides(spark, sf_dir, "<*> off", "well off"), "token_subset")


@registered(
    f"WITH b AS (SELECT text, row_number() OVER (ORDER BY text) AS i FROM ({_SIDE.format(chr(39) + 'badly off' + chr(39))}) WHERE w LIKE '_'), "
    f"a AS (SELECT text, row_number() OVER (ORDER BY text) AS i FROM ({_SIDE.format(chr(39) + 'well off' + chr(39))}) WHERE w LIKE '_') SELECT b.text AS before_text, a.text AS after_text FROM b JOIN a USING (i)"
)
def pair_by_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of rules, which work both ways and pair position by position."""
    short = lambda df: df.where(F.length(F.split("text", " ")[1]) == 1)
    before, after = _sides(spark, sf_dir, "badly off", "well off")
    with tempfile.TemporaryDirectory() as folder:
        path = Path(folder) / "rules.txt"
        path.write_text("# endings\n\non <*> and <*> went well off <=> on <*> and <*> went badly off\n")
        return matchers.match(spark, short(before), short(after), f"rules:{path}")


class _ByEnd:
    """A matcher of one's own: the same group's name, which is the second word."""

    def match(self, before: list[str], after: list[str]) -> list[tuple[int, int]]:
        place = {t.split()[1]: j for j, t in enumerate(after)}
        return [(i, place[t.split()[1]]) for i, t in enumerate(before)]


@registered(_PAIRED)
def pair_by_own_matcher(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matchers.match(spark, *_sides(spark, sf_dir, "badly off", "well off"), _ByEnd())


def _frozen(texts: DataFrame, n: str) -> DataFrame:
    zero = [F.lit(0).cast("long").alias(c) for c in stats.LEVEL_COLUMNS]
    none = [F.lit(None).cast("long").alias(c) for c in ("first", "last")]
    return texts.select("text", F.expr(n).cast("long").alias("count"), *none, *zero, F.lit(None).cast("string").alias("example"))


@registered(
    f"SELECT a.text AS text, 'changed' AS category, 30 AS before_count, 90 AS after_count FROM ({_SIDE.format(chr(39) + 'badly off' + chr(39))}) b JOIN ({_SIDE.format(chr(39) + 'well off' + chr(39))}) a USING (w)"
)
def diff_of_paired_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired templates of two runs are one entry, changed by a factor of three."""
    before, after = _sides(spark, sf_dir, "badly off", "well off")
    total = before.count()
    result = pipeline.compared(_frozen(before, "30"), _frozen(after, "90"), RunSummary("b", records=90 * total), RunSummary("a", records=90 * total), DiffConfig(significance=None))
    return result.of("changed").select("text", "category", F.col("before_count").cast("int").alias("before_count"), F.col("after_count").cast("int").alias("after_count"))


@registered(_TEMPLATES + "SELECT row_number() OVER (ORDER BY count DESC, text) AS place, text, count FROM t")
def result_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most frequent first, ties by text; the twin numbers them."""
    found = pipeline.analyze(grouped(spark, sf_dir).drop("g", "half"))
    return spark.createDataFrame([(i + 1, r.text, r["count"]) for i, r in enumerate(found.top())], "place long, text string, count long")

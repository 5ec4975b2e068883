"""analyze, diff, match and check over records, as DataFrame plans.

The functions here take a DataFrame of records (run, ord, message, ts_micros,
tz_aware, level); ``sievelog.api`` puts reading and formats in front of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import EXAMPLE_BYTES, WILDCARD, CheckConfig, DiffConfig, MiningConfig, SettingError
from ..functions.masking import mask
from ..functions.tokens import cut_bytes
from ..operators import compare, matchers, stats, values
from ..operators.assign import UNMATCHED, assign
from ..operators.train import prepare, settled, train
from ..operators.tree import Tree
from .model import Model, absorb, empty_history
from .results import Analysis, Check, Diff, Finding, RunSummary

STATS = ["count", "first", "last", *stats.LEVEL_COLUMNS]


@F.pandas_udf(T.StringType())
def _example(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: cut_bytes(t, EXAMPLE_BYTES))


def _examples(templates: DataFrame, mode: str) -> DataFrame:
    """Examples raw, masked or none; only kept examples are cut."""
    if mode == "none":
        return templates.withColumn("example", F.lit(None).cast("string"))
    short = F.octet_length("example") <= EXAMPLE_BYTES
    return templates.withColumn("example", F.when(short | F.col("example").isNull(), F.col("example")).otherwise(_example("example")))


def _shown(prepared: DataFrame, mode: str) -> DataFrame:
    """Records whose message is what an example shows."""
    return prepared.withColumn("message", F.col("masked")) if mode == "masked" else prepared


def _values_shown(found: DataFrame, config: MiningConfig, mode: str) -> DataFrame:
    """Values as the examples' mode allows: as they are, masked (and then summed by what they have become), or none."""
    if mode == "none":
        return found.where(F.lit(False))
    return found.withColumn("value", mask(F.col("value"), config.masks)) if mode == "masked" else found


def _text(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def _texts(tree: Tree, prepared: DataFrame) -> DataFrame:
    """Number and text of each cluster (at most ``max_templates`` rows)."""
    rows = [(c, " ".join(t)) for c, t in enumerate(tree.clusters)]
    return prepared.sparkSession.createDataFrame(rows, "cluster int, text string")


def trained(
    prepared: DataFrame, config: MiningConfig, start: Tree | None = None, examples: str = "raw", *, chunks: int | None = None, keep_tree: bool = True
) -> tuple[DataFrame, DataFrame, Tree | None]:
    """(frozen templates, raw cluster statistics, tree) of training alone."""
    clusters, tree = train(prepared, config, start, examples=examples, chunks=chunks, keep_tree=keep_tree)
    named = clusters.withColumn("text", _text(F.col("tokens")))
    return stats.freeze(named.select("text", "run", *STATS, "example", "first_ord")), clusters, tree


def counted(
    prepared: DataFrame, tree: Tree, *, exact: bool = False, pool_unmatched: bool = True, examples: str = "raw"
) -> tuple[DataFrame, DataFrame, dict[int, tuple[tuple[int, int], ...]]]:
    """(frozen templates, assigned records, unmatched (tokens, records) by run) of a pass against a finished tree.

    A record that matches nothing goes to ``<*>`` repeated to its length, or is
    left out of the templates.  Records are summed by cluster in one pass whose
    result, at most a row per template, run and unmatched length, is kept.
    """
    named = assign(prepared, tree, exact=exact)
    alone = F.when(F.col("cluster") == UNMATCHED, F.col("n_tokens"))
    grouped = settled(stats.per_template(_shown(named, examples).withColumn("wild", alone), ["cluster", "wild", "run"]))
    unmatched: dict[int, tuple[tuple[int, int], ...]] = {}
    for r in grouped.where("wild is not null").orderBy("run", "wild").select("run", "wild", "count").collect():
        unmatched[r.run] = (*unmatched.get(r.run, ()), (r.wild, r["count"]))
    texts = _texts(tree, prepared)
    wild = F.when(F.col("wild") > 0, F.concat(F.lit(WILDCARD), F.expr(f"repeat(' {WILDCARD}', wild - 1)"))).otherwise(F.lit(""))
    frozen = grouped.join(texts, "cluster", "left")
    frozen = frozen.withColumn("text", F.coalesce("text", wild)) if pool_unmatched else frozen.where("text is not null")
    return _examples(stats.freeze(frozen.drop("cluster", "wild")), examples), named.join(F.broadcast(texts), "cluster", "left"), unmatched  # bounded by max_templates


def _summaries(clusters: DataFrame, base: dict[int, RunSummary]) -> dict[int, RunSummary]:
    """Counters with the flags that training raised."""
    rows = clusters.groupBy("run").agg(F.bool_or("pooled").alias("pooled"), F.max("evicted").alias("evicted"), F.sum("count").alias("records")).collect()
    out = dict(base)
    for r in rows:
        own = out.get(r.run, RunSummary(f"run {r.run}", records=r.records))
        out[r.run] = replace(own, records=own.records or r.records, overflowed=bool(r.pooled), evicted=r.evicted or 0)
    return out


def _model(clusters: DataFrame, tree: Tree, config: MiningConfig, start: Model | None, format: str) -> Model:
    births = {b: c for c, b in enumerate(tree.births)}
    history = [empty_history() for _ in tree.clusters]
    overflow = {n: h for n, h in start.overflow.items()} if start else {}
    if start:
        for c, h in enumerate(start.history):
            if (new := births.get(c - len(start.history))) is not None:
                history[new] = h
            else:  # evicted since
                n = len(start.tree.clusters[c])
                overflow[n] = absorb(overflow.get(n, empty_history()), *h)
    for r in clusters.toLocalIterator():
        run = (r["count"], r["first"], r["last"], [r[c] for c in stats.LEVEL_COLUMNS])
        if r.pooled:
            overflow[r.n_tokens] = absorb(overflow.get(r.n_tokens, empty_history()), *run)
        else:
            c = births[r.birth]
            history[c] = absorb(history[c], *run)
    return Model(config, tree, history, overflow, format)


def analyze(
    records: DataFrame, config: MiningConfig | None = None, *, run: RunSummary | None = None, format: str = "plain", examples: str = "raw",
    start: Model | None = None, keep_model: bool = False, with_values: bool = False, value_templates: int = values.TRACKED, value_limit: int | None = values.DISTINCT, chunks: int | None = None,
) -> Analysis:
    """Templates of one run; ``chunks`` trains so many stretches apart and merges their trees.

    Of a position ``value_limit`` values are counted, the ones seen first, or all (None).
    """
    if examples not in ("raw", "masked", "none"):
        raise SettingError("examples are 'raw', 'masked' or 'none'")
    config = config or MiningConfig()
    if start and start.config.fingerprint() != config.fingerprint():
        raise SettingError("the state was mined with other masks or parameters")
    prepared = prepare(records, config)
    templates, clusters, tree = trained(prepared, config, start.tree if start else None, examples, chunks=chunks, keep_tree=keep_model or with_values)
    summary = _summaries(clusters, {0: run} if run else {}).get(0, run or RunSummary())
    model = _model(clusters, tree, config, start, format) if keep_model else None
    result = Analysis(templates.drop("run", "first_ord"), summary, format, model=model)
    if with_values:
        frozen, named, _ = counted(prepared, tree, examples=examples)
        first = values.tracked(templates, value_templates).select("text")
        found = values.parameters(named.join(F.broadcast(first), "text", "left_semi"), config.masks, config.delimiters)  # at most value_templates rows
        result.templates, result.values, result.numbers = frozen.drop("run", "first_ord"), values.distribution(_values_shown(found, config, examples), limit=value_limit), values.numeric_summary(found)
    return result


def diff(
    records: DataFrame, config: MiningConfig | None = None, options: DiffConfig | None = None, *, summaries: dict[int, RunSummary] | None = None,
    recount: bool = True, matcher: object = None, threshold: float | None = None, examples: str = "raw", new_values: bool = False, value_templates: int = values.TRACKED, chunks: int | None = None,
) -> Diff:
    """Compare the last run of ``records`` with the runs before it (several are pooled as baselines)."""
    config, options = config or MiningConfig(), options or DiffConfig()
    prepared = prepare(records, config)
    templates, clusters, tree = trained(prepared, config, examples=examples, chunks=chunks, keep_tree=recount or new_values)
    runs = _summaries(clusters, summaries or {})
    last = max(runs, default=1)
    named = None
    if recount or new_values:
        templates, named, unmatched = counted(prepared, tree, examples=examples)
        for r, lengths in unmatched.items():
            runs[r] = replace(runs[r], overflowed=True, unmatched=lengths)
    before, after = templates.where(F.col("run") < max(last, 1)), templates.where(F.col("run") == max(last, 1))
    unstable = None
    if last > 1:
        before, unstable = compare.pool_baselines(before, options.min_baselines, last)
    summary_b = runs.get(0, RunSummary("before"))
    for r in range(1, last):
        summary_b = replace(summary_b, records=summary_b.records + runs[r].records, lines=summary_b.lines + runs[r].lines)
    result = compared(before, after, summary_b, runs.get(max(last, 1), RunSummary("after")), options, matcher=matcher, threshold=threshold, unstable=unstable)
    if new_values:
        if last != 1:
            raise SettingError("new values need exactly two runs")
        first = values.tracked(templates.groupBy("text").agg(F.sum("count").alias("count")), value_templates).select("text")
        found = values.parameters(named.join(F.broadcast(first), "text", "left_semi"), config.masks, config.delimiters)
        result.value_changes = values.value_changes(_values_shown(found, config, examples))
    return result


def compared(
    before: DataFrame, after: DataFrame, before_run: RunSummary, after_run: RunSummary, options: DiffConfig, *,
    matcher: object = None, threshold: float | None = None, unstable: DataFrame | None = None,
) -> Diff:
    """Comparison of two frames of frozen templates, which may come from saved results."""
    spark = after.sparkSession
    n_unstable = 0
    if unstable is not None:
        n_unstable = after.join(unstable, "text", "left_semi").count()
        after = after.join(unstable, "text", "left_anti")
    chosen = options.matcher if matcher is None else matcher
    pairs = None
    if chosen != "exact":
        one_b, one_a = before.join(after.select("text"), "text", "left_anti"), after.join(before.select("text"), "text", "left_anti")
        pairs = matchers.match(spark, one_b, one_a, chosen, threshold)
    both = compare.joined(before, after, pairs)
    entries = compare.with_p(compare.classify(both, before_run.records, after_run.records, options))
    return Diff(entries, before_run, after_run, options, unstable=n_unstable)


def match(records: DataFrame, model: Model, *, exact: bool = False, run: RunSummary | None = None, examples: str = "raw") -> Analysis:
    """Records against a model, which is only read; what matches nothing is counted by its length."""
    prepared = prepare(records, model.config)
    templates, _, unmatched = counted(prepared, model.tree, exact=exact, pool_unmatched=False, examples=examples)
    lost = sum(n for _, n in unmatched.get(0, ()))
    total = (templates.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0] + lost) if run is None else run.records
    summary = replace(run or RunSummary(), records=total, unmatched=unmatched.get(0, ()))
    return Analysis(templates.drop("run", "first_ord"), summary, model.format, model=model)


def _model_templates(model: Model, like: DataFrame) -> DataFrame:
    rows = [(" ".join(t), 0, h[0], h[1], h[2], *h[3]) for t, h in zip(model.tree.clusters, model.history, strict=True)]
    rows += [(" ".join([WILDCARD] * n), 0, h[0], h[1], h[2], *h[3]) for n, h in model.overflow.items()]
    schema = "text string, run int, count long, first long, last long, " + ", ".join(f"{c} long" for c in stats.LEVEL_COLUMNS)
    frame = like.sparkSession.createDataFrame(rows, schema)
    return stats.freeze(frame.withColumn("example", F.lit(None).cast("string")).withColumn("first_ord", F.lit(0).cast("long")))


def check(
    records: DataFrame, model: Model, options: CheckConfig | None = None, limits: DiffConfig | None = None, *, run: RunSummary | None = None, examples: str = "raw"
) -> Check:
    """A log held against a model: matched records by the model, the others mined by themselves."""
    if model.config.on_full == "evict":
        raise SettingError("a state that evicts cannot be checked against")
    options, limits = options or CheckConfig(), limits or DiffConfig()
    prepared = prepare(records, model.config)
    matched, named, unmatched = counted(prepared, model.tree, pool_unmatched=False, examples=examples)
    strange = named.where(F.col("cluster") == UNMATCHED).select(*prepared.columns)
    fresh, _, _ = trained(strange, model.config, examples=examples, keep_tree=False)
    lost = sum(n for _, n in unmatched.get(0, ()))
    total = (matched.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0] + lost) if run is None else run.records
    summary = replace(run or RunSummary(), records=total, unmatched=unmatched.get(0, ()))
    known = RunSummary("model", records=sum(h[0] for h in model.history) + sum(h[0] for h in model.overflow.values()))
    result = compared(_model_templates(model, prepared), matched.unionByName(fresh), known, summary, limits, matcher="exact")
    result.entries = result.entries.where("category is null or category <> 'disappeared'")
    return Check(result, summary, findings(result, summary, options), options)


def findings(result: Diff, run: RunSummary, options: CheckConfig) -> list[Finding]:
    """Why the check fails: nothing parsed, too many unmatched records, new templates."""
    if not run.records:
        return [Finding("empty", "nothing was checked: the log has no record", 0.0)]
    out, share = [], 100.0 * run.unmatched_records / run.records
    if share > options.max_unmatched:
        out.append(Finding("unmatched", f"{share:.2f}% of the records ({run.unmatched_records:,}) fit no template of the model; {options.max_unmatched:g}% are allowed", share, options.max_unmatched))
    if options.fail_on != "none":
        n = (result.new_alerts() if options.fail_on == "new-alerts" else result.of("new")).count()
        if n:
            kind = " of level WARN or above" if options.fail_on == "new-alerts" else ""
            out.append(Finding("new", f"{n:,} template{'s' if n > 1 else ''}{kind} not in the model", float(n)))
    return out


def saved_templates(frame: DataFrame) -> DataFrame:
    """Templates of a saved result in the shape that ``compared`` takes."""
    wanted: Sequence[str] = ["text", *STATS, "example"]
    return frame.select(*wanted)

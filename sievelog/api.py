"""The calls of the library: analyze, diff, check, match, inspect, parameters, saved results."""

from __future__ import annotations

import json
from collections.abc import Sequence
from contextlib import ExitStack
from datetime import UTC, datetime, timedelta
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .config import ALGO_VERSION, LEVELS, CheckConfig, DiffConfig, MiningConfig, SettingError
from .functions.mask_sets import SETS, MaskSet, select
from .functions.parameters import extract_parameters
from .operators.matchers import NAMES as MATCHERS
from .operators.matchers import OWN as OWN_MATCHERS
from .operators.stats import LEVEL_COLUMNS
from .operators.values import DISTINCT
from .plans import model as models
from .plans import pipeline
from .plans.results import Analysis, Check, Diff, RunSummary
from .reporters.documents import REPORTERS, render, view, write
from .sources import detect, external
from .sources.formats import FORMATS, Format, PlainFormat, RegexFormat
from .sources.lines import read_lines
from .sources.records import TimeWindow, admitted, counters, parse

__all__ = [
    "analyze", "check", "diff", "extract_parameters", "info", "inspect_file", "is_saved_analysis", "load_analysis", "load_config", "match",
    "render", "save_analysis", "time_bound", "view", "write",
]

Paths = str | Path | Sequence[str | Path]
MAX_SAVED_BYTES = 256 << 20
FEW_PARSED = 0.10


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def time_bound(text: str | datetime | None) -> int | None:
    """Microseconds of an ISO text or a datetime; without a zone the time is taken as written."""
    if text is None:
        return None
    if isinstance(text, str):
        try:
            text = datetime.fromisoformat(text.strip())
        except ValueError as error:
            raise SettingError(f"{text!r} is no ISO time") from error
    when = text if text.tzinfo else text.replace(tzinfo=UTC)
    return (when - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)


def load_config(path: str | Path) -> dict:
    """Settings of a TOML file: tables of options by name."""
    import tomllib

    data = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    known = {"mining", "masks", "diff", "check", "output", "input"}
    if unknown := set(data) - known:
        raise SettingError(f"{path} has unknown tables: {', '.join(sorted(unknown))}")
    return data


def mining_config(masks: Sequence[str] | str | None = None, mask_sets: Sequence[MaskSet] = (), **options) -> MiningConfig:
    """Mining settings; ``masks`` are names of mask sets."""
    own = {k: v for k, v in options.items() if v is not None}
    if masks is not None or mask_sets:
        own["masks"] = select(masks, mask_sets)
    return MiningConfig(**own)


class _Runs:
    """Lines and records of one or more runs, each a list of inputs."""

    def __init__(self, stack: ExitStack, runs: Sequence[Paths], format: str | Format, multiline: bool | None, windows: Sequence[TimeWindow], source: dict | None = None):
        spark = session()
        self.names, paths = [], []
        for run in runs:
            given = [str(p) for p in ([run] if isinstance(run, (str, Path)) else run)]
            self.names.append(", ".join(given))
            paths.append([stack.enter_context(external.fetch(p, **(source or {}))) if external.is_source(p) else p for p in given])
        self.spec = detect.format_of(spark, format, paths[0], multiline)
        if any(not w.open for w in windows) and (isinstance(self.spec, PlainFormat) or (isinstance(self.spec, RegexFormat) and not self.spec.time_group)):
            raise SettingError("a time window needs a format with a time")
        run_bit = 63 - max(1, (len(paths) - 1).bit_length())  # the order of all runs: the run comes first
        records, self.summaries = None, {}
        for k, (own, window) in enumerate(zip(paths, windows, strict=True)):
            lines = read_lines(spark, own, 0, run_bit).withColumn("run", F.lit(k))
            parsed = parse(lines, self.spec)
            row = counters(lines, parsed, window).first()
            self.summaries[k] = RunSummary(self.names[k], **({c: row[c] for c in ("lines", "records", "unparsed", "out_of_range", "untimed", "tz_aware")} if row else {}))
            shifted = admitted(parsed, window).withColumn("ord", F.col("ord") + F.lit(k).cast("long") * (1 << run_bit))
            records = shifted if records is None else records.unionByName(shifted)
        self.records: DataFrame = records
        self.warnings = [f"{s.unparsed:,} of {s.lines:,} lines of {s.name} were not parsed" for s in self.summaries.values() if s.lines and s.unparsed > FEW_PARSED * s.lines]
        if len(paths) > 11:
            self.warnings.append("more than 10 baselines are pooled")


def analyze(
    path: Paths, *, format: str | Format = "auto", multiline: bool | None = None, config: MiningConfig | None = None, masks: Sequence[str] | str | None = None,
    since=None, until=None, examples: str = "raw", values: bool = False, value_templates: int = 200, value_limit: int | None = DISTINCT,
    load_state: str | Path | None = None, save_state: str | Path | None = None, source: dict | None = None, **mining,
) -> Analysis:
    """Templates of the log in one or more files; of a variable position the first ``value_limit`` values are counted, or all (None)."""
    config = config or mining_config(masks, **mining)
    with ExitStack() as stack:
        runs = _Runs(stack, [path], format, multiline, [TimeWindow(time_bound(since), time_bound(until))], source)
        start = models.load(load_state, config) if load_state else None
        out = pipeline.analyze(
            runs.records, config, run=runs.summaries[0], format=runs.spec.name, examples=examples, start=start,
            keep_model=save_state is not None, with_values=values, value_templates=value_templates, value_limit=value_limit,
        )
        out.templates = out.templates.cache()
        out.templates.count()  # before a fetched log goes
        out.warnings = runs.warnings + (["the template limit was reached"] if out.run.overflowed else [])
        if save_state is not None:
            models.save(out.model, save_state)
        return out


def diff(
    before: Paths, after: Paths | None = None, *, baselines: Sequence[Paths] = (), split_at=None, format: str | Format = "auto", multiline: bool | None = None,
    config: MiningConfig | None = None, options: DiffConfig | None = None, masks: Sequence[str] | str | None = None, since=None, until=None,
    recount: bool = True, matcher: object = None, threshold: float | None = None, examples: str = "raw", new_values: bool = False, source: dict | None = None, **mining,
) -> Diff:
    """What differs between two logs, between baselines and a log, between two parts of one log, or between two saved results."""
    options = options or DiffConfig()
    if split_at is None and after is None:
        raise SettingError("a second log or split_at is needed")
    if split_at is None and is_saved_analysis(before) and is_saved_analysis(after):
        return _diff_saved(before, after, options, matcher, threshold)
    config = config or mining_config(masks, **mining)
    low, high, cut = time_bound(since), time_bound(until), time_bound(split_at)
    if cut is not None:
        inputs, windows = [before, before], [TimeWindow(low, cut), TimeWindow(cut, high)]
    else:
        inputs = [before, *baselines, after]
        windows = [TimeWindow(low, high)] * len(inputs)
    with ExitStack() as stack:
        runs = _Runs(stack, inputs, format, multiline, windows, source)
        out = pipeline.diff(runs.records, config, options, summaries=runs.summaries, recount=recount, matcher=matcher, threshold=threshold, examples=examples, new_values=new_values)
        out.entries = out.entries.cache()
        out.entries.count()
        out.warnings = runs.warnings
        return out


def match(state: str | Path, path: Paths, *, exact: bool = False, format: str | Format = "auto", multiline: bool | None = None, config: MiningConfig | None = None, masks=None, since=None, until=None, examples: str = "raw", **mining) -> Analysis:
    """Counts of a saved model's templates in a log; nothing is learned."""
    model = models.load(state, config or mining_config(masks, **mining))
    with ExitStack() as stack:
        runs = _Runs(stack, [path], format, multiline, [TimeWindow(time_bound(since), time_bound(until))])
        out = pipeline.match(runs.records, model, exact=exact, run=runs.summaries[0], examples=examples)
        out.templates = out.templates.cache()
        out.templates.count()
        return out


def check(state: str | Path, path: Paths, *, max_unmatched: float = 1.0, fail_on: str = "new-alerts", options: DiffConfig | None = None, format: str | Format = "auto", multiline: bool | None = None, config: MiningConfig | None = None, masks=None, since=None, until=None, examples: str = "raw", **mining) -> Check:
    """Whether a log holds anything that a saved model does not know."""
    model = models.load(state, config or mining_config(masks, **mining))
    with ExitStack() as stack:
        runs = _Runs(stack, [path], format, multiline, [TimeWindow(time_bound(since), time_bound(until))])
        return pipeline.check(runs.records, model, CheckConfig(max_unmatched, fail_on), options, run=runs.summaries[0], examples=examples)


def inspect_file(path: str | Path, **options) -> dict:
    """How a log is read, without mining it."""
    return detect.inspect(session(), str(path), **options)


def save_analysis(result: Analysis, path: str | Path) -> None:
    """A result as a JSON document that ``diff`` reads."""
    write(result, path, "json")


def is_saved_analysis(path: object) -> bool:
    """Whether a path is a saved result."""
    if not isinstance(path, (str, Path)) or not Path(path).is_file() or Path(path).suffix != ".json":
        return False
    with Path(path).open("rb") as file:
        return b'"kind": "analysis"' in file.read(4096)


def load_analysis(path: str | Path) -> Analysis:
    """Read a saved result."""
    raw = Path(path)
    if raw.stat().st_size > MAX_SAVED_BYTES:
        raise SettingError(f"{path} is larger than 256 MiB")
    head = raw.read_bytes()
    if head[:2] in (b"\xff\xfe", b"\xfe\xff"):
        raise SettingError(f"{path} is UTF-16; save it as UTF-8")
    data = json.loads(head.decode("utf-8-sig"))
    if data.get("kind") != "analysis" or data.get("schema_version") != 1:
        raise SettingError(f"{path} is no saved result of this kind")
    if data.get("algo_version", ALGO_VERSION) != ALGO_VERSION:
        raise SettingError(f"{path} was mined by another version of the rules; its templates cannot be compared")
    micros = lambda x: time_bound(x) if x else None
    rows = [
        (x["id"], x["text"], x["count"], micros(x.get("first_seen")), micros(x.get("last_seen")), *(x["levels"].get(n, 0) for n in LEVELS), x.get("example"), x.get("level"))
        for x in data["templates"]
    ]
    schema = "id string, text string, count long, first long, last long, " + ", ".join(f"{c} long" for c in LEVEL_COLUMNS) + ", example string, level string"
    run = {k: tuple(map(tuple, v)) if k == "unmatched" else v for k, v in data["runs"][0].items()}
    return Analysis(session().createDataFrame(rows, schema), RunSummary(**run), data.get("format", "plain"), data.get("warnings", []))


def _diff_saved(before, after, options: DiffConfig, matcher: object, threshold: float | None) -> Diff:
    left, right = load_analysis(before), load_analysis(after)
    return pipeline.compared(pipeline.saved_templates(left.templates), pipeline.saved_templates(right.templates), left.run, right.run, options, matcher=matcher, threshold=threshold)


def info() -> dict:
    """Versions and what is known by name."""
    import pyspark

    return {
        "version": __version__, "algo_version": ALGO_VERSION, "spark": pyspark.__version__, "formats": [*FORMATS, "log4j"], "mask_sets": list(SETS),
        "matchers": [*MATCHERS, *OWN_MATCHERS], "reports": list(REPORTERS), "sources": list(external.SOURCES),
    }

"""Results: frames of templates with the counters of their runs, ready to show, write or compare."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..config import CheckConfig, DiffConfig
from ..operators import stats


@dataclass(frozen=True)
class RunSummary:
    """Counters of one run."""

    name: str = "run"
    lines: int = 0
    records: int = 0
    unparsed: int = 0
    out_of_range: int = 0
    untimed: int = 0
    tz_aware: bool = False
    overflowed: bool = False
    evicted: int = 0
    unmatched: tuple[tuple[int, int], ...] = ()

    @property
    def unmatched_records(self) -> int:
        return sum(n for _, n in self.unmatched)


@dataclass
class Analysis:
    """Templates of one run: id, text, count, first, last, n_<level>, example, level."""

    templates: DataFrame
    run: RunSummary
    format: str = "plain"
    warnings: list[str] = field(default_factory=list)
    values: DataFrame | None = None
    numbers: DataFrame | None = None
    model: object = None

    def top(self, k: int | None = None) -> list:
        return stats.ranked(self.templates, k).collect()

    def filtered(self, *, min_level: str | None = None, min_count: int = 0) -> Analysis:
        return Analysis(stats.only(self.templates, min_level=min_level, min_count=min_count), self.run, self.format, self.warnings, self.values, self.numbers, self.model)

    def level_totals(self) -> dict[str, int]:
        return {r.level: r.records for r in stats.level_totals(self.templates).collect() if r.records}


@dataclass
class Diff:
    """Entries of two runs, a row per template, with its category."""

    entries: DataFrame
    before: RunSummary
    after: RunSummary
    config: DiffConfig
    warnings: list[str] = field(default_factory=list)
    value_changes: DataFrame | None = None
    unstable: int = 0

    def of(self, category: str) -> DataFrame:
        from ..operators.compare import ordered

        return ordered(self.entries, category)

    def counts(self) -> dict[str, int]:
        found = {r.category: r["count"] for r in self.entries.groupBy("category").count().collect()}
        out = {c: found.get(c, 0) for c in ("new", "disappeared", "changed", "unchanged")}
        out["unchanged"] += self.unstable
        return out

    def new_alerts(self) -> DataFrame:
        from pyspark.sql import functions as F

        return self.of("new").where(stats.is_alert(F.col("level")))


@dataclass(frozen=True)
class Finding:
    """Why a check failed."""

    kind: str
    message: str
    value: float
    threshold: float | None = None


@dataclass
class Check:
    """A log held against a model."""

    diff: Diff
    run: RunSummary
    findings: list[Finding]
    config: CheckConfig

    @property
    def passed(self) -> bool:
        return not self.findings

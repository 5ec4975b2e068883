"""Reports of results: JSON, plain text, Markdown, CSV, HTML, CI summary, JUnit, chat message, metrics.

A result is collected once into ``View`` rows (at most the templates of the
result, which ``max_templates`` bounds); ``write_bulk`` writes frames without
collecting them.
"""

from __future__ import annotations

import csv
import html
import io
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime, timedelta
from pathlib import Path

from pyspark.sql import DataFrame

from ..config import ALERTS, ALGO_VERSION, LEVELS, SettingError
from ..operators.stats import LEVEL_COLUMNS
from ..plans.results import Analysis, Check, Diff, RunSummary
from . import text as t

NAME = "sievelog"
HTML_ROWS = 2000


@dataclass
class View:
    """Plain rows of a result."""

    kind: str
    runs: list[RunSummary]
    sections: dict[str, list[dict]]
    unchanged: int = 0
    warnings: list[str] = field(default_factory=list)
    extra: dict = field(default_factory=dict)

    @property
    def templates(self) -> list[dict]:
        return self.sections.get("templates", [])

    @property
    def title(self) -> str:
        return " -> ".join(r.name for r in self.runs)


def _time(micros: int | None, aware: bool) -> str | None:
    if micros is None:
        return None
    when = datetime.fromtimestamp(0, UTC) + timedelta(microseconds=micros)
    return (when if aware else when.replace(tzinfo=None)).isoformat()


def _levels(row: dict) -> dict[str, int]:
    return {name: row[c] for name, c in zip(LEVELS, LEVEL_COLUMNS, strict=True) if row.get(c)}


def view(result: Analysis | Diff | Check) -> View:
    """Collect a result once."""
    if isinstance(result, Check):
        out = view(result.diff)
        out.kind = "check"
        share = 100.0 * result.run.unmatched_records / result.run.records if result.run.records else 0.0
        out.extra = {
            "passed": result.passed, "fail_on": result.config.fail_on, "max_unmatched": result.config.max_unmatched,
            "unmatched": {"records": result.run.unmatched_records, "share": round(share, 6), "by_length": [list(p) for p in result.run.unmatched]},
            "findings": [asdict(f) for f in result.findings],
        }
        return out
    if isinstance(result, Analysis):
        rows = [r.asDict(recursive=True) for r in result.top()]
        for r in rows:
            r |= {"levels": _levels(r), "first_seen": _time(r["first"], result.run.tz_aware), "last_seen": _time(r["last"], result.run.tz_aware)}
        extra = {"format": result.format}
        for name, frame in (("values", result.values), ("numbers", result.numbers)):
            if frame is not None:
                extra[name] = [r.asDict(recursive=True) for r in frame.orderBy("text", "position", "name").collect()]
        return View("analysis", [result.run], {"templates": rows}, warnings=list(result.warnings), extra=extra)
    sections = {}
    for name in ("new", "changed", "disappeared"):
        sections[name] = [r.asDict(recursive=True) for r in result.of(name).collect()]
        for r in sections[name]:
            aware = result.after.tz_aware
            r |= {"levels": _levels(r), "first_seen": _time(r["first"], aware), "last_seen": _time(r["last"], aware)}
    extra = {"config": asdict(result.config)}
    if result.value_changes is not None:
        extra["value_changes"] = [r.asDict(recursive=True) for r in result.value_changes.orderBy("text", "position", "name").collect()]
    return View("diff", [result.before, result.after], sections, result.counts()["unchanged"], list(result.warnings), extra)


def _alert(row: dict) -> bool:
    return row["level"] in ALERTS


def _alerts_first(rows: list[dict]) -> list[dict]:
    return sorted(rows, key=lambda r: not _alert(r))


def _share(n: int, total: int) -> str:
    return f"{100 * n / total if total else 0:.2f}%"


def _number(row: dict) -> int:
    return row["count"] if "count" in row else row["after_count"]


# Reports


def as_json(v: View, top: int | None = None, **_: object) -> str:
    keys = ("id", "text", "count", "category", "before_count", "after_count", "before_share", "after_share", "ratio", "factor", "score", "p", "level", "levels", "example", "first_seen", "last_seen")
    pick = lambda rows: [{k: r[k] for k in keys if k in r} for r in rows[:top]]
    names = {"new": "new_templates"}
    data: dict = {"schema_version": 1, "algo_version": ALGO_VERSION, "kind": v.kind, "runs": [asdict(r) for r in v.runs], "warnings": v.warnings}
    if v.kind != "analysis":
        data["summary"] = {n: len(rows) for n, rows in v.sections.items()} | {"new_alerts": sum(map(_alert, v.sections["new"])), "unchanged": v.unchanged}
    data |= {names.get(n, n): pick(rows) for n, rows in v.sections.items()} | v.extra
    return json.dumps(data, ensure_ascii=False, indent=2) + "\n"


def as_text(v: View, top: int = 20, **_: object) -> str:
    line = lambda x, w=160: t.clip(" ".join(t.printable(x).split()), w)
    out = []
    if v.kind == "analysis":
        run = v.runs[0]
        out += [f"{t.printable(run.name)}: {run.records:,} records, {len(v.templates):,} templates, {run.unparsed:,} unparsed lines, format {v.extra['format']}"]
        out += [f"warning: {t.printable(w)}" for w in v.warnings] + ["", f"{'count':>10}  {'share':>7}  level  template"]
        out += [f"{r['count']:>10,}  {_share(r['count'], run.records):>7}  {r['level'] or '':<5}  {line(r['text'])}" for r in v.templates[:top]]
        if len(v.templates) > top:
            out.append(f"... {len(v.templates) - top:,} more templates")
        return "\n".join(out) + "\n"
    b, a = v.runs
    out += [f"{t.printable(v.title)}: {b.records:,} -> {a.records:,} records, " + ", ".join(f"{len(rows):,} {n}" for n, rows in v.sections.items()) + f", {v.unchanged:,} unchanged"]
    out += [f"warning: {t.printable(w)}" for w in v.warnings] + [f"FAILED: {f['message']}" for f in v.extra.get("findings", [])]
    for name, rows in v.sections.items():
        out += ["", f"{name.capitalize()} templates ({len(rows):,})"]
        out += [f"{'before':>10}  {'after':>10}  {'change':>8}  level  template"] if rows else ["  none"]
        for r in rows[:top]:
            change = f"x{r['ratio']:.2f}" if r["ratio"] is not None else "new" if name == "new" else "gone"
            out.append(f"{r['before_count']:>10,}  {r['after_count']:>10,}  {change:>8}  {r['level'] or '':<5}  {line(r['text'])}")
        if len(rows) > top:
            out.append(f"... {len(rows) - top:,} more")
    return "\n".join(out) + "\n"


def as_markdown(v: View, top: int = 20, **_: object) -> str:
    out = [f"# {t.cell(v.title)}", ""]
    if v.kind == "analysis":
        out += [f"{v.runs[0].records:,} records, {len(v.templates):,} templates.", "", "| count | level | template |", "|---:|---|---|"]
        return "\n".join(out + [f"| {r['count']:,} | {r['level'] or ''} | `{t.cell(r['text'])}` |" for r in v.templates[:top]]) + "\n"
    out.append(", ".join(f"{len(rows):,} {n}" for n, rows in v.sections.items()) + f", {v.unchanged:,} unchanged.")
    for name, rows in v.sections.items():
        if rows:
            out += ["", f"## {name.capitalize()} templates", "", "| before | after | level | template |", "|---:|---:|---|---|"]
            out += [f"| {r['before_count']:,} | {r['after_count']:,} | {r['level'] or ''} | `{t.cell(r['text'])}` |" for r in rows[:top]]
    return "\n".join(out) + "\n"


def as_csv(v: View, top: int | None = None, **_: object) -> str:
    buffer = io.StringIO()
    write = csv.writer(buffer, lineterminator="\n").writerow
    none = lambda x: "" if x is None else x
    if v.kind == "analysis":
        write(["count", "level", "first_seen", "last_seen", "template"])
        for r in v.templates[:top]:
            write([r["count"], r["level"] or "", none(r["first_seen"]), none(r["last_seen"]), t.guarded(r["text"])])
    else:
        write(["kind", "before_count", "after_count", "level", "template", "score", "p_value"])
        for name, rows in v.sections.items():
            for r in rows[:top]:
                write([name, r["before_count"], r["after_count"], r["level"] or "", t.guarded(r["text"]), none(r["score"] if name == "changed" else None), none(r["p"])])
    return buffer.getvalue()


_STYLE = "body{font:14px sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:2px 8px;text-align:left}td.n{text-align:right}code{white-space:pre-wrap}"


def as_html(v: View, top: int = HTML_ROWS, **_: object) -> str:
    """A page that loads nothing."""
    esc = lambda x: html.escape(t.printable(str(x)))
    out = ["<!DOCTYPE html>", '<html lang="en"><head><meta charset="utf-8">', f"<meta http-equiv=\"Content-Security-Policy\" content=\"default-src 'none'; style-src 'unsafe-inline'\"><title>{esc(v.title)}</title><style>{_STYLE}</style></head><body>"]
    out.append(f"<h1>{esc(v.title)}</h1><p>" + "; ".join(f"{esc(r.name)}: {r.records:,} records, {r.unparsed:,} unparsed lines" for r in v.runs) + "</p>")
    out += [f"<p>warning: {esc(w)}</p>" for w in v.warnings] + [f"<p><b>failed:</b> {esc(f['message'])}</p>" for f in v.extra.get("findings", [])]
    top = min(top, HTML_ROWS)
    for name, rows in v.sections.items():
        numbers = ["count"] if name == "templates" else ["before_count", "after_count"]
        out.append(f"<h2>{esc(name)} ({len(rows):,})</h2><table><tr>" + "".join(f"<th>{n}</th>" for n in [*numbers, "level", "template", "example"]) + "</tr>")
        for r in rows[:top]:
            out.append("<tr>" + "".join(f'<td class="n">{r[n]:,}</td>' for n in numbers) + f"<td>{esc(r['level'] or '')}</td><td><code>{esc(r['text'])}</code></td><td><code>{esc(r['example'] or '')}</code></td></tr>")
        out.append("</table>" + (f"<p>... {len(rows) - top:,} more</p>" if len(rows) > top else ""))
    return "\n".join([*out, "</body></html>"]) + "\n"


def _item(row: dict, name: str, records: int) -> str:
    level = f"**{row['level']}** " if row["level"] else ""
    if name == "templates":
        size = f"{row['count']:,} ({_share(row['count'], records)})"
    elif name == "changed" and row["ratio"] is not None:
        size = f"x{row['ratio']:.2f} ({row['before_count']:,} -> {row['after_count']:,})"
    elif name == "disappeared":
        size = f"{row['before_count']:,} -> 0"
    else:
        size = f"{row['after_count']:,}"
    return f"- {level}{size} {t.code_span(row['text'], 300)}"


def as_ci_summary(v: View, top: int = 20, max_bytes: int = 900_000, **_: object) -> str:
    """Markdown for a job summary; lists are halved until the document fits."""
    top = rows = min(top, max(map(len, v.sections.values()), default=0))
    while True:
        names = " -> ".join(t.code_span(r.name, 80, tail=True) for r in v.runs)
        out = [f"## {NAME}: {names}", ""]
        if v.kind == "analysis":
            run = v.runs[0]
            out.append(f"{run.records:,} records, {len(v.templates):,} templates, {run.unparsed:,} unparsed lines.")
        else:
            alerts = sum(map(_alert, v.sections["new"]))
            out.append(f"{alerts:,} alert{'' if alerts == 1 else 's'} of " + ", ".join(f"{len(r):,} {n}" for n, r in v.sections.items()) + f", {v.unchanged:,} unchanged.")
        out += [f"\n> warning: {t.code_span(w, 300)}" for w in v.warnings] + [f"\n> failed: {t.code_span(f['message'], 300)}" for f in v.extra.get("findings", [])]
        for name, every in v.sections.items():
            shown = (_alerts_first(every) if name == "new" else every)[:rows]
            if every:
                out += ["", f"### {name.capitalize()} ({len(shown):,} of {len(every):,})", "", *(_item(r, name, v.runs[-1].records) for r in shown)]
        if rows < top:
            out += ["", f"_Lists are shortened to {rows} templates to fit a job summary._"]
        text = "\n".join(out) + "\n"
        if len(text.encode()) <= max_bytes or rows == 0:
            return text
        rows //= 2


def as_junit(v: View, top: int = 20, **_: object) -> str:
    """New alerts are failing test cases, other new templates passing ones."""
    if v.kind == "analysis":
        raise SettingError("a JUnit report needs a comparison")
    alerts = [r for r in v.sections["new"] if _alert(r)]
    quiet = [r for r in v.sections["new"] if not _alert(r)][:top]
    properties = {"before": t.xml(v.runs[0].name, 200, True, True), "after": t.xml(v.runs[1].name, 200, True, True)} | {f"{n}_templates": str(len(rows)) for n, rows in v.sections.items()} | {"unchanged_templates": str(v.unchanged)}
    out = ['<?xml version="1.0" encoding="UTF-8"?>', "<testsuites>", f'  <testsuite name="{NAME}" tests="{max(1, len(alerts) + len(quiet))}" failures="{len(alerts)}" errors="0" skipped="0" time="0">', "    <properties>"]
    out += [f'      <property name="{k}" value="{x}" />' for k, x in properties.items()] + ["    </properties>"]
    for r in [*alerts, *quiet]:
        level = r["level"] or "none"
        case = f'    <testcase classname="{NAME}.new.{level}" name="{t.xml(r["text"], 200, attribute=True)} [{r["id"][:8]}]" time="0"'
        if not _alert(r):
            out.append(case + " />")
            continue
        body = f"template: {t.xml(r['text'], 500)}\nrecords: {r['after_count']:,} ({_share(r['after_count'], v.runs[1].records)} of the run)\nfirst seen: {r['first_seen'] or '-'}\nlast seen: {r['last_seen'] or '-'}"
        out += [case + ">", f'      <failure message="new {level} template, {r["after_count"]:,} records" type="{level}">{body}</failure>', "    </testcase>"]
    if not alerts and not quiet:
        out.append(f'    <testcase classname="{NAME}.new" name="no new templates" time="0" />')
    return "\n".join([*out, "  </testsuite>", "</testsuites>"]) + "\n"


def as_chat(v: View, top: int = 10, max_chars: int = 3000, **_: object) -> str:
    """A short message; templates are left out, never cut, until it fits."""
    names = " -> ".join(t.code_span(t.defused(r.name), 60, tail=True) for r in v.runs)
    if v.kind == "analysis":
        rows = v.templates
        head = [f"{NAME}: {names}", f"{v.runs[0].records:,} records, {len(rows):,} templates, {v.runs[0].unparsed:,} unparsed lines.", "Most frequent templates:"]
    else:
        rows = _alerts_first(v.sections["new"])
        alerts = sum(map(_alert, rows))
        head = [f"{NAME}: {names}", f"{alerts:,} alert{'' if alerts == 1 else 's'} of {len(rows):,} new, {len(v.sections['disappeared']):,} disappeared, {len(v.sections['changed']):,} changed."]
        head += ["New templates:"] if rows else []
    out, shown = "\n".join(head), 0
    for r in rows[:top]:
        item = "- " + (f"{r['level']} " if r["level"] else "") + f"{_number(r):,} x {t.code_span(t.defused(r['text']), 200)}"
        if len(out) + len(item) + 1 + 30 > max_chars:
            break
        out += "\n" + item
        shown += 1
    return out + (f"\n... and {len(rows) - shown:,} more" if shown < len(rows) else "") + "\n"


def as_metrics(v: View, top: int = 20, **_: object) -> str:
    """Gauges in the text exposition format."""
    out: list[str] = []

    def family(name: str, help_: str, samples: list[tuple[dict, int]]) -> None:
        if samples:
            out.extend([f"# HELP {NAME}_{name} {help_}", f"# TYPE {NAME}_{name} gauge"])
            for labels, value in samples:
                shown = ",".join(f'{k}="{t.label(str(x), 120 if k == "template" else 64)}"' for k, x in labels.items() if x is not None)
                out.append(f"{NAME}_{name}" + (f"{{{shown}}}" if shown else "") + f" {value}")

    named = lambda r: {"id": r["id"], "level": r["level"], "template": r["text"]}
    if v.kind == "analysis":
        run = v.runs[0]
        family("records", "Records of the log.", [({}, run.records)])
        family("unparsed_lines", "Lines that are in no record.", [({}, run.unparsed)])
        family("templates", "Different templates.", [({}, len(v.templates))])
        sums = {n: sum(r["levels"].get(n, 0) for r in v.templates) for n in LEVELS}
        family("level_records", "Records of each level.", [({"level": n}, x) for n, x in sums.items() if x])
        family("template_records", "Records of the most frequent templates.", [(named(r), r["count"]) for r in v.templates[:top]])
    else:
        sides = ("before", "after")
        family("diff_records", "Records of each run.", [({"side": s}, r.records) for s, r in zip(sides, v.runs, strict=True)])
        family("diff_templates", "Templates by what became of them.", [({"change": n}, len(rows)) for n, rows in v.sections.items()] + [({"change": "unchanged"}, v.unchanged)])
        family("diff_new_alerts", "New templates of level WARN or above.", [({}, sum(map(_alert, v.sections["new"])))])
        family("diff_template_records", "Records of the listed templates in each run.", [({"change": n} | named(r) | {"side": s}, r[f"{s}_count"]) for n, rows in v.sections.items() for r in rows[:top] for s in sides])
    return "\n".join(out) + "\n"


Reporter = Callable[..., str]
REPORTERS: dict[str, Reporter] = {
    "json": as_json, "text": as_text, "markdown": as_markdown, "csv": as_csv, "html": as_html, "github-summary": as_ci_summary,
    "junit": as_junit, "chat-message": as_chat, "prometheus": as_metrics,
}
SUFFIXES = {".json": "json", ".txt": "text", ".md": "markdown", ".csv": "csv", ".html": "html", ".htm": "html", ".xml": "junit", ".prom": "prometheus"}
APPENDABLE = ("text", "markdown", "github-summary", "chat-message")


def register(name: str, reporter: Reporter) -> None:
    REPORTERS[name] = reporter


def render(result: Analysis | Diff | Check, name: str = "text", **options: object) -> str:
    """Text of a report by name."""
    if name not in REPORTERS:
        raise SettingError(f"unknown report {name!r}; known: {', '.join(REPORTERS)}")
    return REPORTERS[name](view(result), **{k: x for k, x in options.items() if x is not None})


def write(result: Analysis | Diff | Check, path: str | Path, name: str | None = None, *, append: bool = False, **options: object) -> None:
    """Write a report; without a name the suffix decides."""
    name = name or SUFFIXES.get(Path(path).suffix.lower())
    if name is None:
        raise SettingError(f"the suffix of {path} names no report")
    if append and name not in APPENDABLE:
        raise SettingError(f"a {name} report cannot be added to a file")
    text = render(result, name, **options)
    target = Path(path)
    if append and target.exists() and target.stat().st_size:
        text = "\n" + text
    with target.open("a" if append else "w", encoding="utf-8", newline="") as out:
        out.write(text)


def write_bulk(templates: DataFrame, path: str, format: str = "parquet") -> None:
    """Write a frame of templates or entries as a data set, without collecting it."""
    templates.write.mode("overwrite").format(format).save(path)

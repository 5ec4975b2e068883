"""Command line.  Exit codes: 0 good, 1 error, 2 findings (``--fail-on`` or a failed check), 130 interrupted."""

from __future__ import annotations

import argparse
import json
import sys

from . import __version__, api, plugins
from .config import DiffConfig, SettingError
from .functions.mask_sets import SETS, load_set
from .reporters.documents import render, write
from .sources.formats import FORMATS
from .streaming.session import Backlog, Session


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="sievelog", description="Log templates and run comparison on Spark.")
    parser.add_argument("--version", action="version", version=__version__)
    parser.add_argument("--config", help="TOML file with settings")
    parser.add_argument("--plugins", action="append", default=[], help="folder with plugins; may be repeated")
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *, files: str | None = None, mining: bool = True, report: bool = True) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=text)
        if files:
            p.add_argument("files", nargs=files)
        p.add_argument("--format", "-f", default="auto")
        p.add_argument("--multiline", action=argparse.BooleanOptionalAction, default=None)
        p.add_argument("--debug", action="store_true")
        if mining:
            for name_, kind in (("depth", int), ("sim-th", float), ("max-children", int), ("max-templates", int)):
                p.add_argument(f"--{name_}", type=kind)
            p.add_argument("--on-full", choices=["pool", "evict"])
            p.add_argument("--delimiters")
            p.add_argument("--masks", help="names of mask sets, comma-separated; all, default, none")
            p.add_argument("--masks-file", action="append", default=[])
        if report:
            p.add_argument("--top", "-n", type=int)
            p.add_argument("--out", "-o")
            p.add_argument("--append", action="store_true")
            p.add_argument("--report")
            p.add_argument("--json", action="store_true")
            p.add_argument("--examples", default="raw", choices=["raw", "masked", "none"])
            p.add_argument("--since")
            p.add_argument("--until")
        return p

    a = command("analyze", "fold a log into templates", files="+")
    learn = command("learn", "mine a log and save the model", files="+")
    for p in (a, learn):
        p.add_argument("--min-count", type=int, default=1)
        p.add_argument("--level")
        p.add_argument("--only-alerts", action="store_true")
        p.add_argument("--values", action="store_true")
        p.add_argument("--load-state")
        p.add_argument("--save-state", required=p is learn)
    d = command("diff", "compare logs or saved results", files="+")
    d.add_argument("--baseline", action="append", default=[])
    d.add_argument("--split-at")
    d.add_argument("--recount", action=argparse.BooleanOptionalAction, default=True)
    d.add_argument("--matcher", default="jaccard")
    d.add_argument("--matcher-threshold", type=float)
    d.add_argument("--new-values", action="store_true")
    d.add_argument("--min-baselines", type=int)
    d.add_argument("--min-new-count", type=int, default=1)
    d.add_argument("--fail-on", choices=["new", "new-alerts", "changed", "none"], default="none")
    c = command("check", "hold a log against a model", files="+")
    c.add_argument("--state", required=True)
    c.add_argument("--max-unmatched", type=float, default=1.0)
    c.add_argument("--fail-on", choices=["new", "new-alerts", "none"], default="new-alerts")
    for p in (d, c):
        p.add_argument("--threshold-ratio", type=float, default=2.0)
        p.add_argument("--min-count", type=int, default=10)
        p.add_argument("--significance", type=float, default=0.01)
    m = command("match", "count a model's templates in a log", files="+")
    m.add_argument("--state", required=True)
    m.add_argument("--exact", action="store_true")
    s = command("stream", "mine standard input while it arrives")
    s.add_argument("--load-state")
    s.add_argument("--save-state")
    s.add_argument("--save-every", type=int, default=0, help="save after so many lines")
    q = command("params", "values of a message at a template's positions", report=False)
    q.add_argument("template")
    q.add_argument("message")
    i = command("inspect", "how a log is read", files=1, mining=False, report=False)
    i.add_argument("--records", type=int, default=5)
    for name, text in (("formats", "known formats"), ("masks", "known mask sets"), ("info", "versions and names"), ("plugins", "what is known by name")):
        p = command(name, text, mining=False, report=False)
        if name == "masks":
            p.add_argument("name", nargs="?")
    return parser


def _mining(args: argparse.Namespace, settings: dict):
    own = dict(settings.get("mining", {}))
    own |= {k: v for k in ("depth", "sim_th", "max_children", "max_templates", "on_full", "delimiters") if (v := getattr(args, k)) is not None}
    return api.mining_config(args.masks or settings.get("masks", {}).get("sets"), [load_set(p) for p in args.masks_file], **own)


def _show(result, args: argparse.Namespace) -> None:
    if args.append and not args.out:
        raise SettingError("--append needs --out")
    if args.out:
        write(result, args.out, args.report, append=args.append, top=args.top)
    if args.json:
        print(render(result, "json", top=args.top), end="")
    elif args.report and not args.out:
        print(render(result, args.report, top=args.top), end="")
    elif not args.out:
        print(render(result, "text", top=args.top or 20), end="")


def run(argv: list[str]) -> int:
    args = _parser().parse_args(argv)
    settings = api.load_config(args.config) if args.config else {}
    kind = args.command
    for folder in args.plugins:
        plugins.folder(folder)
    plugins.installed()
    if kind == "info":
        print(json.dumps(api.info(), indent=2))
    elif kind == "plugins":
        print("\n".join(f"{p.kind:<10} {p.name:<20} {p.origin}" for p in plugins.catalogue()))
    elif kind == "formats":
        print("\n".join([*FORMATS, "log4j", "log4j:PATTERN", "regex:PATTERN", "auto"]))
    elif kind == "masks":
        chosen = [SETS[args.name]] if args.name else SETS.values()
        for s in chosen:
            print(f"{s.name}: {s.description}")
            if args.name:
                print("\n".join(f"  {r.name}  {r.token}  {r.pattern}" for r in s.rules))
    elif kind == "inspect":
        print(json.dumps(api.inspect_file(args.files[0], format=args.format, multiline=args.multiline, sample_records=args.records), indent=2))
    elif kind == "params":
        config = _mining(args, settings)
        found = api.extract_parameters(args.template, args.message, config.masks, config.delimiters)
        if found is None:
            print("the message does not fit the template", file=sys.stderr)
            return 1
        print(json.dumps([{"position": p, "name": n, "value": v} for p, n, v in found], ensure_ascii=False, indent=2))
    elif kind == "stream":
        return _stream(args, settings)
    else:
        return _batch(kind, args, settings)
    return 0


def _batch(kind: str, args: argparse.Namespace, settings: dict) -> int:
    config, usual = _mining(args, settings), {"format": args.format, "multiline": args.multiline, "examples": args.examples, "since": args.since, "until": args.until}
    if kind in ("analyze", "learn"):
        if args.level and args.only_alerts:
            raise SettingError("--level and --only-alerts exclude each other")
        out = api.analyze(args.files, config=config, values=args.values, load_state=args.load_state, save_state=args.save_state, **usual)
        level = "WARN" if args.only_alerts else args.level.upper() if args.level else None
        _show(out.filtered(min_level=level, min_count=args.min_count), args)
        return 0
    if kind == "match":
        _show(api.match(args.state, args.files, exact=args.exact, config=config, **usual), args)
        return 0
    limits = DiffConfig(threshold_ratio=args.threshold_ratio, min_count=args.min_count, significance=args.significance or None)
    if kind == "check":
        checked = api.check(args.state, args.files, max_unmatched=args.max_unmatched, fail_on=args.fail_on, options=limits, config=config, **usual)
        _show(checked, args)
        return 0 if checked.passed else 2
    limits = DiffConfig(args.threshold_ratio, args.min_count, args.min_new_count, args.significance or None, args.matcher, args.min_baselines)
    if (args.split_at is None) != (len(args.files) == 2):
        raise SettingError("diff takes two logs, or one with --split-at")
    after = None if args.split_at else args.files[1]
    found = api.diff(
        args.files[0], after, baselines=args.baseline, split_at=args.split_at, config=config, options=limits, recount=args.recount,
        matcher=args.matcher, threshold=args.matcher_threshold, new_values=args.new_values, **usual,
    )
    _show(found, args)
    counts = found.counts()
    failed = {"none": 0, "new": counts["new"], "changed": counts["new"] + counts["changed"]}.get(args.fail_on)
    return 2 if (found.new_alerts().count() if failed is None else failed) else 0


def _stream(args: argparse.Namespace, settings: dict) -> int:
    config = _mining(args, settings)
    start = api.models.load(args.load_state, config) if args.load_state else None
    live = Session(config, format="plain" if args.format == "auto" else args.format, multiline=args.multiline, start=start)
    read = saved = 0
    for batch in Backlog(sys.stdin).batches():
        if batch:
            live.add_lines(batch)
        else:
            live.flush()  # nothing has come for a second
        read += len(batch)
        for template in live.new_templates():
            print(f"{template.id}  {template.text}", flush=True)
        if args.save_state and args.save_every and read - saved >= args.save_every:
            live.save(args.save_state)
            saved = read
    live.flush()
    for template in live.result()[: args.top or 20]:
        print(f"{template.count:>10,}  {template.level or '':<5}  {template.text}")
    if args.save_state:
        live.save(args.save_state)
    return 0


def main() -> None:
    argv = sys.argv[1:]
    try:
        code = run(argv)
    except KeyboardInterrupt:
        code = 130
    except (SettingError, OSError) as error:
        if "--debug" in argv:
            raise
        print(f"error: {error}", file=sys.stderr)
        code = 1
    sys.exit(code)


if __name__ == "__main__":
    main()



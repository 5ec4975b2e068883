"""Plugins: formats, reports, matchers, sources and mask sets of other packages and of folders.

Installed packages name theirs as entry points of the groups in ``GROUPS``;
a folder holds mask sets as JSON files and modules whose ``PLUGINS`` lists
plugin objects by kind.  What each kind has to be:

* formats: ``name`` and ``spec()``, which gives a format description (data, no code per line);
* reports: ``name``, ``kinds`` (of analysis, diff, check) and ``render(view, **options)``;
* matchers: ``name`` and ``match(before_texts, after_texts)``, which gives pairs of indices;
* sources: ``name`` and ``command(target, options)``, which gives a ``Command``;
* mask_sets: a ``MaskSet``.
"""

from __future__ import annotations

import hashlib
import importlib.util
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from importlib.metadata import entry_points
from pathlib import Path
from typing import Any

from .config import SettingError
from .functions import mask_sets
from .operators import matchers
from .reporters import documents
from .sources import external, formats

PREFIX = "sievelog."
KINDS = ("formats", "reports", "matchers", "sources", "mask_sets")
GROUPS = tuple(PREFIX + kind for kind in KINDS)


@dataclass(frozen=True)
class Plugin:
    """Something known by name and where it came from."""

    kind: str
    name: str
    origin: str


_KNOWN: dict[tuple[str, str], Plugin] = {}


def _has(plugin: Any, *names: str) -> None:
    missing = [n for n in names if not hasattr(plugin, n)]
    if missing:
        raise SettingError(f"the plugin {plugin!r} has no {', '.join(missing)}")


def _add_format(plugin: Any) -> str:
    _has(plugin, "name", "spec")
    spec = plugin.spec()
    if not isinstance(spec, (formats.PlainFormat, formats.JsonFormat, formats.RegexFormat)):
        raise SettingError(f"the format {plugin.name!r} gives no format description")
    formats.FORMATS[plugin.name] = spec
    return plugin.name


def _add_report(plugin: Any) -> str:
    _has(plugin, "name", "kinds", "render")

    def report(v: documents.View, **options: object) -> str:
        if v.kind not in plugin.kinds:
            raise SettingError(f"the report {plugin.name!r} shows {', '.join(plugin.kinds)}, not {v.kind}")
        return plugin.render(v, **options)

    documents.register(plugin.name, report)
    return plugin.name


def _add_matcher(plugin: Any) -> str:
    _has(plugin, "name", "match")
    matchers.OWN[plugin.name] = plugin
    return plugin.name


def _add_source(plugin: Any) -> str:
    _has(plugin, "name", "command")
    external.SOURCES[plugin.name] = plugin.command
    return plugin.name


def _add_mask_set(plugin: Any) -> str:
    if not isinstance(plugin, mask_sets.MaskSet):
        raise SettingError(f"{plugin!r} is no mask set")
    mask_sets.SETS[plugin.name] = plugin
    return plugin.name


_ADD: dict[str, Callable[[Any], str]] = {"formats": _add_format, "reports": _add_report, "matchers": _add_matcher, "sources": _add_source, "mask_sets": _add_mask_set}


def add(kind: str, plugin: Any, origin: str = "call") -> Plugin:
    """Make a plugin known by its name; a name that came from elsewhere is not taken over."""
    if kind not in _ADD:
        raise SettingError(f"unknown kind of plugin {kind!r}; known: {', '.join(KINDS)}")
    name = getattr(plugin, "name", "")
    old = _KNOWN.get((kind, name))
    if old and old.origin != origin:
        raise SettingError(f"{name!r} is known already, from {old.origin}")
    if not old and (kind, name) in _built_in():
        raise SettingError(f"{name!r} is built in")
    found = Plugin(kind, _ADD[kind](plugin), origin)
    _KNOWN[kind, found.name] = found
    return found


def _built_in() -> set[tuple[str, str]]:
    named = {"formats": formats.FORMATS, "reports": documents.REPORTERS, "matchers": {**matchers.SCORES, "exact": 0, "token_subset": 0}, "sources": external.SOURCES, "mask_sets": mask_sets.SETS}
    return {(kind, name) for kind, names in named.items() for name in names if (kind, name) not in _KNOWN}


def installed() -> list[Plugin]:
    """Plugins of installed packages, by entry points; each is a plugin or a class without arguments."""
    found = []
    for kind, group in zip(KINDS, GROUPS, strict=True):
        for point in sorted(entry_points(group=group), key=lambda p: p.name):
            loaded = point.load()
            found.append(add(kind, loaded() if isinstance(loaded, type) else loaded, f"package {point.dist.name if point.dist else point.value}"))
    return found


def folder(path: str | Path) -> list[Plugin]:
    """Plugins of a folder: ``*.json`` are mask sets, ``*.py`` modules with a dict ``PLUGINS`` of lists by kind."""
    root, found = Path(path), []
    if not root.is_dir():
        raise SettingError(f"{path} is no folder")
    for file in sorted(root.iterdir()):
        if file.suffix == ".json":
            found.append(add("mask_sets", mask_sets.load_set(file), f"file {file}"))
        elif file.suffix == ".py" and not file.name.startswith("_"):
            name = f"_plugin_{hashlib.sha256(str(file.resolve()).encode()).hexdigest()[:12]}"
            spec = importlib.util.spec_from_file_location(name, file)
            module = importlib.util.module_from_spec(spec)  # type: ignore[arg-type]
            spec.loader.exec_module(module)  # type: ignore[union-attr]
            listed: dict[str, Iterable[Any]] = getattr(module, "PLUGINS", {})
            found += [add(kind, plugin, f"file {file}") for kind, plugins in listed.items() for plugin in plugins]
    return found


def catalogue() -> list[Plugin]:
    """Everything known by name, built-in names first."""
    return sorted((Plugin(kind, name, "built in") for kind, name in _built_in()), key=lambda p: (p.kind, p.name)) + sorted(_KNOWN.values(), key=lambda p: (p.kind, p.name))

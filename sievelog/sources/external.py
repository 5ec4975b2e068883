"""Logs of other programs: container, cluster and journal logs, fetched on the driver into a file."""

from __future__ import annotations

import os
import re
import shutil
import subprocess
import tempfile
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from ..config import SettingError

TIMEOUT_S, MAX_BYTES, ERROR_CHARS = 300, 1 << 30, 500
_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.@:-]*")


@dataclass(frozen=True)
class Command:
    argv: list[str]
    merge_stderr: bool = False


@dataclass(frozen=True)
class Options:
    tail: int | None = None
    since: str | None = None
    previous: bool = False


def _checked(text: str, what: str) -> str:
    if not _NAME.fullmatch(text):
        raise SettingError(f"{text!r} is no name of a {what}")
    return text


def docker(target: str, o: Options) -> Command:
    options = [*(["--tail", str(o.tail)] if o.tail is not None else []), *(["--since", o.since] if o.since else [])]
    return Command(["docker", "logs", *options, "--", _checked(target, "container")], merge_stderr=True)


def kubectl(target: str, o: Options) -> Command:
    parts = target.split("/")
    if len(parts) not in (2, 3):
        raise SettingError("a pod is named NAMESPACE/POD or NAMESPACE/POD/CONTAINER")
    space, pod, *container = (_checked(p, "pod") for p in parts)
    options = [f"--namespace={space}", *([f"--container={container[0]}"] if container else [])]
    options += [*([f"--tail={o.tail}"] if o.tail is not None else []), *([f"--since={o.since}"] if o.since else []), *(["--previous"] if o.previous else [])]
    return Command(["kubectl", "logs", *options, "--", pod])


def journalctl(target: str, o: Options) -> Command:
    options = [*([f"--lines={o.tail}"] if o.tail is not None else []), *([f"--since={o.since}"] if o.since else [])]
    return Command(["journalctl", f"--unit={_checked(target, 'unit')}", "--output=short-iso", "--no-pager", *options])


SOURCES: dict[str, Callable[[str, Options], Command]] = {"docker": docker, "kubectl": kubectl, "journalctl": journalctl}


def is_source(text: str) -> bool:
    return text.partition(":")[0] in SOURCES and ":" in text


def _program(name: str) -> str:
    """The program from absolute entries of PATH only."""
    places = [p for p in os.environ.get("PATH", "").split(os.pathsep) if os.path.isabs(p)]
    found = shutil.which(name, path=os.pathsep.join(places))
    if not found:
        raise SettingError(f"the program {name!r} was not found")
    return found


@contextmanager
def fetch(source: str, *, tail: int | None = None, since: str | None = None, previous: bool = False, timeout: float = TIMEOUT_S, max_bytes: int = MAX_BYTES) -> Iterator[str]:
    """Path of a private file with the log; it is removed at the end."""
    kind, _, target = source.partition(":")
    if kind not in SOURCES:
        raise SettingError(f"unknown source {kind!r}; known: {', '.join(SOURCES)}")
    command = SOURCES[kind](target, Options(tail, since, previous))
    argv = [_program(command.argv[0]), *command.argv[1:]]
    with tempfile.TemporaryDirectory(prefix="fetch-") as folder:
        path = os.path.join(folder, "log")
        errors = os.path.join(folder, "errors")
        with open(path, "wb") as out, open(errors, "wb") as err:
            running = subprocess.Popen(argv, stdout=out, stderr=out if command.merge_stderr else err, stdin=subprocess.DEVNULL)
            ends = time.monotonic() + timeout
            try:
                while running.poll() is None:  # the cap holds while the log arrives, not only at its end
                    if time.monotonic() > ends:
                        raise SettingError(f"{kind} took longer than {timeout:g} s")
                    if os.path.getsize(path) > max_bytes:
                        raise SettingError(f"the log of {source} is larger than {max_bytes} bytes")
                    time.sleep(0.02)
            finally:
                if running.poll() is None:
                    running.kill()
                    running.wait()
        if running.returncode:
            with open(path if command.merge_stderr else errors, "rb") as said:
                raise SettingError(f"{kind} failed: {said.read(4 * ERROR_CHARS).decode(errors='replace')[:ERROR_CHARS]}")
        if os.path.getsize(path) > max_bytes:
            raise SettingError(f"the log of {source} is larger than {max_bytes} bytes")
        yield path

"""Log formats as data: plain text, JSON lines, and patterns with named groups."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from ..config import SettingError


@dataclass(frozen=True)
class PlainFormat:
    """The whole record is the message; ``record_start`` says which lines start one."""

    name: str = "plain"
    record_start: str | None = None
    multiline: bool = False


@dataclass(frozen=True)
class JsonFormat:
    """A JSON object per line; the first key that is present wins."""

    name: str = "jsonl"
    message_keys: tuple[str, ...] = ("message", "msg", "log")
    time_keys: tuple[str, ...] = ("timestamp", "time", "ts", "@timestamp", "timeMillis")
    level_keys: tuple[str, ...] = ("level", "severity", "lvl", "log.level")
    ts_format: str | None = None
    multiline: bool = False
    join_unterminated: bool = False


@dataclass(frozen=True)
class RegexFormat:
    """A pattern searched in the first line of a record."""

    name: str
    pattern: str
    message_group: str | None = None
    time_group: str | None = None
    level_group: str | None = None
    ts_format: str | None = None
    multiline: bool = False

    def __post_init__(self) -> None:
        try:
            groups = re.compile(self.pattern).groupindex
        except re.error as error:
            raise SettingError(f"the pattern of format {self.name!r} cannot be read: {error}") from error
        for group in (self.message_group, self.time_group, self.level_group):
            if group and group not in groups:
                raise SettingError(f"format {self.name!r} has no group {group!r}")

    def index(self, group: str | None) -> int | None:
        return re.compile(self.pattern).groupindex[group] if group else None

    @property
    def java(self) -> str:
        """The pattern for Java: named groups are plain ones, the last $ does not match before a line feed."""
        body = re.sub(r"\(\?P<\w+>", "(", self.pattern)
        return body[:-1] + r"\z" if body.endswith("$") and not body.endswith(r"\$") else body


Format = PlainFormat | JsonFormat | RegexFormat

# What the known formats look like.
_ISO = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?"
_SYSLOG_ISO = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:[+-]\d{2}(?::?\d{2})?)?"
_LEVELS = r"TRACE|DEBUG|INFO|NOTICE|WARN(?:ING)?|ERROR|ERR|FATAL|CRITICAL|CRIT"
_ACCESS = r'^[^\[]*\[(?P<ts>\d{2}/[A-Za-z]{3}/\d{4}:[^\]]+)\] (?P<msg>"[^"]*" \d{3})'
# The columns of PostgreSQL's csvlog up to the message, in the order of its documentation.
_CSVLOG = (
    "log_time user_name database_name process_id connection_from session_id session_line_num command_tag session_start_time "
    "virtual_transaction_id transaction_id error_severity sql_state_code message"
).split()


def _csvlog() -> str:
    """A csvlog line up to its message: columns that records have no field for are a quoted or a plain value."""
    shapes = {
        "log_time": r"(?P<ts>\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:\.\d+)?)(?: [A-Z]{2,5})?", "error_severity": r"(?P<lvl>[A-Z]+[0-9]?)",
        "sql_state_code": r'[^,"]*', "message": r'"(?P<msg>(?:[^"]|"")*)',
    }
    return "^" + ",".join(shapes.get(column, r'(?:"(?:[^"]|"")*"|[^,"]*)') for column in _CSVLOG)


_BUILT_IN = (
    PlainFormat(),
    JsonFormat(),
    JsonFormat("journald", ("MESSAGE",), ("__REALTIME_TIMESTAMP",), ("PRIORITY",)),
    JsonFormat("docker-json", ("log",), ("time",), (), join_unterminated=True),
    JsonFormat("serilog-clef", ("@m", "@mt"), ("@t",), ("@l",)),
    RegexFormat("nginx", _ACCESS, "msg", "ts", None, "%d/%b/%Y:%H:%M:%S %z"),
    RegexFormat("apache", _ACCESS, "msg", "ts", None, "%d/%b/%Y:%H:%M:%S %z"),
    RegexFormat("nginx-error", r"^(?P<ts>\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}) \[(?P<lvl>\w+)\] (?P<msg>.*)$", "msg", "ts", "lvl", "%Y/%m/%d %H:%M:%S", True),
    RegexFormat("syslog", rf"^(?P<ts>[A-Z][a-z]{{2}} +\d{{1,2}} \d{{2}}:\d{{2}}:\d{{2}}|{_SYSLOG_ISO}) \S+ (?P<msg>.*)$", "msg", "ts", None, "%b %e %H:%M:%S", True),
    RegexFormat("k8s", r"^(?P<ts>\d{4}-\d{2}-\d{2}T[\d:.]+Z) (?:stdout|stderr) [FP] (?P<msg>.*)$", "msg", "ts"),
    RegexFormat("app", rf"^(?P<ts>{_ISO})[ \t]+(?:\[[^\]]*\][ \t]+)?\[?(?P<lvl>{_LEVELS})\]?[ \t:-]+(?P<msg>.*)$", "msg", "ts", "lvl"),
    RegexFormat("logfmt", r'^(?:ts|time)="?(?P<ts>[^"\s]+)"?(?: \S+=\S*)*? (?:level|lvl)=(?P<lvl>\w+) ?(?P<msg>.*)$', "msg", "ts", "lvl"),
    RegexFormat(
        "haproxy",
        r"^(?:[^\[\]]*haproxy\[\d+\]: |<\d+>1 \S+ \S+ haproxy \S+ \S+ \S+ |\d{4}-\d{2}-\d{2}T\S+ )?"
        r"\S+:\d+ \[(?P<ts>\d{2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2}\.\d+)\] (?P<msg>\S+ \S+ .*)$",
        "msg", "ts", None, "%d/%b/%Y:%H:%M:%S.%f",
    ),
    RegexFormat(
        "postgresql",
        r"^(?P<ts>\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:\.\d+)?)(?: (?:[A-Z]{2,5}|[+-]\d{2}(?::?\d{2})?))?[ :].{0,120}?[ \t\]:]"
        r"(?P<lvl>LOG|STATEMENT|DETAIL|HINT|CONTEXT|QUERY|LOCATION|ERROR|FATAL|PANIC|WARNING|NOTICE|INFO|DEBUG[1-5]?):  (?P<msg>.*)$",
        "msg", "ts", "lvl", None, True,
    ),
    RegexFormat("postgresql-csv", _csvlog(), "msg", "ts", "lvl", None, True),
    RegexFormat(
        "github-actions",
        r"^\ufeff?(?P<ts>\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z) (?:##\[(?P<lvl>error|warning|notice|debug)\])?(?P<msg>.*)$",
        "msg", "ts", "lvl", None, True,
    ),
)
FORMATS: dict[str, Format] = {f.name: f for f in _BUILT_IN}
#: Candidates of ``auto``; on equal scores the first wins.
DETECTION_ORDER = ("journald", "docker-json", "jsonl", "k8s", "nginx", "nginx-error", "app", "syslog")


def register(spec: Format) -> None:
    """Make a format known by its name."""
    FORMATS[spec.name] = spec


def from_pattern(pattern: str, name: str = "regex") -> RegexFormat:
    """A format of a pattern whose groups are named as usual."""
    groups = re.compile(pattern).groupindex
    pick = lambda *names: next((n for n in names if n in groups), None)
    return RegexFormat(name, pattern, pick("message", "msg"), pick("timestamp", "time", "ts"), pick("level", "lvl", "severity"))


def resolve(name: str | Format, multiline: bool | None = None) -> Format:
    """Format by name, ``regex:PATTERN`` or ``log4j:PATTERN``."""
    if not isinstance(name, str):
        spec: Format = name
    elif name.startswith("regex:"):
        spec = from_pattern(name.removeprefix("regex:"))
    elif name == "log4j" or name.startswith("log4j:"):
        from .log4j import DEFAULT_PATTERN, log4j_format

        spec = log4j_format(name.partition(":")[2] or DEFAULT_PATTERN)
    elif name in FORMATS:
        spec = FORMATS[name]
    else:
        raise SettingError(f"unknown format {name!r}; known: {', '.join(FORMATS)}, log4j, regex:PATTERN, auto")
    return spec if multiline is None else replace(spec, multiline=multiline)

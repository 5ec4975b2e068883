"""log4j and logback conversion patterns as formats.

A pattern is cut into parts by one grammar (text, or a conversion word with its
alignment and options); each kind of part has a shape of its own, and the shapes
in a row are the format's regular expression.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import takewhile

from ..config import SettingError
from .formats import RegexFormat

DEFAULT_PATTERN = "%d{ISO8601} %-5p [%t] %c - %m%n"

# The conversion words of the pattern layouts' documentation, by what they print.
WORDS = {
    "time": "d date",
    "level": "p level priority",
    "message": "m msg message",
    "end": "n",
    "word": "c logger C class F file M method l location L line r relative pid processId T tid threadId threadPriority tp sn sequenceNumber",
    "text": "t thread threadName tn x NDC X mdc MDC marker markerSimpleName K map MAP u uuid hostName hostname host N nano nanoTime",
    "trace": "ex exception throwable xEx xException xThrowable rEx rException rThrowable wEx wException wThrowable xwEx nopex nopexception",
}
KINDS = {word: kind for kind, words in WORDS.items() for word in words.split()}
# The named date patterns of the same documentation, as patterns of date letters.
DATES = {
    "ABSOLUTE": "HH:mm:ss,SSS", "ABSOLUTE_MICROS": "HH:mm:ss,nnnnnn", "ABSOLUTE_NANOS": "HH:mm:ss,nnnnnnnnn", "COMPACT": "yyyyMMddHHmmssSSS",
    "DATE": "dd MMM yyyy HH:mm:ss,SSS", "ISO8601_BASIC": "yyyyMMdd'T'HHmmss,SSS", "ISO8601_OFFSET_DATE_TIME_HH": "yyyy-MM-dd'T'HH:mm:ss,SSSX",
    "ISO8601_OFFSET_DATE_TIME_HHMM": "yyyy-MM-dd'T'HH:mm:ss,SSSXX", "ISO8601_OFFSET_DATE_TIME_HHCMM": "yyyy-MM-dd'T'HH:mm:ss,SSSXXX",
}
#: Versions differ in the letter between date and time of these; both are ISO 8601, which needs no time format.
EITHER = ("ISO8601", "DEFAULT", "DEFAULT_MICROS", "DEFAULT_NANOS")
# Date letters, (what they match, their strptime directive), by the letter and how often it is repeated.
NUMBERS = {"y": ("%Y", 4), "M": ("%m", 2), "d": ("%d", 2), "H": ("%H", 2), "m": ("%M", 2), "s": ("%S", 2), "D": ("%j", 3)}
NAMES = {"MMM": (r"[A-Za-z]{3}", "%b"), "MMMM": (r"[A-Za-z]+", "%B"), "yy": (r"\d{2}", "%y")}
FRACTION, ZONE = (r"\d{1,9}", "%f"), (r"(?:Z|[+-]\d{2}(?::?\d{2})?)", "%z")

_LONGEST_FIRST = "|".join(sorted(KINDS, key=len, reverse=True))
_PART = re.compile(rf"(?P<text>(?:[^%]|%%)+)|%(?P<left>-?)(?P<width>\d*)(?:\.-?\d+)?(?P<word>{_LONGEST_FIRST})(?P<options>(?:\{{[^}}]*\}})*)")
_DATE_PART = re.compile(r"'(?P<quoted>[^']*)'|(?P<letters>(?P<letter>[A-Za-z])(?P=letter)*)|(?P<other>.)", re.DOTALL)


@dataclass(frozen=True)
class Part:
    """Text between conversion words, or one of these."""

    kind: str
    text: str = ""
    option: str = ""
    left: bool = False
    padded: bool = False


def parts_of(pattern: str) -> Iterator[Part]:
    at = 0
    while at < len(pattern):
        m = _PART.match(pattern, at)
        if m is None:
            raise SettingError(f"the converter at {pattern[at:]!r} is not supported")
        at = m.end()
        if m["text"]:
            yield Part("literal", m["text"].replace("%%", "%"))
        else:
            options = re.findall(r"\{([^}]*)\}", m["options"])
            yield Part(KINDS[m["word"]], option=next(filter(None, options), ""), left=bool(m["left"]), padded=bool(m["width"]))


def _date_letters(letters: str) -> tuple[str, str]:
    letter, n = letters[0], len(letters)
    if letters in NAMES:
        return NAMES[letters]
    if letter in "Sn":
        return FRACTION
    if letter in "XxZ":
        return ZONE
    directive, most = NUMBERS.get(letter, ("", 0))
    if not directive or n > most or (letter in "yD" and n != most):
        raise SettingError(f"the date field {letters!r} is not supported")
    return (rf"\d{{{n}}}" if n > 1 else r"\d{1,2}"), directive


def date_pattern(option: str) -> tuple[str, str | None]:
    """Regular expression and time format of a date option."""
    if option in EITHER:
        day, time = date_pattern("yyyy-MM-dd")[0], date_pattern("HH:mm:ss,SSS")[0]
        return f"{day}[T ]{time}", None
    shapes, directives = [], []
    for m in _DATE_PART.finditer(DATES.get(option, option)):
        if m["letters"]:
            shape, directive = _date_letters(m["letters"])
        else:
            text = m["quoted"] if m["quoted"] is not None else m["other"]
            shape, directive = ("[,.]" if text in (",", ".") else re.escape(text)), text.replace("%", "%%")
        shapes.append(shape)
        directives.append(directive)
    return "".join(shapes), "".join(directives)


def _shape(part: Part) -> str:
    if part.kind == "literal":
        return re.escape(part.text)
    if part.kind == "time":
        return date_pattern(part.option or "DEFAULT")[0]
    return {"level": "[A-Za-z]+", "message": ".*", "word": r"\S*", "text": ".*?"}[part.kind]


def log4j_format(pattern: str, *, name: str = "log4j", multiline: bool = True) -> RegexFormat:
    """Format of a conversion pattern; stack traces join the record before them."""
    parts = [p for p in parts_of(pattern) if p.kind != "trace"]
    line = list(takewhile(lambda p: p.kind != "end", parts))
    if any(p.kind != "end" for p in parts[len(line) :]):
        raise SettingError("a line break inside the pattern is not supported: one record is one line")
    if not line:
        raise SettingError(f"the pattern {pattern!r} has no fields")
    # the first part of each kind that a record has a field for is that field
    groups = {"message": "msg", "time": "ts", "level": "lvl"}
    first = {kind: next((i for i, p in enumerate(line) if p.kind == kind), None) for kind in groups}
    pieces = []
    for i, part in enumerate(line):
        shape = _shape(part)
        if first.get(part.kind) == i:
            shape = f"(?P<{groups[part.kind]}>{shape})"
        pieces.append((shape + " *" if part.left else " *" + shape) if part.padded else shape)
    found = {kind: groups[kind] if at is not None else None for kind, at in first.items()}
    ts_format = date_pattern(line[first["time"]].option or "DEFAULT")[1] if found["time"] else None
    whole = "^" + "".join(pieces) + ("$" if line[-1].kind == "message" else "")
    return RegexFormat(name, whole, found["message"], found["time"], found["level"], ts_format, multiline)

"""How text of a log may be written into a report."""

from __future__ import annotations

import re
import unicodedata

_CONTROL = re.compile(r"[\x00-\x08\x0b-\x1f\x7f-\x9f]")
_SPACES = re.compile(r"[\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_MENTION = re.compile(r"<(?=[!@#])|@(?=(?:channel|here|everyone|all)(?![A-Za-z0-9_]))", re.IGNORECASE)


def flatten(text: str) -> str:
    """Control characters as ``\\xNN``, white space as single spaces."""
    shown = _CONTROL.sub(lambda m: f"\\x{ord(m[0]):02x}", text)
    return _SPACES.sub(" ", shown).strip(" ")


def clip(text: str, width: int, tail: bool = False) -> str:
    """At most ``width`` characters; three dots stand for what is left out."""
    if len(text) <= width:
        return text
    return "..." + text[len(text) - (width - 3) :] if tail else text[: width - 3] + "..."


def code_span(text: str, width: int, tail: bool = False) -> str:
    return "`" + clip(flatten(text), width, tail).replace("`", "'") + "`"


def xml(text: str, width: int, tail: bool = False, attribute: bool = False) -> str:
    plain = re.sub("[\ufffe\uffff]", lambda m: f"U+{ord(m[0]):04X}", clip(flatten(text), width, tail))
    plain = plain.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return plain.replace('"', "&quot;") if attribute else plain


def label(text: str, width: int) -> str:
    """Value of a metric's label."""
    return clip(flatten(text), width).replace("\\", "\\\\").replace('"', '\\"')


def defused(text: str) -> str:
    """Chat mentions that alarm nobody."""
    return _MENTION.sub(lambda m: m[0] + "\u200b", text)


def printable(text: str) -> str:
    """Control and format characters as escapes, for terminals."""
    return "".join(c if c == " " or unicodedata.category(c)[0] != "C" else f"\\x{ord(c):02x}" if ord(c) < 256 else f"\\u{ord(c):04x}" for c in text)


def guarded(text: str) -> str:
    """A CSV cell that no spreadsheet takes for a formula."""
    return "'" + text if text[:1] in ("=", "+", "-", "@", "\t", "\r") and text else text


def cell(text: str) -> str:
    """A cell of a Markdown table."""
    return flatten(text).replace("\\", "\\\\").replace("|", "\\|").replace("`", "'")

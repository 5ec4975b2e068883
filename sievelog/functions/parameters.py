"""Values that a message has at the variable positions of a template."""

from __future__ import annotations

from collections.abc import Sequence

from ..config import DEFAULT_RULES, WILDCARD, MaskRule
from .masking import Masker
from .tokens import DELIMITERS


def extract(masker: Masker, template: Sequence[str], message: str, delimiters: str = DELIMITERS, *, exact: bool = True) -> list[tuple[int, str, str]] | None:
    """(position, name, value), or None if the message does not fit.

    A wildcard gives one value named ``*``: the part of the message that its
    token stands for.  Any other token gives a value per match that starts in
    it.  ``exact`` asks for equal constants; without it only the number of
    tokens has to agree.
    """
    matches = masker.matches(message)
    # pieces of the masked text with their places in the message; a replacement is one piece
    text, origin, at = [], [], 0  # origin: for each masked character (from, to, match)
    for number, (start, end, rule) in enumerate(matches):
        text.append(message[at:start])
        origin += [(i, i + 1, -1) for i in range(at, start)]
        text.append(rule.token)
        origin += [(start, end, number)] * len(rule.token)
        at = end
    text.append(message[at:])
    origin += [(i, i + 1, -1) for i in range(at, len(message))]
    masked, spans, i = "".join(text), [], 0
    while i < len(masked):
        if masked[i] in delimiters:
            i += 1
            continue
        j = i
        while j < len(masked) and masked[j] not in delimiters:
            j += 1
        spans.append((i, j))
        i = j
    if len(spans) != len(template):
        return None
    out, seen = [], -1
    for position, (token, (a, b)) in enumerate(zip(template, spans, strict=True)):
        inside = [m for m in dict.fromkeys(o[2] for o in origin[a:b] if o[2] >= 0) if m > seen]
        seen = max([seen, *inside])
        if token == WILDCARD:
            out.append((position, "*", message[origin[a][0] : origin[b - 1][1]]))
            continue
        if exact and masked[a:b] != token:
            return None
        out += [(position, matches[m][2].name, message[matches[m][0] : matches[m][1]]) for m in inside]
    return out


def extract_parameters(template: str, message: str, masks: Sequence[MaskRule] = DEFAULT_RULES, delimiters: str = DELIMITERS) -> list[tuple[int, str, str]] | None:
    """The same for a template text; tokens of the text are split at single spaces."""
    return extract(Masker(masks), template.split(" ") if template else [], message, delimiters)

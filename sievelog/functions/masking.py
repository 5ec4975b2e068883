"""Masking: variable parts of a message become tokens, in one pass from left to right.

The default rules are one column expression.  Other rules, layers and checks
run in an Arrow-batched function over Python's ``re`` in ASCII mode.
"""

from __future__ import annotations

import functools
import hashlib
import json
import operator
import re
from collections.abc import Iterable, Iterator, Sequence
from re import _constants, _parser  # type: ignore[attr-defined]

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT_RULES, MaskRule, SettingError

_EDGE = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"


def _java(pattern: str) -> str:
    """A default rule for Java, where a word boundary is to be ASCII."""
    body = pattern.removeprefix(r"\b").removesuffix(r"\b")
    return (_EDGE[0] if pattern.startswith(r"\b") else "") + body + (_EDGE[1] if pattern.endswith(r"\b") else "")


def _any() -> str:
    """Any default rule.  Each starts with a hexadecimal digit or a slash, so other places are passed at once; only ``uuid`` starts with a letter."""
    uuid, *digits, path, num = (f"(?:{_java(r.pattern)})" for r in DEFAULT_RULES)
    return f"(?=[0-9a-fA-F/])(?:{uuid}|(?=[0-9])(?:{'|'.join([*digits, num])})|{path})"


_OPEN, _CLOSE = "\x01", "\x02"
#: Any default rule, for Java.
ANY_RULE = _any()
#: The default rules by their names.
_NUMBER = {r.name: k for k, r in enumerate(DEFAULT_RULES)}


def _by_rule(hit: Column, value: dict[str, Column]) -> Column:
    """What belongs to the default rule that a hit is of, told by the places where the rules have their marks."""
    return (
        F.when(hit.startswith("/"), value["path"])
        .when(F.substring(hit, 5, 1) == "-", value["ts"])
        .when(F.substring(hit, 9, 1) == "-", value["uuid"])
        .when(F.lower(F.substring(hit, 2, 1)) == "x", value["hex"])
        .when(F.substring_index(hit, ".", 2) != hit, value["ip"])  # two points
        .otherwise(value["num"])
    )


def rule_number(hit: Column) -> Column:
    """Number of the default rule that a hit is of."""
    return _by_rule(hit, {name: F.lit(k) for name, k in _NUMBER.items()})


def mask_default(message: Column) -> Column:
    """The default rules: pieces between matches are joined with the tokens of the matches."""
    token = lambda hit: _by_rule(hit, {r.name: F.lit(r.token) for r in DEFAULT_RULES})
    # one pass of the expression sets marks around the matches; a message that has such marks itself takes two passes
    marked = F.split(F.regexp_replace(message, f"({ANY_RULE})", f"{_OPEN}$1{_CLOSE}"), _OPEN, -1)
    piece = lambda p, i: F.when(i == 0, p).otherwise(F.concat(token(F.substring_index(p, _CLOSE, 1)), F.substring_index(p, _CLOSE, -1)))
    quick = F.array_join(F.transform(marked, piece), "")
    hits = F.regexp_extract_all(message, F.lit(f"({ANY_RULE})"), F.lit(1))
    gaps = F.split(message, ANY_RULE, -1)
    tokens = F.concat(F.transform(hits, token), F.array(F.lit("")))
    slow = F.array_join(F.zip_with(gaps, tokens, lambda a, b: F.concat(a, b)), "")
    none = ~message.rlike("[0-9/-]")  # no rule matches without one of these
    return F.when(none, message).when(message.rlike(f"[{_OPEN}{_CLOSE}]"), slow).otherwise(quick)


def luhn(text: str) -> bool:
    """13 to 19 digits, spaces and dashes aside, with a good check digit."""
    digits = text.replace(" ", "").replace("-", "")
    if not (digits.isascii() and digits.isdigit() and 13 <= len(digits) <= 19):
        return False
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def iban(text: str) -> bool:
    """15 to 34 letters and digits, spaces aside, that leave 1 modulo 97."""
    plain = text.replace(" ", "").upper()
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", plain):
        return False
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


CHECKS = {"luhn": luhn, "iban": iban}


def required_literal(pattern: str) -> str:
    """The longest text that every match of a pattern has to contain; empty if none is known."""
    best, run, parsed = "", "", _parser.parse(pattern)
    if parsed.state.flags & re.IGNORECASE:
        return ""
    for kind, value in parsed:
        if kind is _constants.LITERAL:
            run += chr(value)
        else:
            inner = ""
            if kind is _constants.SUBPATTERN and not value[1] & re.IGNORECASE:  # a group that always matches
                inner = _longest(value[3])
            elif kind is _constants.MAX_REPEAT and value[0] >= 1:
                inner = _longest(value[2])
            best, run = max(best, run, inner, key=len), ""
    return max(best, run, key=len)


def _longest(items: Iterable[tuple]) -> str:
    best, run = "", ""
    for kind, value in items:
        run = run + chr(value) if kind is _constants.LITERAL else ""
        best = max(best, run, key=len)
    return best


class Masker:
    """Rules compiled for Python; gives the masked text, or the matches and their places."""

    def __init__(self, rules: Sequence[MaskRule] = DEFAULT_RULES):
        rules = tuple(rules)
        layered = len(rules) > len(DEFAULT_RULES) and rules[-len(DEFAULT_RULES) :] == DEFAULT_RULES
        self.layers = [self._compile(rules[: -len(DEFAULT_RULES)]), self._compile(DEFAULT_RULES)] if layered else [self._compile(rules)]
        literals = [[required_literal(r.pattern) for r in own] for own, _ in self.layers]
        #: Texts of which a match needs one, for layers all of whose rules have one.
        self.gates = [tuple(dict.fromkeys(own)) if all(own) else () for own in literals]
        if layered:
            for rule in rules[: -len(DEFAULT_RULES)]:
                if self._hits(rule.token, 1):
                    raise SettingError(f"the token of rule {rule.name!r} is changed by the default rules")

    @staticmethod
    def _compile(rules: tuple[MaskRule, ...]) -> tuple[tuple[MaskRule, ...], re.Pattern[str] | None]:
        for rule in rules:
            try:
                found = re.compile(rule.pattern, re.ASCII)
            except re.error as error:
                raise SettingError(f"the pattern of rule {rule.name!r} cannot be read: {error}") from error
            if re.search(r"\(\?(?:[=!]|<[=!])|(?<!\\)(?:\\\\)*\\[1-9]", rule.pattern):
                raise SettingError(f"rule {rule.name!r} uses look-around or a back-reference")
            if found.match(""):
                raise SettingError(f"rule {rule.name!r} matches the empty text")
        named = [re.sub(r"\(\?P<\w+>", "(?:", r.pattern) for r in rules]
        return rules, re.compile("|".join(f"(?P<r{i}>{p})" for i, p in enumerate(named)), re.ASCII) if rules else None

    def _hits(self, text: str, layer: int) -> list[tuple[int, int, MaskRule]]:
        rules, pattern = self.layers[layer]
        if self.gates[layer] and not any(literal in text for literal in self.gates[layer]):
            return []  # no rule can match
        found, at = [], 0
        while pattern is not None and (m := pattern.search(text, at)):
            rule = rules[next(i for i in range(len(rules)) if m.group(f"r{i}") is not None)]
            if rule.check and not CHECKS[rule.check](m[0]):
                at = m.start() + 1
                continue
            found.append((m.start(), m.end(), rule))
            at = m.end()
        return found

    def matches(self, text: str) -> list[tuple[int, int, MaskRule]]:
        """(start, end, rule) of every replaced part, in order."""
        found = self._hits(text, 0)
        if len(self.layers) == 1:
            return found
        every, at = [], 0
        for start, end, rule in [*found, (len(text), len(text), None)]:
            every += [(at + a, at + b, r) for a, b, r in self._hits(text[at:start], 1)]
            if rule:
                every.append((start, end, rule))
            at = end
        return every

    def mask(self, text: str) -> str:
        out, at = [], 0
        for start, end, rule in self.matches(text):
            out += [text[at:start], rule.token]
            at = end
        return "".join([*out, text[at:]])


def mask(message: Column, rules: Sequence[MaskRule] = DEFAULT_RULES) -> Column:
    """Masked message: an expression for the default rules, else an Arrow-batched function."""
    rules = tuple(rules)
    if not rules:
        return message
    if rules == DEFAULT_RULES:
        return mask_default(message)
    checked = Masker(rules)  # refuses bad rules on the driver

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        masker = Masker(rules)
        for batch in batches:
            known: dict[str, str] = {}
            yield batch.map(lambda m: known.setdefault(m, masker.mask(m)) if m is not None else None)

    if not checked.gates[0]:
        return run(message)
    # messages without any text that the rules of the first layer need never leave the JVM
    gate = functools.reduce(operator.or_, (message.contains(literal) for literal in checked.gates[0]))
    return F.when(gate, run(F.when(gate, message))).otherwise(mask_default(message) if len(checked.layers) == 2 else message)


def mask_fingerprint(rules: Sequence[MaskRule]) -> str:
    """First 16 hex digits of the SHA-256 of the rules as canonical JSON."""
    data = [{k: v for k, v in vars(r).items() if v is not None} for r in rules]
    return hashlib.sha256(json.dumps(data, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()[:16]

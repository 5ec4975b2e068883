"""Named sets of mask rules, and files that hold one."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import dataclass
from pathlib import Path

from ..config import DEFAULT_RULES, MaskRule, SettingError

MAX_FILE_BYTES = 1 << 20
_NAME, _TOKEN = re.compile(r"[a-z][a-z0-9_-]{0,63}"), re.compile(r"<[A-Z][A-Z0-9_]{0,62}>")


@dataclass(frozen=True)
class MaskSet:
    name: str
    rules: tuple[MaskRule, ...]
    version: int = 1
    description: str = ""


PAYMENT = MaskSet(
    "payment",
    (
        # IBANs and the number ranges of card brands.
        MaskRule("iban", r"\b[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)\b", "<IBAN>", "iban"),
        MaskRule(
            "card",
            r"\b(?:(?:4\d{3}|5[1-5]\d{2}|2[2-7]\d{2}|35\d{2}|6(?:011|[25]\d{2}))[ -]\d{4}[ -]\d{4}[ -]\d{4}|3[47]\d{2}[ -]\d{6}[ -]\d{5}"
            r"|3[068]\d{2}[ -]\d{6}[ -]\d{4}|4\d{15}|5[1-5]\d{14}|2[2-7]\d{14}|3[47]\d{13}|35\d{14}|3[068]\d{12}|6(?:011|[25]\d{2})\d{12})\b",
            "<CARD>",
            "luhn",
        ),
    ),
    description="Payment card numbers (Luhn) and IBANs (modulo 97).",
)
PII = MaskSet(
    "pii",
    (
        # E-mail addresses and international telephone numbers.
        MaskRule("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}\b", "<EMAIL>"),
        MaskRule("phone", r"\+(?:[1-9]\d{0,2}(?:[ .-]|[ .-]?\()(?:[ .()-]{0,2}\d){6,13}|[1-9]\d{9,14})\b", "<PHONE>"),
    ),
    description="E-mail addresses and international telephone numbers.",
)
SECRETS = MaskSet(
    "secrets",
    (
        MaskRule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*-----END [A-Z ]*PRIVATE KEY-----)?", "<KEY>"),
        MaskRule("jwt", r"\beyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]*", "<JWT>"),
        MaskRule("aws_key", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b", "<KEY>"),
        MaskRule("github_key", r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,})\b", "<KEY>"),
        MaskRule("gitlab_key", r"\bglpat-[A-Za-z0-9_-]{20,}", "<KEY>"),
        MaskRule("slack_key", r"\bxox[abeprs]-[A-Za-z0-9-]{10,}", "<KEY>"),
        MaskRule("stripe_key", r"\b[rs]k_(?:live|test)_[A-Za-z0-9]{16,}\b", "<KEY>"),
        MaskRule("google_key", r"\bAIza[A-Za-z0-9_-]{35}", "<KEY>"),
        MaskRule("npm_key", r"\bnpm_[A-Za-z0-9]{36}\b", "<KEY>"),
        MaskRule("sendgrid_key", r"\bSG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}", "<KEY>"),
        MaskRule("sk_key", r"\bsk-[A-Za-z0-9_-]{20,}", "<KEY>"),
    ),
    description="Private keys, JSON web tokens and keys with a known prefix.",
)
_PAIR = r"(?i:password|passwd|pwd|secret|api[_-]?key|access[_-]?key|auth[_-]?token|access[_-]?token|refresh[_-]?token|token)"
CREDENTIALS = MaskSet(
    "credentials",
    (
        MaskRule("authorization", r"(?i:authorization)[\"']?[ \t]*[:=][ \t]*[\"']?(?:(?i:basic|bearer|digest|token)[ \t]+)?[^\s\"',;]{3,}", "<SECRET>"),
        MaskRule("bearer", r"\b(?i:bearer)[ \t]+(?:[A-Za-z._~+/-]*\d[A-Za-z0-9._~+/-]{7,}=*|[A-Za-z0-9._~+/-]{24,}=*)", "<SECRET>"),
        MaskRule("url_password", r"\b[A-Za-z][A-Za-z0-9+.-]*://[^\s/@:]+:[^\s/@]+@", "<SECRET>"),
        MaskRule("pair", r"\b" + _PAIR + r"[\"']?(?:=|:[ \t]?|=[ \t])[\"']?[^\s\"'&,;)}\]{\[(<=][^\s\"'&,;)}\]]{2,}", "<SECRET>"),
    ),
    description="Authorization headers, bearer tokens, passwords in URLs and in key-value pairs.",
)
SETS = {s.name: s for s in (SECRETS, CREDENTIALS, PII, PAYMENT)}


def select(names: Iterable[str] | str | None, extra: Iterable[MaskSet] = ()) -> tuple[MaskRule, ...]:
    """Rules of the named sets in front of the default rules; ``all`` is every set, ``default`` none, ``none`` no rule at all."""
    names = [n.strip() for n in names.split(",")] if isinstance(names, str) else list(names or ["default"])
    if names == ["none"]:
        return ()
    known = SETS | {s.name: s for s in extra}
    wanted = [s for n in names if n != "default" for s in (SETS if n == "all" else [n])]
    wanted += [s.name for s in extra if s.name not in wanted]
    unknown = [n for n in wanted if n not in known]
    if unknown:
        raise SettingError(f"unknown mask set {unknown[0]!r}; known: {', '.join(known)}")
    return tuple(r for n in dict.fromkeys(wanted) for r in known[n].rules) + DEFAULT_RULES


def load_set(path: str | Path) -> MaskSet:
    """Read a set from JSON: name, version, description and rules, no other keys."""
    raw = Path(path).read_bytes()
    if len(raw) > MAX_FILE_BYTES:
        raise SettingError(f"{path} is larger than 1 MiB")
    try:
        data = json.loads(raw)
    except ValueError as error:
        raise SettingError(f"{path} is no JSON: {error}") from error
    if not isinstance(data, dict) or set(data) - {"$schema", "name", "version", "description", "rules"}:
        raise SettingError(f"{path} has unknown keys or is no object")
    if not _NAME.fullmatch(str(data.get("name", ""))):
        raise SettingError(f"{path}: a set needs a name of small letters, digits, - and _")
    rules = []
    for rule in data.get("rules") or []:
        if not isinstance(rule, dict) or set(rule) - {"name", "pattern", "token", "check"}:
            raise SettingError(f"{path}: a rule has unknown keys")
        if not _TOKEN.fullmatch(str(rule.get("token", ""))):
            raise SettingError(f"{path}: a token looks like <NAME>")
        rules.append(MaskRule(str(rule.get("name", "")), str(rule.get("pattern", "")), rule["token"], rule.get("check")))
    if not rules:
        raise SettingError(f"{path} has no rules")
    return MaskSet(data["name"], tuple(rules), int(data.get("version", 1)), str(data.get("description", "")))

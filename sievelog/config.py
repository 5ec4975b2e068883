"""Settings of mining, execution and comparison: frozen, checked on construction, with a fingerprint."""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import dataclass, field

WILDCARD = "<*>"
EXAMPLE_BYTES = 2000
LEVELS = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")
ALERTS = ("WARN", "ERROR", "FATAL")
ALGO_VERSION = 2
HIGH_CARDINALITY_TEMPLATES = 5000


class SettingError(ValueError):
    """A setting that cannot be used."""


@dataclass(frozen=True)
class MaskRule:
    """A pattern whose matches become ``token``; ``check`` (luhn, iban) may refuse a match."""

    name: str
    pattern: str
    token: str
    check: str | None = None

    def __post_init__(self) -> None:
        if self.check not in (None, "luhn", "iban"):
            raise SettingError(f"unknown check {self.check!r}")
        if len(self.pattern.encode()) > 4096:
            raise SettingError(f"the pattern of rule {self.name!r} is longer than 4096 bytes")


# The six default rules, in order.
DEFAULT_RULES = (
    MaskRule("uuid", r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "<UUID>"),
    MaskRule("ts", r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?", "<TS>"),
    MaskRule("ip", r"\b\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?\b", "<IP>"),
    MaskRule("hex", r"\b0[xX][0-9a-fA-F]+\b", "<HEX>"),
    MaskRule("path", r"(?:/[\w.\-]+){2,}", "<PATH>"),
    MaskRule("num", r"\b\d+(?:\.\d+)?\b", "<NUM>"),
)


@dataclass(frozen=True)
class MiningConfig:
    """How messages become templates."""

    depth: int = 4
    sim_th: float = 0.4
    max_children: int = 100
    max_templates: int = 100_000
    on_full: str = "pool"
    delimiters: str = " \t\n\r"
    masks: tuple[MaskRule, ...] = field(default=DEFAULT_RULES)

    def __post_init__(self) -> None:
        if self.depth < 3:
            raise SettingError("depth has to be 3 at least")
        if not 0 <= self.sim_th <= 1:
            raise SettingError("sim_th has to lie between 0 and 1")
        if self.max_children < 1 or self.max_templates < 1:
            raise SettingError("max_children and max_templates have to be 1 at least")
        if self.on_full not in ("pool", "evict"):
            raise SettingError("on_full is 'pool' or 'evict'")
        if not self.delimiters or not self.delimiters.isascii():
            raise SettingError("delimiters have to be ASCII characters")
        if len(self.masks) > 256:
            raise SettingError("at most 256 mask rules are allowed")

    @classmethod
    def high_cardinality(cls, **options) -> MiningConfig:
        """For logs where almost every record opens a template."""
        return cls(**{"max_templates": HIGH_CARDINALITY_TEMPLATES} | options)

    @property
    def threshold(self) -> int:
        """sim_th in millionths; all comparisons are whole-numbered."""
        return math.floor(self.sim_th * 1e6 + 0.5)

    def layers(self, length: int) -> int:
        """Token layers of the tree for messages of so many tokens."""
        return min(self.depth - 3, length - 1) if length else 0

    def fingerprint(self) -> str:
        """First 12 hex digits of the SHA-256 of the settings as canonical JSON."""
        masks = [{k: v for k, v in vars(r).items() if v is not None} for r in self.masks]
        data = {
            "delimiters": self.delimiters, "depth": self.depth, "masks": masks, "max_children": self.max_children,
            "max_templates": self.max_templates, "threshold": self.threshold, "version": ALGO_VERSION,
        }
        if self.on_full != "pool":
            data["on_full"] = self.on_full
        text = json.dumps(data, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        return hashlib.sha256(text.encode()).hexdigest()[:12]


@dataclass(frozen=True)
class DiffConfig:
    """When two runs count as different."""

    threshold_ratio: float = 2.0
    min_count: int = 10
    min_new_count: int = 1
    significance: float | None = 0.01
    matcher: str = "jaccard"
    min_baselines: int | None = None

    def __post_init__(self) -> None:
        if self.threshold_ratio < 1:
            raise SettingError("threshold_ratio has to be 1 at least")
        if self.min_count < 0 or self.min_new_count < 0:
            raise SettingError("counts have to be 0 at least")
        if self.significance is not None and not 0 < self.significance <= 1:
            raise SettingError("significance has to lie between 0 and 1")
        if self.min_baselines is not None and self.min_baselines < 1:
            raise SettingError("min_baselines has to be 1 at least")


@dataclass(frozen=True)
class CheckConfig:
    """When a check against a model fails."""

    max_unmatched: float = 1.0
    fail_on: str = "new-alerts"

    def __post_init__(self) -> None:
        if self.fail_on not in ("new", "new-alerts", "none"):
            raise SettingError("fail_on is 'new', 'new-alerts' or 'none'")

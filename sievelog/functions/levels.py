"""Severity levels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import LEVELS

# Spelling -> level.
ALIASES = {
    "TRACE": "TRACE", "DEBUG": "DEBUG", "INFO": "INFO", "NOTICE": "INFO", "WARN": "WARN", "WARNING": "WARN",
    "ERROR": "ERROR", "ERR": "ERROR", "FATAL": "FATAL", "CRITICAL": "FATAL", "CRIT": "FATAL", "EMERG": "FATAL",
    "ALERT": "FATAL", "PANIC": "FATAL", "0": "FATAL", "1": "FATAL", "2": "FATAL", "3": "ERROR", "4": "WARN",
    "5": "INFO", "6": "INFO", "7": "DEBUG",
}


def parse_level(text: Column) -> Column:
    """Level of a spelling, or null."""
    known = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.try_element_at(known, F.upper(F.trim(text)))


def level_of(text: str | None) -> str | None:
    """The same for a Python string."""
    return ALIASES.get(text.strip().upper()) if text else None


def rank(level: Column) -> Column:
    """0 for TRACE to 5 for FATAL; null for no level."""
    return F.try_element_at(F.create_map(*[F.lit(x) for i, name in enumerate(LEVELS) for x in (name, i)]), level)


def at_least(level: Column, least: str) -> Column:
    """Whether a level is as severe as ``least``; null counts as not."""
    return F.coalesce(rank(level) >= LEVELS.index(least), F.lit(False))


def most_severe(counts: dict[str, Column]) -> Column:
    """The most severe level with a positive count, or null."""
    return F.coalesce(*[F.when(counts[name] > 0, F.lit(name)) for name in reversed(LEVELS)])

"""Tokens of a masked message, template texts and their ids."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import WILDCARD

DELIMITERS = " \t\n\r"


def delimiter_class(delimiters: str = DELIMITERS) -> str:
    return "[" + "".join(re.escape(c) if c not in "\t\n\r" else {"\t": r"\t", "\n": r"\n", "\r": r"\r"}[c] for c in delimiters) + "]+"


def tokenise(masked: Column, delimiters: str = DELIMITERS) -> Column:
    """Longest runs without a delimiter."""
    return F.filter(F.split(masked, delimiter_class(delimiters)), lambda t: t != "")


def tokens_of(masked: str, delimiters: str = DELIMITERS) -> list[str]:
    """The same for a Python string."""
    return [t for t in re.split(delimiter_class(delimiters), masked) if t]


def route_key(token: Column) -> Column:
    """A token with a digit is routed as a wildcard."""
    return F.when(token.rlike("[0-9]"), F.lit(WILDCARD)).otherwise(token)


def template_id(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def id_of(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()[:16]


def generalise(template: Column, tokens: Column) -> Column:
    """Positions that differ become wildcards."""
    return F.zip_with(template, tokens, lambda a, b: F.when(a == b, a).otherwise(F.lit(WILDCARD)))


def exact_matches(template: Column, tokens: Column) -> Column:
    """Positions that are equal and no wildcard."""
    same = F.zip_with(template, tokens, lambda a, b: F.when((a == b) & (a != WILDCARD), 1).otherwise(0))
    return F.aggregate(same, F.lit(0), lambda a, x: a + x)


def cut_bytes(text: str | None, limit: int) -> str | None:
    """At most ``limit`` bytes of UTF-8, cut at a character."""
    return None if text is None else text.encode("utf-8", "replace")[:limit].decode("utf-8", "ignore")

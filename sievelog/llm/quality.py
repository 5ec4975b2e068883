"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted cyclically, one feature after the other, and their
sums are kept as a lookup table per feature.  Then the strongest feature pairs
are boosted on what is left, cyclically too, by trees that cut both features
once; their sums are a table per pair.  A text's score is the logistic of a sum
of table entries, so scoring is binning and addition.

Features are counts of bytes and words of the whole text.  The model is fitted
on at most ``sample`` labelled rows, chosen by a hash of the id.

Defined cases: null and empty texts have all features 0 and are scored; labels
other than 0 and 1 and contradictory labels of one doc_id teach nothing; a
label teaches by every row of its doc_id, ``sample`` rows in all; without labels of both kinds every score is
the share of label 1 (0.5 without any); rows that repeat a doc_id are rows of
their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textscan import CHUNK, Words, mix, pieces, text_arrays

U64 = np.uint64
FEATURES = (
    "log_words", "mean_word", "upper", "lower", "digits", "high_bytes", "spaces", "lines", "marks", "symbols", "shouts", "bars",
    "symbol_ends", "mark_ends", "same_as_last", "distinct_words", "distinct_pairs", "capital_starts", "long_words",
)


def _class(chars: str) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars.encode())] = True
    return table


_UPPER, _LOWER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("abcdefghijklmnopqrstuvwxyz")
_DIGIT, _SPACE, _LINE, _SHOUT, _BAR = _class("0123456789"), _class(" \t\n\r\x0b\x0c"), _class("\n"), _class("!"), _class("|")
_MARK, _SYMBOL = _class(".,;:?'\"()-"), _class("#$%&*+/<=>@[\\]^_`{}~")
_HIGH = np.zeros(256, dtype=bool)
_HIGH[128:] = True


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Feature matrix, a row for each text."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1).astype(float)

    def share(table: np.ndarray) -> np.ndarray:
        places = np.flatnonzero(table[data])
        return np.diff(np.searchsorted(places, offsets)) / size

    words = Words(data, offsets)
    first, count = words.first, np.diff(words.first)
    total = np.maximum(count, 1).astype(float)
    docs, lengths, hashes = words.docs(), words.ends - words.starts, words.hashes()
    per_word = lambda flags: np.bincount(docs[flags], minlength=n) / total
    same = np.zeros(len(docs), dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (docs[1:] == docs[:-1])

    def distinct(keys: np.ndarray, owner: np.ndarray, all_of: np.ndarray) -> np.ndarray:
        keys = keys + mix(owner.astype(U64) + U64(1))
        _, at = np.unique(keys, return_index=True)
        return np.bincount(owner[at], minlength=n) / np.maximum(all_of, 1)

    inner = docs[1:] == docs[:-1]
    pairs = (hashes[:-1] * U64(0x9E3779B97F4A7C15) + hashes[1:])[inner]
    ends, starts = data[words.ends - 1] if len(docs) else data[:0], data[words.starts] if len(docs) else data[:0]
    columns = (
        np.log1p(count), np.bincount(docs, weights=lengths, minlength=n) / total, share(_UPPER), share(_LOWER), share(_DIGIT), share(_HIGH), share(_SPACE),
        share(_LINE), share(_MARK), share(_SYMBOL), share(_SHOUT), share(_BAR), per_word(_SYMBOL[ends]), per_word(_MARK[ends]), per_word(same),
        distinct(hashes, docs, count), distinct(pairs, docs[1:][inner], count - 1), per_word(_UPPER[starts]), per_word(lengths > 15),
    )
    return np.stack(columns, axis=1).astype(np.float64)


def _mapped(score: Callable[[np.ndarray], list[pa.Array]], names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Apply to the features of the last column; the columns before it are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_arrays(batch.column(batch.num_columns - 1))
            for at, to, some, some_offsets in pieces(data, offsets, CHUNK // 2):
                kept = [batch.column(i).slice(at, to - at) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, *score(features(some, some_offsets))], names=[*batch.schema.names[:-1], *names])

    return run


def _listed(x: np.ndarray) -> list[pa.Array]:
    return [pa.array(list(x), pa.list_(pa.float64()))]


@dataclass
class Additive:
    """Lookup tables over binned features and feature pairs."""

    edges: list[np.ndarray]
    base: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(self.edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chance of label 1."""
        total = np.full(len(x), self.base)
        if self.tables:
            for table, b in zip(self.tables, bins := self.bins(x), strict=True):
                total += table[b]
            for i, j, grid_i, grid_j, table in self.pairs:
                total += table[grid_i[bins[i]], grid_j[bins[j]]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Best cut of a histogram: gain and place."""
    cg, ch = np.cumsum(g), np.cumsum(h)
    left = cg[:-1] ** 2 / (ch[:-1] + 1)
    right = (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + 1)
    gain = left + right - cg[-1] ** 2 / (ch[-1] + 1)
    k = int(gain.argmax()) if len(gain) else -1
    return (float(gain[k]), k + 1) if k >= 0 else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Shallow regression tree on a histogram: the value of each bin."""
    gain, cut = _split(g, h) if depth and len(g) > 1 else (0.0, 0)
    if gain <= 1e-6:
        return np.full(len(g), g.sum() / (h.sum() + 1))
    return np.concatenate([_tree(g[:cut], h[:cut], depth - 1), _tree(g[cut:], h[cut:], depth - 1)])


def _quadrants(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Tree on the histogram of a pair that cuts both features once: the value of each cell."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    # cuts before the first row or column leave one side empty, so a pair may be cut in one feature or not at all
    cg, ch = np.pad(cg, ((1, 0), (1, 0))), np.pad(ch, ((1, 0), (1, 0)))

    def corners(c: np.ndarray) -> list[np.ndarray]:
        a, rows, columns, total = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        return [a, rows - a, columns - a, total - rows - columns + a]

    gain = sum(x**2 / (y + 1) for x, y in zip(corners(cg), corners(ch), strict=True))
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.empty_like(g, dtype=float)
    for rows in (slice(0, i), slice(i, None)):
        for columns in (slice(0, j), slice(j, None)):
            out[rows, columns] = g[rows, columns].sum() / (h[rows, columns].sum() + 1)
    return out


def fit(x: np.ndarray, y: np.ndarray, *, bins: int = 32, rounds: int = 120, rate: float = 0.15, pairs: int = 6, pair_rounds: int = 30, grid: int = 6) -> Additive:
    """Cyclic boosting of the tables, then of the strongest pairs."""
    share = float(y.mean()) if len(y) else 0.5
    if not 0 < share < 1:
        return Additive([], base=float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    edges = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, bins + 1)[1:-1])) for i in range(x.shape[1])]
    model = Additive(edges, base=float(np.log(share / (1 - share))))
    model.tables = [np.zeros(len(e) + 1) for e in edges]
    at, total = model.bins(x), np.full(len(y), model.base)
    for _ in range(rounds):
        for b, table in zip(at, model.tables, strict=True):
            p = 1 / (1 + np.exp(-total))
            step = rate * _tree(np.bincount(b, y - p, len(table)), np.bincount(b, p * (1 - p), len(table)))
            table += step
            total += step[b]
    coarse = [np.arange(len(t)) * min(grid, len(t)) // len(t) for t in model.tables]
    p = 1 / (1 + np.exp(-total))

    def histogram(i: int, j: int, v: np.ndarray) -> np.ndarray:
        ni, nj = coarse[i].max() + 1, coarse[j].max() + 1
        return np.bincount(coarse[i][at[i]] * nj + coarse[j][at[j]], v, ni * nj).reshape(ni, nj)

    def strength(i: int, j: int) -> float:
        g, h = histogram(i, j, y - p), histogram(i, j, p * (1 - p))
        return float((g**2 / (h + 1)).sum() - (g.sum(0) ** 2 / (h.sum(0) + 1)).sum() - (g.sum(1) ** 2 / (h.sum(1) + 1)).sum())

    chosen = sorted(combinations(range(len(edges)), 2), key=lambda ij: (-strength(*ij), ij))[:pairs]
    model.pairs = [(i, j, coarse[i], coarse[j], np.zeros((coarse[i].max() + 1, coarse[j].max() + 1))) for i, j in chosen]
    for _ in range(pair_rounds):
        for i, j, ci, cj, table in model.pairs:
            p = 1 / (1 + np.exp(-total))
            step = rate * _quadrants(histogram(i, j, y - p), histogram(i, j, p * (1 - p)))
            table += step
            total += step[ci[at[i]], cj[at[j]]]
    return model


def learn(docs: DataFrame, labels: DataFrame, *, sample: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Additive:
    """Fit on at most ``sample`` labelled documents."""
    label = F.col(label_col).cast("int")
    known = labels.where(label.isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.min(label).alias("label"), F.max(label).alias("other"))
    # at most ``sample`` rows of 12 bytes are broadcast
    some = known.where("label = other").select("doc_id", "label").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    joined = base.join(F.broadcast(some), "doc_id").select("label", F.xxhash64("doc_id", "text").alias("h"), "text")
    # as many rows as ids, unless ids repeat; then the smallest hashes
    found = joined.mapInArrow(_mapped(_listed, ["x"]), "label int, h long, x array<double>").orderBy("h").limit(sample).toPandas()
    if not len(found):
        return Additive([])
    x, y = np.array(found["x"].tolist()), found["label"].to_numpy(dtype=float)
    order = np.lexsort(x.T)
    return fit(x[order], y[order])


def score(self, x: np.ndarray) -> np.ndarray:
        """Chance of label 1."""
        total = np.full(len(x), self.base)
        if self.tables:
            for table, b in zip(self.tables, bins := self.bins(x), strict=True):
                total += table[b]
            for i, j, grid_i, grid_j, table in self.pairs:
                total += table[grid_i[bins[i]], grid_j[bins[j]]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Best cut of a histogram: gain and place."""
    cg, ch = np.cumsum(g), np.cumsum(h)
    left = cg[:-1] ** 2 / (ch[:-1] + 1)
    right = (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + 1)
    gain = left + right - cg[-1] ** 2 / (ch[-1] + 1)
    k = int(gain.argmax()) if len(gain) else -1
    return (float(gain[k]), k + 1) if k >= 0 else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Shallow regression tree on a histogram: the value of each bin."""
    gain, cut = _split(g, h) if depth and len(g) > 1 else (0.0, 0)
    if gain <= 1e-6:
        return np.full(len(g), g.sum() / (h.sum() + 1))
    return np.concatenate([_tree(g[:cut], h[:cut], depth - 1), _tree(g[cut:], h[cut:], depth - 1)])


def _quadrants(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Tree on the histogram of a pair that cuts both features once: the value of each cell."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    # cuts before the first row or column leave one side empty, so a pair may be cut in one feature or not at all
    cg, ch = np.pad(cg, ((1, 0), (1, 0))), np.pad(ch, ((1, 0), (1, 0)))

    def corners(c: np.ndarray) -> list[np.ndarray]:
        a, rows, columns, total = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        return [a, rows - a, columns - a, total - rows - columns + a]

    gain = sum(x**2 / (y + 1) for x, y in zip(corners(cg), corners(ch), strict=True))
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.empty_like(g, dtype=float)
    for rows in (slice(0, i), slice(i, None)):
        for columns in (slice(0, j), slice(j, None)):
            out[rows, columns] = g[rows, columns].sum() / (h[rows, columns].sum() + 1)
    return out


def fit(x: np.ndarray, y: np.ndarray, *, bins: int = 32, rounds: int = 120, rate: float = 0.15, pairs: int = 6, pair_rounds: int = 30, grid: int = 6) -> Additive:
    """Cyclic boosting of the tables, then of the strongest pairs."""
    share = float(y.mean()) if len(y) else 0.5
    if not 0 < share < 1:
        return Additive([], base=float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    edges = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, bins + 1)[1:-1])) for i in range(x.shape[1])]
    model = Additive(edges, base=float(np.log(share / (1 - share))))
    model.tables = [np.zeros(len(e) + 1) for e in edges]
    at, total = model.bins(x), np.full(len(y), model.base)
    for _ in range(rounds):
        for b, table in zip(at, model.tables, strict=True):
            p = 1 / (1 + np.exp(-total))
            step = rate * _tree(np.bincount(b, y - p, len(table)), np.bincount(b, p * (1 - p), len(table)))
            table += step
            total += step[b]
    coarse = [np.arange(len(t)) * min(grid, len(t)) // len(t) for t in model.tables]
    p = 1 / (1 + np.exp(-total))

    def histogram(i: int, j: int, v: np.ndarray) -> np.ndarray:
        ni, nj = coarse[i].max() + 1, coarse[j].max() + 1
        return np.bincount(coarse[i][at[i]] * nj + coarse[j][at[j]], v, ni * nj).reshape(ni, nj)

    def strength(i: int, j: int) -> float:
        g, h = histogram(i, j, y - p), histogram(i, j, p * (1 - p))
        return float((g**2 / (h + 1)).sum() - (g.sum(0) ** 2 / (h.sum(0) + 1)).sum() - (g.sum(1) ** 2 / (h.sum(1) + 1)).sum())

    chosen = sorted(combinations(range(len(edges)), 2), key=lambda ij: (-strength(*ij), ij))[:pairs]
    model.pairs = [(i, j, coarse[i], coarse[j], np.zeros((coarse[i].max() + 1, coarse[j].max() + 1))) for i, j in chosen]
    for _ in range(pair_rounds):
        for i, j, ci, cj, table in model.pairs:
            p = 1 / (1 + np.exp(-total))
            step = rate * _quadrants(histogram(i, j, y - p), histogram(i, j, p * (1 - p)))
            table += step
            total += step[ci[at[i]], cj[at[j]]]
    return model


def learn(docs: DataFrame, labels: DataFrame, *, sample: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Additive:
    """Fit on at most ``sample`` labelled documents."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).cast("int").alias("label"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # at most ``sample`` rows of 12 bytes are broadcast
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    joined = base.join(F.broadcast(some), "doc_id").select("label", "text")
    found = joined.mapInArrow(_mapped(_listed, ["x"]), "label int, x array<double>").limit(2 * sample).toPandas()
    if not len(found):
        return Additive([])
    x, y = np.array(found["x"].tolist()), found["label"].to_numpy(dtype=float)
    order = np.lexsort(x.T)
    return fit(x[order], y[order])


def score(docs: DataFrame, model: Additive, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "") -> DataFrame:
    """Per row: doc_id and score.  ``keep`` names a boolean column that is carried along."""
    columns = [F.col(id_col).alias("doc_id"), *([F.col(keep)] if keep else []), F.col(text_col).alias("_text")]
    schema = "doc_id long, " + (f"{keep} boolean, " if keep else "") + "score double"
    return docs.select(*columns).mapInArrow(_mapped(lambda x: [pa.array(model.score(x).round(6))], ["score"]), schema)

"""Language identification by hyperdimensional profiles.

Every letter of Unicode has a random vector of +1 and -1, made from its code
point; all that is no letter shares one.  An n-gram's vector binds (by product)
the letters' vectors, each permuted (rotated) by its place; a document bundles
(adds) the vectors of all its n-grams, and a language's prototype bundles its
training documents.  A document gets the language whose prototype has the
largest cosine with it.

Prototypes are learned from about ``sample`` documents of each language at most,
chosen by a hash of the id, so a rare language is learned from all it has;
prediction reads every whole text.

Defined cases: text that is null or has no letter gives ``und`` and score 0,
and so does every text if nothing could be learned; a null lang teaches
nothing; rows that repeat a doc_id are rows of their own; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textscan import U64, mix, trimmed

PLACES = 3
#: Characters worked on at once.
CHARS = 1 << 20
#: n-gram vectors held at once.
VECTORS = 1 << 15


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def letter_vectors(points: np.ndarray, dims: int, seed: int) -> np.ndarray:
    """Random vector of each code point (0 stands for all that is no letter)."""
    lanes = np.arange(-(-dims // 64), dtype=U64)
    key = mix(points.astype(U64) + U64((seed + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    bits = np.unpackbits(mix(key[:, None] + mix(lanes + U64(1))).astype("<u8").view(np.uint8).reshape(len(points), -1), axis=1)
    return bits[:, :dims].astype(np.int8) * 2 - 1


def gram_vectors(alphabet: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Vectors of n-grams, given as numbers to the base of the alphabet's size."""
    size = len(alphabet)
    out = alphabet[codes % size]
    for place in range(1, PLACES):
        codes = codes // size
        out = out * np.roll(alphabet, place, axis=1)[codes % size]
    return out


def bundles(texts: list[str], dims: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Bundle of each text (float32), and whether it has a letter."""
    lowered = [f"\n{t.lower()}\n" for t in texts]
    sizes = np.fromiter(map(len, lowered), dtype=np.int64, count=len(lowered))
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    points = np.where(letters()[points], points, 0)
    docs = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    same = docs[1:] == docs[:-1]
    keep = np.ones(len(points), dtype=bool)
    keep[1:] = (points[1:] != 0) | (points[:-1] != 0) | ~same  # runs of other characters count once
    points, docs = points[keep], docs[keep]
    out, has = np.zeros((len(texts), dims), dtype=np.float32), np.zeros(len(texts), dtype=bool)
    has[docs[points > 0]] = True
    if len(points) < PLACES:
        return out, has
    used = np.zeros(0x110000, dtype=np.int32)
    used[points] = 1
    alphabet = np.flatnonzero(used)
    used[alphabet] = np.arange(len(alphabet))
    vectors, size = letter_vectors(alphabet, dims, seed), len(alphabet)
    own = used[points].astype(np.int64)
    grams = (own[:-2] * size + own[1:-1]) * size + own[2:]
    inside = docs[:-2] == docs[2:]
    first = np.searchsorted(docs[:-2][inside], np.arange(len(texts) + 1))
    grams = grams[inside]
    if size**PLACES <= 1 << 23:
        present = np.flatnonzero(np.bincount(grams, minlength=size**PLACES))
        number = np.zeros(size**PLACES, dtype=np.int32)
        number[present] = np.arange(len(present))
        numbers = number[grams]
    else:
        present, numbers = np.unique(grams, return_inverse=True)
    counted = [(d, *np.unique(numbers[first[d] : first[d + 1]], return_counts=True)) for d in np.flatnonzero(has)]
    for low in range(0, len(present), VECTORS):
        block = gram_vectors(vectors, present[low : low + VECTORS])
        for d, found, counts in counted:
            a, b = np.searchsorted(found, (low, low + VECTORS)) if len(present) > VECTORS else (0, len(found))
            for i in range(a, b, 4096):
                j = min(b, i + 4096)
                out[d] += counts[i:j].astype(np.float32) @ block[found[i:j] - low].astype(np.float32)
    return out, has


def _groups(texts: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    """Stretches of about ``CHARS`` characters, or of one longer text: (from, to, texts, nulls as empty ones)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHARS, side="right")))
        yield at, to, [t or "" for t in texts.slice(at, to - at).to_pylist()]
        at = to


def _learner(dims: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for at, to, texts in _groups(batch.column(1)):
                found, has = bundles(texts, dims, seed)
                for lang, vector in zip(np.array(langs[at:to], dtype=object)[has], found[has], strict=True):
                    norm = float(np.linalg.norm(vector))
                    if norm:
                        sums[lang] = sums.get(lang, np.zeros(dims)) + vector / norm
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["lang", "bundle"])

    return learn


def learn_prototypes(
    docs: DataFrame, *, sample: int = 5_000, dims: int = 512, seed: int = 7, parts: int = 24,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> dict[str, np.ndarray]:
    """Unit prototype of each language, from about ``sample`` of its documents at most (share by count, choice by hash)."""
    base = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.lit(seed)).alias("h"))
    share = base.groupBy("lang").agg(F.ceil(F.lit(1_000_000.0 * sample) / F.count("*")).alias("share"))  # a row per language
    base = base.join(F.broadcast(share), "lang").where(F.pmod("h", F.lit(1_000_000)) < F.col("share")).select("lang", "text", "h")
    partial = base.repartition(parts, "h").select("lang", "text").mapInArrow(trimmed(_learner(dims, seed)), "lang string, bundle binary")
    sums: dict[str, np.ndarray] = {}
    for row in sorted(partial.collect(), key=lambda r: (r.lang, bytes(r.bundle))):  # ``parts`` rows for each language
        sums[row.lang] = sums.get(row.lang, 0) + np.frombuffer(row.bundle)
    return {lang: v / np.linalg.norm(v) for lang, v in sorted(sums.items()) if np.linalg.norm(v)}


def _predictor(prototypes: dict[str, np.ndarray], dims: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = np.array([*prototypes, "und"], dtype=object)
    matrix = np.array(list(prototypes.values()), dtype=np.float32).reshape(len(prototypes), dims)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = np.full(batch.num_rows, "und", dtype=object), np.zeros(batch.num_rows)
            for at, to, texts in _groups(batch.column(batch.num_columns - 1)):
                found, has = bundles(texts, dims, seed)
                norms = np.linalg.norm(found, axis=1)
                if len(matrix):
                    cosines = found @ matrix.T / np.maximum(norms, 1e-9)[:, None]
                    best = np.where(has, cosines.argmax(axis=1), len(matrix))
                    langs[at:to] = names[best]
                    scores[at:to] = np.where(has, np.clip(cosines.max(axis=1), 0, 1), 0).round(6)
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(langs, pa.string()), pa.array(scores)], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    return predict


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], *, dims: int = 512, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", keep: str = "") -> DataFrame:
    """Per row: doc_id, lang_pred, score.  ``keep`` names a boolean column that is carried along."""
    columns = [F.col(id_col).alias("doc_id"), *([F.col(keep)] if keep else []), F.col(text_col).alias("_text")]
    schema = "doc_id long, " + (f"{keep} boolean, " if keep else "") + "lang_pred string, score double"
    return docs.select(*columns).mapInArrow(trimmed(_predictor(prototypes, dims, seed)), schema)


def identified(
    docs: DataFrame, prototypes: dict[str, np.ndarray], *, least: Sequence[tuple[int, float]] = ((0, 0.0),), dims: int = 512, seed: int = 7, text_col: str = "text"
) -> DataFrame:
    """Rows of ``docs`` whose text has a language with a score above ``least``; all columns are kept.

    ``least`` has rising (letters, score) steps; the last one that a text has the letters for holds.
    Repeated words count once for that, and a text that fails is tried again without its repeats.
    If nothing could be learned, every text with a letter stays.
    """
    predict = _predictor(prototypes, dims, seed)
    text = docs.columns.index(text_col)
    steps, scores = [n for n, _ in least], np.array([score for _, score in least])

    def above(texts: list[str], bounds: np.ndarray) -> np.ndarray:
        if not prototypes:  # nothing to compare with
            return np.array([any(map(str.isalpha, t)) for t in texts], dtype=bool)
        found = next(predict(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], names=[text_col])])))
        return (np.array(found.column(1)) > bounds) & np.array([lang != "und" for lang in found.column(0).to_pylist()], dtype=bool)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, texts in _groups(batch.column(text)):
                once = [" ".join(dict.fromkeys(t.lower().split())) for t in texts]
                letters = [sum(1 for _ in islice(filter(str.isalpha, t), steps[-1])) for t in once]
                bounds = scores[np.searchsorted(steps, letters, side="right") - 1]
                good = above(texts, bounds)
                failed = np.flatnonzero(~good)
                if len(failed):
                    good[failed] = above([once[i] for i in failed], bounds[failed])
                yield batch.slice(at, to - at).filter(pa.array(good))

    return docs.mapInArrow(trimmed(keep), docs.schema)


def held_out(id_column: Column, parts: int, rest: int) -> Column:
    """True where crc32 of the id as text leaves ``rest`` modulo ``parts``."""
    return F.crc32(F.encode(F.coalesce(id_column.cast("string"), F.lit("")), "UTF-8")) % parts == rest

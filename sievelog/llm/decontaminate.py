"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

A seed is a run of words of a benchmark item whose share of the corpus, were its
words independent, is small: a run of 3 to 8 words with a share of at most
``alone`` proposes the passage around each of its places by itself, a run of 2
or more words with at most ``together`` does with another seed near it, so copies that
are edited every few words are proposed too.  The shares come from the word
frequencies of the whole corpus and do not depend on its size, so the same item
has the same seeds in a small corpus and a large one of its kind.  A passage is
aligned with the item word by word (match 2, mismatch -1, gap -1).  The score is the
best local alignment over the best possible one, so edited and paraphrased copies
score below 1 but above ``least``.  An excerpt scores low if the item is long, so a
passage is also reported, whatever its score, if it aligns by the strict rule
(match 2, mismatch -4, gap -4) as well as ``excerpt`` equal words in a row do.

Words are counted in one pass for all items (a second one from ``vocabulary``
different words on).  Items are then worked on in blocks of at most
``block_bytes`` of text, each broadcast and held against all documents, so the
broadcast is bounded.

Defined cases: words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered; null, empty and
wordless texts or items match nothing; items shorter than a seed use all
their words as the seed; rows that repeat an id are rows of their own; empty
tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ORD, with_order
from .textscan import CHUNK, U64, Words, id_array, ids_of, mix, pieces, text_arrays, trimmed

#: Price of a mismatch or gap in an excerpt: chance matches of common words don't add up.
STRICT = 4
HITS = "doc_id long, item_id long, score double, word_from long, word_to long, seeds long"


@dataclass
class Items:
    """A block of benchmark items: word numbers of each, and where each seed lies."""

    ids: np.ndarray
    words: list[np.ndarray]
    seeds: np.ndarray  # sorted hashes
    places: np.ndarray  # (item, position) of each seed
    weights: np.ndarray  # 2: proposes a passage by itself, 1: with another
    sizes: list[int]  # lengths of the seeds, in words


def _seed_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(max(0, len(hashes) - n + 1), dtype=U64)
    for i in range(n):
        out = mix(out * U64(0xD1342543DE82EF95) + hashes[i : len(hashes) - n + 1 + i] + U64(n))
    return out


def _item_words(texts: list[str | None]) -> tuple[np.ndarray, list[np.ndarray]]:
    data, offsets = text_arrays(pa.array(texts, pa.string()))
    words = Words(data, offsets, lower=True)
    hashes = words.hashes()
    return hashes, [hashes[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]


def _counter(vocabulary: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Corpus counts of the block's words; key -1 is the number of all words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, found = 0, np.zeros(len(vocabulary), dtype=np.int64)
        for batch in batches:
            data, offsets = text_arrays(batch.column(0))
            for _, _, some, some_offsets in pieces(data, offsets, CHUNK // 2):
                hashes = Words(some, some_offsets, lower=True).hashes()
                total += len(hashes)
                at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
                found += np.bincount(at[vocabulary[at] == hashes], minlength=len(vocabulary))
        keys = np.append(np.arange(len(vocabulary)), -1)
        counts = np.append(found, total)
        yield pa.RecordBatch.from_arrays([pa.array(keys[counts > 0]), pa.array(counts[counts > 0])], names=["word", "n"])

    return count


def _rare_seeds(items: list[np.ndarray], share: np.ndarray, vocabulary: np.ndarray, lengths: tuple[int, int], alone: float, together: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """From each word of an item the shortest runs of a small enough share: hashes, places, weights and lengths.

    A longer run is tried where a shorter one is too frequent; an item without
    a run that proposes by itself keeps its rarest longest one for that.
    """
    hashes, places, weights, sizes = [], [], [], set()
    for k, words in enumerate(items):
        if not len(words):
            continue
        low, high = (min(n, len(words)) for n in lengths)
        frequency = np.concatenate([[0.0], np.cumsum(np.log(share[np.searchsorted(vocabulary, words)]))])
        done = {1: np.zeros(len(words), dtype=bool), 2: np.zeros(len(words), dtype=bool)}
        for size in range(min(2, low), high + 1):
            own = _seed_hashes(words, size)
            expected = frequency[size:] - frequency[:-size]
            for weight, limit in ((2, alone), (1, together)):
                keep = np.flatnonzero((expected <= np.log(limit)) & ~done[weight][: len(own)]) if weight == 1 or size >= low else np.empty(0, dtype=np.int64)
                if weight == 2 and size == high and not done[2].any() and not len(keep):
                    keep = np.array([expected.argmin()])
                if len(keep):
                    done[weight][keep] = True
                    if weight == 2:
                        done[1][keep] = True  # one seed of a place is enough
                    sizes.add(size)
                    hashes.append(own[keep])
                    places.append(np.stack([np.full(len(keep), k), keep], axis=1))
                    weights.append(np.full(len(keep), weight))
    if not hashes:
        return np.empty(0, dtype=U64), np.empty((0, 2), dtype=np.int64), np.empty(0, dtype=np.int64), []
    every, where, weight = np.concatenate(hashes), np.concatenate(places), np.concatenate(weights)
    order = np.argsort(every, kind="stable")
    return every[order], where[order], weight[order], sorted(sizes)


def align(item: np.ndarray, passage: np.ndarray, gap: int = 1) -> tuple[int, int, int]:
    """Best local alignment score, and the part of the passage that has it (from, to).  A mismatch costs as much as a gap."""
    width = len(passage)
    above, begin_above = np.zeros(width + 1, dtype=np.int64), np.arange(width + 1)
    best, span = 0, (0, 0)
    steps = np.arange(width + 1) * gap
    for word in item:
        diagonal = above[:-1] + np.where(passage == word, 2, -gap)
        up = above[1:] - gap
        cell, begin = np.zeros(width + 1, dtype=np.int64), np.arange(width + 1)
        cell[1:] = np.maximum(np.maximum(diagonal, up), 0)
        begin[1:] = np.where(cell[1:] == 0, begin[1:], np.where(diagonal >= up, begin_above[:-1], begin_above[1:]))
        lifted = cell + steps  # gaps in the item: the best cell to the left, less its distance
        running = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == running, np.arange(width + 1), 0))
        left = running - steps
        begin = np.where(left > cell, begin[source], begin)
        above, begin_above = np.maximum(cell, left), begin
        top = int(above.argmax())
        if above[top] > best:
            best, span = int(above[top]), (int(begin_above[top]), top)
    return best, *span


def _finder(items: Items, least: float, excerpt: int, margin: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def hits_of(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word position, seed number) of every seed in the texts."""
        positions, seeds = [], []
        for size in items.sizes:
            grams = _seed_hashes(hashes, size)
            low = np.searchsorted(items.seeds, grams)
            near = items.seeds[np.minimum(low, len(items.seeds) - 1)] == grams
            near &= docs[: len(grams)] == docs[size - 1 :]
            at = np.flatnonzero(near)
            high = np.searchsorted(items.seeds, grams[at], side="right")
            many = high - low[at]
            positions.append(np.repeat(at, many))
            seeds.append(np.repeat(low[at], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
        return np.concatenate(positions), np.concatenate(seeds)

    lengths = np.array([len(w) for w in items.words], dtype=np.int64)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = ids_of(batch.column(0))
            data, offsets = text_arrays(batch.column(1))
            for at, _, some, some_offsets in pieces(data, offsets, CHUNK // 2):
                words = Words(some, some_offsets, lower=True)
                hashes, docs = words.hashes(), words.docs()
                if not len(items.seeds) or not len(hashes):
                    continue
                position, seed = hits_of(hashes, docs)
                if not len(position):
                    continue
                item, place, weight = items.places[seed, 0], items.places[seed, 1], items.weights[seed]
                owner, diagonal = docs[position], position - place
                order = np.lexsort((diagonal, item, owner))
                owner, item, diagonal, weight = owner[order], item[order], diagonal[order], weight[order]
                slack = (lengths[item] * margin).astype(np.int64) + 2
                # hits of one document and item whose starts lie near each other are one passage
                fresh = np.concatenate([[True], (owner[1:] != owner[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > slack[1:])])
                heads = np.flatnonzero(fresh)
                ends = np.append(heads[1:], len(fresh))
                strong = np.add.reduceat(weight, heads) >= 2
                rows = []
                for i, j in zip(heads[strong].tolist(), ends[strong].tolist(), strict=True):
                    d, k = owner[i], item[i]
                    low = max(words.first[d], diagonal[i] - slack[i])
                    high = min(words.first[d + 1], diagonal[j - 1] + lengths[k] + slack[i])
                    score, begin, end = align(items.words[k], hashes[low:high])
                    share = score / (2 * len(items.words[k]))
                    found = share >= least
                    if not found and score >= 2 * excerpt:  # the strict rule scores no higher
                        strict, begin, end = align(items.words[k], hashes[low:high], STRICT)
                        found = strict >= 2 * excerpt
                    if found:
                        rows.append((ids[at + d], items.ids[k], round(share, 6), int(low - words.first[d] + begin), int(low - words.first[d] + end), j - i))
                if rows:
                    columns = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [id_array(np.array(columns[0])), id_array(np.array(columns[1])), pa.array(columns[2], pa.float64()), *(pa.array(c, pa.int64()) for c in columns[3:])],
                        names=[x.split()[0] for x in HITS.split(", ")],
                    )

    return find


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, *, seed: tuple[int, int] = (3, 8), alone: float = 1e-8, together: float = 1e-6, least: float = 0.5, excerpt: int = 13, margin: float = 0.3,
    block_bytes: int = 8 << 20, vocabulary: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """A row per leaked passage: doc_id, item_id, score, word_from, word_to, seeds."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    blocks = -(-size // block_bytes)

    def block(k: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Ids, distinct words and words of about ``block_bytes`` of items."""
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        every, words = _item_words([r.text for r in own])
        return np.array([-(1 << 63) if r.item_id is None else r.item_id for r in own], dtype=np.int64), np.unique(every), words

    first = block(0) if blocks == 1 else None
    known = first[1] if first else np.empty(0, dtype=U64)
    for k in range(blocks) if not first else ():
        known = np.union1d(known, block(k)[1])
    counts, total = np.zeros(len(known), dtype=np.int64), 0
    for low in range(0, len(known), vocabulary):
        counted = base.select("text").mapInArrow(trimmed(_counter(known[low : low + vocabulary])), "word long, n long")
        for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect():  # a row per word of the benchmark
            if r.word < 0:
                total = r.n
            else:
                counts[low + r.word] = r.n
    share, found = np.maximum(counts, 1) / max(total, 1), None
    for k in range(blocks):
        ids, _, words = first or block(k)
        seeds, places, weights, sizes = _rare_seeds(words, share, known, seed, alone, together)
        hits = base.mapInArrow(trimmed(_finder(Items(ids, words, seeds, places, weights, sizes), least, excerpt, margin)), HITS)
        found = hits if found is None else found.unionByName(hits)
    return found if found is not None else spark.createDataFrame([], HITS)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of ``docs`` without a leaked passage, all columns kept."""
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("_doc")  # whatever the columns are called
    rows, _ = with_order(docs, id_col, docs[text_col].alias("text"), whole)
    leaked = find_leaks(rows.select(ORD, "text"), benchmark, id_col=ORD, **options).select(F.col("doc_id").alias("_leaked")).distinct()
    return rows.join(leaked, rows[ORD] == leaked["_leaked"], "left_anti").select("_doc.*")

"""Packing by minimum bin slack.

Every text becomes token ids and an end id.  A document longer than the window
is cut into full windows and a rest.  What is left to decide depends only on
how many rests there are of each length, a table of at most ``capacity`` rows:
for each window the largest rest left is taken, a bitset subset-sum dynamic
programme over the remaining lengths finds the multiset that fills the window
closest to capacity, and its counts, backtracked, are used for as many windows
as the table allows.  Each repetition uses up a length, so there are at most
``capacity`` patterns whatever the input.  Pieces take their places by their
rank among the pieces of their length.

Defined cases: null and empty texts are the end id alone; rows that repeat a
doc_id are documents of their own; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpoint, salted_rank, salts_for
from .textscan import trimmed

PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long"
#: Bytes of known words and their ids that a worker keeps in each of two generations.
CACHED_BYTES = 12 << 20
#: Longer words are encoded wherever they occur and never kept.
CACHED_WORD = 64
#: What a kept word takes besides its own bytes and ids.
ENTRY_BYTES = 180
#: Bytes of text encoded at once (or one longer text).
CHUNK = 1 << 20
#: Latin letters that need no composition (U+00D7 and U+00F7 are no letters), and ASCII marks that follow them as a token run of their own.
LATIN = "".join(map(chr, [*range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))
MARKS = "!\"#$%&()*+,-./:;=>?@[\\]^_`{}~"
LETTERS = re.compile(f"[{LATIN}A-Z]+").fullmatch


def _byte_level() -> dict[int, str]:
    """Byte -> printable character: printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_LEVEL = _byte_level()


class WordEncoder:
    """Ids of texts, word by word: Arrow splits and numbers the words, only distinct new ones are encoded.

    White space always separates tokens of this tokenizer, so encoding the
    words one by one is exact.  ASCII case is folded first, as the tokenizer
    itself does, except in texts that may hold its special tokens.  Known words
    are kept in two generations of at most ``CACHED_BYTES`` each.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.table: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.size = 0

    def _keep(self, found: dict[str, bytes]) -> None:
        for word, ids in found.items():
            if len(word) <= CACHED_WORD:
                self.table[word] = ids
                self.size += len(word) + len(ids) + ENTRY_BYTES
        if self.size > CACHED_BYTES:
            self.older, self.table, self.size = self.table, {}, 0

    def _new(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of words; a run of Latin letters needs no normaliser or splitting."""
        out, odd, tokenize = {}, [], self.model.tokenize
        for word in words:
            if LETTERS(word):
                ids = [x.id for x in tokenize(word.lower().encode().decode("latin-1").translate(BYTE_LEVEL))]
                out[word] = struct.pack(f"<{len(ids)}I", *ids)
            elif word:
                odd.append(word)
            else:
                out[word] = b""
        found = self.tokenizer.encode_batch(odd, add_special_tokens=False)
        return out | {w: struct.pack(f"<{len(x.ids)}I", *x.ids) for w, x in zip(odd, found, strict=True)}

    def _ids(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words."""
        found = list(map(self.table.get, words))
        places = [i for i, ids in enumerate(found) if ids is None]
        again, new = {}, []
        for i in places:
            if (ids := self.older.get(words[i])) is None:
                new.append(words[i])
            else:
                again[words[i]] = ids
        learned = again | self._new(new)
        for i in places:
            found[i] = learned[words[i]]
        self._keep(learned)
        return found

    def ids_of(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one after the other, and how many each has.  Letters and the marks after them are looked up apart."""
        stems = pc.ascii_rtrim(words, MARKS)
        own = pc.match_substring_regex(stems, f"^[{LATIN}]+$")
        stems = pc.if_else(own, stems, words).dictionary_encode()
        marks = pc.if_else(own, pc.utf8_ltrim(words, LATIN), "").dictionary_encode()
        known = [*self._ids(stems.dictionary.to_pylist()), *self._ids(marks.dictionary.to_pylist())]
        sizes = np.fromiter(map(len, known), dtype=np.int64, count=len(known)) // 4
        parts = np.empty(2 * len(words), dtype=np.int64)
        parts[::2] = stems.indices.to_numpy(zero_copy_only=False)
        parts[1::2] = marks.indices.to_numpy(zero_copy_only=False)
        parts[1::2] += len(stems.dictionary)
        return _joined(np.frombuffer(b"".join(known), dtype="<u4"), sizes, parts), sizes[parts[::2]] + sizes[parts[1::2]]

    def encode(self, texts: pa.LargeStringArray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids (little-endian unsigned 32 bit) of the texts, the end id after each, and where each text begins."""
        special = pc.match_substring(texts, "<|")
        lowered = pc.if_else(special, texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(lowered)
        coded = split.flatten().dictionary_encode()
        known, sizes = self.ids_of(coded.dictionary)
        known, sizes = np.append(known, np.uint32(end_id)), np.append(sizes, 1)
        offsets = split.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        offsets -= offsets[0]
        words = np.insert(coded.indices.to_numpy(zero_copy_only=False), offsets[1:], len(sizes) - 1)
        ends = offsets + np.arange(len(offsets))  # each text before has an end id
        return _joined(known, sizes, words), np.concatenate([[0], np.cumsum(sizes[words])])[ends]


def _joined(flat: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Runs of ``flat``, which has one of each size after the other, in the given order."""
    count, begins = sizes[order], (np.cumsum(sizes) - sizes)[order]
    return flat[np.repeat(begins - (np.cumsum(count) - count), count) + np.arange(count.sum())]


def _cutter(path: str, end_id: int, capacity: int, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), *([pa.binary()] if with_ids else [])]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(path)
        for batch in batches:
            texts = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
            bytes_to = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(texts):
                base = bytes_to[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(bytes_to, base + CHUNK, side="right")))
                ids, first = encoder.encode(texts.slice(at, to - at), end_id)
                tokens = np.diff(first)
                pieces = -(-tokens // capacity)
                doc = np.repeat(np.arange(to - at), pieces)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
                length = np.minimum(tokens[doc] - start, capacity)
                low, raw = 4 * (first[doc] + start), memoryview(ids).cast("B")
                spans = [raw[a:b] for a, b in zip(low.tolist(), (low + 4 * length).tolist(), strict=True)]
                crc = np.fromiter(map(zlib.crc32, spans), dtype=np.int64, count=len(spans))
                columns = [batch.column(0).slice(at, to - at).take(pa.array(doc)), start, length, crc, tokens[doc], *([[bytes(x) for x in spans]] if with_ids else [])]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
                at = to

    return cut


def fill(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """Multiset of the lengths, as (length, count), whose sum comes closest to ``room`` from below.

    ``reach`` has bit s set if s is a subset sum; the programme goes through
    the lengths from the largest and stops at a perfect fill.
    """
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        steps.append((length, reach))
        left, step = min(counts[length], room // length), 1
        while left:
            step = min(step, left)
            reach |= (reach << (length * step)) & mask
            left -= step
            step *= 2
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, []
    for length, before in reversed(steps):
        n = 0
        while not before >> total & 1:
            total -= length
            n += 1
        if n:
            out.append((length, n))
    return out


def plan_windows(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(windows, [(length, count in each)]) until all lengths are used."""
    left, plan = {x: n for x, n in counts.items() if n}, []
    while left:
        largest = max(left)
        rest = dict(left)
        rest[largest] -= 1
        pattern = dict(fill(rest, capacity - largest))
        pattern[largest] = pattern.get(largest, 0) + 1
        windows = min(left[x] // n for x, n in pattern.items())
        plan.append((windows, sorted(pattern.items(), reverse=True)))
        for x, n in pattern.items():
            left[x] -= n * windows
            if not left[x]:
                del left[x]
    return plan


def _placer(plan: list[tuple[int, list[tuple[int, int]]]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Places by (length, rank): the window, and the offset there."""
    ranges: dict[int, list[tuple[int, int, int, int]]] = {}
    seen: dict[int, int] = {}
    base = 0
    for windows, pattern in plan:
        offset = 0
        for length, n in pattern:
            ranges.setdefault(length, []).append((seen.get(length, 0), base, n, offset))
            seen[length] = seen.get(length, 0) + n * windows
            offset += length * n
        base += windows
    tables = {x: np.array(rows, dtype=np.int64).T for x, rows in ranges.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("length", "rank"))
            windows, offsets = np.empty(len(ranks), dtype=np.int64), np.empty(len(ranks), dtype=np.int64)
            for length in np.unique(lengths):
                own = np.flatnonzero(lengths == length)
                froms, bases, each, starts = tables[int(length)]
                k = np.searchsorted(froms, ranks[own], side="right") - 1
                within = ranks[own] - froms[k]
                windows[own] = bases[k] + within // each[k]
                offsets[own] = starts[k] + within % each[k] * length
            kept = [x for x in batch.schema.names if x != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in kept), pa.array(windows), pa.array(offsets)], names=[*kept, "sequence_id", "offset"])

    return place


def pack(
    docs: DataFrame, tokenizer: str, *, end_id: int = 2, capacity: int = 4096, with_ids: bool = False,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``with_ids`` adds the piece's ids (binary, little-endian unsigned 32 bit);
    ``sequences`` joins them to whole sequences.  A sequence is padded to
    ``capacity`` unless the ids in it are a power of two.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = PIECES + (", ids binary" if with_ids else "")
    cut = checkpoint(source.mapInArrow(trimmed(_cutter(tokenizer, end_id, capacity, with_ids)), schema))
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    plan = plan_windows(counts, capacity)
    ranked = salted_rank(cut, ["length"], ["doc_id", "start", "ids_crc32"], "rank", salts_for(sum(counts.values())))
    ranked = ranked.select(*[x.split()[0] for x in schema.split(", ")], "rank")
    placed = ranked.mapInArrow(trimmed(_placer(plan)), f"{schema}, sequence_id long, offset long")
    return placed.select("*", F.col("length").cast("long").alias("_long")).drop("length").withColumnRenamed("_long", "length")


def sequences(pieces: DataFrame, *, capacity: int = 4096, pad_id: int = 0) -> DataFrame:
    """Whole sequences of ``pack(..., with_ids=True)``: sequence_id, tokens, ids, padded with ``pad_id``.

    A sequence has at most ``capacity`` pieces, so the group that is gathered is bounded.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = pieces.groupBy("sequence_id").agg(F.sum("length").alias("tokens"), parts.alias("parts"))
    body = F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    power = F.expr("tokens & (tokens - 1)") == 0
    pad = F.unhex(F.expr(f"repeat('{struct.pack('<I', pad_id).hex()}', cast({capacity} - tokens as int))"))
    return joined.select("sequence_id", "tokens", F.when(power, body).otherwise(F.concat(body, pad)).alias("ids"))

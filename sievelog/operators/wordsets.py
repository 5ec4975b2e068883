"""Candidate pairs of word sets by their Jaccard similarity or overlap, from packed keys.

Words are put in one order for both sides: rare ones first, by counts of hash
buckets (which only steer the order), then by hash.  Two sets that are similar
have a word in common among the first words of either, and larger ones so many
there that two of them fall into one of a few groups of words: small sets meet
by words, larger ones by such pairs of words, which seldom meet by chance.  Keys travel sorted and packed.  Keys that collide add candidates and
lose none; callers confirm pairs on the words themselves.

For overlap, where a small set may be in much larger ones, sets are packed in
blocks instead, and blocks of both sides meet each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .train import settled, stored

EPSILON = 1e-9
BUCKETS = 1 << 20
#: (size of the smaller set from which it holds, groups of words): fewer groups need fewer first words, more groups make fewer pairs of them.
CLASSES = ((20, 2), (40, 4), (80, 8))
#: Below this similarity the first words are nearly all words, and pairs of them too many.
LEAST_FOR_TWO = 0.5
#: White space of word sets but the blank.
_OTHER_SPACE = r"[\t\n\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Sets up to which all workers get their signatures (36 bytes each), which sort out most candidates.
SIGNED = 5_000_000
#: Keys that a task packs, and pairs that it looks at, at once.
AT_ONCE, PAIRS_AT_ONCE = 3_000_000, 5_000_000
#: Bytes of text of a block of both sides, bits of a set's signature there, and pairs whose texts leave a task at once.
BLOCK, SIGN, TEXTS_AT_ONCE = 24 << 20, 512, 2000


def _coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row and number of every word that is not empty, and the different words."""
    texts = texts.cast(pa.string()).fill_null("")
    split = pc.split_pattern(pc.replace_substring_regex(texts, _OTHER_SPACE, " ") if pc.any(pc.match_substring_regex(texts, _OTHER_SPACE)).as_py() else texts, " ")
    row = np.repeat(np.arange(len(split)), np.diff(split.offsets.to_numpy()))
    flat = split.flatten()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    coded = flat.dictionary_encode()
    return row[full], coded.indices.to_numpy(zero_copy_only=False)[full], coded.dictionary


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and number of every word that is not empty, and the hashes of the different words."""
    row, word, every = _coded(texts)
    return row, word, pd.util.hash_array(every.to_numpy(zero_copy_only=False).astype(object), categorize=False)


def _distinct(row: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.sort((row.astype(np.int64) << 32) | word.astype(np.int64))
    if len(both):
        both = both[np.concatenate([[True], both[1:] != both[:-1]])]
    return both >> 32, both & 0xFFFFFFFF


def _signatures(row: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Three words of 64 bits for each row: which of 64 classes have a word of it, two, and three.

    Bits that differ between two rows are no more than the words that only one of them has.
    """
    counts = np.bincount(row * 64 + (hashes >> np.uint64(40)).astype(np.int64) % 64, minlength=n * 64).reshape(n, 64)
    bits = np.uint64(1) << np.arange(64, dtype=np.uint64)
    return np.stack([(np.where(counts > k, bits, np.uint64(0))).sum(axis=1, dtype=np.uint64) for k in range(3)], axis=1)


def _counter(signed: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row of the counts of buckets, and, if ``signed``, numbers, sizes and signatures of the sets, in rows of no part."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row_of = lambda part, blobs: pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([blobs], pa.list_(pa.binary()))], names=["part", "blobs"])
        total = np.zeros(BUCKETS, dtype=np.uint32)
        for batch in batches:
            row, word, hashes = _words(batch.column("text"))
            row, word = _distinct(row, word)
            np.add.at(total, (hashes % np.uint64(BUCKETS)).astype(np.int64), np.bincount(word, minlength=len(hashes)).astype(np.uint32))
            if signed and batch.num_rows:
                signs, sizes = _signatures(row, hashes[word], batch.num_rows), np.bincount(row, minlength=batch.num_rows).astype(np.uint32)
                yield row_of(-1, [_pack(batch.column("i").to_numpy()), _pack(batch.column("side").to_numpy()), _pack(sizes), *(_pack(signs[:, k]) for k in range(3))])
        yield row_of(TaskContext.get().partitionId() % 32, [_pack(total)])

    return counts


def _sum(table: pa.Table) -> pa.Table:
    total = np.zeros(BUCKETS, dtype=np.uint32)
    for blobs in table.column("blobs"):
        total += _unpack(blobs.as_py()[0], np.uint32)
    return pa.table({"blobs": pa.array([[_pack(total)]], pa.list_(pa.binary()))})


def _pack(values: np.ndarray) -> bytes:
    """Byte planes, compressed: high bytes are mostly alike."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpack(blob: bytes, kind: type) -> np.ndarray:
    n, width = int.from_bytes(blob[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(blob[8:], decompressed_size=n * width, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(kind).reshape(n)


def _places(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Size of each entry's row and its place there; rows come one after the other."""
    size = np.bincount(row)
    first = np.cumsum(size) - size
    return size[row], np.arange(len(row)) - first[row]


def _twos(row: np.ndarray, hashes: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and key of every two words of a row and of a group."""
    group = (hashes >> np.uint64(20)) % np.uint64(groups)
    cell = row.astype(np.int64) * groups + group.astype(np.int64)
    order = np.argsort(cell, kind="stable")
    cell, hashes = cell[order], hashes[order]
    number = np.cumsum(np.concatenate([[0], cell[1:] != cell[:-1]])) if len(cell) else cell
    size, place = _places(number) if len(cell) else (cell, cell)
    later = size - 1 - place
    one = np.repeat(np.arange(len(cell)), later)
    other = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(later) - later, later)
    return cell[one] // groups, hashes[one] + hashes[other]


def _dealt(parts: int, kind: int, key: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """Packed rows (part, kind, keys, columns...) of one side."""
    key = key * _MIX
    part = ((key >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
    low = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    order = np.argsort((part << 32) | low)
    part, low = part[order], low[order]
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own = order[a:b]
        yield int(part[a]), kind, _pack(np.diff(low[a:b], prepend=0).astype(np.uint32)), [_pack(c[own]) for c in columns]


def _flushed(parts: int, kept: dict[tuple[int, int], list]) -> Iterator[pa.RecordBatch]:
    for (kind, side), some in kept.items():
        columns = [np.concatenate(c) for c in zip(*some, strict=True)]
        rows = list(_dealt(parts, kind, *columns))
        if rows:
            part, kinds, keys, blobs = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kinds, pa.int32()), pa.array([side] * len(rows), pa.int32()), pa.array(keys, pa.binary()), pa.array(blobs, pa.list_(pa.binary()))], names=["part", "kind", "side", "keys", "columns"])


def _prepared(before: DataFrame, after: DataFrame) -> tuple[DataFrame, Broadcast, Broadcast | None, int]:
    """Both sides (side, i, text), the counts of buckets, ids, sizes and signatures of each side unless there are too many sets, and the parts that keys are dealt to."""
    spark = before.sparkSession
    column = F.col("i").cast("long").alias("i")
    sides = before.select(F.lit(0).alias("side"), column, "text").unionByName(after.select(F.lit(1).alias("side"), column, "text"))
    signed = sides.count() <= SIGNED
    counted = settled(sides.mapInArrow(_counter(signed), "part int, blobs array<binary>"))
    often = np.zeros(BUCKETS, dtype=np.uint32)
    for r in counted.where("part >= 0").groupBy("part").applyInArrow(_sum, "blobs array<binary>").collect():  # at most 32 rows
        often += _unpack(bytes(r.blobs[0]), np.uint32)
    shared = spark.sparkContext.broadcast(often)  # 4 MiB
    known = None
    if signed:
        rows = [[_unpack(bytes(x), t) for x, t in zip(r.blobs, (np.int64, np.int32, np.uint32, *[np.uint64] * 3), strict=True)] for r in counted.where("part < 0").select("blobs").collect()]
        if rows:
            ids, of, *signs = (np.concatenate(c) for c in zip(*rows, strict=True))
            rows = []
            ordered = [own[np.argsort(ids[own])] for own in (np.flatnonzero(of == 0), np.flatnonzero(of == 1))]
            known = spark.sparkContext.broadcast([(ids[own], [c[own] for c in signs]) for own in ordered])
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return sides, shared, known, parts


def jaccard_candidates(before: DataFrame, after: DataFrame, least: float) -> DataFrame:
    """Distinct (b, a), long, that hold every pair with a word in common and a similarity of ``least``; frames have i and text."""
    sides, shared, known, parts = _prepared(before, after)
    classes = CLASSES if least >= LEAST_FOR_TWO else ()
    small = classes[0][0] if classes else np.inf

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[int, int], list] = {}
        total = 0
        for batch in batches:
            side, ids = batch.column("side").to_numpy(), batch.column("i").to_numpy()
            row, word, hashes = _words(batch.column("text"))
            if not len(row):
                continue
            order = np.lexsort((hashes, shared.value[(hashes % np.uint64(BUCKETS)).astype(np.int64)]))
            rank = np.empty(len(order), dtype=np.int64)
            rank[order] = np.arange(len(order))
            row, place = _distinct(row, rank[word])
            code = hashes[order][place]
            n, at = _places(row)
            need = np.ceil(n * least - EPSILON)
            one = (n - at >= need) & (n * least < small)  # those that may meet a small set
            for k, (size, groups) in enumerate(classes):
                upper = classes[k + 1][0] if k + 1 < len(classes) else np.inf
                two = (n >= size) & (n * least < upper) & (n - at > need - (groups + 1))
                twos, keys = _twos(row[two], code[two], groups)
                for s in (0, 1):
                    if (own := side[twos] == s).any():
                        kept.setdefault((2 + k, s), []).append((keys[own], ids[twos[own]]))
                        total += int(own.sum())
            for s in (0, 1):
                if (own := one & (side[row] == s)).any():
                    kept.setdefault((1, s), []).append((code[own], ids[row[own]], n[own].astype(np.uint32), (n - at)[own].astype(np.uint32)))
                    total += int(own.sum())
            if total > AT_ONCE:
                yield from _flushed(parts, kept)
                kept, total = {}, 0
        yield from _flushed(parts, kept)

    def likely(b: np.ndarray, a: np.ndarray) -> np.ndarray:
        """Whether so few words as the signatures tell may be in one set only."""
        (b_ids, (nb, *b_signs)), (a_ids, (na, *a_signs)) = known.value
        b, a = np.searchsorted(b_ids, b), np.searchsorted(a_ids, a)
        every = nb[b].astype(np.int64) + na[a]
        apart = sum(np.bitwise_count(x[b] ^ y[a]).astype(np.int64) for x, y in zip(b_signs, a_signs, strict=True))
        return apart <= every - 2 * np.ceil(every * (least / (1 + least)) - EPSILON)

    def met(table: pa.Table) -> pa.Table:
        pairs = []
        for kind in range(1, 2 + len(classes)):
            sides = []
            for s in (0, 1):
                own = table.filter(pc.and_(pc.equal(table["kind"], kind), pc.equal(table["side"], s)))
                keys = [np.cumsum(_unpack(k.as_py(), np.uint32).astype(np.int64)) for k in own["keys"]]
                blobs = own["columns"].to_pylist()
                kinds = (np.int64, np.uint32, np.uint32) if kind == 1 else (np.int64,)
                columns = [np.concatenate([_unpack(x[c], t) for x in blobs]) if blobs else np.zeros(0, t) for c, t in enumerate(kinds)]
                key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
                order = np.argsort(key, kind="stable")
                sides.append((key[order], [c[order] for c in columns]))
            (kb, left), (ka, right) = sides
            low, high = np.searchsorted(ka, kb, "left"), np.searchsorted(ka, kb, "right")
            some = np.flatnonzero(high > low)
            low, n = low[some], (high - low)[some]
            ends, at = np.cumsum(n), 0
            while at < len(some):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
                own = n[at:to]
                x = np.repeat(some[at:to], own)
                y = np.repeat(low[at:to], own) + np.arange(len(x)) - np.repeat(np.cumsum(own) - own, own)
                if kind == 1:
                    nb, na = left[1][x].astype(np.int64), right[1][y].astype(np.int64)
                    rest = np.minimum(left[2][x], right[2][y])
                    near = (np.minimum(nb, na) >= np.maximum(nb, na) * (least - EPSILON)) & (rest >= np.ceil((nb + na) * (least / (1 + least)) - EPSILON))
                    near &= np.minimum(nb, na) < small
                    x, y = x[near], y[near]
                found = pd.DataFrame({"b": left[0][x], "a": right[0][y]}).drop_duplicates()
                pairs.append(found if known is None else found[likely(found["b"].to_numpy(), found["a"].to_numpy())])
                at = to
        every = pd.concat(pairs).drop_duplicates() if pairs else pd.DataFrame({"b": [], "a": []}, dtype="int64")
        return pa.table({"b": pa.array(every["b"], pa.int64()), "a": pa.array(every["a"], pa.int64())})

    packed = sides.mapInArrow(probes, "part int, kind int, side int, keys binary, columns array<binary>")
    return packed.groupBy("part").applyInArrow(met, "b long, a long").distinct()


def _block(ids: list[np.ndarray], texts: list[pa.Array], rows: list[np.ndarray], codes: list[np.ndarray]) -> list[bytes]:
    """One side of a block, packed: ids, codes of its words and how many sets have each, the places of these, sizes of the sets, and the texts."""
    joined = lambda some, kind: np.concatenate([np.zeros(0, kind), *some])
    row, code = joined(rows, np.uint32), joined(codes, np.uint32)
    both = np.sort((code.astype(np.uint64) << np.uint64(32)) | row)
    code, row = both >> np.uint64(32), both.astype(np.uint32)
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    own = joined(ids, np.int64)
    size = np.bincount(row, minlength=len(own)).astype(np.uint32)
    steps = np.diff(code[first].astype(np.int64), prepend=0).astype(np.uint32)
    text = pa.concat_arrays([pa.array([], pa.binary()), *texts])
    raw = b"".join(text.to_pylist())
    lengths = pc.binary_length(text).to_numpy().astype(np.uint32)
    return [_pack(own), _pack(steps), _pack(np.diff(np.append(first, len(code))).astype(np.uint32)), _pack(row), _pack(size), _pack(lengths), _pack(np.frombuffer(raw, np.uint8))]


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows (k, b, a) of both sides of as many sets as have ``most`` bytes of text, with 8 more for each."""
    from pyspark import TaskContext

    def fresh() -> list[tuple[list, list, list, list]]:
        return [([], [], [], []), ([], [], [], [])]

    def packed(k: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), *(pa.array([_block(*x)], pa.list_(pa.binary())) for x in kept)], names=["k", "b", "a"])

    kept, counts, total, k = fresh(), [0, 0], 0, TaskContext.get().partitionId() << 32
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("text").cast(pa.binary()).fill_null(b"")).to_numpy().astype(np.int64) + 8)
        cuts = [0, *(np.flatnonzero(np.diff((total + ends) // most)) + 1), batch.num_rows]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(low, high - low)
            for s in (0, 1):
                own = part.filter(pc.equal(part.column("side"), s))
                if not own.num_rows:
                    continue
                row, word, hashes = _words(own.column("text"))
                row, word = _distinct(row, word)
                columns = own.column("i").to_numpy(), own.column("text").cast(pa.binary()).fill_null(b""), (row + counts[s]).astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)[word]
                for some, column in zip(kept[s], columns, strict=True):
                    some.append(column)
                counts[s] += own.num_rows
            total += int(ends[high - 1] - (ends[low - 1] if low else 0)) if high else 0
            if high < batch.num_rows or total >= most:
                yield packed(k)
                kept, counts, total, k = fresh(), [0, 0], 0, k + 1
    if sum(counts):
        yield packed(k)


class _Side:
    """One side of a block, unpacked."""

    def __init__(self, blobs: list[bytes]) -> None:
        self.blobs = blobs
        self.codes, self.often = np.cumsum(_unpack(blobs[1], np.uint32).astype(np.int64)), _unpack(blobs[2], np.uint32).astype(np.int64)
        self.rows, self.n = _unpack(blobs[3], np.uint32).view(np.int32), _unpack(blobs[4], np.uint32).astype(np.int64)
        self.first = np.cumsum(self.often) - self.often
        bit = np.repeat((self.codes * 0x9E3779B1 >> 12) % SIGN, self.often)
        self.signs = np.zeros((SIGN // 64, len(self.n)), dtype=np.uint64)
        np.bitwise_or.at(self.signs.reshape(-1), (bit >> 6) * len(self.n) + self.rows, np.uint64(1) << (bit & 63).astype(np.uint64))

    def texts(self, of: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """Ids and texts of these sets."""
        if not hasattr(self, "ids"):
            raw = _unpack(self.blobs[6], np.uint8)
            offsets = np.concatenate([[0], np.cumsum(_unpack(self.blobs[5], np.uint32).astype(np.int64))])
            self.text = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
            self.ids = _unpack(self.blobs[0], np.int64)
        return pa.array(self.ids[of]), self.text.take(pa.array(of)).cast(pa.string())


def _within(own: _Side, other: _Side, least: float, fewest: int, ties: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sets of ``own`` and larger ones (as large ones, with ``ties``) of ``other`` that may have ``least`` of them.

    Of a set's words, those that no set of ``other`` has are missing in all of
    them.  Of the rest as many as may be missing besides, and one more, have one
    in any set that has enough: the words that the fewest sets of ``other`` have.
    """
    if not len(own.codes) or not len(other.codes):
        return
    need = np.maximum(np.ceil(own.n * least - EPSILON).astype(np.int64), 1)
    at = np.minimum(np.searchsorted(other.codes, own.codes), len(other.codes) - 1)
    often = np.where(other.codes[at] == own.codes, other.often[at], 0)
    entry = np.flatnonzero(np.repeat(often > 0, own.often)).astype(np.int32)
    present = np.bincount(own.rows[entry], minlength=len(own.n))
    alive = (own.n >= fewest) & (present >= need)
    entry = entry[alive[own.rows[entry]]]
    word, row = np.repeat(np.arange(len(own.codes), dtype=np.int32), own.often)[entry], own.rows[entry]
    del entry
    order = np.argsort((row.astype(np.int64) << 32) | often[word])
    word, row = word[order], row[order]
    del order
    if not len(row):
        return
    _, place = _places(np.cumsum(np.concatenate([[0], row[1:] != row[:-1]])))
    some = place <= (present - need)[row]
    word, row = word[some], row[some]
    low, many = other.first[at[word]], often[word]
    ends, begin = np.cumsum(many), 0
    while begin < len(row):
        to = int(np.searchsorted(ends, ends[begin] - many[begin] + PAIRS_AT_ONCE // 10, "right"))
        to = int(np.searchsorted(row, row[min(max(to, begin + 1), len(row)) - 1], "right"))  # all words of a set, so that a pair comes once
        x = np.repeat(np.arange(begin, to), many[begin:to])
        y = other.rows[low[x] + np.arange(len(x)) + ends[begin] - many[begin] - (ends[x] - many[x])]
        x = row[x]
        near = own.n[x] < other.n[y] + ties
        x, y = x[near], y[near]
        apart = np.zeros(len(x), dtype=np.int64)
        for c, (mine, others) in enumerate(zip(own.signs, other.signs, strict=True)):
            apart += np.bitwise_count(mine[x] & ~others[y])
            if c % 2:
                near = apart <= (own.n - need)[x]
                x, y, apart = x[near], y[near], apart[near]
        pairs = np.unique((x.astype(np.int64) << 32) | y)
        if len(pairs):
            yield pairs >> 32, pairs & 0xFFFFFFFF
        begin = to


def _shares(before: pa.Array, after: pa.Array) -> np.ndarray:
    """Shared words over the smaller set of words, of each two texts."""
    row, word, _ = _coded(pa.concat_arrays([before, after]))
    row, word = _distinct(row, word)
    sizes = np.bincount(row, minlength=2 * len(before))
    both = np.sort(((row % len(before)) << 32) | word)
    shared = np.bincount(both[1:][both[1:] == both[:-1]] >> 32, minlength=len(before))
    return shared / np.maximum(np.minimum(sizes[: len(before)], sizes[len(before) :]), 1)


def overlap_pairs(sides: DataFrame, least: float, fewest: int) -> DataFrame:
    """(b, a, score, before_text, after_text) of every pair of sets of ``fewest`` words or more that shares ``least`` of the smaller set, and a word.

    ``sides`` has side (0: before, 1: after), i and text; it is read once.  Sets
    are packed in blocks with their texts, and every block of one side meets every
    block of the other: nothing but the blocks is written, and nothing travels.
    """
    tasks, most = 5 * sides.sparkSession.sparkContext.defaultParallelism, BLOCK
    rows = sides.select("side", F.col("i").cast("long").alias("i"), "text").coalesce(tasks)
    blocks = stored(rows.mapInArrow(lambda batches: _blocks(batches, most), "k long, b array<binary>, a array<binary>"))
    parts = max(1, blocks.select("k").count())

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = before = None
        for batch in batches:
            for at in range(batch.num_rows):
                if key != (k := batch.column("k")[at].as_py()):
                    key, before = k, _Side(batch.column("b")[at].as_py())
                after = _Side(batch.column("a")[at].as_py())
                for own, other, ties in ((before, after, True), (after, before, False)):
                    for x, y in _within(own, other, least, fewest, ties):
                        b, a = (x, y) if ties else (y, x)
                        for begin in range(0, len(b), TEXTS_AT_ONCE):
                            ids, texts = zip(*(side.texts(of[begin : begin + TEXTS_AT_ONCE]) for side, of in ((before, b), (after, a))), strict=True)
                            score = _shares(*texts)
                            found = pa.RecordBatch.from_arrays([*ids, pa.array(score), *texts], names=["b", "a", "score", "before_text", "after_text"])
                            yield found.filter(pa.array((score > 0) & (score >= least)))

    pairs = blocks.select("k", "b").coalesce(2 * parts).crossJoin(blocks.select("a").coalesce(2 * parts))
    return pairs.mapInArrow(met, "b long, a long, score double, before_text string, after_text string")


def both_sides(before: DataFrame, after: DataFrame) -> DataFrame:
    """(side, i, text) of two frames with i and text."""
    return before.select(F.lit(0).alias("side"), "i", "text").unionByName(after.select(F.lit(1).alias("side"), "i", "text"))


def overlap_candidates(before: DataFrame, after: DataFrame, least: float, fewest: int) -> DataFrame:
    """(b, a) of ``overlap_pairs``, long; frames have i and text."""
    return overlap_pairs(both_sides(before, after), least, fewest).select("b", "a")

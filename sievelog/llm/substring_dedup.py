"""Substring dedup by fixed-block anchors.

Reference blocks of ``block`` words that do not overlap (they start at
multiples of ``block``) are indexed, and rolling windows of ``block`` words
probe them.  A window of ``window >= 2 * block - 1`` words contains a whole
reference block wherever it starts, so a repeated window has a hit.  Of two
equal windows either can hold the block and the other the probe: with their
starts d places apart, the one probes at d modulo ``block``, the other at -d, so
probes at offsets up to ``block // 2`` from a block's start miss no pair and the
others are not sent.  Hits are extended: all windows that contain a hit are
compared with their earliest occurrence by 96 bits of hash (and the bucket), and
the repeated windows of a document, joined, are its maximal exact repeats.

Probes travel packed: a row per bucket and piece of input holds 32 bits of hash
for each probe of many documents, and only one entry of those that repeat within
the piece, so a window that a third of all documents share costs an entry per
piece.  Buckets follow the bytes of text (``bucket_bytes`` each), so the share of
accidental hits in a bucket stays about 1 in 2,000 at any size; such a hit costs an
extension and changes no result.  From 2 ** 16 buckets on (2 TB of text) buckets
grow with the input; a bucket has to fit a task.  Texts are exchanged once,
compressed, by document bucket, for both later passes.

Defined cases: words are ``[^\\x20\\x09-\\x0D]+``; null and empty texts have none;
texts shorter than a window lose nothing; rows sort by doc_id, nulls last; rows
that repeat a doc_id are rows of their own, in the order in which they are
stored; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ORD, with_order
from .textscan import CHUNK, U64, Words, ids_of, mix, ngrams, pieces, text_arrays

#: kind 0: entries to compare, 1: answers that pass through; the blobs are numpy arrays.
PACKED = "bucket int, kind int, docs binary, counts binary, hashes binary, extra binary, more binary"
_PACKED = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), *((x, pa.binary()) for x in ("docs", "counts", "hashes", "extra", "more"))])
ANSWERS = "bucket int, docs binary, hashes binary"
_ANSWERS = pa.schema([("bucket", pa.int32()), ("docs", pa.binary()), ("hashes", pa.binary())])
RESULT = "doc_id long, n_words long, n_removed long, removed array<struct<start: long, end: long>>, text string"


def home(ids: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a document."""
    return (mix(ids.astype(np.int64).view(U64) + U64(0x51)) % U64(buckets)).astype(np.int32)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and length of each run of equal neighbours."""
    if not len(keys):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return first, np.diff(np.append(first, len(keys)))


def _runs2(keys: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for pairs of keys."""
    if not len(keys):
        return _runs(keys)
    first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (more[1:] != more[:-1])]))
    return first, np.diff(np.append(first, len(keys)))


def _slices(buckets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    for at, n in zip(*_runs(buckets), strict=True):
        yield int(buckets[at]), int(at), int(at + n)


def _answer_rows(ids: np.ndarray, values: np.ndarray, buckets: int, kind: bool) -> list[tuple]:
    """Rows that carry (document, value) to the documents' buckets."""
    where = home(ids, buckets)
    order = np.argsort(where, kind="stable")
    ids, values, where = ids[order], values[order], where[order]
    out = []
    for bucket, a, b in _slices(where):
        blobs = (ids[a:b].tobytes(), values[a:b].astype(U64).tobytes())
        out.append((bucket, 1, blobs[0], b"", blobs[1], b"", b"") if kind else (bucket, *blobs))
    return out


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _rolling(words: Words, hashes: np.ndarray, n: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and word number of every n-word run in texts of at least ``least`` words."""
    docs = words.docs()
    grams = ngrams(hashes, n)
    count = np.diff(words.first)
    starts = np.flatnonzero((docs[: len(grams)] == docs[n - 1 :]) & (count[docs[: len(grams)]] >= least)) if len(grams) else np.empty(0, dtype=np.int64)
    return grams[starts], docs[starts], starts


def _prober(block: int, window: int, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = ids_of(batch.column(0))
            data, offsets = text_arrays(batch.column(1))
            for at, to, some, some_offsets in pieces(data, offsets, CHUNK << max(0, min(2, bits - 10))):
                words = Words(some, some_offsets)
                own = ids[at:to]
                grams, docs, starts = _rolling(words, words.hashes(), block, window)
                if not len(grams):
                    continue
                place = (starts - words.first[docs]) % block
                sent = place <= block // 2
                keys, docs, anchored = grams[sent] >> U64(32 - bits), docs[sent], place[sent] == 0
                order = np.argsort(keys, kind="stable")
                keys, docs, anchored = keys[order], docs[order], anchored[order]
                first, many = _runs(keys)
                known = (many > 1) & np.logical_or.reduceat(anchored, first)
                inside = np.repeat(known, many)
                rows = _answer_rows(own[docs[inside]], keys[inside], 1 << bits, True)
                anchored[first[known]] = True  # the one entry stands for all
                keep = ~inside
                keep[first[known]] = True
                keys, docs, anchored = keys[keep], docs[keep], anchored[keep]
                bucket = (keys >> U64(32)).astype(np.int32)
                order = np.lexsort((docs, bucket))
                keys, docs, anchored, bucket = keys[order].astype(np.uint32), docs[order], anchored[order], bucket[order]
                for b, i, j in _slices(bucket):
                    head, count = _runs(docs[i:j])
                    rows.append((b, 0, own[docs[i:j][head]].tobytes(), count.astype(np.uint32).tobytes(), keys[i:j].tobytes(), np.packbits(anchored[i:j]).tobytes(), b""))
                yield _batch(rows, _PACKED)

    return probe


def _entries(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
    """Ids and hashes of the entries; rows of the answers that pass."""
    kinds = table.column("kind").to_pylist()
    docs, counts, hashes = (table.column(x).to_pylist() for x in ("docs", "counts", "hashes"))
    passed = [(table.column("bucket")[i].as_py(), docs[i], hashes[i]) for i, k in enumerate(kinds) if k]
    ids = [np.repeat(np.frombuffer(docs[i], dtype=np.int64), np.frombuffer(counts[i], dtype=np.uint32)) for i, k in enumerate(kinds) if not k]
    return np.concatenate(ids) if ids else np.empty(0, dtype=np.int64), [hashes[i] for i, k in enumerate(kinds) if not k], passed


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_batch(rows, _ANSWERS)]) if rows else _ANSWERS.empty_table()


def _matcher(bits: int) -> Callable[[pa.Table], pa.Table]:
    """Entries whose hash another entry has too, one of them a reference block."""

    def match(table: pa.Table) -> pa.Table:
        ids, blobs, rows = _entries(table)
        if len(ids):
            bucket = table.column("bucket")[0].as_py()
            keys = np.concatenate([np.frombuffer(b, dtype=np.uint32) for b in blobs])
            flags = [np.unpackbits(np.frombuffer(e, dtype=np.uint8))[: len(b) // 4] for e, b in zip((e for e, k in zip(table.column("extra").to_pylist(), table.column("kind").to_pylist(), strict=True) if not k), blobs, strict=True)]
            anchored = np.concatenate(flags).astype(bool)
            order = np.argsort(keys, kind="stable")
            keys, anchored, ids = keys[order], anchored[order], ids[order]
            first, many = _runs(keys)
            hit = np.repeat((many > 1) & np.logical_or.reduceat(anchored, first), many)
            full = keys[hit].astype(U64) | (U64(bucket) << U64(32))
            rows += _answer_rows(ids[hit], full, 1 << bits, False)
        return _table(rows)

    return match


def _answers_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = b"".join(table.column("docs").to_pylist())
    return np.frombuffer(ids, dtype=np.int64), np.frombuffer(b"".join(table.column("hashes").to_pylist()), dtype=U64)


def _pair_keys(ids: np.ndarray, values: np.ndarray) -> np.ndarray:
    return mix(mix(ids.view(U64) + U64(0x77)) + values)


def _unpacked(texts: pa.Table) -> list[bytes]:
    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(t) for t in texts.column("packed").to_pylist()]


def _extender(block: int, window: int, bits: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Windows that contain a hit, packed to the bucket of their smallest rolling hash, which neighbours mostly share."""

    def extend(texts: pa.Table, answers: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if not texts.num_rows or not answers.num_rows:
            return _PACKED.empty_table()
        hits = np.unique(_pair_keys(*_answers_of(answers)))
        ids = ids_of(texts.column(ORD).combine_chunks())
        data, offsets = text_arrays(pa.array(_unpacked(texts), pa.large_binary()))
        found = []
        for at, to, some, some_offsets in pieces(data, offsets):
            words = Words(some, some_offsets)
            hashes, own = words.hashes(), ids[at:to]
            grams, docs, starts = _rolling(words, hashes, block, window)
            if not len(grams):
                continue
            keys = _pair_keys(own[docs], grams >> U64(32 - bits))
            near = hits[np.minimum(np.searchsorted(hits, keys), len(hits) - 1)] == keys
            reach = np.zeros(len(hashes) + 1, dtype=np.int64)
            reach[1:] = np.cumsum(np.bincount(starts[near], minlength=len(hashes)))
            wide, wide_docs, wide_starts = _rolling(words, hashes, window, window)
            candidate = reach[wide_starts + window - block + 1] > reach[wide_starts]
            if not candidate.any():
                continue
            smallest = np.full(len(hashes), np.iinfo(np.uint64).max, dtype=U64)
            smallest[starts] = grams
            low = smallest[wide_starts[candidate]].copy()
            for k in range(1, window - block + 1):
                np.minimum(low, smallest[wide_starts[candidate] + k], out=low)
            d = wide_docs[candidate]
            more = (ngrams(hashes, window, 1)[wide_starts[candidate]] >> U64(32)).astype(np.uint32)
            found.append((own[d], (wide_starts[candidate] - words.first[d]).astype(np.int64), wide[candidate], more, (mix(low) >> U64(64 - bits)).astype(np.int32)))
        if not found:
            return _PACKED.empty_table()
        doc, start, value, more, bucket = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((start, doc, more, value))
        doc, start, value, more, bucket = doc[order], start[order], value[order], more[order], bucket[order]
        first, many = _runs2(value, more)
        lead = np.repeat(first, many)
        later = (doc != doc[lead]) | (start != start[lead])  # repeated within this group already
        rows += _answer_rows(doc[later], start[later], 1 << bits, True)
        order = first[np.lexsort((start[first], doc[first], bucket[first]))]
        doc, start, value, more, bucket = doc[order], start[order], value[order], more[order], bucket[order]
        for b, i, j in _slices(bucket):
            d, s = doc[i:j], start[i:j]
            heads = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (s[1:] != s[:-1] + 1)]))
            count = np.diff(np.append(heads, j - i)).astype(np.uint32)
            rows.append((b, 0, d[heads].tobytes(), count.tobytes(), value[i:j].tobytes(), s[heads].astype(np.uint32).tobytes(), more[i:j].tobytes()))
        return pa.Table.from_batches([_batch(rows, _PACKED)])

    return extend


def _judge(bits: int) -> Callable[[pa.Table], pa.Table]:
    """Starts of the windows that occur earlier too."""

    def judge(table: pa.Table) -> pa.Table:
        ids, blobs, rows = _entries(table)
        if len(ids):
            value = np.concatenate([np.frombuffer(b, dtype=U64) for b in blobs])
            starts = []
            for kind, extra, counts in zip(*(table.column(x).to_pylist() for x in ("kind", "extra", "counts")), strict=True):
                if not kind:
                    count = np.frombuffer(counts, dtype=np.uint32).astype(np.int64)
                    first = np.cumsum(count) - count
                    starts.append(np.repeat(np.frombuffer(extra, dtype=np.uint32).astype(np.int64) - first, count) + np.arange(count.sum()))
            start = np.concatenate(starts)
            more = np.frombuffer(b"".join(table.column("more").to_pylist()), dtype=np.uint32)
            order = np.lexsort((start, ids, more, value))
            ids, start, value, more = ids[order], start[order], value[order], more[order]
            first, many = _runs2(value, more)
            lead = np.repeat(first, many)
            later = (ids != ids[lead]) | (start != start[lead])
            rows += _answer_rows(ids[later], start[later], 1 << bits, False)
        return _table(rows)

    return judge


def _remover(window: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Texts without the words of their repeated windows."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", span), ("text", pa.string())])

    def remove(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return schema.empty_table()
        ids = ids_of(texts.column(ORD).combine_chunks())
        owner, starts = _answers_of(answers)
        order = np.lexsort((starts, owner))
        owner, starts = owner[order], starts[order].astype(np.int64)
        low, high = np.searchsorted(owner, ids), np.searchsorted(owner, ids, side="right")
        n_words, n_removed, removed, kept = [], [], [], []
        for i, text in enumerate(_unpacked(texts)):
            words = text.split()
            n_words.append(len(words))
            if low[i] == high[i]:
                n_removed.append(0)
                removed.append([])
                kept.append(b" ".join(words).decode())
                continue
            begin = starts[low[i] : high[i]]
            gone = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(gone, begin, 1)
            np.add.at(gone, np.minimum(begin + window, len(words)), -1)
            gone = np.cumsum(gone[:-1]) > 0
            n_removed.append(int(gone.sum()))
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
            removed.append([{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)])
            kept.append(b" ".join([words[k] for k in np.flatnonzero(~gone)]).decode())
        return pa.table([texts.column("doc_id").cast(pa.int64()), pa.array(n_words), pa.array(n_removed), pa.array(removed, span), pa.array(kept, pa.string())], schema=schema)

    return remove


def dedup_substrings(
    docs: DataFrame, *, window: int = 20, block: int = 10, bits: int | None = None, bucket_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, removed (word ranges), text (the words that stay, one space between).

    A word goes if it lies in a window of ``window`` words whose sequence also
    starts earlier: in a row before, or earlier in its own.  There are
    ``2 ** bits`` buckets of hashes and of documents, of ``bucket_bytes`` of
    text each unless given.
    """
    if window < 2 * block - 1:
        raise ValueError("a window has to contain a whole reference block: window >= 2 * block - 1")
    base, _ = with_order(docs, id_col, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if bits is None:
        total = base.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        bits = max(6, (2 * tasks - 1).bit_length() if tasks <= 512 else 10, min(16, (total // bucket_bytes).bit_length()))
    # the bucket of a document, as home() has it
    homes = base.select(ORD, "doc_id", "text").mapInArrow(_homes(bits), f"bucket int, {ORD} long, doc_id long, packed binary")
    hits = base.select(ORD, "text").mapInArrow(_prober(block, window, bits), PACKED).groupBy("bucket").applyInArrow(_matcher(bits), ANSWERS)
    windows = homes.groupBy("bucket").cogroup(hits.groupBy("bucket")).applyInArrow(_extender(block, window, bits), PACKED)
    later = windows.groupBy("bucket").applyInArrow(_judge(bits), ANSWERS)
    return homes.groupBy("bucket").cogroup(later.groupBy("bucket")).applyInArrow(_remover(window), RESULT)


def _homes(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            bucket = pa.array(home(ids_of(batch.column(0)), 1 << bits), pa.int32())
            packed = pa.array([pack((t or "").encode()) for t in batch.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([bucket, batch.column(0), batch.column(1), packed], names=["bucket", ORD, "doc_id", "packed"])

    return run
